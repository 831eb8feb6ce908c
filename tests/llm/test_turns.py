"""Operator 13 against all edits of short conversations, and its passes against a plain one."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from pagelake.llm import turns

WS = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, audit) by trying everything; rows: (role, text, fault)."""
    best = None
    fills = [()] + [(a,) for a in "ua"] + list(itertools.product("ua", repeat=2))
    for edits in itertools.product("DKUA", repeat=len(rows)):
        if any(e != "D" and f in ("b", "d") for e, (_, _, f) in zip(edits, rows, strict=True)):
            continue
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for a in gaps[i]:
                    cost, audit = cost + 3, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[a], ""))
                if i == len(rows):
                    break
                e, (role, text, fault) = edits[i], rows[i]
                cost += {"D": 4, "K": 0}.get(e, 3) + (3 if fault == "t" and e != "D" else 0)
                audit += {"U": "R", "A": "R"}.get(e, e)
                if e != "D":
                    out.append(({"K": role, "U": "user", "A": "assistant"}[e], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_repair_is_least_of_all_edits(n):
    for kinds in itertools.product(itertools.product("sua-", "ktb"), repeat=n):
        if n == 3 and zlib.crc32(str(kinds).encode()) % 90:
            continue
        rows = [({"s": "system", "u": "user", "a": "assistant", "-": "tool"}[i], "x", f) for i, f in kinds]
        assert turns.repair("".join(turns.code(i, f) for i, f in kinds)) == brute(rows)


def test_blocks_give_what_the_whole_gives(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(turns.code(rng.choice("ssuuuaaaa-"), rng.choice("kkkktdb")) for _ in range(rng.randint(5, 40)))
        monkeypatch.setattr(turns, "BLOCK", 512)
        whole = turns.repair(codes)
        for size in (1, 3, 7):
            monkeypatch.setattr(turns, "BLOCK", size)
            assert turns.repair(codes) == whole


def plain(table):
    """The contract, row by row; edits by turns.repair, which is held against all edits above."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind, rows = zlib.crc32(key.encode()) % 20, convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(WS)[-1:]
            faults.append("b" if not end else "d" if (role, text) in seen else "k" if end in ".!?" else "t")
            seen.add((role, text))
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in rows]
        cost, audit = turns.repair("".join(map(turns.code, initials, faults)))
        lines, state, at = [], "", 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else rows[at][1:]
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:{text}")
            state = role[:1]
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, first long, part string, own string, n string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut", " ", "", None, "é? ", "line\n.", "long " * 5000 + ".", "x\x0b"]
    table = []
    for conv in [None, *range(60)]:
        for turn in [*range(rng.randint(0, 7)), *[None] * rng.randint(0, 1), *[9] * rng.randint(0, 2)]:
            table.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    table += [(77, t % 500, ("user", "assistant")[t % 2], f"t{t % 300}.") for t in range(900)]  # a hot conversation with ties
    table += table[:40] + table[10:20]
    df = spark.createDataFrame([(*r, 1, "p", "o", "n") for r in table], SCHEMA).repartition(4)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turns.repair_conversations(df).collect()}
    assert got == plain(table)


def test_no_rows(spark):
    assert turns.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = turns.repair_conversations(spark.createDataFrame([(dropped, 0, "user", "Hi.", 1, "", "", "")], SCHEMA)).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = plain([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turns.repair_conversations(df).collect()} == want
