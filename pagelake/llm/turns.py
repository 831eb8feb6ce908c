"""Conversation structure repair (operator 13).

A conversation's edits are a path through a small graph: layers are its rows,
states say what stands before (nothing, a system row, a user, an assistant).
The weight of a path is one integer. Its high digits are the cost; below them
stand the letters of the edits, one digit each from the left, and zeros to the
end. So the least integer is the cheapest repair and, among equals, the one
whose letters come first. Put before a path, a letter takes the first place and
moves the others on by one.

Rows are sorted over the whole table by conversation and turn, so a long
conversation is read by several tasks, which hand on one letter a row. Blocks
of letters are solved for each state they can end in and then joined, which
keeps the integers short. Only the last pass, a hash of the repaired text in
order, has to see a conversation's texts in one task; it streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: What stands before a row, and where a role's initial leads from there.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an inserted or new-named row gets, and where it leads.
FILL = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4  # digits, in the order of their letters
LETTERS = " DIKR"
INITIALS, FAULTS = "sua-", "ktdb"
BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 512
SUMS = ("blank", "duplicate", "truncated", "illegal")


def code(initial: str, fault: str) -> str:
    """One letter for a row: its role's initial and its fault (k: none)."""
    return chr(97 + 4 * INITIALS.index(initial) + FAULTS.index(fault))


CODES = {code(i, f): (i, f) for i in INITIALS for f in FAULTS}


def _weights(codes: str, ends: tuple[int, ...]) -> tuple[list[int | None], int]:
    """For each state before the rows the least weight of a path to one of `ends`; the bits below the cost."""
    bits = 3 * (3 * len(codes) + 3)  # at most two rows are put in at a place
    first, low = bits - 3, (1 << bits) - 1

    def put(path: int | None, cost: int, letter: int) -> int | None:
        if path is None:
            return None
        letters = path & low
        return path - letters + (cost << bits) + (letter << first) + (letters >> 3)

    def least(*paths: int | None) -> int | None:
        return min((p for p in paths if p is not None), default=None)

    def filled(paths: list[int | None]) -> list[int | None]:
        out = paths
        for _ in range(2):
            out = [least(paths[s], put(out[FILL[s]], 3, INSERT)) for s in range(4)]
        return out

    paths = filled([0 if s in ends else None for s in range(4)])
    for letter in reversed(codes):
        initial, fault = CODES[letter]
        more = 3 if fault == "t" else 0
        here = []
        for s in range(4):
            options = [put(paths[s], 4, DELETE)]
            if fault in "kt":
                options.append(put(paths[FILL[s]], 3 + more, REROLE))
                if initial in STEP[s]:
                    options.append(put(paths[STEP[s][initial]], more, KEEP))
            here.append(least(*options))
        paths = filled(here)
    return paths, bits


def _read(weight: int, bits: int) -> tuple[int, str]:
    digits = f"{weight & ((1 << bits) - 1):0{bits // 3}o}".rstrip("0")
    return weight >> bits, "".join(LETTERS[int(d)] for d in digits)


@lru_cache(maxsize=1 << 14)
def _solved(codes: str, ends: tuple[int, ...]) -> tuple[tuple[int, str] | None, ...]:
    paths, bits = _weights(codes, ends)
    return tuple(None if p is None else _read(p, bits) for p in paths)


def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation's rows; audit least among equals.

    Blocks come from the back. Two ways of equal cost over the same rows, from
    one state to another, never begin with each other (the longer one would
    only add insertions, which cost), so what is least within a block is least
    with any rest.
    """
    starts = range(0, len(codes), BLOCK)
    if len(starts) < 2:
        return _solved(codes, ENDS)[START]
    rest = _solved(codes[starts[-1] :], ENDS)
    for at in reversed(starts[:-1]):
        to = [_solved(codes[at : at + BLOCK], (e,)) for e in range(4)]
        rest = [min(((to[e][s][0] + rest[e][0], to[e][s][1] + rest[e][1]) for e in range(4) if to[e][s] and rest[e]), default=None) for s in range(4)]
    return rest[START]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of the rows that the damage leaves; nulls of role and text are one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(say("conv_id"), F.lit(":"), say("turn")), "utf-8")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), say("role").alias("role"), say("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def _in_order(turn: Column) -> Column:
    return F.struct(turn.isNotNull(), turn)


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one (n of them), with the role's initial and the first one's fault."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("n")).withColumn("said", F.md5("text"))
    first = same.groupBy("conv_id", "role", "said").agg(F.min(_in_order(F.col("turn"))).alias("first")).toDF("c", "r", "s", "first")
    joined = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "b").when(_in_order(F.col("turn")) != F.col("first"), "d").when(end.isin(".", "!", "?"), "k").otherwise("t")
    initial = F.substring("role", 1, 1)
    return joined.select("conv_id", "turn", "role", "text", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault"))


def _letters(key: T.DataType):
    """Of sorted rows: (conv_id, part, seq, codes, turns, first, last), a conversation's rows in pieces of bounded length."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = (to_arrow_type(key), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["conv_id", "part", "seq", "codes", "turns", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, open_ = TaskContext.get().partitionId(), 0, None
        size = 0
        for b in batches:
            out = []

            def close(done: list | None, out: list = out) -> None:
                nonlocal seq
                if done is not None:
                    out.append((done[0], part, seq, "".join(done[1]), *done[2:]))
                    seq += 1

            for conv, turn, n, initial, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_ is None or conv != open_[0] or size >= 1 << 16:
                    close(open_)
                    open_, size = [conv, [], 0, None, None], 0
                open_[1].append(code(initial, fault) + code(initial, "b" if fault == "b" else "d") * (n - 1))
                size += n
                if turn is not None and turn != open_[4]:
                    open_[2] += 1
                    open_[3] = turn if open_[3] is None else open_[3]
                    open_[4] = turn
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if open_ is not None:
            last = (open_[0], part, seq, "".join(open_[1]), *open_[2:])
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds, strict=True)], names=names)

    return run


def _gaps(pieces: list[dict]) -> int:
    known = [p for p in pieces if p["first"] is not None]
    if not known:
        return 0
    turns = sum(p["turns"] for p in known) - sum(a["last"] == b["first"] for a, b in zip(known, known[1:], strict=False))
    return known[-1]["last"] - known[0]["first"] + 1 - turns


def _plan(pieces: list[dict]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation from its pieces in order."""
    codes = "".join(p["codes"] for p in pieces)
    found = {c: codes.count(c) for c in set(codes)}
    of = lambda fault: sum(n for c, n in found.items() if CODES[c][1] == fault)
    roles = codes.translate({ord(c): i for c, (i, _) in CODES.items()})
    legal = sum(roles[i : i + 2] in ("su", "ua", "au") for i in range(len(roles) - 1))
    return _gaps(pieces), of("b"), of("d"), of("t"), max(0, len(roles) - 1) - legal, *repair(codes)


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_plan(pieces.as_py()) for pieces in b.column("pieces")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *arrays], names=["conv_id", "gaps", *SUMS, "cost", "audit"])


class _Repaired:
    """The text of a repaired conversation, hashed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + role + ":").encode())
        self.hash.update(text.encode())
        self.any = True

    def fill(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = FILL[self.state], self.at + 1
            self._say(NAMES[self.state], "")

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.fill()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = STEP[self.state][role[:1]]
                self._say(role, text)
            elif letter == "R":
                self.state = FILL[self.state]
                self._say(NAMES[self.state], text)


def _hashes(key: T.DataType):
    """Of a conversation's plan and then its rows in order: the plan and the hash of what is repaired."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = (to_arrow_type(key), *[pa.int64()] * 6, pa.string(), pa.string())
    names = ["conv_id", "gaps", *SUMS, "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = state = None

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        def done() -> list:
            if plan is None:
                return []
            state.fill()
            return [(*plan, state.hash.hexdigest())]

        for b in batches:
            out = []
            for is_row, conv, role, text, n, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if is_row:
                    state.row(role, text, n)
                else:
                    out += done()
                    plan, state = (conv, *own.values()), _Repaired(own["audit"])
            yield batch(out)
        yield batch(done())

    return run


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for every conv_id, null too.

    The rows are damaged first (see damaged()). A conversation's rows go by
    turn, nulls first; rows of one turn by role and text, repeated ones side by
    side, the second a duplicate of the first. A null role or text is one
    space, so such a text is blank. A role whose initial isn't s, u or a can't
    be kept as it is. A conversation that lost all its rows has zeros, an empty
    audit and the hash of the empty string. An empty table gives no rows.
    Other columns are not read.
    """
    table = conversations.select("conv_id", "turn", "role", "text")
    key = table.schema["conv_id"].dataType
    rows = materialise(_faults(damaged(table)))
    parts = max(8, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    head = F.substring("text", 1, 32)  # ranges are told apart by short values; within one the whole text counts
    ordered = rows.repartitionByRange(parts, "conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")
    piece = "part int, seq long, codes string, turns long, first long, last long"
    schema = T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string(piece).fields])
    pieces = ordered.select("conv_id", "turn", "n", "initial", "fault").mapInArrow(_letters(key), schema)
    every = table.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("codes"), F.lit(0).cast("long").alias("turns"), *[F.lit(None).cast("long").alias(c) for c in ("first", "last")])
    # A letter a row and a few numbers a piece, as long as the audit that comes of them.
    together = pieces.unionByName(every).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "codes", "turns", "first", "last"))).alias("pieces"))
    numbers = ", ".join(f"{c} long" for c in ("gaps", *SUMS, "cost"))
    plan = T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string(f"{numbers}, audit string").fields])
    plans = together.mapInArrow(_plans, plan)
    own = F.struct("gaps", *SUMS, "cost", "audit").alias("own")
    none = lambda kind: F.lit(None).cast(kind)
    first = plans.select(F.lit(False).alias("is_row"), "conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("n"), own)
    then = rows.select(F.lit(True).alias("is_row"), "conv_id", "turn", "role", "text", "n", F.lit(None).cast(first.schema["own"].dataType).alias("own"))
    stream = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "text")
    result = T.StructType([*plan.fields, T.StructField("repaired_sha256", T.StringType())])
    return stream.select("is_row", "conv_id", "role", "text", "n", "own").mapInArrow(_hashes(key), result)
