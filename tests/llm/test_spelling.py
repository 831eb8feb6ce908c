"""Operator 11 against comparing all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pagelake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, part string, id string, root string"


def brute(rows):
    """(word, form, root, n, n_near, form_n) by the contract's words; near words through all one-letter deletions."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    without = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :]].add(w)

    def near(w):
        found = {v for i in range(len(w)) for v in without[w[:i] + w[i + 1 :]] | ({w[:i] + w[i + 1 :]} & words.keys())} | without[w]
        return {v for v in found if v != w and (len(v) != len(w) or sum(a != b for a, b in zip(v, w, strict=True)) == 1)}

    form, near_n = {}, {}
    for w, n in words.items():
        others = near(w)
        near_n[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near_n[w], words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    letters = "abÀé÷ÿz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "abababab", "bababab", "x" * 4000, "x" * 3999 + "y", "x" * 3999]
    words = []
    for w in base:
        words += [w] * rng.randint(3, 40)
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words += [rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]])] * rng.randint(1, 12)
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (500, ""), (501, "1234 ,;"), (502, texts[1].upper()), (503, "łódź ααα Łaaaa aaaaa日aaaaa")]
    return [*out, out[2], out[2], (600, " ".join(["Hotword"] * 5000 + ["Hotwords"] * 7))]


def test_variants(spark, rows):
    df = spark.createDataFrame([(i, t, "w", 1, "p", "i", "r") for i, t in rows], SCHEMA).repartition(6)
    assert rows_of(spelling.variants(df)) == brute(rows)


def test_small_batches_and_many_ranges(spark, rows):
    df = spark.createDataFrame([(i, t, "w", 1, "p", "i", "r") for i, t in rows], SCHEMA).repartition(3)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "7"), ("spark.sql.shuffle.partitions", "23"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        assert rows_of(spelling.variants(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "one two", "", 1, "", "", "")], SCHEMA)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert len(want) > 500 and sum(r[1] is not None for r in want) > 50
    assert rows_of(spelling.variants(df)) == want
