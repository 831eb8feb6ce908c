"""Operators 3, 5 and 7 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from pagelake.llm import common, graph, near_copies, repeats, simhash, substrings, suffixes
from pagelake.llm.graph import components
from pagelake.llm.seeds import Shape

SCHEMA = "doc_id long, text string, lang string, doc string, seed string, at string, hull string, fp string, root string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 49, 50, 51, 70, 160)]
    texts = [None, "", " \n ", "one", "Same text here", "Same text here", "a " * 400, "b" * 900, "x" * 199, "x" * 200, "é" * 300]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 30)))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [t.replace("a", "e", 1) for t in texts[-15:]] + texts[-9:]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    out = list(zip(ids, texts, strict=True))
    return [*out, out[20], out[30]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "1", None, "h", "f", "r") for i, t in rows], SCHEMA).repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("shape", [substrings.SHAPE, Shape(window=10, k=3)])
def test_substrings(docs, rows, shape):
    first = {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - shape.window + 1):
            first.setdefault(tuple(w[k : k + shape.window]), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - shape.window + 1):
            if first[tuple(w[k : k + shape.window])] < i:
                gone[k : k + shape.window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(docs, shape).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 100


@pytest.mark.parametrize("shape", [suffixes.SHAPE, Shape(window=40, k=9, part=5)])
def test_suffixes(docs, rows, shape):
    n = shape.window
    seen = Counter(raw[k : k + n] for raw in ((t or "").encode() for _, t in rows) for k in range(len(raw) - n + 1))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.remove_repeats(docs, shape).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 100


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_rolling_hashes_decide_nothing(spark):
    """Words and passages whose polynomial hashes modulo 2^64 collide are still told apart."""
    filler = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, f"{filler(0)} {one}"), (2, f"{filler(0)} {two}"), (3, f"{filler(1)} {one} {filler(2)}"), (4, f"{filler(1)} {two} {filler(2)}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 60, 3: 0, 4: 120}
    ends = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    raw = [one.encode(), two.encode()]
    seen = Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    want = {}
    for i, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want[i + 1] = int(gone.sum())
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(ends).collect()} == want


def test_repeated_rows_of_suffixes(spark):
    text = " ".join(f"word{i}" for i in range(90))[:400]
    for ids in ((7, 7), (7, 8), (None, None), (None, 7)):
        d = spark.createDataFrame([(i, text) for i in ids] + [(9, "other")], "doc_id long, text string")
        assert sorted(r["n_removed"] for r in suffixes.remove_repeats(d).collect()) == [0, 400, 400], ids


def test_large_seeds(spark, docs, rows, monkeypatch):
    """The ways for large seeds and classes give what the others give."""
    narrow = Shape(window=40, k=9, part=5)
    ask = lambda: [sorted(tuple(r) for r in f(docs, s).collect()) for f, s in ((suffixes.remove_repeats, narrow), (substrings.remove_repeats, Shape(window=10, k=3)))]
    want = ask()
    monkeypatch.setattr(repeats, "LARGE", 2)
    assert ask() == want


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(90))
    d = spark.createDataFrame([(None, text), (1, text), (2, text + " end")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(d).collect()} == {None: 0, 1: 0, 2: 90}
    assert all(r["n_removed"] > 0 for r in suffixes.remove_repeats(d).collect())
    assert {r["component_id"] for r in simhash.near_duplicates(d).filter("doc_id is null or doc_id = 1").collect()} == {1}


def test_empty_tables(docs):
    none = docs.filter("false")
    assert substrings.remove_repeats(none).count() == suffixes.remove_repeats(none).count() == simhash.near_duplicates(none).count() == 0


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        low[g] = min(i, low.get(g, i))
    want = sorted((i, p - (1 << 64) if p >> 63 else p, low[g]) for (i, _), p, g in zip(rows, prints, group, strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()) == want


def test_links_of_random_prints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r["fp"]: r["root"] for r in simhash._links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), 4).collect()}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                assert got[signed(a)] == got[signed(b)]
    assert len(set(got.values())) > 20


def test_components_of_a_path(spark):
    n = 200
    links = spark.range(n).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1, n + 1), 0), 901: 900}


def shingle_set(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def groups_of(rows):
    """The smallest id of each row's component of five-word similarity 0.8, by comparing all pairs."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        low[g] = min(i, low.get(g, i))
    return [low[g] for g in group]


@pytest.fixture(scope="module")
def edited():
    """Texts with copies of 1 to 12 edited words, some over a chain of edits, and one line that all share."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [None, "", "one", "One", "two words"]
    for n in (6, 20, 60, 120, 200, 300):
        base = "the line that all of these texts share".split() + [word() for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 6, 9, 12):
            w = list(base)
            for at in rng.sample(range(len(w)), min(edits, len(w))):
                w[at] = word()
            texts.append(" ".join(w))
            base = w if rng.random() < 0.3 else base
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_near_copies(spark, edited, rows):
    for some in (edited, rows):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        want = sorted((i, g) for (i, _), g in zip(some, groups_of(some), strict=True))
        assert sorted(tuple(r) for r in near_copies.near_copies(docs).collect()) == want
    assert near_copies.near_copies(docs.filter("false")).count() == 0


def test_stage_drops_edited_copies(spark, edited):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in edited], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(set(groups_of(edited)))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want and len(want) < len(edited) - 10


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    for n, m, both in ((0, 0, 0), (1, 1, 0), (1, 3, 1), (9, 10, 9), (70, 60, 58), (500, 40, 40), (3000, 3100, 2900), (300, 300, 20)):
        some = rng.integers(0, 2**63, n + m - both, np.uint64)
        a, b = some[:n], some[n - both :]
        least = near_copies.differ(near_copies.sketch(a), near_copies.sketch(b))
        assert least == near_copies.differ(near_copies.sketch(b), near_copies.sketch(a)) and least <= n + m - 2 * both
    assert least * 180 > 20 * (n + m)


def test_unlike_pairs_go_before_texts_are_read(spark):
    """Texts that share a line of words, but little else, meet in its cells."""
    rng = random.Random(3)
    line = " ".join(f"w{i}" for i in range(30))
    sets = [near_copies.grams(line + " " + " ".join(str(rng.random()) for _ in range(90))) for _ in range(20)]
    sets.append(np.unique(np.append(sets[0][2:], np.uint64(1))))
    sketches = spark.createDataFrame([(i, len(g), bytearray(near_copies.sketch(g))) for i, g in enumerate(sets)], "key long, n int, sketch binary")
    pairs = spark.createDataFrame([(a, b) for a in range(21) for b in range(a)], "a long, b long")
    assert [tuple(r) for r in near_copies._sketched(pairs, sketches, 80).collect()] == [(20, 0)]


def test_simhash_links_of_the_stage_are_checked(spark):
    """Of sets within four bits of another those that pass the check are linked, over several steps too; sets further apart are not asked."""
    prints = [(1, 0b1), (2, 0b111), (3, 0b111), (4, 0b1111111), (5, (1 << 40) - 1), (6, (1 << 40) - 2)]
    sketches = spark.createDataFrame(prints, "key long, fp long")
    asked = []

    def verified(pairs):
        asked.extend(tuple(sorted((r["a"], r["b"]))) for r in pairs.collect())
        return pairs.filter("a + b <> 11")

    links = {frozenset((r["a"], r["b"])) for r in near_copies._within_bits(sketches, verified).collect()}
    of = near_copies.components(spark.createDataFrame([tuple(p) for p in links], "a long, b long"))
    assert {r["node"]: r["root"] for r in of.collect()} == {2: 1, 3: 1, 4: 1}
    assert (5, 6) in asked and not {(a, b) for a, b in asked if a < 5 <= b}


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    docs, sizes, before = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1), [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def common(source, *_):
        sizes.extend(r["n"] for r in source.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect())
        return np.zeros(0, np.uint64)

    monkeypatch.setattr(near_copies, "_common", common)
    assert near_copies.near_copies(docs).count() == 3000
    assert sum(sizes) == 3000 and max(sizes) <= 500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_exploded_cells_are_not_broadcast(spark, monkeypatch):
    """Spark sizes cells like the rows they come from, so within its bound they can be many times as large as the driver's memory."""
    plans = []
    for m in (simhash, near_copies, graph):
        monkeypatch.setattr(m, "materialise", lambda df, f=m.materialise: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "x y")], "doc_id long, text string")
    simhash._links(spark.createDataFrame([(1,), (3,), (-1,)], "fp long"))
    near_copies.near_copies(docs)
    exploded = [p for p in plans if re.search(r"Generate (explode\((array_compact|concat|array)|posexplode)\(.*cell#", p) and "Join [cell#" in p]
    assert len(exploded) >= 3 and not [p for p in exploded if "BroadcastHashJoin [cell#" in p]


def test_broadcasts_are_measured(spark):
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(guessed)
    try:
        for given, want in ((before, "1048576"), ("256k", "262144"), ("-1", "-1")):
            spark.conf.set(guessed, given)
            with common.measured_broadcasts(spark), common.measured_broadcasts(spark):
                assert spark.conf.get(guessed) == want and spark.conf.get(measured) == str({"256k": 262144}.get(given, given.rstrip("b")))
            assert spark.conf.get(guessed) == given and not spark.conf.get(measured, None)
    finally:
        spark.conf.set(guessed, before)
