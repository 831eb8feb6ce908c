"""Operators 2, 4, 6, 8, 9 and the pipeline."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagelake.llm import language_id, mixing, queries, sharding, syncmers, topk
from pagelake.llm.common import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "two words"), (5, "12 34 !!"), (6, "Same here, the same."), (7, "Same here, the same."), (8, "long " * 20000), (9, "中文文本沒有空格也可以"), (None, "no id here"), (7, "Same here, the same.")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def clash(df):
    names = ["id", "twin", "anchors", "place", "next", "size", "shard", "slot", "score", "lang_pred", "rate", "copies", "p_clean", "crc", "words", "head"]
    return df.withColumns({n: F.lit("x") for n in names})


def test_fingerprints(spark, odd):
    got = syncmers.compare_with_edits(clash(odd)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    texts = [""] + [t or "" for t in (r["text"] for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect())]
    order = [None, *range(10)]
    texts[0] = "no id here"
    for k, i in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(order)]
        f = len(t) // 4
        edited = t[: len(t) - f] + after[:f]
        assert (by[i]["n_chars"], by[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= by[i]["near_edited"] <= 1 and 0 <= by[i]["near_next"] <= 1
    assert by[6]["fingerprint"] == by[7]["fingerprint"] != by[4]["fingerprint"] and by[6]["near_next"] == 1.0
    assert syncmers.compare_with_edits(odd.filter("false")).count() == 0


def xx(values):
    """Spark's xxhash64 of longs: each hashes with the one before as its seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    """(hash, position) of closed syncmers, from their definition."""
    h = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(text, text[1:], strict=False)]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    span = 2
    while span < s:
        h = [xx((h[i], h[i + span])) for i in range(len(h) - span)]
        span *= 2
    out = []
    for i in range(len(text) - k + 1):
        inner = h[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((xx((inner[0], inner[-1])) % (1 << 64) >> 33, i))
    return out


def test_syncmers_by_definition(spark):
    rng = random.Random(1)
    texts = ["", "short", "exactly fifteen", "a" * 60, "".join(rng.choice("abcdeé 中😀") for _ in range(400)), "x" * 14]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in syncmers.with_anchors(df, "text", "a").collect():
        assert [(x >> 32, x & 0xFFFFFFFF) for x in r["a"]] == brute_anchors(r["text"]), r["text"]
    part = len(brute_anchors(texts[4])) / 386
    assert 0.15 < part < 0.4


def test_edits_by_definition(spark):
    """Every column from whole texts by definition; ids with gaps, ties, repeated rows and texts of all sizes, in many ranges."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.choice((0, 1, 3, 7, 16, 30, 31, 60, 200, 500)))) for _ in range(60)]
    rows = [(3 * i - 50, t) for i, t in enumerate(texts)] + [(4, "tied with another"), (4, "of that id"), (10, texts[20]), (10, texts[20])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    twins = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({(i, twins[t], t) for i, t in rows})
    after = {(i, t): order[(k + 1) % len(order)][2] for k, (i, _, t) in enumerate(order)}
    whole = lambda t: brute_anchors(t) or ([(twins_of(t) % (1 << 64) >> 33, 0)] if t else [])
    twins_of = lambda t: twins[t] if t in twins else extra[t]
    edits = {(i, t): t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (i, t), n in after.items()}
    extra = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in set(edits.values())], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    alike = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    want = []
    for i, t in rows:
        a, e = whole(t), whole(edits[i, t])
        h = lambda x: [y for y, _ in x]
        cut = lambda x: {x[j : j + 4] for j in range(max(1, len(x) - 3))}
        bare = lambda x, y: 0 < len(x) < 128 and 0 < len(y) < 128 and not (brute_anchors(x) and brute_anchors(y))
        near = lambda x, y: alike(cut(x), cut(y)) if bare(x, y) else alike(h(whole(x)), h(whole(y)))
        stay = sum(at + syncmers.K <= len(t) - len(t) // 4 for _, at in brute_anchors(t))
        in_place = 1.0 if edits[i, t] == t else stay / (len(a) + len(e) - stay)
        want.append((i, len(t), hashlib.sha256(edits[i, t].encode()).hexdigest(), *(round(x, 9) for x in (near(t, edits[i, t]), near(t, after[i, t]), in_place))))
    columns = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "edited_in_place"]
    for rows_each in (1, 5, 1000):
        got = [tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in syncmers.compare_with_edits(df, rows_each).collect()]
        assert sorted(got) == sorted(want), rows_each
    prints = {}
    for r in syncmers.compare_with_edits(df, 3).collect():
        prints.setdefault(r["fingerprint"], r["n_chars"])
    assert len(prints) == len({tuple(whole(t)) for _, t in rows})


def test_short_texts_are_alike_by_pieces(spark):
    rows = [(1, "ten chars!"), (2, "fifteen letters"), (3, "eighteen letters.."), (4, ""), (5, "x")]
    by = {r["doc_id"]: r["near_edited"] for r in syncmers.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[1] == 5 / 9 and 0.3 < by[2] < 1 and 0.3 < by[3] < 1 and by[4] == by[5] == 1.0


def test_likeness_follows_the_edit(spark):
    r = queries.op2_syncmers(spark, SF).filter("n_chars > 300").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert 0.5 < r["e"] < 0.7 and r["n"] < 0.02


def test_sharding_against_one_heap(spark, odd):
    """One partition gives the groups and loads of a plain heap over all groups; many come near its largest load."""
    for docs in (documents(spark, SF), clash(odd)):
        sizes: dict = {}
        for r in docs.collect():
            text = (r["text"] or "").encode()
            sizes[text] = sizes.get(text, 0) + len(text) + 16
        heap, groups = [(0, i) for i in range(7)], {}
        for text, size in sorted(sizes.items(), key=lambda x: (-x[1], hashlib.md5(x[0]).digest())):
            load, i = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, i))
            groups.setdefault(i, set()).add(zlib.crc32(text))
        out = {}
        for parts in (1, 16):
            rows = sharding.shard_documents(docs, shards=7, partitions=parts).collect()
            out[parts] = [{r["text_crc32"] for r in rows if r["shard"] == k} for k in {r["shard"] for r in rows}], max(sum(r["size"] for r in rows if r["shard"] == k) for k in range(7))
        assert sorted(map(sorted, out[1][0])) == sorted(map(sorted, groups.values())) and out[1][1] == max(heap)[0]
        assert out[16][1] <= max(max(sizes.values()), 1.1 * max(heap)[0])


def test_sharding(spark, odd):
    for docs in (documents(spark, SF), clash(odd)):
        out = sharding.shard_documents(docs, shards=7, partitions=5).collect()
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert len(out) == docs.count()
        assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in out)
        shard_of: dict = {}
        for r in out:
            shard_of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert all(len(s) == 1 for s in shard_of.values())
        for s in range(7):
            slots = sorted(r["slot"] for r in out if r["shard"] == s)
            assert slots == list(range(len(slots)))
    loads: dict = {}
    for r in sharding.shard_documents(documents(spark, SF), shards=7).collect():
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) < 1.1 * min(loads.values())
    assert sharding.shard_documents(odd.filter("false")).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e18, 1e18]), (2, [1e300, -1e300]), (3, [3e7, -3e7]), (5, [4e7, -3e7]), (20, [2e7, 4.2e7]), (4, [5e15, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(table, table.filter("vec_id % 20 = 0")).collect()}
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i in (0, 3, 20)}
    assert got == {(q, v): sum(a * b for a, b in zip(whole[q], whole[v], strict=True)) for q in (0, 20) for v in whole if v != q}
    raw = spark.createDataFrame([(0, [1 << 62, 1]), (20, [3, 1]), (5, [1 << 31, -(1 << 30)])], "vec_id long, vector array<long>")
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(raw, raw.filter("vec_id % 20 = 0")).collect()} == {(20, 5, 3 * (1 << 31) - (1 << 30))}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=8)] for _ in range(300)]
    vectors[40] = vectors[41] = vectors[42]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (401, [None] * 8), (402, [math.nan] + [0.0] * 7), (403, [1.0, 2.0]), (420, [1.0, 1.0]), (None, vectors[0]), (440, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    table = df.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"), "score")
    got: dict = {}
    for r in topk.top_k(table, table.filter("vec_id % 20 = 0"), k=20, block=37, query_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    for q in (i for i in x if i % 20 == 0):
        best = sorted(((int(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q])), key=lambda p: (-p[0], p[1]))[:20]
        assert got[q] == [(k + 1, i, s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in x if i % 20 == 0}
    assert topk.top_k(table.filter("false"), table.filter("false")).count() == 0


def test_language_id(spark, odd):
    docs = documents(spark, SF)
    marked = docs.withColumn("held_out", language_id.held_out())
    assert {r["doc_id"] for r in marked.filter("held_out").collect()} == {i for i in range(docs.count()) if zlib.crc32(str(i).encode()) % 5 == 0}
    model = language_id.fit(marked, train=~F.col("held_out"))
    said = language_id.predict(marked, model, keep=("doc_id", "held_out", "lang", "n_chars"))
    r = said.filter("held_out and n_chars > 20").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["right"] > 0.95
    again = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(clash(odd), model).collect()}
    assert all(again[i] == ("und", 0.0) for i in (0, 1, 2, 5))
    assert again[6] == again[7] and all(0 <= s <= 1 for _, s in again.values())
    nothing = language_id.fit(docs.filter("false"), train=F.lit(True))
    assert language_id.predict(odd, nothing).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(odd.filter("false"), model).count() == 0


def test_language_id_sends_a_kept_text_once(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('some words of a plain text ', id) as text", "'en' as lang").coalesce(1)
    said = language_id.predict(docs, language_id.fit(docs, train=F.lit(True)), keep=("text", "doc_id"))
    assert "__text" not in said._jdf.queryExecution().optimizedPlan().toString() and said.columns == ["text", "doc_id", "lang_pred", "score"]
    assert sorted((r["doc_id"], r["text"]) for r in said.filter("lang_pred = 'en'").collect()) == [(i, f"some words of a plain text {i}") for i in range(2000)]


def test_texts_without_letters_have_no_language(spark):
    docs = documents(spark, SF)
    model = language_id.fit(docs, train=F.lit(True))
    rows = [(0, "½ ² ³ ① Ⅷ ٣"), (1, "12.5 %"), (2, "ª word"), (3, "é")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[0] == got[1] == "und" and "und" not in (got[2], got[3])


def test_sample_of_languages_is_bounded(spark, monkeypatch):
    """A text repeated in most rows counts once, rare languages stay, and no language exceeds its share."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [("en", "the same text in most rows")] * 3000 + [("de", " ".join(word() for _ in range(9))) for _ in range(400)] + [("xx", "one lonely row"), (None, "no label"), ("en", None)]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(6)
    drawn: list = []
    monkeypatch.setattr(language_id, "LanguageModel", lambda x, langs: drawn.append((x, langs)))
    language_id.fit(df, F.lit(True), max_rows=90, max_per_language=50)
    langs = drawn[0][1]
    assert {k: langs.count(k) for k in set(langs)} == {"en": 1, "de": 30, "xx": 1} and len(drawn[0][0]) == 32


def brute_features(text):
    words = regex.findall(r"\p{L}+", text.lower())
    n = max(1, len(text))
    symbols = sum(c in "!$%&*#|=<>{}_~^0123456789" for c in text)
    share = len(set(words)) / max(1, len(words))
    upper = len(regex.findall(r"\p{Lu}", text)) / n
    marks = [f"#symbols {math.floor(math.ceil(symbols * 20 / n) / 10 * 10)}", f"#distinct {math.floor(share * 10)}", f"#upper {math.floor(upper * 10)}", f"#length {math.floor(math.log2(max(1, len(words))))}"]
    return words, marks


def least_deviation(x, cap, rounds=400):
    """How near accelerated projected gradient least squares comes to the targets, given tokens and posteriors."""
    n, p = x[:, 0], x[:, 1:]
    first = (n[:, None] * p).sum(axis=0)
    budget = first[0] / mixing.TARGETS["clean"]
    wanted = budget * np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    total = lambda r: (n[:, None] * p * r[:, None]).sum(axis=0)
    rate = ahead = np.ones(len(n))
    t = 1.0
    for _ in range(rounds):
        new = np.clip(ahead - p @ ((total(ahead) - wanted) / first), 0, cap)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, rate, t = np.clip(new + (t - 1) / t2 * (new - rate), 0, cap), new, t2
    return np.abs(total(rate) - wanted).max() / budget


def test_mixing_by_definition(spark):
    """Posteriors, expected totals, rates and copies, from the classifier's weights in plain Python."""
    docs, labels = documents(spark, "/root/testdata/sf0.001"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = mixing.fit(docs, labels)
    sure = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    want = {}
    for r in docs.collect():
        words, marks = brute_features(r["text"] or "")
        odds = list(model.start)
        for w in {*words, *marks} & set(model.weights):
            odds = [o + x for o, x in zip(odds, model.weights[w], strict=True)]
        toxic, good = map(sure, odds)
        want[r["doc_id"]] = (len(words), (1 - toxic) * good, (1 - toxic) * (1 - good), toxic)
    for cap in (None, 1.0):
        got = mixing.mix(docs, labels, max_rate=cap).collect()
        assert len(got) == len(want)
        for r in got:
            n, *p = want[r["doc_id"]]
            assert r["n_tokens"] == n and all(abs(x - r[f"p_{d}"]) < 1e-9 for x, d in zip(p, mixing.DOMAINS, strict=True)), r["doc_id"]
        clean = sum(n * p[0] for n, *p in want.values())
        totals = [sum(r["rate"] * want[r["doc_id"]][0] * want[r["doc_id"]][1 + i] for r in got) for i in range(3)]
        budget = clean / mixing.TARGETS["clean"]
        off = max(abs(t - budget * mixing.TARGETS[d]) for t, d in zip(totals, mixing.DOMAINS, strict=True)) / budget
        assert abs(off - got[0]["deviation"]) < 1e-9 and all(0 <= r["rate"] <= (cap or math.inf) for r in got)
        assert off < least_deviation(np.array([want[r["doc_id"]] for r in got]), cap or math.inf) + 2e-3
        assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)


def test_mixing(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = documents(spark, "/root/testdata/sf0.01")
    out = mixing.mix(docs, labels, max_rate=1.0).join(labels, "doc_id")
    by = {r["kind"]: r for r in out.groupBy(F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("poor").alias("kind")).agg(F.avg((F.col("copies") > 0).cast("int")).alias("kept"), F.avg("p_toxic").alias("p")).collect()}
    assert by["clean"]["kept"] > 0.97 and by["toxic"]["kept"] < 0.4 and by["toxic"]["p"] > 0.6 > 0.2 > by["clean"]["p"]
    sums = mixing.mix(docs, labels).agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS]).first()
    total = sum(sums)
    assert abs(sums["clean"] / total - 0.9) < 0.02 and abs(sums["poor"] / total - 0.1) < 0.02 and sums["toxic"] / total < 0.01
    few = mixing.mix(clash(odd), labels.filter("false"))
    assert few.count() == odd.count() and few.filter("rate < 0 or copies < 0 or rate is null").count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (3, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd, nulls).count() == odd.count()
    assert mixing.mix(odd.filter("false"), labels).count() == 0 and mixing.mixed_documents(odd.filter("false"), labels).count() == 0


def test_pipeline_stages(spark, odd):
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
            assert stage(spark, docs.filter("false"), SF).count() == 0
        if name in ("language_id", "simhash_near_dedup", "suffix_array_dedup"):
            assert stage(spark, clash(odd), SF).columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.materialise(out)
    assert 0 < docs.count() <= 200 and docs.filter("size(ids) <> n_tokens").count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()
    assert [r["doc_id"] for r in kept].count(6) == 1 and [r["doc_id"] for r in kept].count(7) == 0
    assert [r["doc_id"] for r in kept].count(None) == 1


def test_language_stage_keeps_clean_documents(spark):
    docs = documents(spark, SF)
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert docs.filter("n_chars > 30").join(kept, "doc_id", "left_anti").count() == 0


def test_language_stage_drops_junk_and_unlearned_languages(spark):
    rng = random.Random(4)
    letters = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (8, 30, 200)]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    ]
    clean = documents(spark, SF)
    bad = spark.createDataFrame([(10_000 + i, t, None, "x", len(t)) for i, t in enumerate(letters + other)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, clean.unionByName(bad), SF).collect()}
    assert not {i for i in kept if i >= 10_000}
    assert {r["doc_id"] for r in clean.filter("n_chars > 30").collect()} <= kept


def test_expected_likeness_is_a_mean_of_draws():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.full(300, 0.3))
    centre = np.sqrt(p)
    for n in (4, 64, 1024):
        drawn = [np.sqrt(x) / np.sqrt(x.sum()) @ centre for x in rng.multinomial(n, p, 400)]
        assert abs(np.mean(drawn) - language_id.expected_likeness(centre, np.array([float(n)]))[0]) < 0.03


def test_languages_are_bounded(spark):
    """A dirty column of languages neither fills the driver nor hides the common ones."""
    df = documents(spark, "/root/testdata/sf0.001").select("text", "lang")
    dirty = spark.range(600).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    model = language_id.fit(df.unionByName(dirty), F.lit(True), max_rows=60, max_languages=5)
    assert len(model.langs) == 5 and {r["lang"] for r in df.filter("lang is not null").select("lang").distinct().collect()} <= set(model.langs)
