"""Operators 1 and 10 against the tokenizer libraries."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import bpe, token_counts

SCHEMA = "doc_id long, text string, lang string, word string, block string, n_tokens string"
TEXTS = [None, "", " ", "\n\t ", "Hello WORLD's  don't é<|endoftext|>x 123 ...", "é ΑΣ İ 中文 x\x00y", "<|StartOfText|> <|startoftext|>", "a" * 5000, "The end. " * 3000, "Hello WORLD's", "Hello WORLD's", "▁a ▁▁b  c", "x" + " " * 40 + "y\n\n  z", "<s>a</s><unk>", "ﬁ Å 😀 ½² ___"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "word", None, "7") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None), (3, "again", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_encode_and_decode(docs):
    t = bpe.tokenizer(public_tokenizers.path(bpe.TOKENIZER))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect())
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    one = docs.filter("doc_id in (4, 5, 6)")
    texts = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(one)).collect()}
    assert texts == {r["doc_id"]: t.decode(t.encode(r["text"], add_special_tokens=False).ids, skip_special_tokens=False) for r in one.collect()}


def test_decode_keeps_repeated_rows(spark):
    rows = [(1, "hello world"), (1, "hello world"), (None, "hello world"), (None, "hello world"), (None, ""), (2, None), (2, "world hello hello")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["decoded"]) for r in bpe.decode(bpe.encode(docs)).collect()]
    t = bpe.tokenizer(public_tokenizers.path(bpe.TOKENIZER))
    want = [(i, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(docs):
    none = docs.filter("false")
    assert bpe.digests(none).count() == bpe.encode(none).count() == token_counts.count_tokens(none).count() == 0


def test_blocks_split_rows(docs):
    many = docs.repartition(3)
    assert sorted(str(tuple(r)) for r in bpe.digests(many, block_chars=10).collect()) == sorted(str(tuple(r)) for r in bpe.digests(docs).collect())


def test_kept_columns_may_have_any_name(docs):
    named = docs.select(F.col("doc_id").alias("id"), F.lit("p").alias("piece"), F.lit(1).alias("number"), "text")
    got = bpe.digests(named, keep=("id", "piece", "number"), block_chars=50)
    assert sorted(str(tuple(r)) for r in got.drop("piece", "number").collect()) == sorted(str(tuple(r)) for r in bpe.digests(docs).collect())
    assert got.select("piece", "number").distinct().collect() == [("p", 1)]


def encoders():
    file = public_tokenizers.path(bpe.TOKENIZER)
    whole, words = bpe.tokenizer(file), bpe.word_encoder(file)
    ours = lambda text: [i for e in words.encode_batch(bpe.split_words(text), add_special_tokens=False) for i in e.ids]
    return ours, lambda text: whole.encode(text, add_special_tokens=False).ids


def test_words_cover_the_library():
    ours, library = encoders()
    for c in range(0x3100):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}"
            assert ours(text) == library(text), hex(c)


def test_marks_of_every_class_after_capitals():
    ours, library = encoders()
    marks = [chr(c) for c in range(0x300, 0x1E000) if unicodedata.combining(chr(c))]
    of_class = {unicodedata.combining(m): m for m in marks}
    capitals = "İIÅΣǅẞΑΪ"
    for m in marks:
        for c in capitals:
            assert ours(f"{c}{m}a normal text") == library(f"{c}{m}a normal text"), (c, hex(ord(m)))
    rng = random.Random(3)
    letters = [*capitals, "i", "e", " ", "'", "S", "s", "1", "<|endoftext|>", "\u1e9b", "\ufb01", "\uac00", "\u1100", "\u1161", *of_class.values(), *marks[:112]]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
        assert ours(text) == library(text), ascii(text)


def test_token_counts(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect())
    assert got == sorted((r["doc_id"] if r["doc_id"] is not None else -1, len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in docs.collect())


def test_prefix_answers(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    # Null ids, repeated rows, and long texts at some of their prefixes.
    places = lambda n: sorted({*range(0, n + 1, max(1, n // 60)), n, max(0, n - 1)})
    every = docs.unionByName(docs.filter("doc_id is null or doc_id in (0, 4, 7)"))
    got = [(r["doc_id"], len(r["counts"]) - 1, [r["counts"][i] for i in places(len(r["counts"]) - 1)]) for r in token_counts.prefix_counts(every).collect()]
    texts = [(r["doc_id"], r["text"] or "") for r in every.collect()]
    assert sorted(got, key=str) == sorted([(i, len(t), [len(sp.encode(t[:j])) for j in places(len(t))]) for i, t in texts], key=str)
    some = docs.filter(F.length("text") < 100).filter("doc_id is not null and doc_id <> 3")
    counts = token_counts.prefix_counts(some)
    for r in counts.join(some, "doc_id").collect():
        assert r["counts"] == [len(sp.encode(r["text"][:i])) for i in range(len(r["text"]) + 1)]
    for budget in (0, 3, 10):
        cut = {r["doc_id"]: (r["n_tokens"], r["cut_chars"]) for r in token_counts.count_tokens(some, budget=budget).collect()}
        stored = {r["doc_id"]: (r["n_tokens"], r["cut_chars"]) for r in token_counts.fits_budget(counts, budget).collect()}
        assert cut == stored


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab tTheing.,'12\n▁é中😀<s>", max_size=40))
def test_counter_on_any_text(text):
    model = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert token_counts.counter(model).count(text) == len(sp.encode(text))
