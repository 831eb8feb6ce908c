"""The page store: versions, failed and rival saves, deletion."""

import os

import pytest

from pagelake.sources.store import Conflict, PageStore

FILES = "path string, size long, mtime long, content binary, hash string, bucket int"


def files(spark, pages, mtime=1):
    return spark.createDataFrame([(p, len(c), mtime, c.encode(), "h", 9) for p, c in pages.items()], FILES)


def contents(store, version=None):
    return {r["path"]: bytes(r["data"]).decode() for r in store.contents(version).collect()}


def test_versions(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.pages().count() == 0 and store.versions() == []
    one = {f"p{i}": f"text {i % 5}" for i in range(30)}
    assert store.save(files(spark, one)) == 1
    assert contents(store) == one and store.blobs().count() == 5
    two = {k: v for k, v in one.items() if k != "p3"} | {"p4": "other", "new": "text 1"}
    half = store.prepare(files(spark, {"p0": "lost"}, 2))  # as if the session had died here
    assert contents(store) == one
    again = PageStore(spark, str(tmp_path / "s"), buckets=99)
    assert again.save(files(spark, two, 2)) == 2
    assert contents(store) == two and contents(store, 1) == one and store.blobs().count() == 6
    with pytest.raises(Conflict):
        store.commit(half)
    (tmp_path / "s" / "versions" / "00000003.json").write_text('{"buckets": {')  # cut off while it was written
    assert contents(store) == two and store.versions() == [1, 2]
    assert store.save(files(spark, {}, 3)) == 4 and contents(store) == {} and contents(store, 2) == two
    with pytest.raises(ValueError):
        store.pages(3)
    store.vacuum(keep=2)
    assert store.versions() == [2, 4] and contents(store, 2) == two and contents(store) == {}
    store.vacuum()
    assert store.versions() == [4] and not any(n.startswith("save-") for n in os.listdir(tmp_path / "s" / "rows"))


def test_only_buckets_with_changes_are_written(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "s"), buckets=32)
    pages = {f"p{i}": str(i) for i in range(200)}
    store.save(files(spark, pages))
    before = store._version(None)[1]["buckets"]
    store.save(files(spark, pages | {"p7": "seven"}))
    after = store._version(None)[1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    store.save(files(spark, pages | {"p7": "seven"}))
    assert store._version(None)[1]["buckets"] == after


def test_equal_paths_nulls_and_same_fingerprints(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "s"))
    rows = [("a", 1, 1, b"x"), ("a", 1, 2, b"y"), (None, 1, 1, b"z"), ("gone", 1, 1, None), ("empty", 0, 1, b"")]
    store.save(spark.createDataFrame(rows, "path string, size long, mtime long, content binary"))
    assert contents(store) == {"a": "y", "empty": ""}
    store.save(spark.createDataFrame([("a", 1, 2, b"?"), ("empty", 0, 2, b"")], "path string, size long, mtime long, content binary"))
    assert contents(store) == {"a": "y", "empty": ""}  # path, size and mtime as stored: the content isn't looked at
