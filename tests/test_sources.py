"""Archives and images read in part, from files of awkward kinds."""

import io
import os
import struct
import tarfile
import zipfile

from pyspark.sql import functions as F

from pagelake.plans import sources
from pagelake.sources import archives, images, ranges
from pagelake.sources.ranges import open_path, split_path


def test_paths():
    assert split_path("file:/a b/c%20d.zip") == ("file:///", "/a b/c%20d.zip")
    assert split_path("s3a://bucket/x/y.zip") == ("s3a://bucket/", "/x/y.zip")
    assert split_path("/plain") == ("file:///", "/plain")


def test_archives_over_two_gigabytes_are_listed_by_ranges(spark, tmp_path):
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w") as z:
        for n in ("P10.png", "p2.JPG", "note.txt", "dir/", "p2.jpg"):
            z.writestr(n, n.encode())
    big = 2_300_000_000
    with open(tmp_path / "a b%.cbz", "wb") as f:  # a hole, then the archive, as after a stub
        f.seek(big)
        f.write(small.getvalue())
    with open(tmp_path / "t.tar", "wb") as f:
        for name, size in (("x9.png", big), ("x10.png", 3)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            f.seek(f.tell() + -(-size // 512) * 512)
        f.write(bytes(1024))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 and no more")
    (tmp_path / "empty.cbt").write_bytes(bytes(3))
    (tmp_path / "other.rar").write_bytes(b"Rar!")
    (tmp_path / "cut.tar").write_bytes((tarfile.TarInfo("y1.png").tobuf() + b"junk" * 200))
    got = archives.scan_archives(spark, str(tmp_path)).collect()
    name = lambda r: os.path.basename(r["archive"])
    pages = [(name(r), r["page_no"], r["entry_name"], r["ext"]) for r in sorted(got, key=lambda r: (r["archive"], r["page_no"])) if not r["error"]]
    assert pages == [("a b%.cbz", 1, "p2.JPG", ".jpg"), ("a b%.cbz", 2, "p2.jpg", ".jpg"), ("a b%.cbz", 3, "P10.png", ".png"), ("cut.tar", 1, "y1.png", ".png"), ("t.tar", 1, "x9.png", ".png"), ("t.tar", 2, "x10.png", ".png")]
    assert sorted(name(r) for r in got if r["error"]) == ["broken.zip", "empty.cbt", "other.rar"]
    read = {name(r): r["read_bytes"] for r in archives.list_archives(spark, str(tmp_path)).filter("read_bytes is not null").collect()}
    assert max(read.values()) < 100_000 and len(read) == 6
    asked = spark.createDataFrame([(r["archive"], r["entry_name"]) for r in got if name(r).startswith("a b")] + [(got[0]["archive"], "none.png"), ("/no/such.zip", "p")], "archive string, entry_name string")
    found = {r["entry_name"]: (r["content"] and bytes(r["content"]).decode(), r["error"]) for r in archives.read_entries(asked).collect()}
    assert found["P10.png"] == ("P10.png", None) and found["p2.JPG"] == ("p2.JPG", None)
    assert found["none.png"][1] and found["p"][1]


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def frame(marker, w, h):
    return segment(marker, struct.pack(">BHHB", 8, h, w, 1) + bytes(3))


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def avif(extents, owned, primary):
    """owned: (item, property number) in order."""
    ipco = box(b"ipco", b"".join(box(b"ispe", struct.pack(">III", 0, *e)) for e in extents))
    ipma = box(b"ipma", struct.pack(">II", 0, len(owned)) + b"".join(struct.pack(">HBB", i, 1, p) for i, p in owned))
    meta = bytes(4) + box(b"hdlr", bytes(20)) + box(b"pitm", struct.pack(">IH", 0, primary)) + box(b"iprp", ipco + ipma)
    return box(b"ftyp", b"avif" + bytes(4)) + box(b"free", bytes(9)) + box(b"meta", meta)


IMAGES = {
    "png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 9), (7, 9)),
    "bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 5, -6), (5, 6)),
    "os2": (b"BM" + bytes(12) + struct.pack("<IHHHH", 12, 5, 6, 1, 24), (5, 6)),
    "gif": (b"GIF87a" + struct.pack("<HH", 3, 4), (3, 4)),
    "thumbnail": (b"\xff\xd8" + segment(0xE1, b"Exif\0\0\xff\xd8" + frame(0xC0, 160, 120)) + segment(0xC4, bytes(5)) + frame(0xC0, 4000, 3000), (4000, 3000)),
    "progressive": (b"\xff\xd8" + segment(0xDB, bytes(65)) + b"\xff\xff" + frame(0xC2, 1, 65535), (1, 65535)),
    "long segments": (b"\xff\xd8" + segment(0xE2, b"\xff\xc0" * 32000) * 3 + frame(0xC1, 12, 34), (12, 34)),
    "lossy": (b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(4) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 640, 480), (640, 480)),
    "lossless": (b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 99 | 199 << 14) + bytes(5), (100, 200)),
    "extended": (b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(4) + bytes(4) + b"\xff\xff\0\x01\0\0", (65536, 2)),
    "avif": (avif([(10, 20), (300, 400)], [(1, 1), (2, 2)], 2), (300, 400)),
    "empty": (b"", None),
    "null": (None, None),
    "text": (b"no image at all, but long enough to be read as one", None),
    "no frame": (b"\xff\xd8" + segment(0xE0, bytes(14)) + segment(0xDA, bytes(6)), None),
    "cut": (b"\xff\xd8" + segment(0xE0, bytes(14))[:-3], None),
    "half png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0", None),
    "no size": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 0, 9), None),
    "no primary": (avif([(10, 20)], [(1, 1)], 3), None),
}


def test_image_sizes(spark, tmp_path):
    files = spark.createDataFrame([(k, v[0]) for k, v in IMAGES.items()], "path string, content binary")
    got = {r["path"]: (r["width"], r["height"]) if not r["error"] else None for r in images.page_sizes(files).collect()}
    assert got == {k: v[1] for k, v in IMAGES.items()}
    for k, (content, _) in IMAGES.items():
        with open_path(str(tmp_path / "in" / k), write=True) as f:
            f.write(content or b"-")  # Spark doesn't list files without a byte
    with open(tmp_path / "in" / "png", "r+b") as f:
        f.truncate(2_300_000_000)
    rows = images.scan_sizes(spark, str(tmp_path / "in")).collect()
    assert {os.path.basename(r["path"]): (r["width"], r["height"]) if not r["error"] else None for r in rows} == {k: v[1] for k, v in IMAGES.items()}
    assert max(r["read_bytes"] for r in rows) < 200_000
    good, bad = images.scan_page_sizes(spark, str(tmp_path / "in"))
    assert good.count() == 11 and bad.count() == 8


def test_empty_tables(spark):
    assert images.page_sizes(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert archives.archive_entries(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_sizes_of_images_in_archives(spark, tmp_path):
    """Heads of entries, read in part; one bad entry or archive is one row. Written, thousands of images share a file."""
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    with zipfile.ZipFile(tmp_path / "a.cbz", "w") as z:
        z.writestr("dir/", b"")
        z.writestr("dir/1.png", png(3, 4) + bytes(1_000_000))
        z.writestr("2", b"no image")
    (tmp_path / "b.cbz").write_bytes(b"broken")
    rows = {r["path"].partition(tmp_path.name + "/")[2]: r for r in images.scan_packed_sizes(spark, str(tmp_path), 1).collect()}
    assert {k: (r["width"], r["height"], r["error"] is None) for k, r in rows.items()} == {"a.cbz/dir/1.png": (3, 4, True), "a.cbz/2": (None, None, False), "b.cbz": (None, None, False)}
    assert rows["a.cbz/dir/1.png"]["read_bytes"] < 20_000


def test_page_images_share_files(spark):
    t = sources.Tables(spark, "/root/testdata/sf0.001")
    place = sources._packed(t, spark.range(0, 12_000, 1, 3).selectExpr("cast(id as string) path", "cast('x' as binary) content"), "packs")
    assert 3 <= ranges.list_files(spark, place).count() <= 6


def test_packed_archives(spark, tmp_path):
    """Archives in a zip are listed and read where they lie; one that is compressed, or a pack that is none, is an error row."""

    def zipped(names):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            for n in names:
                z.writestr(n, n * 3)
        return f.getvalue()

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.cbz", zipped(["p2.png", "p10.png", "note.txt"]))
        z.writestr("two.zip", zipped([f"q{i}.png" for i in range(1500)]))
        z.writestr("bad.cbz", b"broken")
        z.writestr("thin.cbz", zipped(["p1.png"]), zipfile.ZIP_DEFLATED)
    (tmp_path / "b.zip").write_bytes(b"no pack")
    found = archives.scan_packed_archives(spark, str(tmp_path)).withColumn("n", F.regexp_extract("archive", "[^/]*$", 0))
    rows = found.collect()
    assert sorted(r["n"] for r in rows if r["error"]) == ["b.zip", "bad.cbz", "thin.cbz"]
    assert [r["entry_name"] for r in sorted(rows, key=lambda r: r["page_no"]) if r["n"] == "one.cbz"] == ["p2.png", "p10.png"]
    good = found.filter("error is null")
    asked = good.select("archive", "file", "start", "length", "entry_name")
    asked = asked.unionByName(asked.filter("entry_name = 'p2.png'").withColumn("entry_name", F.lit("none.png")))
    read = archives.read_entries(asked).collect()
    assert len(read) == 1503 and [r["entry_name"] for r in read if r["error"]] == ["none.png"]
    assert all(bytes(r["content"]).decode() == r["entry_name"] * 3 for r in read if not r["error"])
