"""Document fingerprints from closed syncmers (operator 2); DataFrame functions only.

A k-mer of 15 characters is a closed syncmer, an anchor, if the smallest hash
of its inner substrings of 8 stands at its first or last place. Whether it is
one depends on nothing outside, so equal passages have equal anchors anywhere.
A fingerprint is the list of all anchors of a text, in order, each with its
position; nothing is cut.

Short texts may lack anchors. Where one of two texts does and both are of fewer
than 128 characters, all their pieces of four characters are compared instead.

Anchors being free of context, those of an edited text are known from its
parts: the ones that lie within the kept part, the ones within the new part,
and the few that cross the seam. So each text is looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 15, 8
PLACES = K - S + 1  # of inner substrings; a power of two
#: Pieces of texts without anchors, and the length from which no text lacks them but by a chance of about 1 in 10^14.
PIECE, SMALL = 4, 128
_NO_ID = -(1 << 63)
_STEPS = [1 << i for i in range(PLACES.bit_length() - 1)]


def _paired(df: DataFrame, name: str, step: int, f) -> DataFrame:
    """An array with f of each element and the one `step` further on. A projection of its own, so it is computed once."""
    return df.withColumn(name, F.zip_with(name, F.slice(name, F.lit(step + 1), F.size(name)), f))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with an array of longs: the anchors of a text column in order, 31 bits of hash above 32 bits of position."""
    n = F.char_length(text)
    d = df.withColumn("__h", F.split(F.col(text), ""))
    for step in [1 << i for i in range(S.bit_length() - 1)]:  # hashes of 2, 4, 8 characters
        d = _paired(d, "__h", step, lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("__h", F.slice("__h", F.lit(1), F.greatest(n - S + 1, F.lit(0)))).withColumn("__m", F.col("__h"))
    for step in _STEPS:  # minima of 2, 4, 8 neighbours
        d = _paired(d, "__m", step, lambda a, b: F.least(a, b))

    def anchor(low: Column, i: Column) -> Column:
        first, last = F.get(F.col("__h"), i), F.get(F.col("__h"), i + PLACES - 1)
        hashed = F.shiftleft(F.shiftrightunsigned(F.xxhash64(first, last), 33), 32)
        return F.when(last.isNotNull() & ((low == first) | (low == last)), hashed.bitwiseOR(i.cast("long")))

    return d.withColumn(out, F.array_compact(F.transform("__m", anchor))).drop("__h", "__m")


def _or_whole(anchors: Column, text: Column) -> Column:
    """A text without anchors counts as one of itself; an empty one has none."""
    return F.when((F.size(anchors) > 0) | (text == ""), anchors).otherwise(F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 33), 32)))


def hashes(anchors: Column) -> Column:
    """The distinct anchors, without positions."""
    return F.array_distinct(F.transform(anchors, lambda a: F.shiftright(a, 32).cast("int")))


def digest(anchors: Column) -> Column:
    """A hash of all anchors and positions, in hex."""
    return F.lower(F.lpad(F.hex(F.xxhash64(anchors)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the elements of two arrays, each without repeats, in common, 0 to 1; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def pieces(text: Column) -> Column:
    """The distinct pieces of a short text, as hashes; one of fewer characters is its own piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - PIECE + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, PIECE))))


def alike(a: str, b: str) -> Column:
    """The likeness of two texts with columns <name>, <name>_found and <name>_hashes: text, anchors and their hashes."""
    short = lambda x: (F.char_length(x) > 0) & (F.char_length(x) < SMALL)
    bare = (F.size(f"{a}_found") == 0) | (F.size(f"{b}_found") == 0)
    return F.when(bare & short(a) & short(b), likeness(pieces(F.col(a)), pieces(F.col(b)))).otherwise(likeness(F.col(f"{a}_hashes"), F.col(f"{b}_hashes")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, anchors and fingerprint, their digest, of every row; a null text counts as empty and has no anchors."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    d = with_anchors(rows, "__text", "anchors").withColumn("anchors", _or_whole(F.col("anchors"), F.col("__text")))
    return d.select("doc_id", F.char_length("__text").cast("long").alias("n_chars"), "anchors", digest(F.col("anchors")).alias("fingerprint"))


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def _place(marks: list[int]) -> Column:
    """Number of the marks below id, found in two steps."""
    if not marks:
        return F.lit(0)
    wide = max(1, int(len(marks) ** 0.5))
    parts = [marks[i : i + wide] for i in range(0, len(marks), wide)]
    below = lambda c: F.size(F.filter(c, lambda m: m < F.col("id")))
    part = below(_longs([p[-1] for p in parts]))  # parts that lie below as a whole
    inside = F.get(F.split(F.lit("|".join(" ".join(map(str, p)) for p in parts)), "\\|"), part)
    return part * wide + F.when(inside.isNotNull(), below(F.split(inside, " ").cast("array<bigint>"))).otherwise(0)


def _placed(base: DataFrame, rows_each: int, most: int) -> DataFrame:
    """Rows (id, twin, ...) in ranges of ids of about rows_each rows, place; the first document of the range that follows stands at its end again, as ghost.

    The driver sees a mark and a first key for each of at most `most` ranges.
    """
    pieces = min(most, max(1, base.count() // rows_each))
    marks = base.agg(F.percentile_approx("id", [i / pieces for i in range(1, pieces)], 20 * pieces).alias("m")).first()["m"] if pieces > 1 else []
    placed = base.withColumn("place", _place(sorted(set(marks or []))))
    firsts = {r["place"]: r["first"] for r in placed.groupBy("place").agg(F.min(F.struct("id", "twin")).alias("first")).collect()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    table = lambda f: _longs([f(firsts[p], p) if p in firsts else 0 for p in range(order[-1] + 1)]) if order else F.array().cast("array<bigint>")
    own = F.col("place")
    is_first = (F.get(table(lambda k, _: k["id"]), own) == F.col("id")) & (F.get(table(lambda k, _: k["twin"]), own) == F.col("twin"))
    at = lambda place, ghost: F.struct(place.cast("int").alias("place"), F.lit(ghost).alias("ghost"))
    here = F.when(is_first, F.array(at(own, False), at(F.get(table(lambda _, p: before[p]), own), True))).otherwise(F.array(at(own, False)))
    return placed.select(*base.columns, F.inline(here))


def compare_with_edits(docs: DataFrame, rows_each: int = 1000, most_ranges: int = 16_384) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next and edited_in_place for every row.

    The edited text: the last quarter (rounded down) of the code points gives
    way to as many, or all, from the start of the next document by doc_id; the
    first follows the last. near_*: the share of distinct anchors in common (of
    short texts without an anchor: of pieces);
    edited_in_place: of anchors with their positions, the share within what the
    edit keeps. fingerprint, edited_fingerprint: digests of all anchors with
    positions.
    Rows of equal id and text count as one document (each row is returned); of
    equal ids the order is by a hash of the text, and rows without id come
    first. A null text counts as empty. Other columns are not read. Texts move
    once, to ranges of ids of about rows_each rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    d = with_anchors(_placed(base, rows_each, most_ranges).repartition("place"), "text", "found")
    d = d.withColumn("anchors", _or_whole(F.col("found"), F.col("text"))).withColumn("hashes", hashes(F.col("anchors")))
    d = d.withColumn("nr", F.dense_rank().over(Window.partitionBy("place").orderBy("ghost", "id", "twin")))
    follows = Window.partitionBy("place").orderBy("nr").rangeBetween(1, 1)
    d = d.withColumn("next", F.first(F.struct("text", "found", "hashes")).over(follows)).filter("not ghost")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.select("id", "text", "found", "anchors", "hashes", F.col("next.text").alias("after"), F.col("next.found").alias("after_found"), F.col("next.hashes").alias("after_hashes"), n.alias("n"), (n - cut).alias("kept"), cut.alias("cut"))
    d = d.withColumn("head", F.substring(F.col("after"), F.lit(1), F.col("cut"))).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), "head"))
    # The seam: up to K - 1 characters on either side.
    start = F.greatest(F.col("kept") - (K - 1), F.lit(0))
    d = d.withColumns({"start": start, "head_n": F.char_length("head"), "seam": F.substring(F.col("edited"), start + 1, F.col("kept") - start + K - 1)})
    d = with_anchors(d, "seam", "crossing")
    position = lambda a: a.bitwiseAND(F.lit(0xFFFFFFFF))
    within = lambda c, end: F.filter(c, lambda a: position(a) + K <= end)
    moved = lambda c, by: F.transform(c, lambda a: a + by)
    d = d.withColumn("stay", within("found", F.col("kept")))
    d = d.withColumn("edited_anchors", F.concat("stay", moved("crossing", F.col("start")), moved(within("after_found", F.col("head_n")), F.col("kept"))))
    d = d.withColumnsRenamed({"found": "text_found", "hashes": "text_hashes", "edited_anchors": "edited_found"})
    d = d.withColumn("edited_anchors", _or_whole(F.col("edited_found"), F.col("edited"))).withColumn("edited_hashes", hashes(F.col("edited_anchors")))
    stay = F.size("stay")
    return d.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        digest(F.col("anchors")).alias("fingerprint"),
        digest(F.col("edited_anchors")).alias("edited_fingerprint"),
        alike("text", "edited").alias("near_edited"),
        alike("text", "after").alias("near_next"),
        F.when(F.col("edited") == F.col("text"), F.lit(1.0)).otherwise(stay / (F.size("anchors") + F.size("edited_anchors") - stay)).alias("edited_in_place"),
    )
