"""Search, replacement, layout and assembly of texts over block tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T


#: Noncharacters, which no text holds, about each match, and between it and its groups.
_OPEN, _SHUT, _CUT = "\ufdd0", "\ufdd1", "\ufdd2"


@dataclass(frozen=True)
class Search:
    """What to look for: literal or regex, case, whole words."""

    find: str
    regex: bool = False
    match_case: bool = False
    whole_word: bool = False

    def __post_init__(self):
        if not self.find.strip():
            raise ValueError("nothing to look for")

    @property
    def body(self) -> str:
        find = self.find.strip()
        if not self.regex:
            return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", find)
        return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", find.replace("(?P<", "(?<"))

    @property
    def pattern(self) -> str:
        """As a Java pattern; words in the Unicode sense."""
        body = rf"(?<!\w)(?:{self.body})(?!\w)" if self.whole_word else self.body
        return f"(?{'' if self.match_case else 'iu'}U){body}"

    @property
    def groups(self) -> dict[str, int]:
        """Numbers of the groups by number or name; 0 is the whole match."""
        if not self.regex:
            return {"0": 0}
        p = re.compile(self.find.strip().replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!"))
        return {str(i): i for i in range(p.groups + 1)} | p.groupindex

    def expansion(self, replacement: str) -> list[str | int]:
        """A replacement as texts and group numbers: $1, $&, ${name} and $$ in regex searches, else as it is.

        One that asks for a group the pattern lacks is taken as it is.
        """
        if not self.regex:
            return [replacement]
        out: list[str | int] = []
        for text, number, name in re.findall(r"((?:[^$]|\$\$|\$(?![\d&{]))+)|\$(\d+|&)|\$\{(\w+)\}|\$", replacement):
            if text:
                out.append(text.replace("$$", "$"))
                continue
            group = self.groups.get("0" if number == "&" else number or name)
            if group is None:
                return [replacement]
            out.append(group)
        return out


def _parts(c: Column, search: Search, groups: list[int] | None = None) -> tuple[Column, Column]:
    """Texts between the matches, and the matches, each an array of the match and the groups asked for; empty matches don't count."""
    asked = f"{_CUT}$".join(map(str, [0, *(groups or [])]))
    marked = F.regexp_replace(c, search.pattern, f"{_OPEN}${asked}{_SHUT}")
    marked = F.regexp_replace(marked, f"{_OPEN}(?:{_CUT}[^{_SHUT}]*)?{_SHUT}", "")
    segments = F.split(marked, _OPEN, -1)
    found = F.transform(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), lambda x: F.split(x, _SHUT, -1))
    texts = F.concat(F.slice(segments, 1, 1), F.transform(found, lambda x: x[1]))
    return texts, F.transform(found, lambda x: F.split(x[0], _CUT, -1))


def find_matches(blocks: DataFrame, search: Search, column: str = "text") -> DataFrame:
    """Every non-empty match of a block with its ordinal and place."""
    parts, found = _parts(F.col(column), search)
    d = blocks.select("page_id", "block_idx", F.col(column).alias("__t"), parts.alias("__p"), F.transform(found, lambda m: m[0]).alias("__m")).filter("size(__m) > 0")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.col("__p")[i])
        end = start + F.length(F.col("__m")[i])
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(i.alias("ordinal"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("__m")[i].alias("found")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<ordinal:int,start:int,end:int,found:string>>").alias("out"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size("__m") - 1), zero, step)["out"]
    return d.select("page_id", "block_idx", "__t", F.inline(folded)).withColumn("preview", T.preview(F.col("__t"), F.col("start"), F.col("end"))).drop("__t")


def _replaced(c: Column, search: Search, replacement: str, keep_case: bool, nth: int | None) -> tuple[Column, Column]:
    """The text with its matches (or the n-th, from 0) replaced, and how many were."""
    plan = search.expansion(replacement)
    groups = sorted({g for g in plan if isinstance(g, int) and g})
    parts, found = _parts(c, search, groups)

    def new(m: Column) -> Column:
        text = F.concat(F.lit(""), *(F.lit(x) if isinstance(x, str) else m[groups.index(x) + 1 if x else 0] for x in plan))
        return T.preserve_case(m[0], text) if keep_case else text

    put = F.transform(found, lambda m, i: new(m) if nth is None else F.when(i == nth, new(m)).otherwise(m[0]))
    joined = F.array_join(F.zip_with(parts, put, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return joined, F.size(found) if nth is None else (F.size(found) > nth).cast("int")


def replace_all(blocks: DataFrame, search: Search, replacement: str, column: str = "text", keep_case: bool = False) -> DataFrame:
    """Changed blocks: old and new text and how many replacements, in the case of what they replace if asked."""
    new, count = _replaced(F.col(column), search, replacement, keep_case, None)
    return blocks.select("page_id", "block_idx", F.col(column).alias("old"), new.alias("new"), count.alias("count")).filter("count > 0 and old <> new")


def replace_nth(blocks: DataFrame, search: Search, replacement: str, n: int, column: str = "text", keep_case: bool = False) -> DataFrame:
    """Blocks with an n-th match (from 0), and their text with it replaced."""
    new, count = _replaced(F.col(column), search, replacement, keep_case, n)
    return blocks.select("page_id", "block_idx", F.col(column).alias("old"), new.alias("new"), count.alias("count")).filter("count > 0").drop("count")


def replace_html(df: DataFrame, search: Search, replacement: str, column: str = "html") -> DataFrame:
    """Replace between tags only; tags stay, a match across tags is none."""
    tag = "<[^>]+>"
    texts, tags = F.split(F.col(column), tag, -1), F.regexp_extract_all(F.col(column), F.lit(tag), F.lit(0))
    new = F.transform(texts, lambda x: _replaced(x, search, replacement, False, None)[0])
    return df.withColumn("new", F.array_join(F.zip_with(new, tags, lambda x, g: F.concat(x, F.coalesce(g, F.lit("")))), ""))


def set_langs(pages: DataFrame, source: str, target: str) -> DataFrame:
    """All pages in one source and target language."""
    return pages.withColumns({"source_lang": F.lit(source), "target_lang": F.lit(target)})


def search_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("matches"), F.countDistinct("page_id").alias("pages"))


def replace_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("count"), F.lit(0)).alias("replacements"))


def match_cursor(matches: DataFrame) -> DataFrame:
    """Next and previous match of a page, around the ends."""
    w = Window.partitionBy("page_id").orderBy("block_idx", "ordinal")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("block_idx", "ordinal")
    d = matches.withColumns({"nxt": F.coalesce(F.lead(here).over(w), F.first(here).over(whole)), "prv": F.coalesce(F.lag(here).over(w), F.last(here).over(whole))})
    return d.select("page_id", "block_idx", "ordinal", F.col("nxt.block_idx").alias("next_block"), F.col("nxt.ordinal").alias("next_ordinal"), F.col("prv.block_idx").alias("prev_block"), F.col("prv.ordinal").alias("prev_ordinal"))


def block_text(lines: DataFrame, no_space: Column) -> DataFrame:
    """Line texts of a block in order, joined without blanks where the language has none."""
    g = lines.groupBy("page_id", "block_idx").agg(F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("l"), F.bool_or(no_space).alias("tight"))
    t = F.transform("l", lambda x: x["text"])
    return g.select("page_id", "block_idx", F.when(F.col("tight"), F.array_join(t, "")).otherwise(F.array_join(t, " ")).alias("text"))


def split_small_lines(lines: DataFrame) -> DataFrame:
    """Mark small lines of a block (thickness under 0.7 and area under 0.75 of its medians); none if all are."""
    w = Window.partitionBy("page_id", "block_idx")
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = lines.withColumns({"thick": F.least(width, height), "area": width * height})
    small = (F.col("thick") < 0.7 * F.percentile("thick", 0.5).over(w)) & (F.col("area") < 0.75 * F.percentile("area", 0.5).over(w))
    d = d.withColumn("small", small)
    return d.withColumn("small", F.col("small") & ~F.bool_and("small").over(w)).drop("thick", "area")


def page_json(blocks: DataFrame, column: str) -> DataFrame:
    """{"block_0": ...} of each page, four blanks deep, other alphabets as they are."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    d = blocks.select("page_id", "block_idx", quoted(F.col(column)).alias("q"))
    g = d.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", "q"))).alias("l"))
    rows = F.transform("l", lambda x, i: F.concat(F.lit('    "block_'), i.cast("string"), F.lit('": '), x["q"]))
    return g.select("page_id", F.concat(F.lit("{\n"), F.array_join(rows, ",\n"), F.lit("\n}")).alias("json"))


def parse_reply(replies: DataFrame, blocks: DataFrame) -> DataFrame:
    """The outermost {...} of a page's reply; blocks without a key keep their translation."""
    m = F.from_json(F.regexp_extract("reply", "(?s)\\{.*\\}", 0), "map<string,string>")
    d = blocks.join(replies.select("page_id", m.alias("m")), "page_id", "left")
    return d.withColumn("translation", F.coalesce(F.try_element_at("m", F.concat(F.lit("block_"), F.col("block_idx").cast("string"))), F.col("translation"))).drop("m")


def parse_lines(replies: DataFrame) -> DataFrame:
    """Recognised lines of a page from either shape of reply; corners 0 and 2, none with a corner that lacks x or y.

    A list of entries, the first (the whole page) left out; or an object whose
    readResult holds blocks, of which the first one's lines count.
    """
    corner = "array<struct<x:int,y:int>>"
    entries = F.from_json("reply", f"array<struct<description:string,boundingPoly:struct<vertices:{corner}>>>")
    rest = F.slice(entries, F.lit(2), F.greatest(F.size(entries) - 1, F.lit(0)))
    read = F.from_json("reply", f"struct<readResult:struct<blocks:array<struct<lines:array<struct<text:string,boundingPolygon:{corner}>>>>>>")
    lines = F.get(read["readResult"]["blocks"], F.lit(0))["lines"]
    one = lambda text, v: F.struct(text.alias("text"), v.alias("v"))
    listed = F.when(F.trim("reply").startswith("["), F.transform(rest, lambda e: one(e["description"], e["boundingPoly"]["vertices"]))).otherwise(F.transform(lines, lambda e: one(e["text"], e["boundingPolygon"])))
    d = replies.select("page_id", F.posexplode(listed).alias("line_idx", "e"))
    v = F.col("e.v")
    whole = (F.size(v) >= 3) & F.forall(v, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return d.filter(whole).select("page_id", "line_idx", F.col("e.text").alias("text"), v[0]["x"].alias("x1"), v[0]["y"].alias("y1"), v[2]["x"].alias("x2"), v[2]["y"].alias("y2"))


def collapse_frames(frames: DataFrame, blank: int) -> DataFrame:
    """The label of a line: repeats of the frame before and blanks dropped, then the most frequent, the earliest on ties."""
    w = Window.partitionBy("line_id").orderBy("t")
    d = frames.withColumn("before", F.lag("label").over(w)).filter((F.col("before").isNull() | (F.col("before") != F.col("label"))) & (F.col("label") != blank))
    n = d.groupBy("line_id", "label").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    best = n.groupBy("line_id").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("neg"))).alias("label"))
    return frames.select("line_id").distinct().join(best, "line_id", "left")


def collapse_text(frames: DataFrame, blank: int) -> DataFrame:
    """Symbols of a line after the same collapse, in order, and their mean probability."""
    w = Window.partitionBy("line_id").orderBy("t")
    d = frames.withColumn("before", F.lag("label").over(w)).filter((F.col("before").isNull() | (F.col("before") != F.col("label"))) & (F.col("label") != blank))
    g = d.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("t", F.col("label").cast("string").alias("s")))).alias("l"), F.avg("prob").alias("prob"))
    return g.select("line_id", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("text"), "prob")


def page_prompt(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", F.concat(F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("Context: "), "context", F.lit("\n"))).otherwise(""), F.lit("Translate the values, keep the keys:\n"), "json"))


def cache_keys(pages: DataFrame) -> DataFrame:
    """Content and context digests, and the digest of settings with their keys in order."""
    entries = F.array_sort(F.map_entries("settings"))
    return pages.select(
        "page_id", F.md5("content").alias("content_key"), F.when(F.coalesce("context", F.lit("")) == "", "no_context").otherwise(F.md5("context")).alias("context_key"),
        F.concat_ws("_", F.col("tool"), F.sha2(F.to_json(F.map_from_entries(entries)), 256)).alias("settings_key"),
    )


def erasable(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.trim("text") != "") & (F.trim("translation") != "") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Touching or overlapping spans of equal style, merged."""
    w = Window.partitionBy("text_id", "style").orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int"))
    d = d.withColumn("island", F.sum("new").over(w))
    return d.groupBy("text_id", "style", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def covers(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Whether the spans of a text cover it without a gap."""
    w = Window.partitionBy("text_id").orderBy("start", "end")
    upto = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = spans.withColumn("ok", F.col("start") <= upto).groupBy("text_id").agg(F.bool_and("ok").alias("ok"), F.max("end").alias("last"))
    return lengths.join(g, "text_id", "left").select("text_id", F.coalesce(F.col("ok") & (F.col("last") >= F.col("length")), F.col("length") == 0).alias("covered"))


def coalesce_runs(runs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Style runs of a text: cut to its length, stretched over gaps, equal neighbours merged; the head gets the default style."""
    d = runs.join(lengths, "text_id").withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")}).filter("end > start")
    w = Window.partitionBy("text_id").orderBy("start")
    head = d.groupBy("text_id").agg(F.min("start").alias("end"), F.first("length").alias("length")).filter("end > 0").select("text_id", F.lit(0).cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("default").alias("style"), "length")
    d = d.select("text_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "style", "length").unionByName(head)
    d = d.withColumn("end", F.coalesce(F.lead("start").over(w), "length"))
    d = d.withColumn("new", F.coalesce(F.lag("style").over(w) != F.col("style"), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    return d.groupBy("text_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("style").alias("style")).drop("island")


def layout_greedy(blocks: DataFrame, most: Column, measure: Callable[[str], float] = len) -> DataFrame:
    """Texts (page_id, block_idx, text, lang) wrapped greedily into lines that measure at most `most`; line rows with an overflow flag.

    Lines break at blanks, and inside a word at its hyphens where that fits; in
    languages without blanks between any characters, with line ends kept. A
    word or character too long for a line has one of its own. measure is a
    function of a line, such as the width in a font; by default characters.
    """

    def at_hyphen(line: str, word: str, room: float) -> int:
        """The end of the longest part of the word, up to a hyphen inside, that still fits the line."""
        ends = [i + 1 for i in range(1, len(word) - 1) if word[i] == "-"]
        return max((e for e in ends if measure(f"{line} {word[:e]}" if line else word[:e]) <= room), default=0)

    def by_words(text: str, room: float) -> list[str]:
        lines, line, words = [], "", text.split()[::-1]
        while words:
            longer = f"{line} {words[-1]}" if line else words[-1]
            cut = 0 if measure(longer) <= room else at_hyphen(line, words[-1], room)
            if cut:
                word = words.pop()
                lines.append(f"{line} {word[:cut]}" if line else word[:cut])
                words.append(word[cut:])
                line = ""
            elif measure(longer) <= room:
                line = longer
                words.pop()
            else:
                lines.append(line or words.pop())
                line = ""
        return [*lines, line] if line else lines

    def by_letters(text: str, room: float) -> list[str]:
        out = []
        for paragraph in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            lines = [""]
            for c in paragraph.replace(" ", ""):
                if lines[-1] and measure(lines[-1] + c) > room:
                    lines.append(c)
                else:
                    lines[-1] += c
            out += lines
        return out

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out: list[tuple] = []
            for page, block, text, tight, room in b.itertuples(index=False, name=None):
                lines = (by_letters if tight else by_words)(text or "", room)
                out += [(page, block, n, line, bool(measure(line) > room)) for n, line in enumerate(lines)]
            yield pd.DataFrame(out, columns=["page_id", "block_idx", "line_no", "line", "overflow"])

    slim = blocks.select(F.col("page_id").cast("long").alias("page_id"), F.col("block_idx").cast("long").alias("block_idx"), "text", T.is_no_space(F.col("lang")).alias("tight"), most.cast("double").alias("room"))
    return slim.mapInPandas(run, "page_id long, block_idx long, line_no int, line string, overflow boolean")


def overflow_report(lines: DataFrame) -> DataFrame:
    """Of each page: blocks laid out, and how many of them overflow."""
    blocks = lines.groupBy("page_id", "block_idx").agg(F.bool_or("overflow").alias("over"))
    return blocks.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.col("over").cast("long")).alias("overflowing"))


def layout_columns(blocks: DataFrame, width: int, first_indent: str = "", next_indent: str = "", max_lines: int | None = None, placeholder: str = "...") -> DataFrame:
    """Texts wrapped into columns; words longer than a line are broken with a hyphen; line rows with an overflow flag.

    Where an indent leaves less than two columns, lines get a letter each.
    """

    def wrap(text: str) -> tuple[list[str], bool]:
        lines, line, words = [], "", text.split()
        while words:
            word = words.pop(0)
            indent = next_indent if lines else first_indent
            room = width - len(indent) - (len(line) + 1 if line else 0)
            if len(word) <= room:
                line = f"{line} {word}" if line else word
            elif len(word) > width - len(indent) and room > 1:
                line = (f"{line} " if line else "") + word[: room - 1] + "-"
                words.insert(0, word[room - 1 :])
                lines.append(indent + line)
                line = ""
            elif line:
                lines.append(indent + line)
                line = ""
                words.insert(0, word)
            else:  # an indent that leaves no room for a letter and a hyphen: a letter at least
                lines.append(indent + word[: max(1, room)])
                words[:0] = [word[max(1, room) :]] if len(word) > max(1, room) else []
        if line:
            lines.append((next_indent if lines else first_indent) + line)
        if max_lines is not None and len(lines) > max_lines:
            last = lines[max_lines - 1][: max(0, width - len(placeholder))].rstrip() + placeholder
            return [*lines[: max_lines - 1], last], True
        return lines, False

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = [(p, i, n, line, over) for p, i, t in zip(b["page_id"], b["block_idx"], b["text"], strict=True) for lines, over in [wrap(t or "")] for n, line in enumerate(lines)]
            yield pd.DataFrame(out, columns=["page_id", "block_idx", "line_no", "line", "overflow"])

    if width < 4:
        raise ValueError("a line needs four characters")
    slim = blocks.select(F.col("page_id").cast("long").alias("page_id"), F.col("block_idx").cast("long").alias("block_idx"), "text")
    return slim.mapInPandas(run, "page_id long, block_idx long, line_no int, line string, overflow boolean")


def detect(pages: DataFrame, fn: Callable, ratio: float = 3.5, share: float = 0.2) -> DataFrame:
    """Boxes (page_id, label, x1, y1, x2, y2) of a user's detector, run on overlapping slices of tall pages and merged.

    pages: page_id, width, height and what fn needs. fn: a pandas frame of
    slices (the columns of pages with slice, start_y and end_y) to one of boxes
    (page_id, slice, label and corners in the slice). It gets a batch at a
    time, so a model loads once for each worker.
    """
    from .clusters import merge_slices
    from .strips import overlap_slices, whole_pages

    slices = overlap_slices(pages, ratio, share, *(c for c in pages.columns if c != "page_id"))

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield fn(b)

    found = slices.mapInPandas(run, "page_id long, slice long, label int, x1 long, y1 long, x2 long, y2 long")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("slice", "y1", "x1", "y2", "x2", "label"))
    return merge_slices(whole_pages(found, pages, ratio, share).withColumn("det_idx", order), "page_height")


def _by_key(df: DataFrame, keys: list[str], fn: Callable, schema: str, size: int = 20_000) -> DataFrame:
    """fn on pandas frames of whole groups of equal keys, about `size` rows at a time, after one shuffle by keys."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held: list = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            if rows < size:
                continue
            whole = pd.concat(held, ignore_index=True)
            changed = (whole[keys] != whole[keys].shift()).any(axis=1)
            last = int(changed[changed].index[-1])  # the last group may go on in the next batch
            if last:
                yield fn(whole.iloc[:last])
            held, rows = [whole.iloc[last:]], len(whole) - last
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def read_text(blocks: DataFrame, fns: dict[str, Callable]) -> DataFrame:
    """Blocks given to their bucket's reader, many pages at a time; fn: pandas frame of blocks to list of texts, '' without a reader."""

    def run(pdf):
        pdf = pdf.assign(text="")
        for bucket, rows in pdf.groupby("bucket").groups.items():
            if bucket in fns:
                pdf.loc[rows, "text"] = list(fns[bucket](pdf.loc[rows]))
        return pdf[["page_id", "block_idx", "text"]]

    slim = blocks.select(F.col("page_id").cast("long").alias("page_id"), F.col("block_idx").cast("long").alias("block_idx"), "bucket", "x1", "y1", "x2", "y2")
    return _by_key(slim, ["page_id"], run, "page_id long, block_idx long, text string")


def translate(blocks: DataFrame, fn: Callable, cache: DataFrame) -> DataFrame:
    """Translatable blocks missing from the cache go to fn, one call for each page with its texts in order; others get ''."""
    d = blocks.join(cache.select("page_id", "block_idx", "value"), ["page_id", "block_idx"], "left")
    wanted = T.has_content(F.col("text"))

    def run(pdf):
        import pandas as pd

        out = [part.assign(value=fn(list(part["text"]))) for _, part in pdf.sort_values(["page_id", "block_idx"]).groupby("page_id")]
        return pd.concat(out)[["page_id", "block_idx", "value"]]

    todo = d.filter(wanted & F.col("value").isNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("block_idx").cast("long").alias("block_idx"), "text")
    asked = _by_key(todo, ["page_id"], run, "page_id long, block_idx long, value string")
    return d.filter(wanted & F.col("value").isNotNull()).select("page_id", "block_idx", "value").unionByName(asked).unionByName(d.filter(~wanted).select("page_id", "block_idx", F.lit("").alias("value")))
