"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of ASCII and their full-width forms, in order.
_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(chr(ord(c) + 0xFEE0) for c in _HALF)
#: Half-width kana and marks, their full-width forms, and letters that a voicing mark joins.
_KANA = "".join(map(chr, range(0xFF61, 0xFFA0)))
_WIDE = "".join(unicodedata.normalize("NFKC", c).strip() if c not in "\uff9e\uff9f" else {"\uff9e": "\u309b", "\uff9f": "\u309c"}[c] for c in _KANA)
_VOICED = {c + m: v for c in _KANA for m in "\uff9e\uff9f" if len(v := unicodedata.normalize("NFKC", c + m)) == 1}


def has_content(c: Column) -> Column:
    """Worth translating: any letter or number."""
    return c.rlike("[\\p{L}\\p{N}]")


def is_no_space(lang: Column) -> Column:
    """A language written without blanks between words."""
    return F.coalesce(F.lower(lang).rlike("zh|ja|th"), F.lit(False))


def preprocess(c: Column, lang: Column) -> Column:
    flat = F.translate(c, "\r\n", "")
    return F.when(is_no_space(lang), F.translate(flat, " ", "")).otherwise(flat)


def format_case(c: Column, upper: bool) -> Column:
    """All upper case; or, when a text is all upper case, lower with a capital in front."""
    if upper:
        return F.upper(c)
    return F.when((c == F.upper(c)) & (c != F.lower(c)), F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))).otherwise(c)


def preview(c: Column, start: Column, end: Column, around: int = 30) -> Column:
    """The text about a match with ellipses where it is cut, line ends shown as \\n."""
    low, high = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(c))
    cut = F.replace(F.substring(c, low + 1, high - low), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.when(low > 0, "…").otherwise(""), cut, F.when(high < F.length(c), "…").otherwise(""))


_CASED = "\\p{Lu}\\p{Lt}\\p{Ll}"
_TITLE = f"^[^{_CASED}]*[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*(?:[^{_CASED}]+[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*)*[^{_CASED}]*$"


def title_case(c: Column) -> Column:
    """Every run of letters with case: a capital, then small letters."""
    runs = F.regexp_extract_all(c, F.lit(f"[{_CASED}]+|[^{_CASED}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def preserve_case(match: Column, replacement: Column) -> Column:
    """The replacement in the case of what it replaces: lower, upper, title, or first letter."""
    cased = F.lower(match) != F.upper(match)
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 30))
    return (
        F.when(~cased, replacement)
        .when(match == F.lower(match), F.lower(replacement))
        .when(match == F.upper(match), F.upper(replacement))
        .when(match.rlike(_TITLE), title_case(replacement))
        .when(match.rlike("^\\p{Lu}"), capital)
        .otherwise(replacement)
    )


def plain_text(c: Column) -> Column:
    """The text of HTML: tags go, the common entities become characters."""
    flat = F.regexp_replace(F.regexp_replace(c, "(?i)<br\\s*/?>", "\n"), "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        flat = F.replace(flat, F.lit(name), F.lit(char))
    return flat


def is_vertical(direction: Column, target: Column) -> Column:
    """Set in columns: a vertical block in a language that can be."""
    return F.coalesce((direction == "vertical") & F.lower(target).isin("zh-cn", "zh-tw", "ja"), F.lit(False))


def rotate_crops(direction: Column, width: Column, height: Column) -> Column:
    """Lines to be turned before reading: vertical and over 1.15 times as high as wide."""
    return (direction == "vertical") & (height > 1.15 * width)


def reader_override(free: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Free text taller than 0.3 or wider than 0.5 of its page goes to the other reader."""
    return free & ((height > 0.3 * page_height) | (width > 0.5 * page_width))


def smart_color(found: tuple[Column, Column, Column], default: tuple[Column, Column, Column]) -> Column:
    """A struct r, g, b: the colour found, else the default; one that is nearly grey becomes black or white by its luma."""
    known = found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull()
    grey = F.greatest(*found) - F.least(*found) < 40
    snapped = F.when(0.299 * found[0] + 0.587 * found[1] + 0.114 * found[2] < 128, 0).otherwise(255)
    return F.struct(*(F.when(~known, d).when(grey, snapped).otherwise(c).alias(n) for n, c, d in zip("rgb", found, default, strict=True)))


def looks_html(c: Column) -> Column:
    return c.rlike("<[^>]+>")


def norm_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r| | ", "\n")


def text_delta(old: Column, new: Column) -> Column:
    """(start, removed, inserted): the smallest edit, by common prefix, then common suffix."""
    most = F.least(F.length(old), F.length(new))
    chars = lambda c: F.split(c, "")

    def common(a: Column, b: Column) -> Column:
        first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
        return F.when(first == 0, most).otherwise(F.least(first - 1, most))

    prefix = common(chars(old), chars(new))
    suffix = F.least(common(F.reverse(chars(old)), F.reverse(chars(new))), most - prefix)
    middle = lambda c: F.substring(c, prefix + 1, F.length(c) - prefix - suffix)
    return F.struct(prefix.alias("start"), middle(old).alias("removed"), middle(new).alias("inserted"))


def clean_ja(c: Column) -> Column:
    """Recognised text: no blanks, middle dots in runs of dots become dots, half to full width."""
    flat = F.replace(F.regexp_replace(c, "(?U)\\s+", ""), F.lit("…"), F.lit("..."))
    wide = F.regexp_replace(flat, "・(?=[・.])|(?<=[・.])・", ".")
    for two, one in _VOICED.items():
        wide = F.replace(wide, F.lit(two), F.lit(one))
    return F.translate(wide, _HALF + _KANA, _FULL + _WIDE)


def safe_stem(c: Column) -> Column:
    """A file stem without forbidden characters; 'chapter' if nothing is left."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), '[<>:"/\\\\|?*\r\n\t]+', "_")
    s = F.trim(F.regexp_replace(s, "(?U)[\\s\x1c-\x1f]+", " "))
    s = F.regexp_replace(s, "^[._-]+|[._-]+$", "")
    return F.when(s == "", "chapter").otherwise(s)


def out_ext(c: Column) -> Column:
    """An archive suffix in lower case with its dot; .zip by default."""
    low = F.lower(F.trim(c))
    dotted = F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))
    return F.when(dotted.isin(".zip", ".cbz", ".cb7", ".cbt", ".pdf"), dotted).otherwise(".zip")


def block_id() -> Column:
    """x1_y1_x2_y2_angle in whole numbers."""
    return F.concat_ws("_", *(F.col(c).cast("long").cast("string") for c in ("x1", "y1", "x2", "y2", "angle")))


def natural_key(c: Column) -> Column:
    """Sorts p2 before P10: an array of (lower-cased text, number of digits, digits), numbers by value; a text at the end without number comes before one with."""
    parts = F.regexp_extract_all(c, F.lit("[^0-9]+[0-9]*|[0-9]+"), F.lit(0))
    digits = lambda p: F.regexp_extract(p, "([0-9]*)$", 1)
    bare = lambda p: F.regexp_replace(digits(p), "^0+", "")
    return F.transform(parts, lambda p: F.struct(F.lower(F.regexp_replace(p, "[0-9]+$", "")).alias("text"), F.when(digits(p) == "", -1).otherwise(F.length(bare(p))).alias("n"), bare(p).alias("digits")))


def is_image_file(c: Column) -> Column:
    return F.lower(c).rlike("\\.(jpg|jpeg|png|bmp|webp|avif)$")


def safe_ext(c: Column) -> Column:
    ext = F.regexp_extract(F.lower(c), "(\\.[a-z0-9]+)$", 1)
    return F.when(is_image_file(c), ext).otherwise(".png")
