"""Scripts and languages: fixed tables as map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recogniser bucket, language code and language name of each script.
SCRIPTS = {
    "Cyrillic": ("cyrillic", "ru", "Russian"),
    "HanS": ("chinese", "zh", "Chinese"),
    "HanT": ("chinese", "zh", "Chinese"),
    "Hangul": ("korean", "ko", "Korean"),
    "Japanese": ("japanese", "ja", "Japanese"),
    "Latin": ("latin", "en", "Auto"),
}
#: Language codes in order, and their names.
LANGUAGES = {
    "ar": "Arabic",
    "cs": "Czech",
    "de": "German",
    "en": "English",
    "es": "Spanish",
    "fa": "Persian",
    "fi": "Finnish",
    "fr": "French",
    "he": "Hebrew",
    "hr": "Croatian",
    "hu": "Hungarian",
    "id": "Indonesian",
    "it": "Italian",
    "ja": "Japanese",
    "ko": "Korean",
    "mn": "Mongolian",
    "nl": "Dutch",
    "pl": "Polish",
    "pt": "Portuguese",
    "pt-br": "Brazilian Portuguese",
    "ro": "Romanian",
    "ru": "Russian",
    "th": "Thai",
    "tr": "Turkish",
    "vi": "Vietnamese",
    "zh": "Chinese",
    "zh-CN": "Simplified Chinese",
    "zh-TW": "Traditional Chinese",
}
#: Codes of languages written from right to left.
RTL = ("ar", "fa", "he")


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def normalize_script(c: Column) -> Column:
    """Without -dn and _vert endings, in any number."""
    return F.regexp_replace(c, "(-dn|_vert)+$", "")


def _script(c: Column, i: int, default: str) -> Column:
    return F.coalesce(_map({k: v[i] for k, v in SCRIPTS.items()})[normalize_script(c)], F.lit(default))


def ocr_bucket(c: Column) -> Column:
    return _script(c, 0, "chinese")


def script_lang(c: Column) -> Column:
    return _script(c, 1, "zh")


def script_language(c: Column) -> Column:
    return _script(c, 2, "Auto")


def script_ok(c: Column) -> Column:
    return F.coalesce(normalize_script(c).isin(*SCRIPTS), F.lit(False))


def lang_code(c: Column) -> Column:
    """The code of a name; null if it is none of ours."""
    return _map({v: k for k, v in LANGUAGES.items()})[c]


def canonical_lang(c: Column) -> Column:
    """The name of a code."""
    return _map(LANGUAGES)[c]


def to_canonical(label: Column, labels: dict[str, str]) -> Column:
    """The name behind a label of a user interface, which maps labels to names; unknown labels stay."""
    return F.coalesce(_map(labels)[label], label) if labels else label


def to_label(name: Column, labels: dict[str, str]) -> Column:
    """The label of a name; unknown names stay."""
    return to_canonical(name, {v: k for k, v in labels.items()})


def is_rtl(code: Column) -> Column:
    return F.coalesce(code.isin(*RTL), F.lit(False))


def provider_code(c: Column, provider: str) -> Column:
    """A code as one of three providers writes it."""
    if provider == "a":
        return F.when(c == "zh-CN", "zh-Hans").when(c == "zh-TW", "zh-Hant").when(c == "pt-br", "pt").otherwise(c)
    if provider == "b":
        return F.when(c == "zh-CN", "ZH-HANS").when(c == "zh-TW", "ZH-HANT").when(c == "en", "EN-US").when(c == "pt", "PT-PT").otherwise(F.upper(c))
    return F.when(c.isin("zh-CN", "zh-TW", "zh"), "zh").when(c == "pt-br", "pt").otherwise(c)
