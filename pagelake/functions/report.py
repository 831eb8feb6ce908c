"""Failure texts: the telling line, its class, and what to do about it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of an error, in order, with its class and advice.
DETAILS = [
    (("flagged as unsafe", "content was flagged", "safety filters"), "The AI provider flagged this content", None),
    (("insufficient credit",), "Insufficient credits", "Buy more credits"),
    (("timed out", "timeout"), "Request timed out", "Try again"),
    (("too many requests", "rate limit", "429"), "Rate limited by provider", "Wait and try again"),
    (("unauthorized", "invalid api key", "401", "403"), "Authentication failed", "Check API settings"),
    (("connection", "network", "name or service not known", "failed to establish"), "Network or connection error", "Check your connection"),
    (("bad gateway", "service unavailable", "gateway timeout", "502", "503", "504"), "Provider unavailable", "Try again later"),
    (("jsondecodeerror", "empty json", "expecting value"), "Invalid translation response", "Try again"),
]
#: The class of any other error, and advice by reason.
OTHER, ADVICE = "Unexpected tool error", {"ocr": "Try another text recognition tool", "translat": "Try another translator"}
#: Texts of the skip reasons.
REASONS = {
    "Image Load": "Image could not be opened",
    "OCR": "Text recognition failed",
    "OCR Chunk Failed": "Webtoon text recognition chunk failed",
    "Text Blocks": "No text blocks detected",
    "Translation Chunk Failed": "Webtoon translation chunk failed",
    "Translator": "Translation failed",
}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def error_line(c: Column, most: int = 180) -> Column:
    """The first line that says something before a traceback; file lines and notes on handling are passed by; cut with dots."""
    lines = F.filter(F.transform(F.split(c, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^File [\"']") & ~x.startswith("During handling of the above exception"))
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)
    return _let(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), lambda x: F.when(F.lower(x).startswith("traceback"), "").otherwise(cut(x)))


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    return _let(F.lower(c), lambda said: _says(said, phrases))


def _says(said: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(said, F.lit(p)) for p in phrases))


def is_flagged(c: Column) -> Column:
    return _any(F.coalesce(c, F.lit("")), DETAILS[0][0])


def is_user_skip(reason: Column, error: Column | None = None) -> Column:
    said = F.concat_ws(" ", reason, F.lit("") if error is None else error)
    return _any(said, ("user-skipped", "user skipped"))


def is_no_text(reason: Column) -> Column:
    return reason == "Text Blocks"


def _class(c: Column) -> Column:
    """The place of an error in DETAILS, their number for any other error, null without one."""

    def place(said: Column) -> Column:
        out = F.when(said != "", len(DETAILS))
        for i, (phrases, _, _) in reversed(list(enumerate(DETAILS))):
            out = F.when(_says(said, phrases), i).otherwise(out)
        return out

    return _let(F.lower(error_line(c)), place)


def _detail(kind: Column) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(told) for _, told, _ in DETAILS), F.lit(OTHER)), kind), F.lit(""))


def _action(reason: Column, kind: Column) -> Column:
    def by_reason(other: str) -> Column:
        return _let(F.lower(F.coalesce(reason, F.lit(""))), lambda why: F.when(why.contains("ocr"), ADVICE["ocr"]).when(why.contains("translator") | why.contains("translation"), ADVICE["translat"]).otherwise(other))

    known = F.array(*(F.lit(advice) for _, _, advice in DETAILS))
    no_advice = F.when(reason == "Text Blocks", "").otherwise(by_reason("Try again"))
    return _let(kind, lambda k: F.when(k < len(DETAILS), F.coalesce(F.get(known, k), by_reason("Try another tool"))).otherwise(no_advice))


def error_detail(c: Column) -> Column:
    """The class of an error, '' without one."""
    return _detail(_class(c))


def error_action(reason: Column, c: Column) -> Column:
    """What to do: by the error's class; by the reason if content was flagged or the error says nothing known."""
    return _action(reason, _class(c))


def skip_reason(reason: Column, c: Column) -> Column:
    """The text of a reason, with the error's class and the advice where there are such."""
    base = F.coalesce(F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])[reason], F.lit("Page processing failed"))
    after = lambda lead, said, end="": F.when(said != "", F.concat(F.lit(lead), said, F.lit(end))).otherwise("")
    return _let(_class(c), lambda k: F.concat(base, _let(_detail(k), lambda d: after(": ", d)), _let(_action(reason, k), lambda a: after(". ", a, "."))))


def http_error(status: Column, body: Column) -> tuple[Column, Column]:
    """The message of an error body (text, object or list under detail) and the class of the status."""
    detail = F.get_json_object(body, "$.detail")
    told = F.coalesce(F.get_json_object(body, "$.detail.message"), F.get_json_object(body, "$.detail[0].msg"), detail, F.get_json_object(body, "$.message"), body)
    kind = F.when(status == 402, "credits").when((status == 400) & F.contains(F.lower(told), F.lit("flagged")), "flagged").when(status >= 500, "server").otherwise("other")
    return told, kind


#: Names of the steps of a page.
STAGES = {0: "start-image", 1: "text-block-detection", 2: "ocr-processing", 3: "translation", 5: "pre-inpaint-setup", 7: "inpainting", 9: "text-rendering-prepare", 10: "save-and-finish"}


def stage_name(step: Column) -> Column:
    known = F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[step.cast("int")], F.concat(F.lit("stage-"), step.cast("string")))


def progress_pct(index: Column, pages: Column, step: Column, steps: Column, archives: Column) -> Column:
    """Pages make nine tenths, archives, whose indices follow, the last one; a step is its share of a page or archive."""
    share = F.when(steps > 0, step / steps).otherwise(0.0)
    part = lambda n, of: F.when(of > 0, (n + share) / of).otherwise(0.0)
    return F.when(index < pages, 90 * part(index, pages)).otherwise(90 + 10 * part(index - pages, archives))


def parse_credits(c: Column) -> Column:
    """An object as it is, a number as one-time credits."""
    n = c.try_cast("long")
    given = F.from_json(c, "subscription long, one_time long, total long")
    return F.when(n.isNotNull(), F.struct(F.lit(None).cast("long").alias("subscription"), n.alias("one_time"), n.alias("total"))).otherwise(given)
