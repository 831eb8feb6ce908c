"""Mixing documents to target domain weights (operator 8); DataFrame functions only.

A naive Bayes classifier, fitted on labelled documents, gives each document a
posterior over domains. Nonnegative document rates are then fitted by
projected gradient least squares, so that the expected tokens of each domain
(rate * tokens * posterior, summed) meet their targets. A rate depends on the
posterior and on one short vector for each step, so tokens are added up once by
cells of the posterior, and steps are taken on that table, whose size is
bounded; documents stay where they are. Each document's rate then follows from
its own posterior, and the totals reported are those of all documents.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.9, "poor": 0.1, "toxic": 0.0}
#: Cells of a posterior's axis while rates are fitted: at most GRID * (GRID + 1) / 2 + GRID cells hold documents.
GRID = 256


def tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}]+"), "")


def marks(text: Column, words: Column) -> Column:
    """Features besides words: shares of symbols and of distinct words, in steps."""
    n = F.greatest(F.char_length(text), F.lit(1))
    symbols = n - F.char_length(F.translate(text, "!$%&*#|=<>{}_~^0123456789", ""))
    distinct = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    step = lambda name, share: F.concat(F.lit(name), F.floor(share * 10).cast("string"))
    upper = n - F.char_length(F.regexp_replace(text, "\\p{Lu}", ""))
    length = F.floor(F.log2(F.greatest(F.size(words), F.lit(1)).cast("double"))).cast("string")
    return F.array(step("#symbols ", F.ceil(symbols * 20 / n) / 10), step("#distinct ", distinct), step("#upper ", upper / n), F.concat(F.lit("#length "), length))


def featured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, words (tokens in order) and marks of every row; the text is split once, in a projection of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(*keep, text.alias("__text"), tokens(text).alias("words"))
    kept = [c for c in split.columns if c not in ("__text", "words")]
    return split.select(*kept, "words", marks(F.col("__text"), F.col("words")).alias("marks"))


def _slot(word: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(slots)).cast("int") + 1


@dataclass(frozen=True)
class Classifier:
    """Two questions, toxic? and of good quality?: log odds without features, and what each feature adds."""

    start: tuple[float, float]
    weights: dict[str, tuple[float, float]]

    def _slots(self) -> int:
        """A table size at which no two features share a slot."""
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in self.weights]
        h = [x - (1 << 64) if x >> 63 else x for x in h]
        return next(m for m in itertools.count(8 * len(h) + 1, 2) if len({x % m for x in h}) == len(h))

    def log_odds(self, words: Column, marked: Column) -> Column:
        """An array: log odds of toxic, of good quality. Features present are found by hash, their weights by slot."""
        start = F.array(*map(F.lit, self.start))
        if not self.weights:
            return start
        slots = self._slots()
        where = {xxhash.xxh64_intdigest(w.encode(), 42): own for w, own in self.weights.items()}
        at = {(x - (1 << 64) if x >> 63 else x) % slots: own for x, own in where.items()}
        tables = [F.split(F.lit(" ".join(repr(at[i][k]) if i in at else "0" for i in range(slots))), " ").cast("array<double>") for k in (0, 1)]
        found = F.array_intersect(F.concat(words, marked), F.split(F.lit("\n".join(self.weights)), "\n"))
        places = F.transform(found, lambda w: _slot(w, slots))
        return F.aggregate(places, start, lambda acc, i: F.array(*[acc[k] + F.element_at(tables[k], i) for k in (0, 1)]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, vocabulary: int = 128, least: float = 20.0) -> Classifier:
    """Naive Bayes on about max_rows labelled documents, drawn by a hash of the id.

    Words tell whether a text is toxic: the vocabulary most telling ones, by
    G test at least `least`, present or absent. Marks tell whether it is of
    good quality, in any language. So the model has a fixed size.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y0"), F.col("quality").cast("int").alias("y1")).dropna().dropDuplicates(["doc_id"])
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20)))
    labelled = featured(docs.join(F.broadcast(drawn), "doc_id"), [F.col("y0"), F.col("y1")])  # max_rows rows
    rows = materialise(labelled.select("y0", "y1", F.array_distinct(F.concat("words", "marks")).alias("words")))
    n = rows.agg(F.count("*").alias("n"), F.sum("y0").alias("n0"), F.sum("y1").alias("n1")).first()
    counts = rows.select("y0", "y1", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("seen"), F.sum("y0").alias("c0"), F.sum("y1").alias("c1"))
    start, weights = [], {}
    for i in (0, 1):
        yes = n[f"n{i}"] or 0
        no = n["n"] - yes
        base = math.log((yes + 1) / (no + 1))
        told = []
        if yes and no:
            c, o = F.col(f"c{i}"), F.col("seen") - F.col(f"c{i}")
            cells = ((c, F.lit(yes) * F.col("seen")), (o, F.lit(no) * F.col("seen")), (yes - c, yes * (n["n"] - F.col("seen"))), (no - o, no * (n["n"] - F.col("seen"))))
            gain = 2 * sum((F.when(x > 0, x * F.log(x * n["n"] / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
            kind = F.col("word").startswith("#")
            told = counts.withColumn("gain", gain).filter(kind if i else ~kind & (F.col("gain") >= least)).orderBy(F.desc("gain"), "word").limit(vocabulary).collect()
        for r in told:
            p, q = (r[f"c{i}"] + 0.5) / (yes + 1), (r["seen"] - r[f"c{i}"] + 0.5) / (no + 1)
            absent = 0.0 if i else math.log((1 - p) / (1 - q))  # of each mark one value is there
            base += absent
            weights.setdefault(r["word"], [0.0, 0.0])[i] = math.log(p / q) - absent
        start.append(base)
    return Classifier(tuple(start), {w: tuple(x) for w, x in sorted(weights.items())})


def classify(docs: DataFrame, model: Classifier, keep: list[Column]) -> DataFrame:
    """keep, n_tokens and the posteriors p_clean, p_poor, p_toxic (they add up to 1) of every row."""
    sure = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))
    seen = featured(docs, keep)
    kept = [c for c in seen.columns if c not in ("words", "marks")]
    scored = seen.select(*kept, F.size("words").cast("long").alias("n_tokens"), model.log_odds(F.col("words"), F.col("marks")).alias("s"))
    odds = scored.withColumns({"p_toxic": sure(F.col("s")[0]), "good": sure(F.col("s")[1])})
    return odds.select(*[c for c in scored.columns if c != "s"], ((1 - F.col("p_toxic")) * F.col("good")).alias("p_clean"), ((1 - F.col("p_toxic")) * (1 - F.col("good"))).alias("p_poor"), "p_toxic")


def _rate(steps: list[list[float]], max_rate: float | None) -> Column:
    """The rate after the steps, from 1: each subtracts its product with the posterior, goes back into the bounds, and then on by its momentum."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*map(F.lit, g)) for g in steps])

    def inside(r: Column) -> Column:
        r = F.greatest(F.lit(0.0), r)
        return r if max_rate is None else F.least(F.lit(max_rate), r)

    def step(acc: Column, g: Column) -> Column:
        new = inside(acc["ahead"] - sum((p[i] * g[i] for i in range(1, len(p))), p[0] * g[0]))
        return F.struct(new.alias("rate"), inside(new + g[len(p)] * (new - acc["rate"])).alias("ahead"))

    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    return F.aggregate(moves, start, step)


@dataclass(frozen=True)
class Rates:
    """Gradient steps, from which a posterior gives its rate, and how far expected totals still are from the targets, as a share of the budget."""

    steps: list[list[float]]
    deviation: float

    def rate(self, max_rate: float | None) -> Column:
        return _rate(self.steps, max_rate)["rate"] if self.steps else F.lit(1.0)


def cells(posteriors: DataFrame) -> DataFrame:
    """Tokens and their mean posteriors by cells of the posterior, one row a cell; documents without tokens weigh nothing."""
    at = [F.floor(F.col(f"p_{d}") * GRID) for d in ("toxic", "clean")]
    n = F.sum("n_tokens")
    means = [(F.sum(F.col("n_tokens") * F.col(f"p_{d}")) / n).alias(f"p_{d}") for d in DOMAINS]
    return posteriors.filter("n_tokens > 0").groupBy(at[0].alias("u"), at[1].alias("v")).agg(n.alias("n_tokens"), *means).drop("u", "v")


def totals(rows: DataFrame, steps: list[list[float]], max_rate: float | None) -> tuple[list[float], list[float]]:
    """Expected tokens of each domain, of the rates after the steps and of where momentum has led."""
    state = _rate(steps, max_rate) if steps else F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    sums = [F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col(f"s.{k}")).alias(f"{k}_{d}") for d in DOMAINS for k in ("rate", "ahead")]
    row = rows.withColumn("s", state).agg(*sums).first()
    return tuple([row[f"{k}_{d}"] or 0.0 for d in DOMAINS] for k in ("rate", "ahead"))


def fit_rates(posteriors: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, rounds: int = 60, tolerance: float = 1e-3, still: float = 1e-4, patience: int = 8) -> Rates:
    """The projected gradient steps, with momentum, that bring expected domain tokens to the targets in the sense of least squares.

    The token budget is such that the domain of largest target keeps what it
    has. Steps are scaled by each domain's tokens, which bounds the curvature.
    They end when the largest deviation is within the tolerance or has not
    fallen by `still` in `patience` rounds: then bounds on rates, or posteriors
    too soft, forbid a better fit. Those up to the best round are returned.
    Within a cell the mean posterior stands for all; as rates are bent lines
    of the posterior, that errs by the bends only. The deviation returned is
    measured on all posteriors.
    """
    table = materialise(cells(posteriors).coalesce(4))  # its size is bounded
    steps: list[list[float]] = []
    seen: list[float] = []
    t = 1.0
    first, _ = totals(table, steps, max_rate)
    main = max(targets, key=lambda d: targets[d])
    budget = first[DOMAINS.index(main)] / targets[main]
    wanted = [targets.get(d, 0.0) * budget for d in DOMAINS]
    off = lambda sums: max(abs(a - b) for a, b in zip(sums, wanted, strict=True)) / budget if budget else 0.0
    while True:
        now, ahead = totals(table, steps, max_rate)
        seen.append(off(now))
        if seen[-1] <= tolerance or len(seen) > rounds or len(seen) > patience and min(seen[:-patience]) - min(seen[-patience:]) < still:
            break
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        steps.append([*((a - b) / m if m > 0 else 0.0 for a, b, m in zip(ahead, wanted, first, strict=True)), (old - 1) / t])
    discard(table)
    best = steps[: min(range(len(seen)), key=seen.__getitem__)]
    return Rates(best, off(totals(posteriors, best, max_rate)[0]))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, whole_within: float = 0.0) -> DataFrame:
    """doc_id, crc, n_tokens, p_clean, p_poor, p_toxic, rate, copies and deviation for every row of docs.

    No rate exceeds max_rate; targets are then met as nearly as that allows.
    copies is the rate rounded down or up by a hash of id and text, so its
    mean is the rate. whole_within: rates so near a whole number give that many
    copies; totals then move by that share at most.
    deviation: how far expected totals stay from the targets, see fit_rates. A
    null or blank text has no tokens and is judged like one without words; rows with
    a null id are drawn by their text. Repeated rows get equal values. Without
    labels both questions stand at even odds. Extra columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(F.encode(text, "utf-8"))
    model = fit(docs, labels)
    scored = materialise(classify(docs, model, [F.col("doc_id"), crc.alias("crc")]))
    fitted = fit_rates(scored, targets, max_rate)
    rate = fitted.rate(max_rate)
    whole = F.round("rate")
    draw = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.abs(F.col("rate") - whole) <= whole_within, whole).otherwise(F.floor(F.col("rate") + draw))
    return scored.withColumn("rate", rate).withColumns({"copies": copies.cast("int"), "deviation": F.lit(fitted.deviation)})


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, whole_within: float = 0.0) -> DataFrame:
    """The rows of docs, each as often as its copies say (see mix); columns as in docs. Repeated rows, and null ids of equal text, come or go together."""
    chosen = mix(docs, labels, targets, max_rate, whole_within).filter("copies > 0").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("crc").alias("__crc"), F.col("copies").alias("__copies")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__crc": F.crc32(F.encode(text, "utf-8"))})
    joined = rows.join(chosen, ["__id", "__crc"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return joined.select(*docs.columns)
