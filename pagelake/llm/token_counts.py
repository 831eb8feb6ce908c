"""Token counts from prefix dynamic programming (operator 10).

For byte-pair merging by score, the tokens of a prefix end with exactly one
piece t such that the prefix without t is tokenised as it stands and t may
follow its last piece: two pieces may be neighbours iff merging their joined
text gives back these two. So one pass over a text, left to right, finds the
last piece and the exact token count of every prefix. Budget and truncation
questions are then look-ups.

No piece holds a word mark behind another character, so words are independent:
the pass runs once for each distinct word that a worker remembers, and the
counts stored for its prefixes answer both totals and cuts.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "piece_bpe_32k.model"
NEVER = float("-inf")
#: Letters or other characters with the marks before them, marks, one digit.
WORDS = re.compile(rf"{MARK}*(?:[^\W\d_²³¹]+|(?:[^\w{MARK}]|[_²³¹])+)|{MARK}+|[^\W]")


class PrefixCounter:
    """Token counts of all prefixes of a word, remembered within about `memory` bytes."""

    def __init__(self, model_file: str, memory: int = 256 << 20):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        self.words = WORDS.findall
        if any(self.words(p) != [p] for p in self.score):
            raise ValueError("a piece spans words: texts can't be cut like this for this model")
        self.longest = max(map(len, self.score))
        self.memory = memory
        self._pairs: dict[tuple[str, str], bool] = {}
        self._edges: dict[str, tuple | None] = {}
        counter = self

        class Counts(dict):
            """Prefix counts of words met lately; the older half goes when a new half is full."""

            older: dict[str, bytes | array] = {}
            held = 0

            def __missing__(self, word: str) -> bytes | array:
                counts = self.older.get(word)
                if counts is None:
                    counts = counter.prefixes(word)
                    counts = bytes(counts) if counts[-1] < 256 else array("I", counts)
                cost = 300 + 6 * len(word)  # about the bytes that an entry takes
                if 2 * cost > counter.memory:
                    return counts
                if 2 * (self.held + cost) > counter.memory:
                    self.older, self.held = dict(self), 0
                    self.clear()
                self.held += cost
                self[word] = counts
                return counts

        self.known = Counts()

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text, best score first and leftmost among equals, and the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = max(((self.score[j], -i) for i in range(len(parts) - 1) if (j := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def edges(self, piece: str) -> tuple[list, list, bool] | None:
        """What stands at the right and the left edge of a piece while it is merged.

        Each a list of (symbol, score of the merge that consumes it), oldest
        first; and whether scores fall along both, so that score order is time
        order. None if the piece, tokenised alone, is not one piece.
        """
        if piece not in self._edges:
            parts, last = self.merge(piece)
            if len(parts) > 1:
                out = None
            elif last is None:
                out = [(piece, NEVER)], [(piece, NEVER)], True
            else:
                score, left, right = self.score[piece], self.edges(last[0]), self.edges(last[1])
                ends, starts = right[0][:-1] + [(last[1], score), (piece, NEVER)], left[1][:-1] + [(last[0], score), (piece, NEVER)]
                falls = all(x[1] >= y[1] for c in (ends, starts) for x, y in pairwise(c))
                out = ends, starts, falls
            self._edges[piece] = out
        return self._edges[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether left + right is tokenised as these two: no merge crosses the edge before both are whole."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= self.memory >> 8:
                self._pairs.clear()
            known = self._pairs[left, right] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: str, right: str) -> bool:
        b = self.edges(right)
        if b is None or not left:
            return b is not None
        a = self.edges(left)
        if not (a[2] and b[2]):
            return self.merge(left + right)[0] == [left, right]
        ends, starts, i, j, score = a[0], b[1], 0, 0, self.score
        while True:
            (x, x_goes), (y, y_goes) = ends[i], starts[j]
            crossing = score.get(x + y)
            if crossing is not None and crossing > x_goes and crossing >= y_goes:
                return False
            if x_goes == y_goes == NEVER:
                return True
            if x_goes >= y_goes:
                i += 1
            else:
                j += 1

    def prefixes(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ... word[:len(word)]."""
        score, pairs, longest, last, counts = self.score, self._pairs, self.longest, [""], [0]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if piece in score or end - start == 1:
                    key = (last[start], piece)
                    if pairs[key] if key in pairs else self.may_follow(*key):
                        last.append(piece)
                        counts.append(counts[start] + (1 if piece in score else len(piece.encode())))
                        break
            else:
                raise AssertionError(f"no piece ends at {end} of {word!r}")
        return counts

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def count(self, text: str) -> int:
        return sum([self.known[w][-1] for w in self.words(self.marked(text))])

    def all_prefixes(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ... text[:len(text)]."""
        out, base = [], 0
        for word in self.words(self.marked(text)):
            counts = self.known[word]
            out += [base + c for c in counts[1:]]
            base += counts[-1]
        return [0, *out[1:]]

    def cut(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of text, and code points of its longest prefix of at most budget tokens."""
        words = self.words(self.marked(text))
        counts = [self.known[w][-1] for w in words]
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        sums = list(accumulate(counts))
        k = bisect_right(sums, budget)  # the word in which the budget ends
        base = sums[k] - counts[k]
        inside = max(i for i, c in enumerate(self.known[words[k]]) if base + c <= budget)
        return total, max(0, sum(map(len, words[:k])) + inside - 1)  # less the mark put in front


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One counter for each worker and model; a reused worker keeps what it has learnt."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def count_tokens(docs: DataFrame, budget: int = 4096, model_file: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n_bytes, n_tokens and cut_chars of every row of docs.

    cut_chars: code points of the longest prefix of at most budget tokens. A
    null text counts as empty (0 bytes, 0 tokens); equal rows each give a row;
    other columns of docs are not read. No shuffle: memory holds one Arrow
    batch and a bounded word memory.
    """
    model = model_file or public_tokenizers.path(MODEL)
    kept = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"), "n_bytes long, n_tokens long, cut_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            cuts = [c.cut(t, budget) for t in texts]
            new = [[len(t.encode()) for t in texts], [n for n, _ in cuts], [k for _, k in cuts]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in new)], names=[*keep, "n_bytes", "n_tokens", "cut_chars"])

    return kept.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and counts, an array: entry i is the exact token count of the first i code points.

    A null or empty text has the one count 0; null ids and repeated rows each
    give a row; an empty table gives an empty table. Other columns are not read.
    """
    model = model_file or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                counts = pa.array([c.all_prefixes(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), counts], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def fits_budget(counts: DataFrame, budget: int) -> DataFrame:
    """Answers from stored prefix counts, without a tokenizer: n_tokens, over (the text exceeds the budget) and cut_chars, the longest prefix within it.

    Of several prefixes within the budget the longest counts, also where a
    shorter one exceeds it. One row for each row of counts, repeated ones and
    null ids too; the array [0] of an empty text gives 0 tokens and 0 characters.
    """
    n = F.size("counts") - 1
    fit = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i)))
    return counts.select("doc_id", F.element_at("counts", -1).cast("long").alias("n_tokens"), (n > fit).alias("over"), fit.cast("long").alias("cut_chars"))
