"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are the maximal runs of characters other than space and U+0009 to
U+000D. Each word gets an integer; a polynomial hash rolls over n words at a
time in numpy, the hashes are sorted, and positions whose hash occurs twice
are compared word by word, so that a collision of hashes changes nothing. A
longer n-gram can only repeat where a shorter one does, so lengths 6 to 10 look
at the positions that the length before left over: clean texts cost one sort.

Defined cases: a null text counts as empty; an empty text has no words and
fails the base rule; a share that equals its limit passes; repeated rows are judged row by row; very long texts are
measured whole, a block of rows at a time; an empty table gives no rows; columns of
the input beyond ``doc_id`` and ``text``, whatever their names, are not looked at, and
:func:`keep_unrepetitive` passes them through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import per_batch

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    ``ngram_chars``: largest share of word characters inside repeated n-grams
    of that length, all occurrences counted. ``line_chars``: the same for lines
    that repeat an earlier line. ``symbol_words``: largest number of symbols to
    a word.
    """

    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20})
    line_chars: float = 0.30
    symbol_words: float = 0.25
    min_words: int = 10
    repeat_percent: int = 20


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_share: float
    ngram_share: dict[int, float]

    def base_failed(self, rules: Rules) -> bool:
        return self.n_words < rules.min_words or 100 * self.n_repeat_words > rules.repeat_percent * self.n_words

    def kept(self, rules: Rules) -> bool:
        return not (
            self.base_failed(rules)
            or self.line_share > rules.line_chars
            or self.n_symbols > rules.symbol_words * self.n_words
            or any(self.ngram_share[n] > most for n, most in rules.ngram_chars.items())
        )


def _repeated(words: list[bytes], ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the positions ``at``, those whose n words occur at another of them too."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return at[:0]
    found = np.isin(hashes, twice)
    at, hashes = at[found], hashes[found]
    order = np.argsort(hashes, kind="stable")
    p, h = at[order], hashes[order]
    same = h[1:] == h[:-1]
    left, right = p[:-1][same], p[1:][same]
    if all((ids[left + k] == ids[right + k]).all() for k in range(n)):
        return at
    # Two n-grams share a hash: go by the words themselves.
    grams = [tuple(words[i : i + n]) for i in at.tolist()]
    seen = Counter(grams)
    return at[np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))]


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...] = (5, 6, 7, 8, 9, 10)) -> Measures:
    """What the rules look at, of one whole text."""
    text = text or ""
    lines, seen, dup_lines, dup_chars = text.split("\n"), set(), 0, 0
    if len(lines) > 1:
        for line in lines:
            if line.strip(SPACE):
                if line in seen:
                    dup_lines += 1
                    dup_chars += len(line) - sum(map(line.count, SPACE))
                seen.add(line)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words, word_chars = len(words), len(text) - sum(map(text.count, SPACE))
    share, n_repeat = dict.fromkeys(lengths, 0.0), 0
    if n_words > lengths[0]:
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n_words)
        value = (number + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        at, width, h = np.arange(n_words), 0, np.zeros(n_words, np.uint64)
        chars = None
        for n in lengths:
            keep = at + n <= n_words
            at, h = at[keep], h[keep]
            for k in range(width, n):
                h = h * _BASE + value[at + k]
            width = n
            found = _repeated(words, number, h, at, n) if len(at) else at
            if not len(found):
                break
            if chars is None:
                chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
            inside = _covered(n_words, found, n)
            share[n] = float(chars[inside].sum()) / word_chars
            if n == 5:
                n_repeat = int(inside.sum())
            keep = np.isin(at, found, assume_unique=True)
            at, h = at[keep], h[keep]
    return Measures(n_words, word_chars, sum(map(text.count, SYMBOLS)), dup_lines, n_repeat, dup_chars / word_chars if word_chars else 0.0, share)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_5gram_share double, dup_10gram_share double"
)


def repetition(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """A row of measures and the verdict for each row of ``docs(doc_id, text)``. No shuffle."""
    rules = rules or Rules()

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(x.as_py()) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([getattr(m, k) for m in found], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                pa.array([m.base_failed(rules) for m in found], pa.bool_()),
                pa.array([m.kept(rules) for m in found], pa.bool_()),
                pa.array([m.line_share for m in found], pa.float64()),
                pa.array([m.ngram_share[5] for m in found], pa.float64()),
                pa.array([m.ngram_share[10] for m in found], pa.float64()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    return per_batch(docs.selectExpr("cast(doc_id as long) doc_id", "text"), go, SCHEMA, by=1)


def keep_unrepetitive(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    rules = rules or Rules()
    i = docs.columns.index("text")

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([measure(x.as_py()).kept(rules) for x in batch.column(i)], pa.bool_()))

    return per_batch(docs, go, docs.schema, by=i)
