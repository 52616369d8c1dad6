"""Hashed text features for linear models, a bounded labelled sample, and the minimiser that fits them."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import on_workers, parts

#: Buckets that features are hashed to.
BUCKETS = 1 << 20
#: Words remembered with their features by a worker.
MEMO = 250_000
#: Longest token whose features are remembered.
LONGEST = 40

_LETTERS = re.compile(r"[^\W\d_]+")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_features(token: str) -> tuple[int, ...]:
    """Buckets of the words in a token between white space, and of their beginnings, so that inflected forms meet."""
    out = []
    for w in _LETTERS.findall(token.lower()):
        out.append(_bucket(w))
        if len(w) > 5:
            out.append(_bucket(w[:5] + "*"))
        if len(w) > 7:
            out.append(_bucket(w[:7] + "*"))
    return tuple(out)


_RUNS = re.compile(r"(.)\1+")


def shape_features(token: str) -> tuple[int, ...]:
    """Buckets of a token's shape: letters by case, digits, marks as they are; runs count once or as two."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    shape = _RUNS.sub(r"\1\1", shape)
    return _bucket("shape " + shape), _bucket("end " + shape[-2:])


class Features:
    """Counts of buckets in whole texts; with ``chosen``, of these only, numbered in their order."""

    def __init__(self, of: Callable[[str], tuple[int, ...]], chosen: np.ndarray | None = None):
        self.of, self.memo = of, {}
        self.number = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}

    def _new(self, token: str) -> tuple[int, ...]:
        found = self.of(token)
        if self.number is not None:
            found = tuple(self.number[b] for b in found if b in self.number)
        if len(token) <= LONGEST:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = found
        return found

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Counts by bucket, and the number of tokens; each different token is looked up once."""
        tokens = (text or "").split()
        seen: dict[int, int] = {}
        for token, times in Counter(tokens).items():
            found = self.memo.get(token)
            if found is None:
                found = self._new(token)
            for b in found:
                seen[b] = seen.get(b, 0) + times
        return seen, len(tokens)


@dataclass
class Sparse:
    """Rows of a sparse matrix: values of row i lie between ``start[i]`` and ``start[i + 1]``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))

    def dot(self, w: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.value * w[self.column], len(self.start) - 1)

    def back(self, r: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[row], self.width)

    def rows(self, which: np.ndarray) -> Sparse:
        n = np.diff(self.start)[which]
        ends = np.cumsum(n)
        at = np.repeat(self.start[:-1][which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Sparse(np.r_[0, ends], self.column[at], self.value[at], self.width)

    def columns(self, which: np.ndarray) -> Sparse:
        number = np.full(self.width, -1, np.int32)
        number[which] = np.arange(len(which))
        c = number[self.column]
        keep = c >= 0
        start = np.r_[0, np.cumsum(np.bincount(self.row[keep], minlength=len(self.start) - 1))]
        return Sparse(start, c[keep], self.value[keep], len(which))


def share(count: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Value of a feature: its occurrences among a hundred tokens, as if every text had some more of them."""
    return 100.0 * count / (tokens + 20.0)


def labelled(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], of: Callable, most: int, extra: Callable[[str], list[float]] | None = None) -> tuple[Sparse, dict[str, np.ndarray], np.ndarray]:
    """Features and targets of at most ``most`` labelled documents, in the order of a hash of their ids.

    Texts stay on the executors; the driver gets counts of buckets. The last
    array has the values of ``extra`` for each document. Of rows that repeat an id
    the text with the least hash counts, so a fit can be repeated.
    """
    on_workers(docs.sparkSession)
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(c.alias(k) for k, c in targets.items()))
    picked = ids.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    names = list(targets)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) h").join(F.broadcast(picked), "doc_id")  # bounded by most

    def go(batches):
        features = Features(of)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            out = [], [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                seen, n = features.counts(text)
                out[0].append(np.fromiter(seen.keys(), np.uint32, len(seen)).tobytes())
                out[1].append(np.fromiter(seen.values(), np.float32, len(seen)).tobytes())
                out[2].append(n)
                out[3].append(extra(text) if extra else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.float64())), *(batch.column(3 + i) for i in range(len(names)))],
                names=["doc_id", "h", "b", "c", "n", "extra", *names],
            )

    got = rows.select("doc_id", "text", "h", *(F.col(k).cast("double").alias(k) for k in names)).mapInArrow(go, "doc_id long, h long, b binary, c binary, n long, extra array<double>, " + ", ".join(f"{k} double" for k in names))
    first = F.min_by(F.struct("b", "c", "n", "extra", *names), "h").alias("x")
    t = got.groupBy("doc_id").agg(first).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    joined = lambda c, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_py(), kind) for x in t.column(c))])
    size = np.fromiter((len(x.as_py()) // 4 for x in t.column("b")), np.int64, t.num_rows)
    count, column = joined("c", np.float32), joined("b", np.uint32).astype(np.int32)
    # Values are single precision: there is one for each different word of each example.
    value = share(count, np.repeat(t.column("n").to_numpy().astype(np.float32), size))
    x = Sparse(np.r_[0, np.cumsum(size)], column, value.astype(np.float32), BUCKETS)
    more = np.array(t.column("extra").to_pylist(), np.float64).reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 0))
    return x, {k: t.column(k).to_numpy() for k in names}, more


def telling(x: Sparse, y: np.ndarray, most: int, least_rows: int = 5) -> np.ndarray:
    """Columns whose mean differs most between rows with and without ``y``, in standard errors."""
    with_y = np.nonzero(y > 0)[0]
    n1, n0 = max(1, len(with_y)), max(1, len(y) - len(with_y))
    sums = lambda part: [np.bincount(part.column, part.value.astype(np.float64) ** k, part.width) for k in (1, 2)]
    whole, own = sums(x), sums(x.rows(with_y))
    moments = []
    for n, (s1, s2) in ((n1, own), (n0, [a - b for a, b in zip(whole, own, strict=True)])):
        mean = s1 / n
        moments.append((mean, np.maximum(s2 / n - mean**2, 0) / n))
    (m1, v1), (m0, v0) = moments
    z = np.abs(m1 - m0) / np.sqrt(v1 + v0 + 1e-9)
    z[np.bincount(x.column, minlength=x.width) < least_rows] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 0])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    value, g = f(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - rho * (y @ q))
        slope, t = -(g @ q), 1.0 if steps else 1.0 / max(1.0, np.abs(g).sum())
        if slope > -1e-12:
            break
        for _ in range(30):
            new = w - t * q
            v, h = f(new)
            if v <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - w, h - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1.0 / (s @ y))][-memory:]
        done = value - v < 1e-7 * max(1.0, abs(value))
        w, value, g = new, v, h
        if done:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
