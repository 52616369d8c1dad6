"""Hard negatives: for an anchor and each of its best positives, the best rows of other labels in a window of scores.

Scores are inner products of integer vectors. Anchors go out in blocks of bounded bytes, as many passes as there are
blocks; every task multiplies them with the candidates it reads, block by block, in float64, where sums below 2^53
are exact. The first pass keeps the best rows of the anchor's own label: five for each anchor and task, which merge. With them the windows
are known, and the second pass keeps the best rows of other labels in each. Candidates are never shuffled; a task's results are a few
rows an anchor, however many rows it has read, and tasks are as many as the cluster runs at once, not as many as the table has parts.

Defined cases: rows with a null id, label or vector, or with a component that is null, NaN or infinite, take no part.
Ties go by the smaller id. Rows that repeat an id count each, as candidates and as anchors; the rows of an anchor's own id are none of
its positives. Vectors of different lengths have no score and don't meet; those of length 0 score 0. Where components are so large that float64
could round, the pair is scored in whole numbers of any size instead; a score beyond 64 bits that would be returned is an error. An anchor
without positives, or a positive with an empty window, has no rows; an empty table gives none. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, on_workers

#: Bytes of the anchors of a pass; what is broadcast never exceeds it, but for a single longer row.
CHUNK_BYTES = 16 << 20
#: Anchors and candidates that are multiplied at once.
ANCHORS, CANDIDATES = 512, 2048
#: Components of an anchor below this go by float64.
ANCHOR_MOST = 1 << 20
NOBODY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    scale: int = 256  # components are floor(scale * x)
    positives: int = 5
    negatives: int = 10
    low: int = 30  # per cent of the positive's score
    high: int = 90
    chunk_bytes: int = CHUNK_BYTES
    tasks: int | None = None  # of a pass; twice the cores if not given


def by_length(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix)`` for each length of vector; rows with a component that is null or not finite are left out."""
    flat = vectors.flatten()
    x = flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # nulls become NaN
    length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    fine = bad[start + length] == bad[start]
    for n in np.unique(length[fine]).tolist():
        rows = np.nonzero(fine & (length == n))[0]
        yield rows, np.floor(x[start[rows][:, None] + np.arange(n)] * scale)


def whole(m: np.ndarray) -> np.ndarray:
    """The matrix in Python's integers."""
    return np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)


class Best:
    """The best ``k`` of what each of ``n`` rows was offered: scores descending, ties by ascending id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), NOBODY, np.int64)

    def offer(self, at: int, s: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Scores ``s`` of rows ``at`` and after with candidates ``ids``, where ``ok``."""
        k, n = self.k, len(s)
        score, ident = self.score[at : at + n], self.id[at : at + n]
        ok = ok & (s >= score[:, -1:])
        if ok.sum() > 8 * k * n and s.shape[1] > k:  # the block's own k-th best rules out most
            ok &= s >= np.partition(np.where(ok, s, -np.inf), s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
        r, c = np.nonzero(ok)
        v, i = s[r, c], ids[c]
        fresh = (v > score[r, -1]) | (i < ident[r, -1])
        r, v, i = r[fresh], v[fresh], i[fresh]
        rows = np.unique(r)
        r, v, i = np.r_[r, np.repeat(rows, k)], np.r_[v, score[rows].ravel()], np.r_[i, ident[rows].ravel()]
        order = np.lexsort((i, -v, r))
        r = r[order]
        first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        order = order[place < k]
        score[rows], ident[rows] = v[order].reshape(-1, k), i[order].reshape(-1, k)


def as_long(scores) -> list[int]:
    out = [int(s) for s in scores]
    if any(not -(1 << 63) <= s < 1 << 63 for s in out):
        raise OverflowError("a score is beyond 64 bits")
    return out


class Anchors:
    """The anchors of a pass, by length of vector; ``windows`` is None where positives are looked for."""

    def __init__(self, sent: bytes, s: Settings):
        t = pa.ipc.open_stream(sent).read_all().combine_chunks()
        self.s, self.n = s, t.column("n").to_numpy()
        self.id, self.label = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        vectors = t.column("vector").combine_chunks() if isinstance(t.column("vector"), pa.ChunkedArray) else t.column("vector")
        self.windows, k, slots = None, s.positives, 1
        if "scores" in t.column_names:
            self.windows, k, slots = t.column("scores").to_pylist(), s.negatives, s.positives
        self.groups = {}
        for rows, m in by_length(vectors, s.scale):
            big = np.abs(m).max(axis=1, initial=0) >= ANCHOR_MOST
            order = np.argsort(big, kind="stable")
            rows, m, small = rows[order], m[order], int((~big).sum())
            self.groups[m.shape[1]] = rows, m, small, [Best(small, k) for _ in range(slots)], [self._bounds(rows[:small], j) for j in range(slots)]

    def _bounds(self, rows: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The least and the largest integer score in the window of each row's ``j``-th positive; an empty window where it has none."""
        if self.windows is None:
            return None
        ends = [self.window(r, j) for r in rows.tolist()]
        return tuple(np.array([float(e[x]) for e in ends]).reshape(-1, 1) for x in (0, 1))

    def window(self, row: int, j: int) -> tuple[int, int]:
        scores = self.windows[row]
        return (-(-self.s.low * scores[j] // 100), self.s.high * scores[j] // 100) if j < len(scores) else (1, 0)

    def meet(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, int, list, list]]:
        """Offer candidates. What does not fit float64 comes out at once, as ``(row, slot, scores, ids)``."""
        if m.shape[1] not in self.groups:
            return
        rows, a, small, best, bounds = self.groups[m.shape[1]]
        big = np.abs(m).max(axis=1, initial=0) * ANCHOR_MOST * max(1, m.shape[1]) >= 1 << 53
        fits = ~big
        fm, fid, flabel = m[fits].T, ids[fits], labels[fits]
        for at in range(0, small if len(fid) else 0, ANCHORS):
            of = rows[at : min(at + ANCHORS, small)]
            scores = a[at : at + len(of)] @ fm
            same = self.label[of][:, None] == flabel
            for j, b in enumerate(best):
                if bounds[j] is None:
                    b.offer(at, scores, fid, same & (self.id[of][:, None] != fid))
                else:
                    lo, hi = (x[at : at + len(of)] for x in bounds[j])
                    b.offer(at, scores, fid, (scores >= lo) & (scores <= hi) & ~same)
        for these, cs in ((range(small), np.nonzero(big)[0]), (range(small, len(rows)), np.arange(len(ids)))):
            if len(these) and len(cs):
                scores = whole(a[these.start : these.stop]) @ whole(m[cs]).T if m.shape[1] else np.zeros((len(these), len(cs)), object)
                yield from self._whole(rows[these.start : these.stop], scores, ids[cs], labels[cs])

    def _whole(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, list, list]]:
        for row, line in zip(rows.tolist(), scores.tolist(), strict=True):
            same = labels == self.label[row]
            for j in range(1 if self.windows is None else self.s.positives):
                if self.windows is None:
                    found, k = [(-v, i) for v, i, ok in zip(line, ids.tolist(), (same & (ids != self.id[row])).tolist(), strict=True) if ok], self.s.positives
                else:
                    lo, hi = self.window(row, j)
                    found, k = [(-v, i) for v, i, ok in zip(line, ids.tolist(), (~same).tolist(), strict=True) if ok and lo <= v <= hi], self.s.negatives
                found = sorted(found)[:k]
                if found:
                    yield row, j, [-v for v, _ in found], [i for _, i in found]

    def kept(self) -> Iterator[pa.RecordBatch]:
        for rows, _, small, best, _ in self.groups.values():
            for j, b in enumerate(best):
                r, c = np.nonzero(b.id != NOBODY) if small else (np.zeros(0, int), np.zeros(0, int))
                for x in range(0, len(r), 50_000):
                    p, q = r[x : x + 50_000], c[x : x + 50_000]
                    yield self.batch(rows[p], np.full(len(p), j), b.score[p, q].astype(np.int64), b.id[p, q])

    def batch(self, rows, slots, scores, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.n[rows], pa.int64()), pa.array(slots, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64())], names=["n", "slot", "score", "other"])


def one_pass(rows: DataFrame, anchors: pa.Table, s: Settings) -> DataFrame:
    """``(n, slot, score, other)``: the best that each task has for each anchor and slot."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, anchors.schema) as w:
        w.write_table(anchors)
    sent = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())  # at most chunk_bytes of vectors

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Anchors(sent.value, s)
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, batch.num_rows, CANDIDATES):
                for at, m in by_length(batch.column(2).slice(a, CANDIDATES), s.scale):
                    for row, slot, scores, others in known.meet(ids[a + at], labels[a + at], m):
                        yield known.batch(np.full(len(others), row), np.full(len(others), slot), as_long(scores), others)
        yield from known.kept()

    return rows.select("vec_id", "label", "vector").mapInArrow(go, "n long, slot int, score long, other long")


def passes(rows: DataFrame, anchors: DataFrame, s: Settings) -> DataFrame:
    """A pass over all rows for each chunk of the anchors, which are dealt to chunks by number."""
    size = anchors.agg(F.sum(8 * F.size("vector") + 64)).first()[0] or 0
    n = max(1, -(-2 * size // s.chunk_bytes))  # half full on average, as numbers are dealt by hash
    if n == 1:
        return one_pass(rows, anchors.toArrow(), s)
    chunk = F.pmod(F.xxhash64("n"), F.lit(n))
    return reduce(DataFrame.unionAll, (one_pass(rows, anchors.where(chunk == i).toArrow(), s) for i in range(n)))


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("n", "slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, s: Settings | None = None) -> DataFrame:
    """``rows(vec_id, label, vector, anchor)`` to ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Two passes (a chunk of anchors) over the rows; anchors and their positives are written to the shared folder.
    """
    s, spark = s or Settings(), rows.sparkSession
    on_workers(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), "anchor").where("vec_id is not null and label is not null and vector is not null")
    anchors = cut(rows.where("anchor").select(F.monotonically_increasing_id().alias("n"), "vec_id", "label", "vector"), "anchors")
    rows = rows.coalesce(s.tasks or 2 * spark.sparkContext.defaultParallelism)
    first = top(passes(rows, anchors, s), s.positives)
    listed = first.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "other"))).alias("found"))  # five an anchor
    known = cut(anchors.join(listed, "n").select("n", "vec_id", "label", "vector", F.col("found.score").alias("scores"), F.col("found.other").alias("others")), "positives")
    second = top(passes(rows, known.drop("others"), s), s.negatives)
    pairs = known.select("n", F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("scores", "others")).alias("slot", "p"))
    return second.join(pairs, ["n", "slot"]).select("anchor_id", F.col("p.others").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("p.scores").alias("positive_score"), F.col("score").alias("negative_score"))
