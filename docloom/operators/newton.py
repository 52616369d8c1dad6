"""Linear SVM with the squared hinge loss, fitted exactly over rows of any number.

The objective is ``w.w / 2 + c * sum(max(0, 1 - y * (w.x)) ** 2)``, with the constant as one more feature, penalised like the others. Its optimum is unique.
Newton's method finds it: each step solves for the direction, in spaces of up to :data:`SMALL` features with the Hessian itself, in larger ones by conjugate gradients, which need products of the
Hessian with a vector only, ``v + 2c X'Xv`` over the rows inside the margin. Rows are packed once into sparse blocks, written to the shared folder; a pass over them is
one product, each task adds up its blocks, and sums of tasks are added in a second stage, so the driver gets a few vectors, of the length of the feature space, however many rows there are.

Defined cases: a row with a null label is left out; a null vector, or a null in it, counts as zeros; labels over 0 are the positive class; rows of one class only, or none,
have a constant (or zero) score; features are numbered from 0 to ``width - 1``, and others are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.relational import stratified_folds
from docloom.session import scratch, use_package

#: Rows of a block, at most, and sums that reach the driver.
BLOCK_ROWS, SUMS = 4096, 8
#: Features up to which the Hessian is worked out whole.
SMALL = 256


@dataclass(frozen=True)
class Svm:
    """``w``: a weight for each feature; ``b``: the constant; ``gradient``: its largest component at the end; ``active``: rows inside the margin."""

    w: np.ndarray
    b: float
    gradient: float
    active: int
    passes: int


@dataclass
class _Block:
    """Rows as runs of ``(column, value)``, and their labels of -1 and 1."""

    y: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], len(self.y)) + w[-1]

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.r_[np.bincount(self.column, self.value * r[self.row], width), r.sum()]


_PACKED = "y binary, row binary, column binary, value binary"


def _packed(df: DataFrame, features: str, label: str, width: int, positions: str | None) -> DataFrame:
    """Blocks of rows; features are arrays of all values, or of those at ``positions``."""
    use_package(df.sparkSession)
    at = F.col(positions).cast("array<int>") if positions else F.lit(None).cast("array<int>")
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.coalesce(F.col(features).cast("array<double>"), F.array().cast("array<double>")).alias("v"), at.alias("at"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(a, BLOCK_ROWS)
                n = batch.column(1).value_lengths().to_numpy().astype(np.int64)
                value = np.nan_to_num(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
                row = np.repeat(np.arange(len(n)), n)
                column = batch.column(2).flatten().to_numpy(zero_copy_only=False) if positions else np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                if len(column) != len(value) or len(column) and not 0 <= column.min() <= column.max() < width:
                    raise ValueError(f"features must be numbered from 0 to {width - 1}, each with a value")
                y = np.where(batch.column(0).to_numpy() > 0, 1.0, -1.0)
                keep = value != 0
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (y, row[keep].astype(np.int32), column[keep].astype(np.int32), value[keep])], names=["y", "row", "column", "value"])

    return rows.mapInArrow(go, _PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for y, row, column, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            yield _Block(np.frombuffer(y), np.frombuffer(row, np.int32), np.frombuffer(column, np.int32), np.frombuffer(value))


def _summed(blocks: DataFrame, of, length: int) -> np.ndarray:
    """The sum over all blocks of ``of(block)``, a vector of that length: in tasks, then in a few tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for block in _blocks(batches):
            total += of(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for s in batch.column(0):
                total += np.frombuffer(s.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = blocks.mapInArrow(partial, "s binary").repartition(SUMS).mapInArrow(add, "s binary").toArrow()  # SUMS vectors
    return sum((np.frombuffer(s.as_buffer()) for s in sums.column("s")), np.zeros(length))


class _Objective:
    def __init__(self, blocks: DataFrame, c: float, width: int):
        self.blocks, self.c, self.width, self.passes = blocks, c, width, 0
        self.spark = blocks.sparkSession

    def _over(self, of, length: int, *vectors: np.ndarray) -> np.ndarray:
        sent = self.spark.sparkContext.broadcast(vectors)  # of the length of the feature space
        self.passes += 1
        try:
            return _summed(self.blocks, lambda block: of(block, *sent.value), length)
        finally:
            sent.unpersist()

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray, int]:
        """Value, gradient, and rows inside the margin."""
        width = self.width

        def of(block: _Block, w: np.ndarray) -> np.ndarray:
            short = np.maximum(0.0, 1.0 - block.y * block.dot(w))
            return np.r_[block.back(-2 * short * block.y, width), short @ short, np.count_nonzero(short)]

        s = self._over(of, width + 3, w)
        return 0.5 * w @ w + self.c * s[-2], w + self.c * s[:-2], int(s[-1])

    def curved(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The Hessian at ``w`` times ``v``."""
        width = self.width

        def of(block: _Block, w: np.ndarray, v: np.ndarray) -> np.ndarray:
            return block.back(2 * block.dot(v) * (block.y * block.dot(w) < 1), width)

        return v + self.c * self._over(of, width + 1, w, v)


    def hessian(self, w: np.ndarray) -> np.ndarray:
        """The Hessian itself, in one pass."""
        width = self.width

        def of(block: _Block, w: np.ndarray) -> np.ndarray:
            inside = block.y * block.dot(w) < 1
            x = np.zeros((len(block.y), width + 1))
            np.add.at(x, (block.row, block.column), block.value)
            x[:, -1] = 1
            x = x[inside]
            return (2 * x.T @ x).reshape(-1)

        return np.eye(width + 1) + self.c * self._over(of, (width + 1) ** 2, w).reshape(width + 1, width + 1)


def _direction(f: _Objective, w: np.ndarray, g: np.ndarray, rounds: int, tight: float) -> np.ndarray:
    """The Newton step: solved at once in a small space, else by conjugate gradients, as exact as the gradient is large."""
    if f.width <= SMALL:
        return np.linalg.solve(f.hessian(w), -g)
    d, r = np.zeros_like(g), -g
    p, rr = r.copy(), r @ r
    enough = (min(0.1, np.sqrt(np.linalg.norm(g))) * tight) ** 2 * rr
    for _ in range(rounds):
        if rr <= enough:
            break
        hp = f.curved(w, p)
        a = rr / (p @ hp)
        d, r = d + a * p, r - a * hp
        new = r @ r
        p, rr = r + new / rr * p, new
    return d


def fit(df: DataFrame, features: str, label: str, width: int, c: float = 0.01, positions: str | None = None, steps: int = 50, rounds: int = 200, tolerance: float = 1e-8) -> Svm:
    """The optimum for ``df``; ``features`` are arrays of ``width`` values, or sparse with their ``positions``.

    Ends when the gradient is no longer than ``tolerance``, or than rounding leaves it. The curvature is 1 or more in
    all directions, so the weights are then no farther from the optimum than the gradient is long.
    """
    spark = df.sparkSession
    at = scratch(spark, "svm-blocks")
    _packed(df, features, label, width, positions).write.parquet(at)
    blocks = spark.read.schema(_PACKED).parquet(at).persist()
    f, w = _Objective(blocks, c, width), np.zeros(width + 1)
    try:
        value, g, active = f.at(w)
        enough = max(tolerance, 1e-14 * float(np.linalg.norm(g)))
        for _ in range(steps):
            if np.linalg.norm(g) <= enough:
                break
            d, t = _direction(f, w, g, rounds, 0.01), 1.0
            if g @ d >= 0:
                break
            for _ in range(40):
                new = f.at(w + t * d)
                if new[0] <= value + 1e-4 * t * (g @ d) + 1e-14 * abs(value):
                    break
                t /= 2
            else:
                break
            w, (value, g, active) = w + t * d, new
        return Svm(w[:-1], float(w[-1]), float(np.abs(g).max()), active, f.passes)
    finally:
        blocks.unpersist()


def score(df: DataFrame, model: Svm, features: str, positions: str | None = None, into: str = "score") -> DataFrame:
    """``df`` with the decision value, and ``prediction``, 1 where it is over 0."""
    use_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((model.w, model.b))

    @F.pandas_udf("double")
    def value(v, at):
        w, b = sent.value
        return v.combine(at, lambda x, k: b + (0.0 if x is None else float(np.dot(w[np.asarray(k)] if k is not None else w[: len(x)], np.nan_to_num(np.asarray(x, float))))))

    where = F.col(positions).cast("array<int>") if positions else F.lit(None).cast("array<int>")
    return df.withColumn(into, value(F.col(features).cast("array<double>"), where)).withColumn("prediction", (F.col(into) > 0).cast("int"))


def tune(df: DataFrame, features: str, label: str, width: int, key: str, grid: tuple[float, ...] = (0.01, 0.1), folds: int = 3, positions: str | None = None) -> tuple[float, DataFrame]:
    """The penalty with the best area under the curve on held-out folds (the smallest of equals), and ``c, auc`` of each."""
    from docloom.operators import evaluate

    folded, found = stratified_folds(df.where(F.col(label).isNotNull()), label, key, folds), []
    for c in grid:
        for k in range(folds):
            model = fit(folded.where(F.col("fold") != k), features, label, width, c, positions)
            held = score(folded.where(F.col("fold") == k), model, features, positions)
            found.append((float(c), k, evaluate.auc(held.withColumn("_y", (F.col(label) > 0).cast("int")), "_y", "score").first()["auc"]))
    table = df.sparkSession.createDataFrame(found, "c double, fold int, auc double").groupBy("c").agg(F.avg("auc").alias("auc"))
    return max(table.collect(), key=lambda r: (r["auc"], -r["c"]))["c"], table  # as many rows as the grid
