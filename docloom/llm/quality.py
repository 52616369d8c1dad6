"""Quality by ordinal regression: one set of hashed-text weights, ordered thresholds between grades.

Ratings are grades 0 < 1 < ... < K. With a score s = w.x, the cumulative-link
model says P(grade >= k) = sigmoid(s - t_k) with t_1 < t_2 < ... < t_K: all grades
share the weights, and the thresholds keep their order because their distances
are exponentials. Expected grade and tail probabilities follow, and documents
with P(grade >= ``wanted``) of at least ``cutoff`` are kept.

The labels give ``quality`` (0 or 1) and ``toxic``; grades are 0 for poor text,
1 for good text that is toxic, 2 for good text that is not (:data:`GRADE`).

Features are hashed shapes of tokens and hashed words, as shares of the text,
with the shares of tokens that repeat the one before and of repeated lines, and
the length. The model is fitted on a bounded sample of labelled rows; all
documents are scored, whole, without a shuffle.

Defined cases: a null or empty text has no tokens; without ratings, or with only
one grade among them, every document gets that grade (the highest, if there are
none); repeated label rows count with their lowest grade; of documents that repeat a rated id the one
with the least hash is the example, and each is scored by itself; a tail that equals the cut-off is kept; very
long texts and tokens are read whole, a block of rows at a time; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import on_workers, parts
from docloom.llm.hashed import Features, Sparse, labelled, minimise, shape_features, share, sigmoid, telling, word_features

#: The grade of a row of the table of labels.
GRADE = "case when quality = 0 then 0 when coalesce(toxic, 0) = 1 then 1 else 2 end"


@dataclass(frozen=True)
class Settings:
    """``sample``: rated documents that the model is fitted on, at most; ``features``: buckets it keeps, those that tell most."""

    sample: int = 8000
    features: int = 1500
    penalty: float = 1e-4
    grades: int = 3
    wanted: int = 1
    cutoff: float = 0.5


def token_features(token: str) -> tuple[int, ...]:
    return shape_features(token) + word_features(token)


def whole_features(text: str) -> list[float]:
    """Shares of repeated tokens and lines, and how far the text falls short of ten tokens."""
    tokens = text.split()
    n = len(tokens)
    again = sum(map(eq, tokens, tokens[1:]))
    lines = [x for x in text.split("\n") if x]
    return [100.0 * again / (n + 20), 100.0 * (len(lines) - len(set(lines))) / (len(lines) + 5), max(0.0, 10.0 - n) / 2, 1.0 if n == 0 else 0.0]


_WHOLE = 4


@dataclass
class Model:
    buckets: np.ndarray
    w: np.ndarray  # of the buckets, then of the features of whole texts
    thresholds: np.ndarray

    def tails(self, x: Sparse, whole: np.ndarray) -> np.ndarray:
        """Columns P(grade >= 1), P(grade >= 2), ..."""
        s = x.dot(self.w[: x.width], x.row) + whole @ self.w[x.width :]
        return sigmoid(s[:, None] - self.thresholds[None, :])


def fit_ordinal(x: Sparse, whole: np.ndarray, grade: np.ndarray, grades: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the most likely model, with a ridge on the weights."""
    n, k = len(grade), grades - 1
    width = x.width + whole.shape[1]
    share_of = np.array([(grade >= j).mean() if n else 1.0 for j in range(1, grades)]).clip(1e-6, 1 - 1e-6)
    if n == 0 or len(np.unique(grade)) == 1:
        top = int(grade[0]) if n else grades - 1
        return np.zeros(width), np.array([-30.0 if j <= top else 30.0 for j in range(1, grades)]) + np.arange(k) * 1e-3
    row = x.row
    first = -np.log(share_of / (1 - share_of))
    steps = np.log(np.maximum(np.diff(first), 0.05))

    def thresholds(p):
        return p[0] + np.r_[0, np.cumsum(np.exp(np.clip(p[1:], -20, 20)))]

    def loss(v):
        w, p = v[:width], v[width:]
        t = thresholds(p)
        s = x.dot(w[: x.width], row) + whole @ w[x.width :]
        # P(grade = j) is the difference of two neighbouring tails; those beyond the ends are 1 and 0.
        tail = np.column_stack([np.ones(n), sigmoid(s[:, None] - t), np.zeros(n)])
        i = np.arange(n)
        hi, lo = tail[i, grade], tail[i, grade + 1]
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        ds = -(d_hi - d_lo) / prob / n
        dt = np.zeros(k)
        np.add.at(dt, grade[grade > 0] - 1, (d_hi / prob / n)[grade > 0])
        np.add.at(dt, grade[grade < k], -(d_lo / prob / n)[grade < k])
        e = np.exp(np.clip(p[1:], -20, 20))
        dp = np.r_[dt.sum(), [e[j] * dt[j + 1 :].sum() for j in range(k - 1)]]
        value = -float(np.log(prob).mean()) + penalty / 2 * float(w @ w)
        return value, np.concatenate([x.back(ds, row) + penalty * w[: x.width], whole.T @ ds + penalty * w[x.width :], dp])

    v = minimise(loss, np.concatenate([np.zeros(width), first[:1], steps]), rounds=120)
    return v[:width], thresholds(v[width:])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings) -> Model:
    x, y, whole = labelled(docs, labels, {"grade": F.min(F.expr(GRADE))}, token_features, settings.sample, whole_features)
    grade = y["grade"].astype(np.int64)
    whole = whole.reshape(len(grade), _WHOLE)
    chosen = [telling(x, (grade >= j).astype(float), settings.features // (settings.grades - 1)) for j in range(1, settings.grades)]
    buckets = np.unique(np.concatenate(chosen)).astype(np.int64)
    x = x.columns(buckets)
    w, t = fit_ordinal(x, whole, grade, settings.grades, settings.penalty)
    return Model(buckets, w, t)


def score(docs: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """``doc_id, expected_grade, p_ge_1, ..., kept`` for each row of ``docs(doc_id, text)``."""
    on_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features
    tails = [f"p_ge_{j}" for j in range(1, settings.grades)]
    schema = "doc_id long, expected_grade double, " + "".join(f"{k} double, " for k in tails) + "kept boolean"

    def go(batches):
        model = sent.value
        features = Features(token_features, model.buckets)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            start, column, value, whole = [0], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                seen, n = features.counts(text)
                column.extend(seen.keys())
                value.extend(share(c, n) for c in seen.values())
                start.append(len(column))
                whole.append(whole_features(text))
            x = Sparse(np.array(start), np.array(column, np.int64), np.array(value, np.float64), len(model.buckets))
            p = np.round(model.tails(x, np.array(whole).reshape(-1, _WHOLE)), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, settings.wanted - 1] >= settings.cutoff)], names=["doc_id", "expected_grade", *tails, "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(go, schema)
