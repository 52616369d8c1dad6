"""The squared-hinge SVM against a dense solution by plain gradient and Newton steps in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import newton


def dense(x, y, c):
    """Newton with the full Hessian and a line search, to machine precision."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    value = lambda w: 0.5 * w @ w + c * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(100):
        short = np.maximum(0, 1 - y * (x @ w))
        g = w - 2 * c * x.T @ (y * short)
        a = x[short > 0]
        d, t = -np.linalg.solve(np.eye(len(w)) + 2 * c * a.T @ a, g), 1.0
        while value(w + t * d) > value(w) and t > 1e-9:
            t /= 2
        w = w + t * d
        if np.abs(g).max() < 1e-13:
            break
    return w


@pytest.mark.parametrize("c", [0.01, 1.0, 30.0])
def test_weights_are_the_optimum(spark, c):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 12)) * r.choice([0.1, 1, 5], 12)
    y = np.where(x @ r.normal(size=12) + r.normal(size=600) > 0.5, 1, 0)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int").repartition(5)
    m, want = newton.fit(df, "x", "y", 12, c), dense(x, np.where(y > 0, 1, -1), c)
    assert np.r_[m.w, m.b] == pytest.approx(want, abs=1e-7)
    got = {r.id: r.score for r in newton.score(df, m, "x").collect()}
    assert np.array([got[i] for i in range(600)]) == pytest.approx(x @ want[:-1] + want[-1], abs=1e-6)
    assert m.active == int((np.where(y > 0, 1, -1) * (x @ want[:-1] + want[-1]) < 1).sum())


def test_sparse_rows_are_the_same_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 40)) * (r.random((200, 40)) < 0.1)
    y = (x.sum(axis=1) > 0).astype(int)
    full = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, y int")
    thin = spark.createDataFrame([(v[np.nonzero(v)].tolist(), np.nonzero(v)[0].tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, at array<int>, y int")
    a = newton.fit(full, "x", "y", 40, 0.5)
    monkeypatch.setattr(newton, "SMALL", 0)  # conjugate gradients
    b = newton.fit(thin, "x", "y", 40, 0.5, "at")
    assert b.passes > a.passes
    assert a.w == pytest.approx(b.w, abs=1e-8) and a.b == pytest.approx(b.b, abs=1e-8)
    one, two = (sorted(s.score for s in newton.score(d, a, "x", p).collect()) for d, p in ((full, None), (thin, "at")))
    assert one == pytest.approx(two)


def test_odd_rows(spark):
    rows = [([1.0, 2.0], 1), ([None, 1.0], 0), (None, 1), ([0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    m = newton.fit(df, "x", "y", 2, 1.0)
    assert np.r_[m.w, m.b] == pytest.approx(dense(np.array([[1, 2], [0, 1], [0, 0]]), np.array([1, -1, 1]), 1.0), abs=1e-7)
    nothing = newton.fit(df.limit(0), "x", "y", 2)
    assert nothing.w.tolist() == [0, 0] and nothing.b == 0 and nothing.active == 0
    one = newton.fit(df.where("y = 1"), "x", "y", 2, 10.0)
    assert all(r.score > 0 for r in newton.score(df.where("y = 1"), one, "x").collect())
    with pytest.raises(Exception, match="numbered from 0 to 0"):
        newton.fit(df, "x", "y", 1)


def test_tuning_takes_the_better_penalty(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 3))
    df = spark.createDataFrame([(i, v.tolist(), int(v[0] + 0.3 * e > 0)) for i, (v, e) in enumerate(zip(x, r.normal(size=150), strict=True))], "id long, x array<double>, y int")
    c, table = newton.tune(df, "x", "y", 3, "id", (0.01, 0.1))
    by = {t.c: t.auc for t in table.collect()}
    assert set(by) == {0.01, 0.1} and by[c] == max(by.values()) > 0.9
