"""Figures that must not grow faster than the input: sorts, shuffles and repeated work that plans show."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import features as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bags(spark, rows, kind="long"):
    df = spark.createDataFrame([(i, list(g), list(g.values()), list(h), list(h.values())) for i, g, h in rows], f"id {kind}, gk array<string>, gv array<double>, hk array<string>, hv array<double>")
    return df.selectExpr("id", "map_from_arrays(gk, gv) AS g", "map_from_arrays(hk, hv) AS h")


@pytest.mark.parametrize("kind", ["long", "int", "double"])
def test_first_places_are_aggregated_by_hashing(spark, kind):
    of = float if kind == "double" else int
    rows = [(of(-7), {"a": 1.0, "b": 1.0}, {"c": 1.0}), (of(5), {"d": 1.0, "a": 1.0}, {"e": 1.0}), (of(5), {"e": 1.0}, {}), (None, {"d": 1.0}, {"f": 1.0})]
    want = {"a": (-7, 0), "b": (-7, 1), "c": (-7, 2), "d": (None, 0), "e": (5, 0), "f": (None, 1)}
    first = X._first_seen(bags(spark, rows, kind), ["g", "h"], "id")
    assert {r.name: (r["at"], r.place) for r in first.collect()} == want
    assert first.schema["at"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert ("SortAggregate" in plan(first)) == (kind == "double")
    assert [r.name for r in X.feature_index(bags(spark, rows, kind), ["g", "h"], "id").orderBy("index").collect()] == ["d", "f", "a", "b", "c", "e"]


def test_first_places_of_rows_far_apart(spark):
    rows = [(-(1 << 62), {"a": 1.0}, {}), (1 << 62, {"b": 1.0, "a": 1.0}, {})]
    assert sorted(map(tuple, X._first_seen(bags(spark, rows), ["g", "h"], "id").collect())) == [("a", -(1 << 62), 0), ("b", 1 << 62, 0)]


def test_sparse_rows_are_shuffled_by_name_and_by_key_only(spark, monkeypatch):
    rows = [(i, {f"n{(i * k) % 31}": float(k) for k in range(i % 9)}, {f"n{k}": 0.5 for k in range(i % 4)}) for i in range(40)] + [(100, {"unknown": 1.0}, {})]
    df = bags(spark, rows)
    index = X.feature_index(df.where("id < 100"), ["g", "h"], "id")
    at = {r.name: r["index"] for r in index.collect()}
    want = {i: sorted((at[n], g.get(n, 0.0) + h.get(n, 0.0)) for n in {**g, **h} if n in at) for i, g, h in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for names in (1 << 20, 3):  # the second deals names to more tasks than a shuffle has
            monkeypatch.setattr(X, "NAMES", names)
            out = X.sparse(df, "id", ["g", "h"], index)
            assert plan(out).count("Exchange") == 3
            assert {r.id: list(zip(r.positions, r["values"], strict=True)) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_normalised_once_for_their_features(spark, sf):
    from docloom.plans import catalogue

    assert catalogue.queries()["feature_groups"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count(r"\p{Punct}") == 1


def test_features_of_odd_texts(spark):
    import math
    import re

    texts = ["", " . ", "for A|b 1,2.. Été x1", "ΑΣ.Β Σ\n\tNo. 12", "\U0001d400\U0001d41a \U0001d400b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", X.simple_text(F.col("text")).alias("f"), X.simple_text(F.col("text"), T.kept_tokens(F.col("text"))).alias("g"))
    for r in df.collect():
        kept = re.sub(r"[!-/:-@\[-`{-~]", " ", r.text.replace("|", "")).split()
        share = lambda a, b: a / b if b else 0.0
        alpha, dots, digits = sum(t.isalpha() for t in kept), r.text.count("."), sum(c in "0123456789" for c in r.text)
        want = {"NUM_ALL_CAPS": sum(c.isupper() for c in r.text), "NUM_DOTS": dots, "NUM_DIGITS": digits, "PERCENT_DOTS": share(dots, len(r.text)), "PERCENT_DIGITS": share(digits, len(r.text)), "LENGTH": len(r.text)}
        want |= {"NUM_WORDS": len(kept), "ALPHA_TOKENS": alpha, "NON_ALPHA_TOKENS": len(kept) - alpha, "PERCENT_ALPHA_TOKENS": share(alpha, len(kept)), "PERCENT_CAPITALIZED": share(sum(t[0].isupper() for t in kept), len(kept)), "STARTS_WITH_FOR": bool(kept and kept[0].lower() == "for")}
        assert r.f == r.g and all(math.isclose(r.f[k], v) for k, v in want.items()), (r.text, r.f, want)


def test_cells_are_not_shuffled(spark, sf):
    from docloom.plans import catalogue

    query = plan(catalogue.queries()["rare_cells"](spark, sf))
    assert query.count("Exchange") == 1 and "Generate" not in query.split("Exchange")[1]


def test_bigrams_are_counted_in_tasks_of_bounded_size(spark, sf):
    from docloom import session
    from docloom.plans import catalogue

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert session.dealt(rows, "doc_id", 1 << 16).rdd.getNumPartitions() >= 5
    assert session.dealt(rows, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    query = plan(catalogue.queries()["bigram_bag"](spark, sf))
    assert "REPARTITION_BY_NUM" in query and query.count("Exchange") == 2
