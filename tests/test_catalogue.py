"""Every registered query of the library against its SQL."""

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Results depend on the solver, or on what SQL lacks: they are held to what a fitted model must show, or tested elsewhere.
MODELS = {"score_documents", "quality_svm", "quality_rf", "cv_report", "grid_cv", "feature_ablation", "text_model", "squared_hinge_scores", "stemmed_documents"}


#: Without rows on the smallest tables.
EMPTY = {"self_pairs"}


def shown(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    v = v.item() if hasattr(v, "item") else v
    # A column of whole numbers with gaps is read as floats.
    return repr(int(v) if isinstance(v, float) and v.is_integer() else v)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in MODELS])
def test_query(spark, sf, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    assert len(got) or name in EMPTY
    sql = catalogue.oracle_sql()[name]
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(shown, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def ran(spark, sf, name):
    return catalogue.queries()[name](spark, sf).toPandas()


def area(y, score):
    """By comparing every positive with every negative."""
    pos, neg = score[y == 1].to_numpy(), score[y == 0].to_numpy()
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()).item()


@pytest.mark.parametrize("name", ["quality_svm", "quality_rf"])
def test_out_of_fold_scores(spark, sf, name):
    got = ran(spark, sf, name)
    assert got["vec_id"].is_unique and len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert set(got["fold"]) == {0, 1, 2} and (got.groupby("fold")["label"].sum().max() - got.groupby("fold")["label"].sum().min()) <= 1
    cut = 0 if name == "quality_svm" else 0.5
    assert ((got["score"] > cut) == (got["prediction"] == 1)).mean() > 0.99
    assert 0 < area(got["label"], got["score"]) < 1


def test_grid_and_report(spark, sf):
    got, out = ran(spark, sf, "grid_cv"), ran(spark, sf, "quality_svm")
    assert sorted(got["vec_id"]) == sorted(out["vec_id"]) and ((got["score"] > 0) == (got["prediction"] == 1)).mean() > 0.99
    # The best of the grid is fitted on the rows that it scores.
    assert area(got["label"], got["score"]) > 0.5
    r = ran(spark, sf, "cv_report").iloc[0]
    by = [g for _, g in out.groupby("fold")]
    recall = [(g["prediction"][g["label"] == 1] == 1).mean() for g in by]
    assert r["recall_mean"] == pytest.approx(sum(recall) / 3, abs=1e-6)


def test_ablation(spark, sf):
    got = ran(spark, sf, "feature_ablation").set_index("feature_group")["auc"]
    assert set(got.index) == {"all", "low", "high"} and got.between(0.3, 0.7).all()  # the labels of these vectors are chance


def test_text_model(spark, sf):
    r = ran(spark, sf, "text_model").iloc[0]
    n = spark.read.parquet(f"{sf}/labels.parquet").count()
    assert 0.25 * n < r["tp"] + r["fp"] + r["fn"] + r["tn"] < 0.42 * n
    assert r["recall"] > 0.5


def test_scored_rows(spark, sf):
    got = ran(spark, sf, "score_documents")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert len(got) == rows and got["score"].between(0, 1).all()
    said = got["row"].str.contains("widget")
    assert got["score"][said].mean() > got["score"][~said].mean()


def test_squared_hinge_scores(spark, sf):
    """Scores of the whole table are those of the optimum, at the penalty chosen."""
    import numpy as np

    from tests.test_newton import dense

    got = ran(spark, sf, "squared_hinge_scores").sort_values("vec_id")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("label is not null").orderBy("vec_id").toPandas()
    x, y = np.stack(e["embedding"]).astype(float), np.where(e["label"] == 0, 1.0, -1.0)
    fits = [np.abs(np.c_[x, np.ones(len(x))] @ dense(x, y, c) - got["score"].to_numpy()).max() for c in (0.01, 0.1)]
    assert min(fits) < 1e-6 and (got["prediction"] == (got["score"] > 0)).all()


def test_stemmed_documents(spark, sf):
    from docloom.functions import stems

    got = ran(spark, sf, "stemmed_documents").set_index("doc_id")["text"]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = " ".join(stems.stem(w) for w in stems._TOKEN.findall((r.text or "").strip().lower()))
        assert got[r.doc_id] == want or r.text is None
