"""Feature indexes, counted hierarchies and the table function against plain recomputations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import features as X
from docloom.operators import newton, tables
from docloom.operators import relational as R


def bags(spark, rows):
    """Maps made by Spark keep the order of their names."""
    flat = [(i, *(x for m in (g, h) for x in ((None, None) if m is None else (list(m), list(m.values()))))) for i, g, h in rows]
    df = spark.createDataFrame(flat, "id long, gk array<string>, gv array<double>, hk array<string>, hv array<double>")
    return df.select("id", F.map_from_arrays("gk", "gv").alias("g"), F.map_from_arrays("hk", "hv").alias("h"))


def seen(rows):
    out = {}
    for _, g, h in sorted(rows, key=lambda r: r[0]):
        for name in [*(g or {}), *(h or {})]:
            out.setdefault(name, len(out))
    return out


def test_features_are_numbered_as_they_are_first_seen(spark):
    r = random.Random(1)
    draw = lambda k: {f"f{r.randint(0, k)}": float(r.randint(1, 9)) for _ in range(r.randint(0, 5))}
    rows = [(i, draw(60), draw(80)) for i in r.sample(range(1000), 200)] + [(2000, None, {"last": 1.0}), (2001, {}, None)]
    index = X.feature_index(bags(spark, rows).repartition(7), ["g", "h"], "id")
    assert {x.name: x["index"] for x in index.collect()} == seen(rows)
    more = [(i, draw(120), None) for i in range(50)]
    both = {x.name: x["index"] for x in X.feature_space_union(index, bags(spark, more), ["g", "h"], "id").collect()}
    want = seen(rows)
    for name in seen(more):
        want.setdefault(name, len(want))
    assert both == want
    got = {x.id: dict(zip(x.positions, x["values"], strict=True)) for x in X.sparse(bags(spark, rows), "id", ["g", "h"], index).collect()}
    for i, g, h in rows:
        assert got[i] == {want[n]: v for n, v in (Counter(g or {}) + Counter(h or {})).items()}


def test_an_index_of_nothing(spark):
    none = bags(spark, [])
    index = X.feature_index(none, ["g", "h"], "id")
    assert index.count() == 0 and [x["index"] for x in X.feature_space_union(index, bags(spark, [(1, {"a": 1.0}, None)]), ["g"], "id").collect()] == [0]


def test_an_index_and_the_solver(spark):
    """Maps to sparse rows to a model, without a dense row in between."""
    rows = [(i, {"good": 1.0, f"x{i % 7}": 1.0} if i % 2 else {"bad": 1.0, f"x{i % 5}": 1.0}, None) for i in range(60)]
    df = bags(spark, rows)
    index = X.feature_index(df, ["g"], "id")
    x = X.sparse(df, "id", ["g"], index).withColumn("y", F.col("id") % 2)
    m = newton.fit(x, "values", "y", index.count(), 1.0, "positions")
    assert all(r.prediction == r.y for r in newton.score(x, m, "values", "positions").collect())


def test_levels_count_paths_and_not_rows(spark):
    """A ladder where the number of paths doubles with each level: a row a node all the same."""
    edges = spark.createDataFrame([(f"{k}{a}", f"{k + 1}{b}") for k in range(30) for a in "ab" for b in "ab"], "child string, parent string")
    out = R.hierarchy(edges, spark.createDataFrame([("0a",), (None,)], "node string"), 30)
    got = {(r.level, r.node): r.paths for r in out.collect()}
    assert len(got) == 2 + 60 and got[30, "30a"] == 2**29


def test_cycles_end_where_they_close(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4)], "child long, parent long")
    start = spark.createDataFrame([("x", 1), ("y", 4), ("y", 3)], "who string, node long")
    got = sorted(map(tuple, R.hierarchy(edges, start, 100, ("who",), once=True).select("who", "node", "level", "paths").collect()))
    assert got == [("x", 1, 0, 1), ("x", 2, 1, 1), ("x", 3, 2, 1), ("x", 4, 1, 1), ("y", 1, 1, 1), ("y", 2, 2, 1), ("y", 3, 0, 1), ("y", 4, 0, 1)]


RULE = "-" * 40 + "\n"
DASHED = " THE TITLE\n\n" + RULE + "Name              Amount\n" + RULE + "ring_and\ngear                 1,200\n=\nwheel                   20\n" + RULE


@pytest.mark.parametrize("flush", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_table_function_is_the_parser(spark, flush, exact):
    dotted = " LIST\n\n" + "".join(f"{n:.<30}  {a:>9}\n" for n, a in (("one_thing", "1,000"), ("two_things", "20"), ("three", "300")))
    texts = [DASHED, dotted, None, "", "no table here\n", DASHED + "\n\n" + dotted]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables.register(spark)
    got = spark.sql(f"SELECT doc_id, t.* FROM {{d}}, LATERAL drawn_tables(text, {str(flush).lower()}, {str(exact).lower()}) AS t", d=docs)
    options = tables.Options(flush, exact)
    want = [(i, *r) for i, t in enumerate(texts) for r in tables.records(t, options)]
    plain = lambda x: tuple(tuple(map(plain, v)) if isinstance(v, list) else tuple(plain(v)) if isinstance(v, tuple) else v for v in x) if isinstance(x, (tuple, list)) else x
    assert plain([tuple(r) for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.table_no))]) == plain(want) and len(want) >= 3
    whole = tables.parsed(docs, options)
    assert plain([tuple(r) for r in sorted(whole.collect(), key=lambda r: (r.document_id, r.table_no))]) == plain(want)
    assert whole.where("size(rows) = 0").count() + tables.rows_of(whole).select("document_id", "table_no").distinct().count() == tables.tables_of(whole).count()
