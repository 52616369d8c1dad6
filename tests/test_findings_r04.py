"""What the findings of round 4 were about."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import relational
from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["links_scored", "student_pairs_scored"])
def test_no_block_is_left_out(spark, query):
    """the block with the key 0 is one like the others."""
    c = spark.read.parquet(f"{SF}/customer.parquet")
    first = c.where("c_nationkey = 0").select(F.col("c_custkey").alias("a"))
    assert first.count() > 1
    assert catalogue.queries()[query](spark, SF).join(first, "a", "left_semi").count() > 0
    assert "<> 0" not in catalogue.oracle_sql()[query]


def test_a_block_that_stands_for_none_is_named(spark):
    rows = spark.range(12).select("id", (F.col("id") % 3).alias("block"))
    assert relational.self_pairs(rows, "block", "id").count() == 18
    assert relational.self_pairs(rows, "block", "id", none=0).count() == 12


def records(spark, n=200):
    """Two blocks, values that repeat, and what counts for nothing."""
    kinds = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 5 % 3 + 1).cast("int"))
    return spark.range(n).select(
        "id", F.when(F.col("id") % 50 == 49, None).otherwise(F.col("id") * 5 % 7 % 2).alias("g"), F.when(F.col("id") % 17 == 3, None).otherwise(F.round(F.abs(F.sin("id")) * 9000, 0) / 100 - 30).alias("v"),
        F.when(F.col("id") % 23 == 4, None).otherwise(kinds).alias("m"),
    )


def test_sums_of_pairs_without_the_pairs(spark):
    """the same sums as those over all pairs."""
    from docloom.operators import distances, grouped

    r = records(spark)
    x, y, fold = F.abs(F.col("a.v") - F.col("b.v")) / 10, (F.col("a.m") == F.col("b.m")).cast("int"), (F.col("a.id") + F.col("b.id")) % 3
    pairs = relational.self_pairs(r, "g", "id").select(F.col("block").alias("g"), x.alias("x"), y.alias("y"), fold.alias("fold"))
    want = {(s["group"], s["fold"]): s["sums"] for s in grouped.products(pairs, "g", ["x"], "y", "fold").collect()}
    got = {(s["group"], s["fold"]): s["sums"] for s in distances.sums(r, "g", "id", "v", "m", 10, 3).collect()}
    assert set(got) == set(want) and len(want) == 9
    for k, sums in want.items():
        assert got[k] == pytest.approx(sums, rel=1e-11)
    assert distances.countable(r, "g", "id") and not distances.countable(r.unionAll(r), "g", "id") and not distances.countable(r.withColumn("id", F.col("id") - 1), "g", "id")


def test_pairs_of_a_block_are_made_once(spark):
    """whatever the parts, each pair once, spread over tasks; equal keys make none."""
    r = records(spark).unionAll(records(spark, 7))
    want = sorted((a.id, b.id) for a in r.collect() for b in r.collect() if a.g is not None and a.g == b.g and a.id < b.id)
    for part in (9, 1000):
        got = relational.self_pairs(r, "g", "id", part=part).select("a.id", F.col("b.id").alias("b"), F.spark_partition_id().alias("task")).collect()
        assert sorted((p.id, p.b) for p in got) == want
        assert len({p.task for p in got}) > (10 if part == 9 else 0)


def test_scores_are_rounded_as_sql_does(spark):
    """F2: no decimal number is made of each score."""
    import duckdb

    from docloom.operators import distances

    values = [0.5e-6, 1.5e-6, -2.5e-6, 0.49999999999999994e-6, 1e-7, -0.123456500000, 0.1234565, 1234.9999995, float("nan"), float("inf"), None, 0.0]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", distances.rounded(F.col("v"), 6).alias("v")).orderBy("i").collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))
    query = catalogue.queries()["student_pairs_scored"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rint(" in query.lower() and "round(" not in query


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_best_links_without_a_shuffle_of_pairs(spark, most):
    """as by scoring, cutting and numbering all pairs; also with blocks that are too large for one task."""
    from docloom.operators import distances, linkage

    odd = F.when(F.col("id") == 11, float("nan")).when(F.col("id") == 12, float("inf"))
    for r in (records(spark), records(spark).unionAll(records(spark, 9)), records(spark).withColumn("v", F.coalesce(odd, "v")), records(spark, 0)):
        r = r.withColumn("w", F.when(F.col("g") == 1, F.array(F.lit(-0.3), F.lit(0.25))).otherwise(F.array(F.lit(0.2), F.lit(-1.9))))
        p = relational.self_pairs(r, "g", "id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distances.rounded(F.col("a.w")[1] + F.col("a.w")[0] * (F.abs(F.col("a.v") - F.col("b.v")) / 10), 1).alias("score"))
        want = linkage.with_rank(p.where("score > -0.6"), ["a"], "score", ["b"], "place").select("a", "place", "b", "score")
        got = distances.best_links(r, "g", "id", "v", "w", 10, -0.6, 1, most)
        shown = lambda df: sorted((x.a, x.place, x.b, repr(x.score + 0.0)) for x in df.collect())
        assert shown(got) == shown(want) and got.columns == want.columns


def test_links_are_ranked_where_they_are_scored(spark):
    query = catalogue.queries()["links_scored"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = query.split("MapInArrow")[0]
    assert "MapInArrow" in query and "Exchange" not in above and "Window" not in above


def test_ranked_records_are_held_block_by_block():
    """runs of rows go over the borders of batches."""
    import pyarrow as pa

    from docloom.operators import distances

    batches = [pa.RecordBatch.from_pydict({"block": b, "of": p, "id": list(range(len(b)))}) for b, p in (([1, 1, 1], [0, 0, 1]), ([], []), ([1, 2], [1, 1]), ([2, 2], [1, 1]))]
    batches[1] = batches[0].slice(0, 0)
    assert [t.num_rows for t in distances._runs(iter(batches))] == [2, 2, 3]


def test_features_are_made_for_classes_not_for_pairs(spark):
    """F3"""
    from docloom.operators import linkage

    query = catalogue.queries()["pair_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = query.split("Generate explode(as")[0]
    assert "Generate explode(as" in query and "array_intersect" not in above and "round" not in above and "array_intersect" in query
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("block"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("kind"))
    left, right = linkage.classes(rows, ["block", "kind"], "id", "as", part=4), linkage.classes(rows, ["block"], "id", "bs", part=4)
    assert left.count() == 20 and right.count() == 16
    met = linkage.class_pairs(left, right, ["block"], "as", "bs").withColumn("made", F.coalesce(F.col("kind"), F.lit(-1)))
    got = linkage.of_classes(met, "as", "bs", "a", "b").where("a < b")
    assert sorted((r.a, r.b, r.made) for r in got.collect()) == sorted((a, b, a % 5 or -1) for a in range(60) for b in range(a + 2, 60, 2))


def test_states_cities_and_sponsors_of_drawn_rows(spark):
    """what the drawn tables say reaches the features, the state and the sponsors; it was the same for all rows before."""
    from docloom.operators import scoring, tables
    from docloom.plans import text

    got = catalogue.queries()["score_documents"](spark, SF).toPandas()
    said = got["row"].str.split(r" \| ", regex=True)
    assert (said.str.len() == 4).all()
    state = said.str[3].map({"red": "RD", "small": "SM"})
    assert set(got["state"].dropna()) == {"RD", "SM"} and (got["state"].fillna("") == state.fillna("")).all()
    named = said.str[2].isin(["ring", "gear"]).groupby(got["document_id"]).transform("mean") > 0.1
    assert 0 < named.mean() < 1 and (got["sponsors"] == said.str[2].where(named, "")).all()
    rows = tables.extract_rows(text._drawn_requests(spark, SF))
    cities = spark.createDataFrame([("anvil",), ("bolt",)], "city string")
    f = scoring.row_features(rows, F.array(F.lit("ring")), scoring.Places(F.array(F.lit("red")), F.array(F.lit("RD")), cities))
    for group, name in (("geo", "GEO_HAS_STATE"), ("geo", "GEO_ENDS_WITH_STATE"), ("geo", "GEO_HAS_CITY"), ("sponsor", "SPONSOR_PRESENT")):
        assert {r[0] for r in f.select(F.element_at(group, name)).distinct().collect()} == {0.0, 1.0}


def test_rows_are_not_shuffled_for_cities_and_sponsors(spark):
    """the same cities and sponsors as by distinct, grouping and joins."""
    from docloom.functions import names as N
    from docloom.operators import scoring, tables

    cells = [["Lee", "9", "Kim; Lee"], ["x", "8", ""], ["Kim", "7", "Kim, x"], ["Lee:Kim", "6", None]]
    records = [(1, 0, "dots", cells), (1, 1, "dots", [["a"], ["b"]]), (2, 0, "dashes", [["Lee", "Kim", "Lee", "x"], ["Kim", "x", "Lee", "Kim"]]), (3, 0, "dots", []), (4, 0, "dots", [[], ["Lee"]])]
    made = [(d, t, k, [(i, " | ".join(x or "" for x in c), 0, 1, "", c) for i, c in enumerate(rows)]) for d, t, k, rows in records]
    parsed = spark.createDataFrame(made, f"document_id long, table_no int, kind string, {tables.TABLES[tables.TABLES.index('rows array') :]}")
    names = F.array(F.lit("Lee"), F.lit("Kim"))
    got, rows = scoring.rows_with_sponsors(parsed, names), tables.rows_of(parsed)
    want = scoring.with_sponsors(rows, names)
    shown = lambda df: sorted((r.document_id, r.table_no, r.row_no, r.entity_text, list(r.sponsors)) for r in df.collect())
    assert shown(got) == shown(want) and any(r[-1] for r in shown(want))
    cities = spark.createDataFrame([("Kim",), ("x |",), (None,), ("",), ("lee",)], "city string")
    hits = {tuple(r.k) for r in N.named_in(rows.withColumn("k", F.struct("document_id", "table_no", "row_no")), "k", "entity_text", cities, "city").select("k").collect()}
    for most in (1 << 19, 4):
        marked = N.with_named(rows, "entity_text", cities, "city", "there", most)
        assert {(r.document_id, r.table_no, r.row_no) for r in marked.where("there").collect()} == hits and marked.count() == rows.count()
    query = scoring.row_features(got, names, scoring.Places(names, names, cities))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in query and "Exchange" not in query


def test_tokens_of_a_row_are_made_once(spark):
    """and of the counts only those that the model reads, with the values that they have among all."""
    from docloom.operators import features, scoring

    rows = spark.createDataFrame([(1, 0, 0, "Red_ring | 1,200 | For the Lee"), (1, 0, 1, ""), (1, 0, 2, "for x.. 9"), (1, 0, 3, None)], "document_id long, table_no int, row_no int, entity_text string")
    names = F.array(F.lit("Lee"))
    f = scoring.row_features(rows, names, scoring.Places(names, names, spark.createDataFrame([("ring",)], "city string")))
    assert f._jdf.queryExecution().optimizedPlan().toString().count(r"regexp_replace(regexp_replace(replace(entity_text") <= 1
    c = F.col("entity_text")
    for r in f.withColumn("all", features.simple_text(c)).withColumn("words", features.unigram_bag(c)).collect():
        assert r["simple"] == {k: r["all"][k] for k in scoring.ROW_VECTORS.dense["simple"]} and r["unigrams"] == r["words"]
