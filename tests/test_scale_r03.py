"""Work that must not grow with copies, and plans that must not go through the driver."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import grouped, linkage, matching, relational, tables
from docloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def copies(spark):
    items = spark.range(40).select(F.col("id").alias("item_id"), F.lit("red small ring").alias("a"), F.when(F.col("id") < 30, "ring of gold").otherwise("bolt").alias("b"))
    links = spark.range(40).select(F.col("id").alias("item_id"), F.lit("d").alias("document_id"), (F.col("id") + 100).alias("id"))
    entities = spark.range(50).select(F.lit("d").alias("document_id"), F.col("id").alias("entity_id"), F.when(F.col("id") < 20, "Red small | ring").otherwise("gold bolt ring of gold").alias("entity_inferred_name"))
    return items, links, entities


def test_matches_of_copies_are_compared_once(copies):
    found = matching.class_pairs(*copies, ["a", "b"])
    assert sorted((r.n, round(r.score, 3)) for r in found.scored.collect()) == [(200, 1.0), (600, 1.0), (900, 0.5)]
    got = matching.scored_pairs(*copies, ["a", "b"]).collect()
    assert len(got) == len({(r.item_id, r.entity_id) for r in got}) == 1700
    best = matching.rule_matches(*copies, ["a", "b"])
    assert sorted((r.item_id, r.entity_id) for r in best.collect()) == [(i, e) for i in range(40) for e in range(20)]
    by = linkage.by_best(found.scored, "document_id", "score", "document_id", "n").collect()
    assert [(r.document_id, r.best, r.n, r.place) for r in by] == [("d", 1.0, 800, 0)]


def test_matches_are_not_broadcast(copies):
    assert "Broadcast" not in plan(matching.rule_matches(*copies, ["a", "b"]))
    assert "Broadcast" not in plan(matching.to_store(matching.rule_matches(*copies, ["a", "b"]), copies[1]))


def test_table_function_takes_a_table_in_batches(spark):
    dotted = " LIST\n\n" + "".join(f"{n:.<30}  {a:>9}\n" for n, a in (("one_thing", "1,000"), ("two_things", "20"), ("three", "300")))
    rule = "-" * 40 + "\n"
    dashed = " THE TITLE\n\n" + rule + "Name              Amount\n" + rule + "ring_and\ngear                 1,200\n=\nwheel                   20\n" + rule
    texts = [dashed, dotted, None, "", "no table\n", dashed + "\n\n" + dotted]
    docs = spark.createDataFrame([(i, t, f) for f in (False, True) for i, t in enumerate(texts)], "doc_id long, text string, flush_last_run boolean")
    tables.register(spark)
    got = spark.sql("SELECT flush_last_run, document_id, table_no, kind, size(rows) AS n, rows[0].entity_text AS first FROM drawn_tables_of(TABLE({d}))", d=docs)
    want = [(f, i, t[0], t[3], len(t[8]), t[8][0][1]) for f in (False, True) for i, x in enumerate(texts) for t in tables.records(x, tables.Options(f))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 8
    for query in ("dashed_tables_sql", "dotted_tables_sql"):
        assert "drawn_tables_of" in plan(catalogue.queries()[query](spark, "/root/testdata/sf0.001"))


def test_a_title_is_read_upwards_only():
    parts = [tables.Paragraph(["first\n"], 0, 6)] + [tables.Paragraph([f" line {k}\n"], 0, 8) for k in range(3)] + [tables.Paragraph(["x  1\n"], 0, 5)]
    assert tables.title_of(parts, 4) == [" line 0\n", " line 1\n", " line 2\n"]
    assert tables.title_of(parts, 1) == tables.title_of([tables.Paragraph([" only\n"], 0, 6)] + parts[4:], 1) == []


def test_pairs_of_a_large_block_are_dealt(spark):
    rows = spark.range(60).select(F.col("id"), F.when(F.col("id") < 50, 1).otherwise(F.col("id")).cast("int").alias("block"))
    left, right = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    met = relational.dealt_pairs(left, right, ["block"], F.col("a"), F.col("b"), part=10)
    got = met.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in got) == sorted([(a, b) for a in range(50) for b in range(50)] + [(k, k) for k in range(50, 60)])
    assert len({r.task for r in got if r.block == 1}) > 3
    pairs = relational.self_pairs(rows, "block", "id")
    assert pairs.count() == 50 * 49 // 2


def test_weights_do_not_depend_on_the_order_of_sums(spark):
    rows = spark.range(3000).select(F.lit("g").alias("g"), (F.abs(F.sin("id")) * 9).alias("x"), (F.col("id") % 7 < 3).cast("int").alias("y"), (F.col("id") % 3).alias("fold"))
    found = {tuple(m.weights) for n in (1, 3, 8) for m in grouped.fit(rows.repartition(n, "x"), "g", ["x"], "y", "fold", digits=9).where("group = 'g'").collect()}
    assert len(found) == 1 and all(round(w, 9) == w for w in found.pop())


def test_pairs_are_not_shuffled_for_their_models(spark):
    query = plan(catalogue.queries()["student_pairs_scored"](spark, "/root/testdata/sf0.001"))
    # The last join is that which makes the pairs; a join with the models came after it before.
    last = next(line for line in query.split("\n") if "Join" in line)
    assert "SortMergeJoin" in last and "_i#" in last and "_j#" in last
    assert "Exchange" not in query.split(last)[0]
