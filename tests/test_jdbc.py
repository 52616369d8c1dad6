"""A database read in ranges and appended to: the embedded one that comes with Spark, in memory, inside the driver."""

import uuid

import pytest
from pyspark.sql import functions as F

from docloom.operators.linkage import append_new
from docloom.sources import readers, writers


@pytest.fixture
def url(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


@pytest.fixture
def items(spark):
    return spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 != 0, (2005 + F.col("id") % 7).cast("int")).alias("year"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("name"))


def test_ranges_hold_every_row_once(spark, url, items):
    writers.jdbc_append(items, url, "ITEMS", connections=3, batch=100)
    want = sorted(map(tuple, items.collect()))
    for column, parts in (("id", 5), ("year", 3)):  # a tenth of the years is missing
        read = readers.jdbc_ranges(spark, url, "ITEMS", column, parts)
        assert read.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, read.collect())) == want
    sizes = readers.jdbc_ranges(spark, url, "ITEMS", "id", 5).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and all(195 <= x["count"] <= 205 for x in sizes)


def test_filters_and_columns_reach_the_database(spark, url, items):
    writers.jdbc_append(items, url, "ITEMS")
    for read in (readers.jdbc_ranges(spark, url, "ITEMS", "id", 4), readers.jdbc(spark, url, 'SELECT "id", "year", "name" FROM ITEMS WHERE "id" < 500')):
        few = read.where("year = 2007 AND id < 100").select("id")
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(year,2007)" in plan and "LessThan(id,100)" in plan and "name" not in plan.split("ReadSchema")[1]
        assert sorted(x.id for x in few.collect()) == [i for i in range(100) if i % 7 == 2 and i % 10]


def test_a_second_append_of_what_is_missing_adds_nothing(spark, url, items):
    writers.jdbc_append(items.where("id < 600"), url, "ITEMS", createTableColumnTypes="name VARCHAR(2048)")
    for _ in range(2):
        there = readers.jdbc_ranges(spark, url, "ITEMS", "id", 4).select("id")
        writers.jdbc_append(append_new(there, items, ["id"]), url, "ITEMS")
    assert sorted(map(tuple, readers.jdbc_ranges(spark, url, "ITEMS", "id", 4).collect())) == sorted(map(tuple, items.collect()))
    # Texts of a bounded type can be compared by the database.
    assert readers.jdbc_ranges(spark, url, "ITEMS", "id", 4).where("name = 'item 7'").count() == 1


def test_tables_of_no_row_of_one_value_and_of_null(spark, url, items):
    for name, rows in (("T_NONE", items.where("false")), ("T_ONE", items.where("id = 3").union(items.where("id = 3"))), ("T_NULL", items.where("year IS NULL").withColumn("year", F.lit(None).cast("int")))):
        writers.jdbc_append(rows, url, name)
        assert sorted(map(tuple, readers.jdbc_ranges(spark, url, name, "year", 4).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
