"""Summaries for a dashboard: totals by region and period, rates, top lists, quantile classes and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.relational import top_n


def pivot_counts(df: DataFrame, region: str, period: str, periods: list) -> DataFrame:
    """A row for each region with a count for each period, ``total`` over all."""
    t = df.groupBy(region).pivot(period, periods).agg(F.count(F.lit(1)))
    each = [F.coalesce(F.col(str(p)), F.lit(0)).alias(f"p{p}") for p in periods]
    return t.select(region, *each).withColumn("total", sum((F.col(f"p{p}") for p in periods), F.lit(0)))


def per_capita(df: DataFrame, population: DataFrame, region: str, columns: list[str], per: int = 10_000) -> DataFrame:
    return df.join(population, region).select(region, *columns, *((F.col(c) * per / F.col("population")).alias(f"{c}_pc") for c in columns))


def long_form(df: DataFrame, region: str, columns: list[str]) -> DataFrame:
    """``region, metric, value``: choose a metric and a period by filtering rows."""
    return df.unpivot([region], columns, "metric", "value")


def top_by(df: DataFrame, group: str, name: str, value: str, n: int = 5) -> DataFrame:
    return top_n(df, [group], [F.col(value).desc(), F.col(name)], n)


def quantile_breaks(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """One row: ``breaks``, the ends of classes with equal shares, interpolated between values."""
    return df.agg(F.percentile(value, F.array(*(F.lit(i / classes) for i in range(classes + 1)))).alias("breaks"))


def interval_of(value: Column, breaks: Column) -> Column:
    """1-based class of a value; the outer classes take what lies beyond."""
    inner = F.slice(breaks, 2, F.size(breaks) - 2)
    return F.size(F.filter(inner, lambda b: b <= value)) + 1


def interval_label(breaks: Column, k: Column, whole: bool = True) -> Column:
    """``a-b`` for a class, from ``a + 1`` on for whole numbers after the first; the last is open."""
    kind = "bigint" if whole else "decimal(18,2)"
    at = lambda i: F.element_at(breaks, i).cast(kind)
    start = at(k) + F.when((k > 1) & F.lit(whole), 1).otherwise(0)
    n = F.size(breaks) - 1
    return F.when(k == n, F.concat(F.lit("Greater than "), at(k).cast("string"))).otherwise(F.concat(start.cast("string"), F.lit("-"), at(k + 1).cast("string")))
