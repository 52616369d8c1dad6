"""Evaluation in DataFrames: confusion, curves, cross-validation summaries, feature ranking, error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import written


def confusion(df: DataFrame, y: str, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``tp, fp, fn, tn`` and what follows from them; work saved over sampling is (tn + fn) / n - (1 - recall)."""
    yes, said = F.col(y) == 1, F.col(p) == 1
    count = lambda c: F.sum(c.cast("long"))
    t = df.groupBy(*keys).agg(count(yes & said).alias("tp"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"), count(~yes & ~said).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    t = t.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("fpr", ratio(fp, fp + tn))
    pr, re = F.col("precision"), F.col("recall")
    return t.withColumn("f1", ratio(2 * pr * re, pr + re)).withColumn("wss", ratio(tn + fn, tp + fp + fn + tn) - (1 - re))


def _counted(df: DataFrame, y: str, score: str) -> DataFrame:
    """``score, p, n``: positives and others of each score; written, as quantiles, totals and sums all read it."""
    return written(df.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("n")), "scores")


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """``score, tpr, fpr`` at every threshold that occurs, ties together.

    Scores are counted first, so what is ordered has a row for each score; the
    running sums then go by ranges of scores, never through one task with all rows.
    """
    by = _counted(df, y, score)
    done = prefix_sums(by, "score", ["p", "n"], descending=True)
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    # One row of totals.
    return done.crossJoin(F.broadcast(total)).select("score", (F.col("sum_p") / F.col("all_p")).alias("tpr"), (F.col("sum_n") / F.col("all_n")).alias("fpr"))


def prefix_sums(df: DataFrame, order: str, values: list[str], descending: bool = False, bins: int = 256) -> DataFrame:
    """Running sums over all rows by ``order`` (distinct), as ``sum_<value>``.

    Rows are cut into ranges at approximate quantiles; sums run inside each range and
    the sums of the ranges before are added: no task holds all rows, whatever the
    quantiles' error.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / bins for i in range(1, bins)], 1000).alias("cuts"))
    cut = df.crossJoin(F.broadcast(cuts)).withColumn("_bin", F.size(F.filter("cuts", lambda c: c < F.col(order).cast("double"))))
    by = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy("_bin").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bin_order = F.col("_bin").desc() if descending else F.col("_bin").asc()
    totals = cut.groupBy("_bin").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    # At most as many rows as bins.
    before = Window.orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bin", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values))
    out = cut.join(F.broadcast(totals), "_bin")
    return out.select(*df.columns, *((F.sum(v).over(w) + F.col(f"_b_{v}")).alias(f"sum_{v}") for v in values))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve by ranks, ties counted half; a row with ``n_pos, n_neg, auc``."""
    done = prefix_sums(_counted(df, y, score), "score", ["n"])
    # Each positive beats the negatives below it, and half of those beside it.
    won = done.agg(F.sum(F.col("p") * (F.col("sum_n") - F.col("n") + F.col("n") / 2)).alias("won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return won.select("n_pos", "n_neg", (F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def cv_summary(folds: DataFrame, measures: list[str]) -> DataFrame:
    """Mean and population deviation over folds of each measure."""
    return folds.agg(*(x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))


def chi2(df: DataFrame, y: str, feature: str, value: Column | None = None) -> DataFrame:
    """``feature, chi2`` of non-negative feature values against the classes: observed sums by class against those that class sizes let expect.

    ``df`` has a row for each document and feature; ``df`` may carry documents without
    features as rows with a null feature.
    """
    value = F.lit(1.0) if value is None else value
    classes = df.select("doc_id", y).distinct().groupBy(y).agg(F.count("*").alias("n_class"))
    total = classes.agg(F.sum("n_class").alias("n_all"))
    sums = df.where(F.col(feature).isNotNull()).groupBy(feature, y).agg(F.sum(value).alias("seen"))
    every = sums.groupBy(feature).agg(F.sum("seen").alias("seen_all"))
    # Few classes: each feature meets each of them.
    grid = every.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(total))
    full = grid.join(sums, [feature, y], "left").withColumn("seen", F.coalesce("seen", F.lit(0.0)))
    expected = F.col("seen_all") * F.col("n_class") / F.col("n_all")
    return full.groupBy(feature).agg(F.sum((F.col("seen") - expected) ** 2 / expected).alias("chi2"), F.first("seen_all").alias("n"))


def top_percent(ranked: DataFrame, score: str, percents: tuple[int, ...] = (1, 3, 5, 7, 9)) -> DataFrame:
    """Rows of ``ranked`` once for each ``percent`` whose best share of rows they belong to; equals at the edge all stay.

    How many rows are better goes by running sums over the distinct scores.
    """
    by = ranked.groupBy(score).agg(F.count("*").alias("_n"))
    better = prefix_sums(by, score, ["_n"], descending=True).select(score, (F.col("sum__n") - F.col("_n")).alias("_better"))
    total = ranked.agg(F.count("*").alias("_all"))
    # One row of totals.
    placed = ranked.join(better, score).crossJoin(F.broadcast(total)).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return placed.where(F.col("_better") * 100 < F.col("percent") * F.col("_all")).drop("_better", "_all")


def errors(df: DataFrame, y: str, p: str, score: str, key: str, num: int = 1000) -> DataFrame:
    """``kind`` (FP, FN, TN, TP) and the first ``num`` of each kind by key, listed by score: wrong and sure first."""
    kind = F.when((F.col(y) == 0) & (F.col(p) == 1), "FP").when((F.col(y) == 1) & (F.col(p) == 0), "FN").when(F.col(y) == 0, "TN").otherwise("TP")
    cut = Window.partitionBy("kind").orderBy(key)
    first = df.withColumn("kind", kind).withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= num)
    signed = F.when(F.col("kind").isin("FP", "TN"), F.col(score)).otherwise(-F.col(score))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(signed, key))).select("kind", "place", key, score)
