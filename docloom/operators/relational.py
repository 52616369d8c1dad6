"""Relational building blocks: dedupe, latest and most complete rows, intervals, runs, folds, samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import written


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def most_complete(df: DataFrame, key: str, fields: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key with the most fields set; the first of equals."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return keep_first(df.withColumn("n_set", filled), [key], [F.col("n_set").desc(), *order])


def latest(df: DataFrame, key: str, version: str, date: str) -> DataFrame:
    """The version of the latest date; of equal dates the least version, whatever its type."""
    last = df.groupBy(key).agg(F.max(date).alias(date))
    return df.join(last, [key, date]).groupBy(key, date).agg(F.min(version).alias(version)).select(key, version, date)


def _bin(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("bigint")


def inside(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float = 1000) -> DataFrame:
    """Points strictly between the ends of intervals with the same key.

    An equi-join on the key and a bin of ``width``, which intervals enter for each bin that they reach into; a key
    of any size costs its points and what lies near them. ``width`` is best near the usual length.
    """
    bins = F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))
    wide = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    met = points.withColumn("_bin", _bin(F.col(at), width)).join(wide, [key, "_bin"])
    return met.where((F.col(at) > F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def band(df: DataFrame, key: str, at: str, kind: str, before: float, after: float, of_kind: str) -> DataFrame:
    """Rows of ``of_kind`` with rows of other kinds of the same key from ``before`` below to ``after`` above; met by key and bin."""
    a = df.where(F.col(kind) == of_kind).select(key, *(F.col(c).alias(f"{c}_a") for c in df.columns if c != key))
    b = df.where(F.col(kind) != of_kind).select(key, *(F.col(c).alias(f"{c}_b") for c in df.columns if c != key))
    width = max(before + after, 1)
    bins = F.sequence(_bin(F.col(f"{at}_a") - before, width), _bin(F.col(f"{at}_a") + after, width))
    met = a.withColumn("_bin", F.explode(bins)).join(b.withColumn("_bin", _bin(F.col(f"{at}_b"), width)), [key, "_bin"])
    return met.where(F.col(f"{at}_b").between(F.col(f"{at}_a") - before, F.col(f"{at}_a") + after)).drop("_bin")


def runs(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Runs of consecutive numbers: ``first, last, length`` of each."""
    w = Window.partitionBy(*keys).orderBy(n)
    marked = df.select(*keys, n).distinct().withColumn("_run", F.col(n) - F.row_number().over(w))
    return marked.groupBy(*keys, "_run").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length")).drop("_run")


def running_offset(df: DataFrame, keys: list[str], order: list[str], length: Column) -> DataFrame:
    """``offset``: the sum of lengths before the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def hash_order(key: str, seed: str) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def sample_exact(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows by a hash of their key: a top-k, without a full sort."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: str = "f", strata: int = 64) -> DataFrame:
    """``fold``: place in the shuffled class, modulo ``k``."""
    placed = with_place(df, label, key, seed, strata)
    return placed.withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def with_place(df: DataFrame, label: str, key: str, seed: str = "f", strata: int = 64) -> DataFrame:
    """``place``: 0-based, in the shuffled class.

    Places are counted in ``strata`` parts of each class, cut by the first digits
    of the hash, and shifted by the sizes of the parts before: a class as large
    as the table is still spread over tasks.
    """
    # Parts must follow the order of the hash, so they are ranges of its first byte.
    h = df.withColumn("_h", hash_order(key, seed)).withColumn("_part", F.floor(F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") * strata / 256))
    sizes = h.groupBy(label, "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    w = Window.partitionBy(label, "_part").orderBy("_h", key)
    return h.join(before, [label, "_part"]).withColumn("place", F.row_number().over(w) - 1 + F.col("_before")).drop("_h", "_part", "_before")


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Natural-log entropy of a column's values in each group."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.sum(F.col("_n") * F.ln("_n")).alias("_nln"))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    return total.select(*keys, (F.ln("_total") - F.col("_nln") / F.col("_total")).alias("entropy"))


def page_categories(pages: DataFrame, links: DataFrame, namespace: int = 0) -> DataFrame:
    """``page_title, category`` of the pages of a namespace, by the links from their ids."""
    of = pages.where(F.col("page_namespace") == namespace).select("page_id", "page_title")
    return of.join(links.select(F.col("cl_from").alias("page_id"), F.col("cl_to").alias("category")), "page_id").select("page_title", "category")


def entity_pages(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities with ``wikipedia_page``: the one mapped to their id, else to their text, else null; the first by name of several."""
    by_id = mapping.where("entity_id is not null").groupBy("entity_id").agg(F.min("wikipedia_page").alias("_by_id"))
    by_text = mapping.where("entity_text is not null").groupBy("entity_text").agg(F.min("wikipedia_page").alias("_by_text"))
    out = entities.join(by_id, "entity_id", "left").join(by_text, "entity_text", "left")
    return out.withColumn("wikipedia_page", F.coalesce("_by_id", "_by_text")).drop("_by_id", "_by_text")


def hierarchy(edges: DataFrame, start: DataFrame, depth: int, keep: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """``level, *keep, node, paths``: parents of parents, level by level, with the number of paths that lead to each.

    ``edges(child, parent)``, ``start(node, *keep)``. A level has a row for each node that it reaches (for each value of ``keep``), however many
    paths lead there: they are counted by partial aggregation, not carried along. With ``once``, a node that an earlier level has is not
    gone through again, so a cycle ends where it closes, and the search ends at the level that brings nothing new. Levels are written as they are found.
    A null node has no parents.
    """
    keys = [*keep, "node"]
    up = edges.select(F.col("child").alias("node"), "parent")
    level = written(start.groupBy(*keys).agg(F.count("*").alias("paths")), "level")
    found = [level.withColumn("level", F.lit(0))]
    for k in range(1, depth + 1):
        level = level.join(up, "node").select(*keep, F.col("parent").alias("node"), "paths").groupBy(*keys).agg(F.sum("paths").alias("paths"))
        if once:
            level = level.join(reduce(DataFrame.unionAll, (f.select(*keys) for f in found)), keys, "left_anti").select(*keys, "paths")
        level = written(level, "level")
        if once and level.isEmpty():
            break
        found.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionAll, found).select("level", *keys, "paths")


def numbered(df: DataFrame, order: str, ties: list[str], name: str = "index", first: int = 0, bins: int = 256) -> DataFrame:
    """Numbers from ``first`` on by the numeric column ``order``, then ``ties``.

    Rows are cut into ranges at approximate quantiles; numbers run inside each range and are shifted by the sizes of the ranges before, so
    no task holds all rows. ``df`` is read three times.
    """
    at = F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(at, [i / bins for i in range(1, bins)], 1000)).first()[0] or []
    ends = [-math.inf, *(sorted({c for c in cuts if math.isfinite(c)}) or [0.0]), math.inf]
    # Bins are found by bisection, which a filter over all cuts would not do; what is null comes first, what is no number last.
    cut = Bucketizer(splits=ends, inputCol="_at", outputCol="_bin", handleInvalid="keep").transform(df.withColumn("_at", at)).withColumn("_bin", F.coalesce("_bin", F.lit(0.0)).cast("int")).drop("_at")
    sizes = cut.groupBy("_bin").agg(F.count("*").alias("_n"))
    # At most as many rows as bins.
    before = sizes.select("_bin", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_bin").orderBy(order, *ties)
    return cut.join(F.broadcast(before), "_bin").withColumn(name, (F.row_number().over(w) - 1 + first + F.col("_before")).cast("long")).drop("_bin", "_before")


def self_pairs(df: DataFrame, block: str, key: str, none: int | None = None, part: int | None = None) -> DataFrame:
    """Unordered pairs of records of one block, as structs ``a`` and ``b`` with ``a.key < b.key``; the block ``none`` stands for no block and has no pairs.

    A block is cut into parts of ``part`` records in the order of their keys. A part meets itself and each part after it in a cell of its own, so no pair is made twice to be dropped; in
    a cell the one side goes by as rows, the other as an array. Sizes are counted before; the number of tasks is that of cells, within bounds.
    """
    part = part or PART
    rows = df.where(F.col(block).isNotNull() & F.col(key).isNotNull())
    if none is not None:
        rows = rows.where(F.col(block) != none)
    packed = rows.select(F.col(block).alias("block"), F.struct(*df.columns).alias("r"))
    cells = packed.groupBy("block").agg(F.ceil(F.count("*") / part).alias("k")).agg(F.sum(F.col("k").cast("double") * (F.col("k") + 1) / 2)).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = int(max(cores, min(cells, TASKS * cores)))
    whole = Window.partitionBy("block")
    cut = packed.select("block", "r", F.floor((F.row_number().over(whole.orderBy(f"r.{key}")) - 1) / part).cast("int").alias("_p"), (F.ceil(F.count("*").over(whole) / part) - 1).cast("int").alias("_last"))
    a = cut.select("block", F.col("r").alias("a"), F.col("_p").alias("_i"), F.explode(F.sequence("_p", "_last")).alias("_j"))
    b = cut.groupBy("block", F.col("_p").alias("_j")).agg(F.collect_list("r").alias("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_j")))  # a part in an array
    keys = ["block", "_i", "_j"]
    met = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys).hint("merge"), keys)
    return met.select("block", "a", F.explode("_b").alias("b")).where(F.col(f"a.{key}") < F.col(f"b.{key}"))


#: Rows of a block's part, and tasks of :func:`self_pairs` and :func:`dealt_pairs` for each core, at most.
PART, TASKS = 2000, 32


def dealt_pairs(left: DataFrame, right: DataFrame, block: list[str], left_key: Column, right_key: Column, part: int = PART, left_n: Column | int = 1, right_n: Column | int = 1) -> DataFrame:
    """``left`` and ``right`` joined on ``block``, a large block dealt to many tasks.

    The pairs of a block are its size squared, while what a task reads tells nothing of it. So a block is cut into parts of about ``part`` rows by its sides'
    keys, and each part of the one side meets each of the other in a cell of its own. Sides are cut each by its own size, as a row goes along once for each part of the
    other side. Sizes are counted before; the number of tasks is that of cells, within bounds. A row that stands for several counts as ``left_n`` or ``right_n``.
    """
    own_n = lambda n, name: (F.lit(n) if isinstance(n, int) else n).cast("long").alias(name)
    sides = left.select(*block, own_n(left_n, "_l"), own_n(0, "_r")).unionAll(right.select(*block, own_n(0, "_l"), own_n(right_n, "_r")))
    sizes = sides.groupBy(*block).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where("_l > 0 and _r > 0")
    parts = sizes.select(*block, *(F.ceil(F.col(n) / part).cast("int").alias(f"_k{n}") for n in ("_l", "_r")))
    cells = parts.agg(F.sum(F.col("_k_l").cast("double") * F.col("_k_r"))).first()[0] or 0
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks = int(max(cores, min(cells, TASKS * cores)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(parts.hint("merge"), block).withColumn("_i", own(left_key, "_k_l")).withColumn("_j", each("_k_r")).drop("_k_l", "_k_r")
    b = right.join(parts.hint("merge"), block).withColumn("_j", own(right_key, "_k_r")).withColumn("_i", each("_k_l")).drop("_k_l", "_k_r")
    keys = [*block, "_i", "_j"]
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys).hint("merge"), keys).drop("_i", "_j")
