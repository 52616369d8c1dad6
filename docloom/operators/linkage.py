"""Record linkage: candidate pairs that share a shingle, similarity, ranks and differences, choice of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.relational import PART, dealt_pairs, numbered
from docloom.session import written

#: Sentinel for a missing group key.
MISSING = "GROUP_BY_ATTRIBUTE_MISSING"


#: Shingles of the left side that are sent to all workers, at most; counted before.
SENT = 1_000_000


def shingled(df: DataFrame, key: str, c: Column, n: int) -> DataFrame:
    """``key, grams``: the distinct shingles of each text."""
    return df.select(F.col(key), T.tokens(T.normalize(c)).alias("words")).select(key, T.shingles(F.col("words"), n).alias("grams"))


def exploded(df: DataFrame) -> DataFrame:
    """A row for each shingle of ``grams``, as ``gram``.

    Not a plain ``explode``: the optimizer would have it skip empty arrays by a filter below it, which works the array out once
    more, with all that it is made of written out.
    """
    rest = [c for c in df.columns if c != "grams"]
    return df.select(*rest, F.explode_outer("grams").alias("gram")).where("gram is not null")


def candidate_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str = "text", right_text: str = "text", n: int = 2) -> DataFrame:
    """Pairs that share a shingle, with ``shared``, ``jaccard`` and ``containment`` (of the left text in the right).

    An inverted index: both sides are exploded and joined on the shingle, so no
    pair without one is ever made, and intersections are counted by partial
    aggregation. Set sizes travel with the rows; no set is compared with
    another. Where the left side has few different shingles (``SENT``), the right side's are
    held against their hashes before they are shuffled.
    """
    a = exploded(shingled(left, left_key, F.col(left_text), n).select(left_key, F.size("grams").alias("n_left"), "grams"))
    b = exploded(shingled(right, right_key, F.col(right_text), n).select(right_key, F.size("grams").alias("n_right"), "grams"))
    hashes = a.select(F.xxhash64("gram").alias("hash")).distinct()
    if hashes.limit(SENT + 1).count() <= SENT:
        b = b.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(hashes), "hash", "left_semi").drop("hash")
    shared = a.join(b, "gram").groupBy(left_key, right_key).agg(F.count("*").alias("shared"), F.first("n_left").alias("n_left"), F.first("n_right").alias("n_right"))
    union = F.col("n_left") + F.col("n_right") - F.col("shared")
    return shared.select(left_key, right_key, "shared", (F.col("shared") / union).alias("jaccard"), (F.col("shared") / F.col("n_left")).alias("containment"))


def block_pairs(left: DataFrame, right: DataFrame, block: list[str], left_key: str, right_key: str) -> DataFrame:
    """All pairs of records of one block: an equi-join on the block's key, large blocks dealt to many tasks by the sides' keys."""
    return dealt_pairs(left, right, block, F.col(left_key), F.col(right_key))


def classes(df: DataFrame, fields: list[str], key: str, into: str, part: int = PART) -> DataFrame:
    """A row for each class of rows that are equal in ``fields``, with their keys as the array ``into``; a class of more than ``part`` rows is several. Rows without a key are in none."""
    n = F.row_number().over(Window.partitionBy(*fields).orderBy(key)) - 1
    cut = df.where(F.col(key).isNotNull()).select(*fields, key, F.floor(n / part).cast("int").alias("_part"))
    return written(cut.groupBy(*fields, "_part").agg(F.collect_list(key).alias(into)).drop("_part"), "classes")  # they are counted before they meet


def class_pairs(left: DataFrame, right: DataFrame, block: list[str], left_keys: str, right_keys: str) -> DataFrame:
    """All pairs of :func:`classes` of one block, dealt by how many rows they stand for: what is made of their fields is made once for all pairs of their rows, which :func:`of_classes` gives."""
    return dealt_pairs(left, right, block, F.get(left_keys, F.lit(0)), F.get(right_keys, F.lit(0)), left_n=F.size(left_keys), right_n=F.size(right_keys))


def of_classes(pairs: DataFrame, left_keys: str, right_keys: str, left_key: str, right_key: str) -> DataFrame:
    """The pairs of rows of pairs of classes."""
    rest = [c for c in pairs.columns if c not in (left_keys, right_keys)]
    return pairs.select(F.explode(left_keys).alias(left_key), right_keys, *rest).select(left_key, F.explode(right_keys).alias(right_key), *rest)


def group_key(*keys: Column) -> list[Column]:
    return [F.coalesce(k.cast("string"), F.lit(MISSING)) for k in keys]


def groups(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    """``signature, n, first, last`` of the rows that share a composite signature: how many, the least and the largest of their keys. A null is a value of its own."""
    return df.groupBy(F.concat_ws("|", *group_key(*map(F.col, keys))).alias("signature")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def by_best(matches: DataFrame, key: str, score: str, ties: str, weight: str | None = None) -> DataFrame:
    """``key, best, n, place``: the largest score of each key and how many rows have it, numbered from 0 by descending score, then by ``ties`` (a column that the key determines).

    A row counts ``weight`` times, if that is given. Rows are counted by score first, so a key's rows never meet in one task.
    """
    n = F.sum(weight) if weight else F.count("*")
    sizes = matches.where(F.col(score).isNotNull()).groupBy(key, score).agg(n.alias("_n"), F.min(ties).alias("_ties"))
    best = sizes.groupBy(key).agg(F.max(score).alias("best"), F.max_by("_n", score).alias("n"), F.min("_ties").alias("_tie"))
    return numbered(written(best.withColumn("_down", -F.col("best")), "best"), "_down", ["_tie", key], name="place").select(key, "best", "n", "place")


def with_rank(df: DataFrame, keys: list[str], feature: str, ties: list[str], name: str | None = None, descending: bool = True) -> DataFrame:
    """0-based place within the group by the feature; ``ties`` settle equal values."""
    order = F.col(feature).desc() if descending else F.col(feature).asc()
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    return df.withColumn(name or f"rank_{feature}", F.row_number().over(w) - 1)


def with_difference(df: DataFrame, keys: list[str], feature: str, name: str | None = None) -> DataFrame:
    """The value less the group's largest."""
    return df.withColumn(name or f"difference_{feature}", F.col(feature) - F.max(feature).over(Window.partitionBy(*keys)))


def best_with_ties(df: DataFrame, keys: list[str], feature: str, threshold: float | None = None) -> DataFrame:
    """Rows that share the group's largest value, above the threshold."""
    if threshold is not None:
        df = df.where(F.col(feature) > threshold)
    w = Window.partitionBy(*keys).orderBy(F.col(feature).desc())
    return df.withColumn("place", F.rank().over(w)).where("place = 1").drop("place")


def auto_label(score: Column, sure: float = 0.8, none: float = 0.05) -> Column:
    """What a score decides without a reader."""
    return F.when(score >= sure, "match").when(score <= none, "skip").otherwise("ask")


def consecutive_no(df: DataFrame, keys: list[str], order: list[str], yes: Column) -> DataFrame:
    """``run``: how many answers in a row, up to this one, were no. Two prefix sums; no loop."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_stretch", F.sum(yes.cast("int")).over(w)).withColumn("_no", F.when(yes, 0).otherwise(1))
    run = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("run", F.sum("_no").over(run)).drop("_stretch", "_no")


def _similar_to(grams: Column):
    return lambda cell: T.jaccard(T.shinglize(cell), grams)


def _inside(text: Column):
    return lambda cell: F.contains(text, cell)


def with_cells(records: DataFrame, entity: str) -> DataFrame:
    """``cells`` and ``entity_grams`` of an entity's record, for :func:`cell_features`: made before pairs are, once for each record."""
    return records.withColumn("cells", F.transform(T.cells(F.col(f"{entity}_raw")), T.normalize)).withColumn("entity_grams", T.shinglize(F.col(entity)))


def with_grams(records: DataFrame, texts: list[str]) -> DataFrame:
    """``<text>_grams`` of an item's record, for the same."""
    return records.withColumns({f"{t}_grams": T.shinglize(F.col(t)) for t in texts})


def cell_features(pairs: DataFrame, entity: str, texts: list[str]) -> DataFrame:
    """Similarity of each item text with the entity's text and its best cell, and which cells lie inside the item text.

    ``entity`` and ``texts`` are normalised text columns; cells are parted by bars
    in ``<entity>_raw``. What :func:`with_cells` and :func:`with_grams` have made of the records is not made again.
    """
    out = pairs if {"cells", "entity_grams"} <= set(pairs.columns) else with_cells(pairs, entity)
    n = F.size("cells")
    for t in texts:
        grams = F.col(f"{t}_grams") if f"{t}_grams" in pairs.columns else T.shinglize(F.col(t))
        out = (
            out.withColumn(f"jaccard_{t}", T.jaccard(F.col("entity_grams"), grams))
            .withColumn(f"cell_jaccard_{t}", F.array_max(F.transform("cells", _similar_to(grams))))
            .withColumn(f"infix_{t}", F.contains(F.col(t), F.col(entity)).cast("int"))
            .withColumn(f"cells_inside_{t}", F.size(F.filter("cells", _inside(F.col(t)))))
        )
    many = lambda p: F.greatest(*(F.col(f"{p}_{t}") for t in texts)) if len(texts) > 1 else F.col(f"{p}_{texts[0]}")
    return out.withColumn("jaccard_max", many("jaccard")).withColumn("cell_jaccard_max", many("cell_jaccard")).withColumn("cells_inside_max", many("cells_inside")).withColumn("cells_inside_share", many("cells_inside") / n).drop("entity_grams", *(f"{t}_grams" for t in texts))


def append_new(existing: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``found``, distinct rows that ``existing`` does not have yet: what an append may write."""
    return found.dropDuplicates(keys).join(existing, keys, "left_anti")
