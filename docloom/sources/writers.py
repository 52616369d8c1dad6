"""Writers: appends that can be repeated, children with derived keys, cut texts, chunked and partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.linkage import append_new
from docloom.operators.relational import dealt_pairs
from docloom.schemas import LIMITS


def cut_to(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def cut_excerpt(c: Column, most: int = 4096, to: int = LIMITS["excerpt"]) -> Column:
    """Excerpts that are too long are cut with some room to spare."""
    return F.when(F.length(c) >= most, F.substring(c, 1, to)).otherwise(c)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def refresh(df: DataFrame, path: str) -> None:
    """Replace the table; ``df`` must not read from it. Readers that run meanwhile may see it half-written."""
    df.write.mode("overwrite").parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table does not have; a second run adds none. Returns how many were added.

    For one writer at a time: two that run at once both see the table as it was before. Tables that several write
    are :class:`docloom.sources.store.Table`.
    """
    spark = df.sparkSession
    try:
        before = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = spark.createDataFrame([], df.select(*keys).schema)
    new = append_new(before, df, keys).persist()
    n = new.count()
    if n:
        append(new, path)
    new.unpersist()
    return n


def jdbc_append(df: DataFrame, url: str, table: str, connections: int = 8, batch: int = 1000, **options: str) -> None:
    """Append to a table of a database, through ``connections`` connections at most, ``batch`` rows an insert.

    Each task is one transaction. One that is run again after its executor was lost may insert its rows twice,
    unless the table has a key that refuses them.
    """
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=connections, batchsize=batch, **options).mode("append").save()


def with_surrogate(df: DataFrame, natural: list[str], name: str = "id", after: int = 0, parts: int = 64) -> DataFrame:
    """Numbers from ``after + 1`` in the order of the MD5 of the natural key, then of the key: the same whatever the partitions.

    Keys are cut into ranges of their hash; numbers run inside each and are
    shifted by the sizes of those before, so no task sees all rows.
    """
    hashed = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural)))
    h = df.withColumn("_h", hashed).withColumn("_part", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * parts / 65536).cast("int"))
    sizes = h.groupBy("_part").agg(F.count("*").alias("_n"))
    # At most ``parts`` rows.
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy("_h", *natural)
    return h.join(F.broadcast(before), "_part").withColumn(name, (F.row_number().over(w) + F.col("_before") + after).cast("bigint")).drop("_h", "_part", "_before")


def manual_matches(pairs: DataFrame, entities: DataFrame, item_documents: DataFrame) -> DataFrame:
    """Rows to append for a reader's ``pairs(item_id, entity_id)``: only where the item is linked to the entity's document."""
    of = pairs.join(entities.select("entity_id", "document_id"), "entity_id")
    linked = item_documents.groupBy("item_id", "document_id").agg(F.min("id").alias("item_document_id"))
    return of.join(linked, ["item_id", "document_id"]).select("item_document_id", F.col("entity_id").alias("matched_entity_id"), F.lit(True).alias("manual_match"))


def manual_matches_of_blocks(items: DataFrame, chosen: DataFrame, block: str, entities: DataFrame, item_documents: DataFrame) -> DataFrame:
    """The same for a reader who matches by blocks: each of ``items(item_id, block)`` with each of ``chosen(entity_id, block)`` of its block.

    Documents are looked up for items and for entities, and only then do pairs meet, on block and document: none is made in vain or shuffled.
    """
    of = chosen.join(entities.select("entity_id", "document_id"), "entity_id")
    linked = item_documents.groupBy("item_id", "document_id").agg(F.min("id").alias("item_document_id"))
    asked = items.join(linked, "item_id").select(block, "document_id", "item_document_id", "item_id")
    met = dealt_pairs(asked, of.select(block, "document_id", F.col("entity_id").alias("matched_entity_id")), [block, "document_id"], F.col("item_id"), F.col("matched_entity_id"))
    return met.select("item_document_id", "matched_entity_id", F.lit(True).alias("manual_match"))


def children(df: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """A child row for each element of an array, in order."""
    return df.select(F.col(key), F.posexplode(values).alias("position", name))


def updated(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with the column's new values where ``changes`` has them."""
    new = changes.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def chunks(df: DataFrame, path: str, rows: int = 1000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def lines(df: DataFrame, c: str, path: str) -> None:
    df.select(F.col(c).cast("string").alias("value")).write.mode("overwrite").text(path)


def delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, line: str = "\n") -> None:
    """Quotes inside fields are doubled, as :func:`docloom.sources.readers.csv` reads them; lines end in ``line``."""
    df.write.mode("overwrite").csv(path, sep=sep, header=header, escape='"', lineSep=line)


def folds(df: DataFrame, path: str, fold: str = "fold") -> None:
    df.write.mode("overwrite").partitionBy(fold).parquet(path)
