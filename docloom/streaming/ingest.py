"""Incremental runs: new files since the last run go through the table parser once.

The reference behaviour is batch with "skip what is there"; a file stream with
``availableNow`` gives that without listing what was done before, and a repeated
batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.tables import Options, extract_rows
from docloom.sources.writers import append_missing


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of whole texts that arrive below a folder."""
    return spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest_rows(docs: DataFrame, table: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Append the table rows of all documents that are there now and were not seen before."""

    def batch(df: DataFrame, _: int) -> None:
        append_missing(extract_rows(df, options), table, ["document_id", "table_no", "row_no"])

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
