"""What the operators of this subpackage share: the shared folder, cut points, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker expands at once; bounds a worker's memory whatever a batch holds.
BLOCK_BYTES = 4 << 20


#: Bytes of an Arrow batch on its way to a worker, about; rows stay whole.
BATCH_BYTES = 4 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep what is sent to them at once small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may leave the setting out; there one machine is all
    there is, and a folder of its own is used.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/docloom"
    return at.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: lineage ends there.

    A lost executor loses nothing that was cut. The path is kept in ``_cut``
    so that the caller can :func:`uncut` the table once it is of no use; what a
    result still reads from goes when the application ends.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def uncut(*frames: DataFrame) -> None:
    for df in frames:
        remove(df.sparkSession, df._cut)


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, by: int | None = None, rows: int = 10_000) -> DataFrame:
    """``mapInArrow`` with ``f`` on slices of at most ``rows`` rows, or, with ``by``, on slices by the bytes of that column."""
    on_workers(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, rows) for a in range(0, batch.num_rows, rows)) if by is None else parts(batch, by):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(go, schema)


def parts(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a column of texts or bytes add up to about ``most`` bytes; at least a row each."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    block = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.nonzero(block[1:] != block[:-1])[0] + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    release()


#: Bits of a screen: a megabyte, whatever the number of rows.
SCREEN_BITS = 1 << 23


def screen_of(df: DataFrame, c: str) -> bytes:
    """A bit table of fixed size with the bit of every value of the long column ``c`` set."""
    on = df.select(F.pmod(c, F.lit(SCREEN_BITS)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    table = np.zeros(SCREEN_BITS // 64, np.int64)
    got = on.toArrow()  # at most SCREEN_BITS / 64 rows
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table.tobytes()


def passes(screen: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the values may be among those that the screen was made of."""
    bit = h % SCREEN_BITS
    return screen[bit >> 6] >> (bit & 63) & 1 == 1


def screened(df: DataFrame, c: str, screen: bytes) -> DataFrame:
    """Rows of ``df`` whose value of ``c`` may be among those of the screen; the exact join that follows leaves no others."""
    sent, i = df.sparkSession.sparkContext.broadcast(screen), df.columns.index(c)
    return per_batch(df, lambda batch: batch.filter(pa.array(passes(np.frombuffer(sent.value, np.int64), batch.column(i).to_numpy()))), df.schema)


#: Rows of one key that a task of a counted join is given, about, and classes that keys fall into when hot ones are told.
HOT_ROWS, HOT_CLASSES = 1 << 20, 1 << 16


def counted_join(many: DataFrame, few: DataFrame, key: str, n: str, by: str, most: int = HOT_ROWS) -> DataFrame:
    """``many.join(few, key)`` that no hot key brings to one task; ``few``, written before, has a row for each key and in ``n`` how often ``many`` has it.

    A key that ``many`` has over ``most`` times is dealt out by the hash of the column ``by``, and its row of ``few`` goes to each
    of the parts. What is sent to all workers are the numbers of parts by class of key, at most ``HOT_CLASSES`` rows; other keys of such a
    class are dealt out with it, which changes no row of the result.
    """
    spark, of = many.sparkSession, F.pmod(F.xxhash64(key), F.lit(HOT_CLASSES)).cast("int")
    hot = few.where(F.col(n) > most).groupBy(of.alias("hot_class")).agg(F.ceil(F.max(n) / most).cast("int").alias("hot_parts")).collect()
    if not hot:
        return many.join(few, key)
    sent = F.broadcast(spark.createDataFrame(hot, "hot_class int, hot_parts int"))
    classed = lambda df: df.withColumn("hot_class", of).join(sent, "hot_class", "left").withColumn("hot_parts", F.coalesce("hot_parts", F.lit(1)))
    dealt = classed(many).withColumn("hot_part", F.pmod(F.xxhash64(by), "hot_parts").cast("int"))
    each = classed(few).withColumn("hot_part", F.explode(F.sequence(F.lit(0), F.col("hot_parts") - 1)))
    inner = ("hot_class", "hot_parts")
    return dealt.drop(*inner).join(each.drop(*inner), [key, "hot_part"]).drop("hot_part")


#: Bytes of a table for each core up to which :func:`table` moves rows.
SPREAD_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A small one in fewer files than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df
