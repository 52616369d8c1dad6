"""Answers of readers as they arrive: the run of "no" of each item, what is decided without asking on, and nothing counted twice.

State is kept for each item by Spark, in RocksDB, so it outgrows no memory and a restart goes on where the last run stopped. Answers of an item are taken in the
order of their numbers inside a batch, and batches in the order in which they come.

Defined cases: an answer whose number the item has had already is skipped; a null answer is "no"; answers without a number or an item are left out. The answers of one
item in one batch are held at once, with the numbers of all that it has had: state is asked and told once for each item of a batch, not for each answer; limit a batch (``maxFilesPerTrigger``) where an item may have very many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docloom.session import use_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: "No" so many times in a row, and the item's further candidates are taken for no matches.
MOST_NO = 10


class Runs(StatefulProcessor):
    """``item, answer, yes, run, decided`` of each new answer."""

    def __init__(self, most: int = MOST_NO):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        # An entry for each batch that had new answers of the item: their numbers, eight bytes each, and the run after them.
        self.had = handle.getListState("had", "run long, answers binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("answer", kind="stable")
        run, seen = 0, set()
        for run, answers in self.had.get():
            seen.update(np.frombuffer(answers, np.int64).tolist())
        out = []
        for answer, yes in zip(new["answer"].tolist(), new["yes"].fillna(False).astype(bool).tolist(), strict=True):
            if answer in seen:
                continue
            seen.add(answer)
            run = 0 if yes else run + 1
            out.append((key[0], answer, yes, run, run > self.most))
        if out:
            self.had.appendValue((run, np.array([o[1] for o in out], np.int64).tobytes()))
        yield pd.DataFrame(out, columns=["item", "answer", "yes", "run", "decided"]).astype({"item": "int64", "answer": "int64", "yes": bool, "run": "int64", "decided": bool})

    def close(self) -> None:
        """Nothing is held besides the state."""


def runs(answers: DataFrame, most: int = MOST_NO) -> DataFrame:
    """A stream of :class:`Runs` over a stream of ``answers(item, answer, yes)``, ``item`` and ``answer`` whole numbers."""
    use_package(answers.sparkSession)
    rows = answers.where("item is not null and answer is not null").select(F.col("item").cast("long"), F.col("answer").cast("long"), F.col("yes").cast("boolean"))
    return rows.groupBy("item").transformWithStateInPandas(Runs(most), "item long, answer long, yes boolean, run long, decided boolean", "Append", "None")


def follow(answers: DataFrame, table: str, checkpoint: str, most: int = MOST_NO) -> StreamingQuery:
    """Append the runs of all answers that are there now and were not seen before."""
    spark = answers.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # read when the query starts
    try:
        return runs(answers, most).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
