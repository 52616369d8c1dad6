"""Numbered services as Spark sources: pages of records, ids up to the last, and what has come since.

``spark.read.format("docloom_service")`` splits a service into partitions of ``per_partition`` pages or ids each, which executors fetch
on their own; the driver only asks for the last number, by doubling and halving, unless the option ``last`` gives it. ``spark.readStream`` of the
same format has the last number as its offset: each batch fetches what is new since the one before, in the same partitions, and a restart
fetches nothing twice.

The option ``service`` names a factory as ``module:function``; called with the options, it gives an object with

* ``exists(number) -> bool``: whether there is a page or item of that number; all below the last one exist,
* ``fetch(number) -> list[str]``: its records, JSON or any text.

Failures are tried again ``attempts`` times (5) with growing pauses from ``wait`` seconds on, then fail the task, which Spark repeats
elsewhere. Nothing here opens a connection by itself, and nothing is fetched while a query is planned but whether numbers exist.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docloom.session import use_package
from docloom.sources.connectors import last_id, with_retries

SCHEMA = "number long, position int, record string"
#: Records of an Arrow batch that a partition yields, at most.
BATCH = 2000


class Span(InputPartition):
    """The numbers from ``first`` to ``last``, both included."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _service(options):
    module, _, factory = options["service"].partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


def _spans(first: int, last: int, options) -> list[Span]:
    size = max(1, int(options.get("per_partition", "100")))
    return [Span(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]


def _last(options) -> int:
    """The last number that exists now; a failed question is asked again."""
    if "last" in options:
        return int(options["last"])
    return last_id(with_retries(_service(options).exists, int(options.get("attempts", "5")), float(options.get("wait", "0.1"))))


def _read(span: Span, options) -> Iterator[pa.RecordBatch]:
    service = _service(options)
    fetch = with_retries(service.fetch, int(options.get("attempts", "5")), float(options.get("wait", "0.1")))

    def batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        number, position, record = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(position, pa.int32()), pa.array(record, pa.string())], names=["number", "position", "record"])

    rows: list[tuple[int, int, str]] = []
    for number in range(span.first, span.last + 1):
        for position, record in enumerate(fetch(number)):
            rows.append((number, position, record))
            if len(rows) >= BATCH:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


class ServiceReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Span]:
        first = int(self.options.get("first", "1"))
        return _spans(first, _last(self.options), self.options) or [Span(first, first - 1)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.options)


class ServiceStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"number": int(self.options.get("first", "1")) - 1}

    def latestOffset(self) -> dict:
        return {"number": max(_last(self.options), self.initialOffset()["number"])}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans(start["number"] + 1, end["number"], self.options)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.options)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: Spark's checkpoint has the offset."""


class ServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ServiceReader:
        return ServiceReader(self.options)

    def streamReader(self, schema) -> ServiceStream:
        return ServiceStream(self.options)


def register(spark: SparkSession) -> None:
    use_package(spark)
    spark.dataSource.register(ServiceSource)


def pages(spark: SparkSession, service: str, **options) -> DataFrame:
    """``number, position, record`` of all pages of a service, a partition for every ``per_partition`` of them."""
    register(spark)
    return spark.read.format(ServiceSource.name()).options(service=service, **options).load()


def new_pages(spark: SparkSession, service: str, **options) -> DataFrame:
    """The same as a stream of what is new."""
    register(spark)
    return spark.readStream.format(ServiceSource.name()).options(service=service, **options).load()


class TableService:
    """A service that answers from a Parquet table: page ``n`` holds the rows whose ``key`` is in the ``n``-th run of ``page`` numbers from 0 on, as JSON.

    It stands for a remote one in offline runs: any store that Arrow can read will do for ``path``. A row group is read whole for a single page of it, so ``AHEAD``
    rows' worth of pages are read at once and the last ones held by the worker, for its next pages and tasks; not where the table's files have changed since.
    """

    #: Keys that one read covers.
    AHEAD = 100_000
    #: What was read last in this process: what it is of, the first page and the page behind the last, rows by key.
    held: tuple | None = None

    def __init__(self, options: dict):
        import pyarrow.dataset as ds

        self.data, self.key, self.page = ds.dataset(options["path"], format="parquet"), options["key"], int(options.get("page", "50"))
        self.columns = options["columns"].split(",")
        self.of = (tuple((i.path, i.size, i.mtime_ns) for i in self.data.filesystem.get_file_info(self.data.files)), self.key, self.page, tuple(self.columns))

    def _rows(self, first: int, behind: int, columns: list[str]) -> pa.Table:
        """The rows of the pages from ``first`` on, up to the one before ``behind``."""
        import pyarrow.dataset as ds

        key = ds.field(self.key)
        return self.data.to_table(columns=columns, filter=(key >= (first - 1) * self.page) & (key < (behind - 1) * self.page))

    def exists(self, number: int) -> bool:
        return self._rows(number, number + 1, [self.key]).num_rows > 0

    def _ahead(self, number: int) -> tuple[int, pa.Table, np.ndarray]:
        """The first page of a run of pages that holds this one, the run's rows by key, and where each page begins."""
        run = max(1, self.AHEAD // self.page)
        first = (number - 1) // run * run + 1
        if TableService.held is None or TableService.held[:2] != (self.of, first):
            names = list(dict.fromkeys([*self.columns, self.key]))
            rows = self._rows(first, first + run, names).sort_by(self.key)
            begins = np.searchsorted(rows.column(self.key).to_numpy(), (np.arange(run + 1) + first - 1) * self.page)
            TableService.held = (self.of, first, rows.select(self.columns), begins)
        return TableService.held[1:]

    def fetch(self, number: int) -> list[str]:
        import json

        first, rows, begins = self._ahead(number)
        start, end = begins[number - first], begins[number - first + 1]
        return [json.dumps(r, default=str) for r in rows.slice(start, end - start).to_pylist()]
