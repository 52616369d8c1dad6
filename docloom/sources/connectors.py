"""Connectors to services: downloads with retries, probing for the last id, archives, annotators.

Nothing here opens a connection by itself: what fetches is passed in, so that
tests and offline runs use a stub. Work over many ids is a map over partitions; paged services are
:mod:`docloom.sources.services`.
"""

from __future__ import annotations

import http.client
import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import use_package

Fetch = Callable[[str], bytes]


def with_retries(fetch: Fetch, attempts: int = 5, wait: float = 0.0, factor: float = 2.0) -> Fetch:
    """``fetch`` tried again after a failure, waiting longer each time; the last failure is raised."""

    def run(url: str) -> bytes:
        pause = wait
        for k in range(attempts):
            try:
                return fetch(url)
            except OSError:
                if k == attempts - 1:
                    raise
                time.sleep(pause)
                pause *= factor
        raise AssertionError

    return run


def head_status(path: str, host: str, connect: Callable | None = None) -> int | None:
    """The status that a host answers a HEAD request with; None if it can't be reached. ``connect`` makes the connection."""
    connection = (connect or http.client.HTTPConnection)(host)
    try:
        connection.request("HEAD", path)
        return connection.getresponse().status
    except OSError:
        return None
    finally:
        connection.close()


_BILL = "bill_id string, versions array<struct<version_code:string,bill_version_id:string,urls:struct<html:string>>>"


def bill_versions(records: DataFrame) -> DataFrame:
    """``path, url``: where each version of the bills in ``records(record)`` belongs and where it is; bills without versions have none."""
    v = records.select(F.from_json("record", _BILL).alias("b")).select("b.bill_id", F.explode("b.versions").alias("v"))
    return v.select(F.concat_ws("/", "bill_id", "v.version_code", "v.bill_version_id").alias("path"), F.col("v.urls.html").alias("url"))


def last_id(exists: Callable[[int], bool]) -> int:
    """The largest id that exists, when all below it do: doubling, then halving."""
    if not exists(1):
        return 0
    high = 2
    while exists(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low


def report_ids(last: DataFrame) -> DataFrame:
    """``congress, chamber, number`` of all reports up to the last of each row of ``last(congress, chamber, last)``."""
    return last.where("last > 0").select("congress", "chamber", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("number"))


def missing(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not yet stored."""
    return wanted.join(stored, keys, "left_anti")


def download(urls: DataFrame, fetch: Fetch, url: str = "url") -> DataFrame:
    """``url, content, error`` of each url; a failure is a row, not the end of the job. One download is held at a time."""
    use_package(urls.sparkSession)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for u in (u for frame in frames for u in frame["url"]):
            try:
                row = (u, fetch(u), None)
            except OSError as e:
                row = (u, None, str(e))
            yield pd.DataFrame([row], columns=["url", "content", "error"])

    return urls.select(F.col(url).alias("url")).mapInPandas(go, "url string, content binary, error string")


def unzipped(archives: DataFrame, content: str = "content", wanted: str = r"mods\.xml$|\.htm$", renamed: str | None = None) -> DataFrame:
    """``path, member, content`` of the members of zip archives whose names match; with ``renamed``, under that name. A row at a time."""
    use_package(archives.sparkSession)
    pattern = re.compile(wanted)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for n in filter(pattern.search, z.namelist()):
                        yield pd.DataFrame([(path, renamed or n, z.read(n))], columns=["path", "member", "content"])

    return archives.select("path", F.col(content).alias("content")).mapInPandas(go, "path string, member string, content binary")


def text_chunks(text: str, most: int = 100_000) -> list[tuple[int, str]]:
    """``(offset, part)`` of parts of at most ``most`` characters, cut behind a line break where there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = text.rfind("\n", at, end)
            end = cut + 1 if cut >= at else end
        out.append((at, text[at:end]))
        at = end
    return out


#: Chunks, and their characters, that are passed on at once, at most.
CHUNKS, CHARACTERS = 10_000, 4 << 20


def chunked(docs: DataFrame, most: int = 100_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``document_id, chunk, offset, text`` of documents cut for a service with a limit."""
    use_package(docs.sparkSession)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["document_id", "chunk", "offset", "text"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for d, text in zip(b.column(0), b.column(1), strict=True):  # a text at a time, not the batch as Python's
                for k, (o, t) in enumerate(text_chunks(text.as_py() or "", most)):
                    out.append((d.as_py(), k, o, t))
                    held += len(t)
                    if len(out) >= CHUNKS or held >= CHARACTERS:
                        yield batch(out)
                        out, held = [], 0
        if out:
            yield batch(out)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(go, "document_id long, chunk int, offset int, text string")


def annotated(chunks: DataFrame, annotate: Callable[[str], str]) -> DataFrame:
    """``document_id, offset, response`` with an annotator's JSON answer for each chunk."""
    use_package(chunks.sparkSession)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"document_id": frame["document_id"], "offset": frame["offset"], "response": [annotate(t) for t in frame["text"]]})

    return chunks.select("document_id", "offset", "text").mapInPandas(go, "document_id long, offset int, response string")
