"""WARC archives: one gzip stream rewritten as a member for each record, with an index of offsets.

:func:`write` lays pages down as archives that are one gzip stream each, as some
crawlers leave them: nothing in such a file can be reached without inflating all
before it. :func:`normalise` inflates each archive once, from start to end, and
writes every record as a gzip member of its own, with a sidecar index of where
the members lie. Repeated payloads become revisit records there. :func:`read`
goes by the index.

Payloads are told apart by their SHA-1. Of records with equal payloads of
``least`` bytes or more, the one with the largest page id stays a response. Only
digests are shuffled, never payloads: decisions come to the archives as short
lists. Archives hold a bounded number of bytes, so a task's memory is bounded by
one archive's decisions and one record. Files appear by renaming and their
content depends on the input alone, so a task that runs twice does no harm.

Defined cases: null html is an empty payload; a null url is an empty target;
rows that repeat a page id are records of their own, and of equal payloads with
equal ids the one written last is the response; a null id counts as the least;
a payload is held whole, one at a time, whatever its length; an empty table gives no archive and
no rows; columns other than ``page_id``, ``url`` and ``html`` are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import cut, fresh, on_workers, remove, uncut
from docloom.llm.files import reading, writing

#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
#: Archives that a task rewrites or reads, at most.
ARCHIVES_A_TASK = 8
_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def _header(fields: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def response(archive: str, number: int, page_id: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    block = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id(archive, number),
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\s\x00-\x1f]", "%20", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-ID": page_id,
        "X-Payload-Length": len(payload),
    }
    return _header(fields, block)


def revisit(fields: dict[str, str], block: bytes, told: dict) -> bytes:
    """The revisit record that stands for a response whose payload another record has."""
    head = block[: block.index(b"\r\n\r\n") + 4]
    kept = {k: v for k, v in fields.items() if k != "Content-Length"}
    return _header(
        kept
        | {
            "WARC-Type": "revisit",
            "WARC-Profile": _PROFILE,
            "WARC-Refers-To": record_id(told["archive"], told["number"]),
            "X-Refers-To-Page": told["page_id"],
        },
        head,
    )


def parse(buffer: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int, int] | None:
    """Fields of the record at ``at``, and where its block begins and ends; None if it is not all there."""
    end = buffer.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    version, *lines = bytes(buffer[at:end]).decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start, n = end + 4, int(fields["Content-Length"])
    return (fields, start, start + n) if start + n + 4 <= len(buffer) else None


def inflated(f, first: int = _CHUNK) -> Iterator[bytes]:
    """Bytes of a gzip file, whatever number of members it has, in one pass."""
    z = zlib.decompressobj(31)
    while chunk := f.read(first):
        while chunk:
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            elif not chunk:
                break
    if tail := z.flush():
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """``(whole record, fields, block)`` of each record of an inflated archive; holds one record at a time."""
    buffer, at = bytearray(), 0
    for piece in pieces:
        buffer += piece
        while found := parse(buffer, at):
            fields, a, b = found
            yield bytes(buffer[at : b + 4]), fields, bytes(buffer[a:b])
            at = b + 4
        if at > _CHUNK:
            del buffer[:at]
            at = 0
    if len(buffer) > at:
        raise ValueError("the archive ends inside a record")


WRITTEN = "archive string, number long, page_id long, digest string, n_bytes long"


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives of one gzip stream each; a row for each record."""
    on_workers(pages.sparkSession)
    names = [x.split()[0] for x in WRITTEN.split(", ")]

    def go(batches):
        task = TaskContext.get()
        rows = ((p, u, h) for b in batches for p, u, h in zip(*(b.column(i) for i in range(3)), strict=True))
        row, k = next(rows, None), 0
        while row is not None:
            name = f"part-{task.partitionId():06d}-{k:04d}"
            out, size, number = [], 0, 0
            with writing(f"{folder}/{name}.warc.gz", task.taskAttemptId()) as f:
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                while row is not None and size < archive_bytes:
                    page_id, url, html = (x.as_py() for x in row)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = digest_of(payload)
                    f.write(z.compress(response(name, number, page_id, url, payload, digest, date)))
                    out.append((name, number, page_id, digest, len(payload)))
                    size += len(payload) + 1024
                    number += 1
                    row = next(rows, None)
                f.write(z.flush())
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("archive", "digest") else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return cut(pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(go, WRITTEN), "warc-written")


def revisits(written: DataFrame, least: int = 0) -> DataFrame:
    """``archive, told``: by archive, the records that become revisits and the responses that they refer to."""
    one = F.struct("page_id", "archive", "number")
    same = written.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max(one).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = written.where(F.col("n_bytes") >= least).join(same, "digest").where((F.col("archive") != F.col("first.archive")) | (F.col("number") != F.col("first.number")))
    told = F.struct(F.col("number").alias("which"), F.col("first.page_id").alias("page_id"), F.col("first.archive").alias("archive"), F.col("first.number").alias("number"))
    return later.groupBy("archive").agg(F.collect_list(told).alias("told"))  # at most an archive's records


def normalise(written: DataFrame, folder: str, into: str, least: int = 0, level: int = 4) -> DataFrame:
    """Rewrite each archive with a member for each record and a sidecar index; ``archive, n_records`` of each."""
    spark = written.sparkSession
    archives = written.groupBy("archive").agg(F.count("*").alias("n"))
    jobs = archives.join(revisits(written, least), "archive", "left").select("archive", "told")

    def go(batches):
        task = TaskContext.get()
        for batch in batches:
            for archive, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {t["which"]: t for t in told or ()}
                index, at = [], 0
                with reading(f"{folder}/{archive}.warc.gz") as f, writing(f"{into}/{archive}.warc.gz", task.taskAttemptId()) as out:
                    for number, (raw, fields, block) in enumerate(records(inflated(f))):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(revisit(fields, block, refers[number]) if number in refers else raw) + z.flush()
                        out.write(member)
                        index.append({"record": fields["WARC-Record-ID"], "offset": at, "length": len(member)})
                        at += len(member)
                with writing(f"{into}/{archive}.index.jsonl", task.taskAttemptId()) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([len(index)], pa.int64())], names=["archive", "n_records"])

    return cut(_spread(jobs, written).mapInArrow(go, "archive string, n_records long"), "warc-normal")


def _spread(jobs: DataFrame, archives: DataFrame) -> DataFrame:
    """Jobs over so many tasks that each has a few archives: a lost executor costs no more than those."""
    n = archives.select("archive").distinct().count()
    return jobs.repartition(max(1, min(n, 4 * jobs.sparkSession.sparkContext.defaultParallelism), -(-n // ARCHIVES_A_TASK)))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, member_bytes long"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record that the indexes of ``archives(archive)`` list; payloads are held against their digests."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def go(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with reading(f"{folder}/{archive}.index.jsonl") as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                out = []
                with reading(f"{folder}/{archive}.warc.gz") as f:
                    for x in index:
                        f.seek(x["offset"])
                        raw = zlib.decompress(f.read(x["length"]), 31)
                        fields, a, b = parse(raw)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(fields["X-Payload-Length"])
                        if fields["WARC-Record-ID"] != x["record"]:
                            raise ValueError(f"{archive}: the index names another record at {x['offset']}")
                        if fields["WARC-Type"] == "response":
                            payload = raw[raw.index(b"\r\n\r\n", a) + 4 : b]
                            n, digest = len(payload), digest_of(payload)
                            if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                                raise ValueError(f"{archive}: a payload at {x['offset']} differs from its digest")
                        page, other = (int(v) if (v := fields.get(k)) else None for k in ("X-Page-ID", "X-Refers-To-Page"))
                        out.append((page, n, digest, fields["WARC-Type"], other, archive, x["offset"], x["length"]))
                for k in range(0, len(out), 5000):
                    cols = zip(*out[k : k + 5000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return _spread(archives.select("archive"), archives).mapInArrow(go, READ)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages, normalise the archives and read them back; the archives are deleted in the end."""
    raw, into = fresh(spark, "warc-raw"), fresh(spark, "warc")
    written = write(pages, raw)
    normal = normalise(written, raw, into, least)
    remove(spark, raw)
    out = cut(read(normal, into), "warc-read")
    remove(spark, into)
    uncut(written, normal)
    return out
