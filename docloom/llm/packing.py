"""Hierarchical packing: tiers of context sizes, gaps filled from shorter tiers, equal step groups.

A document is its ids and one end id. Tiers are powers of two. A document longer
than the largest tier is cut into full windows; what is left of it, and every
shorter document, goes to the least tier that holds it. Windows are packed from
the longest piece down: the piece opens a window of its tier, and the gap, less
than half a window, is filled with the longest pieces that fit, all of shorter
tiers. A gap that nothing fits is closed by cutting the shortest piece that is
longer. Windows are thus full. What is left at the end of a partition is cut
into powers of two, so that no sequence is padded.

Sequences of one tier fill step groups of ``step_tokens`` tokens: every step has
one shape and the same load; only the last group of a tier in a partition may
hold fewer sequences.

Each partition packs what it reads, in bounded memory and without a shuffle. Ids
of sequences and groups begin with the number of the partition.

Defined cases: null counts as the empty text, whose one id is the end id; rows
that repeat an id are packed one by one; of pieces of one length the last that came is taken first; a text of
any length is encoded whole and cut into full windows; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.bpe import encoder, text_blocks
from docloom.llm.common import on_workers

#: Tokens that wait in a partition's pool before windows are closed.
POOL_TOKENS = 1 << 20
#: Bytes of texts that are encoded at once.
BLOCK = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Piece:
    __slots__ = ("doc_id", "tokens", "start", "ids")

    def __init__(self, doc_id, tokens: int, start: int, ids: np.ndarray):
        self.doc_id, self.tokens, self.start, self.ids = doc_id, tokens, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.tokens, self.start, self.ids[:n]), Piece(self.doc_id, self.tokens, self.start + n, self.ids[n:])


class Packer:
    """Packs the pieces of one partition. Finished sequences gather in ``done`` as ``(tier, pieces)``."""

    def __init__(self, largest: int = 1024, least: int = 64):
        if largest & (largest - 1) or least & (least - 1) or least > largest:
            raise ValueError("tiers are powers of two")
        self.largest, self.least = largest, least
        self.by_length: list[list[Piece]] = [[] for _ in range(largest)]
        self.lengths = 0  # bit n is set if a piece of n ids waits
        self.waiting = 0
        self.done: list[tuple[int, list[Piece]]] = []

    def _put(self, p: Piece) -> None:
        n = len(p.ids)
        self.by_length[n].append(p)
        self.lengths |= 1 << n
        self.waiting += n

    def _take(self, n: int) -> Piece:
        stack = self.by_length[n]
        p = stack.pop()
        if not stack:
            self.lengths &= ~(1 << n)
        self.waiting -= n
        return p

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        for a in range(0, n - self.largest + 1, self.largest):
            self.done.append((self.largest, [Piece(doc_id, n, a, ids[a : a + self.largest])]))
        if rest := n % self.largest:
            self._put(Piece(doc_id, n, n - rest, ids[n - rest :].copy()))
        if self.waiting > POOL_TOKENS:
            self.close()

    def tier(self, n: int) -> int:
        return max(self.least, 1 << (n - 1).bit_length())

    def close(self, last: bool = False) -> None:
        """Pack what waits. Of a window that can't be filled the pieces wait on, unless these are the last."""
        kept: list[list[Piece]] = []
        while self.lengths:
            window = [self._take(self.lengths.bit_length() - 1)]
            size = self.tier(len(window[0].ids))
            gap = size - len(window[0].ids)
            while gap and self.lengths:
                if fits := self.lengths & ((2 << gap) - 1):
                    window.append(self._take(fits.bit_length() - 1))
                else:
                    longer = self.lengths >> (gap + 1)
                    piece, rest = self._take(gap + (longer & -longer).bit_length()).cut(gap)
                    window.append(piece)
                    self._put(rest)
                gap -= len(window[-1].ids)
            if gap:
                kept.append(window)
            else:
                self.done.append((size, window))
        for window in kept:
            if not last:
                for p in window:
                    self._put(p)
                continue
            left = sum(len(p.ids) for p in window)
            window.reverse()
            while left:
                size, held, n = 1 << (left.bit_length() - 1), [], 0
                while n < size:
                    p = window.pop()
                    if len(p.ids) > size - n:
                        p, rest = p.cut(size - n)
                        window.append(rest)
                    held.append(p)
                    n += len(p.ids)
                self.done.append((size, held))
                left -= size


def pack(docs: DataFrame, spec: str, end_id: int = 0, largest: int = 1024, least: int = 64, step_tokens: int = 1 << 14, memo: int = 600_000) -> DataFrame:
    """A row for each piece of each document of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the ids
    of the document before the piece, ``offset`` those of its sequence. A worker remembers the ids of
    ``memo`` pieces of text at most, some 250 bytes each; fewer take more time and give the same ids.
    """
    spark = docs.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(spec)  # a vocabulary: its size is checked when it is read
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def go(batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, memo)
        packer = Packer(largest, least)
        here = TaskContext.get().partitionId()
        made = 0
        tier_made: dict[int, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            cols: list[list] = [[] for _ in names]
            for size, window in packer.done:
                k = tier_made[size] = tier_made.get(size, -1) + 1
                group = (here << 40) | (size.bit_length() << 32) | k // max(1, step_tokens // size)
                at = 0
                for p in window:
                    n = len(p.ids)
                    for c, x in zip(cols, (p.doc_id, p.start, n, p.ids.tobytes(), p.tokens, (here << 36) | made, at, size, group), strict=True):
                        c.append(x)
                    at += n
                made += 1
            packer.done = []
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for c, k in zip(cols, names, strict=True)], names=names)

        for doc_id, texts in text_blocks(batches, BLOCK):
            ids, tokens = enc.encode(texts)
            ids = ids.astype("<u4")
            upto = np.cumsum(tokens).tolist()
            for d, a, b in zip(doc_id.to_pylist(), [0, *upto], upto, strict=False):
                packer.add(d, np.append(ids[a:b], np.uint32(end_id)).astype("<u4", copy=False))
            yield from out()
        packer.close()
        packer.close(last=True)
        yield from out()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(go, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids in place of the ids."""
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
