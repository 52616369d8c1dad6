"""Near-duplicates by SimHash: Golay-coded keys, pigeonholed segments, verified links, components.

Fingerprints are 64 bits: each bit is the majority of that bit over the XXH64
hashes (seed 42) of the text's word shingles. Two fingerprints link when they
differ in at most two bits.

Candidate search. The 64 bits are cut into segments of 23, 23 and 18 bits (the
last padded with zeros). The binary Golay code (23, 12) is perfect: every
segment lies within three bits of one codeword. A segment is decoded to that
codeword and, when it is three bits away, to the five others that are four bits
away. Segments that differ in at most two bits have a codeword in common: some
word between them lies within one bit of each, and its codeword within four
bits of both. By the pigeonhole principle, two errors over three segments leave
one segment intact; a key is therefore an intact segment with one of the
codeword indices of the next one. That is 3 to 18 keys a fingerprint, each of
30 to 35 bits, and no linked pair without a common key.

Candidates that share a key are compared with numpy, in tiles. A bucket beyond
``bucket`` fingerprints is not compared pair by pair: each of its members is
sent to its 65 neighbours within one bit. Fingerprints at most two bits apart
meet at a neighbour, all that meet there are at most two bits apart, and at
most 65 can meet, so this finds the same links at a cost linear in the bucket.

Equal fingerprints are folded before any key is made, so exact copies cost one
row, and every hot key is met by partial aggregation before its shuffle.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; rows with a null id keep their fingerprint and get the component of it
(null if no row of the component has an id); repeated rows get equal results; a bit that
exactly half of the shingles have is not set; very long texts are hashed whole, their bits counted in runs;
an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, on_workers, per_batch, release, uncut

SEED = 42
#: Shingles whose bits are counted at once.
_RUN = 1 << 16
#: Fingerprints whose keys are made at once.
_KEYED = 1000


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``width`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - width + 1].tolist()
    n = len(start)
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _RUN):
        bits = np.unpackbits(h[k : k + _RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for each row."""

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return per_batch(docs.selectExpr("cast(doc_id as long) doc_id", "text"), go, "doc_id long, fp long", by=1)


# The Golay code.

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of 23-bit words divided by the generator: the 11-bit syndrome."""
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (_GENERATOR << (bit - 11)), x)
    return x


@lru_cache(1)
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of up to three bits, its weight, and the errors of four bits, five where it has weight three."""
    least, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    four = [[] for _ in range(2048)]
    for w in range(1, 5):
        e = np.array([sum(1 << i for i in at) for at in combinations(range(23), w)], np.int64)
        s = _remainder(e)
        if w < 4:
            least[s], weight[s] = e, w
        else:
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                four[a].append(b)
    others = np.array([x if len(x) == 5 else [0] * 5 for x in four], np.int64)
    return least, weight, others


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near each 23-bit segment: an array of six columns, and which of them hold."""
    least, weight, others = _decoder()
    s = _remainder(segment)
    found = np.empty((len(segment), 6), np.int64)
    found[:, 0] = segment ^ least[s]
    found[:, 1:] = segment[:, None] ^ others[s]
    holds = np.ones((len(segment), 6), bool)
    holds[:, 1:] = (weight[s] == 3)[:, None]
    return found >> 11, holds  # the upper twelve bits of a codeword tell it from any other


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the positions of the fingerprints they belong to."""
    bits = fps.view(np.uint64)
    segments = [(bits >> np.uint64(shift) & np.uint64(0x7FFFFF)).astype(np.int64) for shift in (0, 23, 46)]
    keys, owner = [], []
    for i in range(3):
        near, holds = codewords(segments[(i + 1) % 3])
        key = (i << 60) | (segments[i] << 12)[:, None] | near
        at = np.nonzero(holds)
        keys.append(key[at])
        owner.append(at[0])
    return np.concatenate(keys), np.concatenate(owner)


def _keyed(fps: DataFrame) -> DataFrame:
    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy()
        key, owner = golay_keys(fp)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], names=["key", "fp"])

    return per_batch(fps, go, "key long, fp long", rows=_KEYED)


# Links.


def bucket_links(node: np.ndarray, bits: np.ndarray, most: int, tile: int = 512) -> np.ndarray:
    """Of nodes and fingerprints of theirs (a row of words each), ``(node, root)`` rows that join those reachable over links inside the bucket."""
    x, n = bits.view(np.uint64), len(node)
    named, number = np.unique(node, return_inverse=True)
    root = np.arange(len(named))
    pairs = []
    for a in range(0, n, tile):
        for b in range(a, n, tile):
            apart = sum(np.bitwise_count(x[a : a + tile, None, k] ^ x[None, b : b + tile, k]).astype(np.int16) for k in range(x.shape[1]))
            i, j = np.nonzero(apart <= most)
            i, j = number[i + a], number[j + b]
            keep = i != j
            if keep.any():
                pairs.append((i[keep], j[keep]))
    if not pairs:
        return np.empty((0, 2), np.int64)
    i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    at = np.nonzero(root != np.arange(len(named)))[0]
    return np.stack([named[at], named[root[at]]], axis=1)


def _within(members: DataFrame, most: int, linked=bucket_links) -> DataFrame:
    """Links inside buckets, as ``linked`` finds them; ``members(key, node, w0, w1, ...)`` come sorted by key and node within each partition."""
    on_workers(members.sparkSession)
    words = len(members.columns) - 2

    def go(batches):
        held = [np.empty(0, np.int64)] * (2 + words)
        for batch in _ended(batches):
            if batch is not None:
                held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            key, node = held[:2]
            if not len(key):
                continue
            starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
            upto = len(starts) if batch is None else len(starts) - 1  # the last bucket may go on
            ends = np.r_[starts[1:], len(key)]
            bits = np.stack(held[2:], axis=1)
            out = [linked(node[a:b], bits[a:b], most) for a, b in zip(starts[:upto].tolist(), ends[:upto].tolist(), strict=True) if b - a > 1]
            rest = len(key) if batch is None else starts[-1]
            held = [h[rest:] for h in held]
            links = np.concatenate([np.empty((0, 2), np.int64), *out])
            if len(links):
                links = np.unique(links, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
        release()

    return members.mapInArrow(go, "a long, b long")


def _ended(batches):
    yield from batches
    yield None


def _meeting(fps: DataFrame) -> DataFrame:
    """Links at two bits or fewer among ``fps(fp)``, by the words within one bit of each: no pairs are made."""
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = fps.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("at")).where(F.size("at") > 1)
    return met.select(F.explode("at").alias("a"), F.array_min("at").alias("b")).where("a <> b").distinct()


def _neighbours(fps: DataFrame, most: int) -> DataFrame:
    """Links at one bit, or none, among ``fps(fp)``: each is looked for at the places one bit away."""
    flips = F.explode(F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))"))
    return fps.select(F.col("fp").alias("a"), flips.alias("b")).join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b").where(F.lit(most == 1))


def links(fps: DataFrame, most: int = 2, bucket: int = 2048) -> DataFrame:
    """``(a, b)`` rows that connect exactly the distinct fingerprints of ``fps(fp)`` that links reach.

    ``bucket`` is no cap: fuller buckets take the way of :func:`_meeting`.
    """
    if most > 2:
        raise ValueError("the keys are complete for two differing bits or fewer")
    keyed = _keyed(fps)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, "key"), "simhash-buckets")
    near = _within(members.where(F.col("n") <= bucket).select("key", F.col("fp").alias("node"), F.col("fp").alias("w0")).repartition("key").sortWithinPartitions("key", "node"), most)
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    far = _meeting(crowded) if most == 2 else _neighbours(crowded, most)
    out = cut(contracted(near.union(far)), "simhash-links")
    uncut(members)
    return out


def contracted(found: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the same components and few more rows than nodes.

    A member ``a`` has a link for each of its keys at most, to the least node it
    reached there. It keeps the least of these, and the others are linked to that.
    """
    least = F.min("b").over(Window.partitionBy("a"))
    each = found.distinct().withColumn("m", least)
    return each.select("a", F.col("m").alias("b")).union(each.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


# Components.


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the least node that it reaches.

    Alternating star steps: each node hands its larger neighbours, then its
    smaller ones, to the least node it knows. Every step is one aggregation and
    one join; a step's result is written to the shared folder, so that lineage
    stays short and a lost executor costs one step.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        then = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        same = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        uncut(now)
        now = then
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _least_ids(rooted: DataFrame) -> DataFrame:
    """``root, component_id``; cut off, so that the join with a large component's members can be split."""
    return cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")


def near_duplicates(docs: DataFrame, width: int = 5, most: int = 2, bucket: int = 2048) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id, copies`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the least id that links reach; ``copies`` counts the
    rows with this very fingerprint.
    """
    each = cut(fingerprints(docs, width), "simhash-fps")
    folded = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    found = links(folded.select("fp"), most, bucket)
    reach = components(found).withColumnRenamed("node", "fp")
    rooted = folded.join(reach, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = _least_ids(rooted)
    labelled = rooted.join(least, "root").select("fp", "component_id", "copies")
    return each.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
