"""Near-duplicate texts: Golay-keyed SimHash candidates, completed by rare shingles, confirmed on whole sets of shingles.

Texts are linked when the Jaccard similarity of their sets of shingles (five
words each) is ``least`` (0.8) or more; groups are what links reach. Two bits of 64
(:mod:`docloom.llm.simhash`) are far stricter than that, so candidates come in two steps.

1. Golay keys of SimHash fingerprints of the set of words, which edits move far
   less than those of shingles. Of a bucket each member meets the bucket's leaders only, so a
   group of any size costs its members. What is confirmed is one group from then on.
2. Rare shingles. Sets of that similarity have one in common among the first fifth
   of each, whatever the order they are listed in (:func:`prefix`); frequent ones are listed
   last. Buckets of one group are left out; in the others, members of different groups
   are compared. With this step no link is missed.

Before a pair is confirmed, sizes and a parity sketch rule out what cannot be
similar: two sets differ in as many shingles at least as their parities differ in bits. The
sketch of 1024 bits travels with the keys; a finer one, in proportion to the set, is read for the pairs that are left.

Crowded buckets (over ``bucket`` members) go by blocks, so no task holds more than
two blocks of one. Their members first meet one block of leaders, which joins a large
group of near copies at a cost in proportion to it; then members outside the largest group
meet all others, block by block. Nothing is capped or sampled.

Shingles are 64-bit numbers, rolled over the XXH64 hashes of words in numpy.
Texts are read twice: for sketches, and by those wanted for confirmation, which a
bit table of fixed size picks before anything is shuffled.

Defined cases: a null text counts as empty; empty and wordless texts are alike; a text of fewer
words than a shingle is one shingle; rows that repeat an id are rows of their own; of equal ids
the row that comes first in the table goes before the others; a row without an id goes last; very long
texts are taken whole, and their sets of shingles are held one block of texts at a time;
an empty table gives an empty result; columns of any other name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import HOT_ROWS, counted_join, cut, on_workers, per_batch, release, screen_of, screened, uncut
from docloom.llm.simhash import SEED, components, golay_keys

#: Fingerprints of the set of words that keys are made of, and bits counted at once.
TABLES = 2
_RUN = 1 << 16
#: Words of the parity sketch that travels with keys.
PARITY = 16
_PARITY = [f"p{k}" for k in range(PARITY)]
#: Most frequent shingles that are told to all workers; more of them only shorten buckets.
_HOT = 1 << 16
#: Words remembered with their hashes within a block of texts, and the longest of them in bytes.
_MEMO, _LONGEST = 100_000, 64
#: Texts whose keys are made at once.
_KEYED = 1000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# Sets of shingles.


class _Hashes(dict):
    """Hashes of words, of bounded size."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= _LONGEST:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = h
        return h


def _mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Another 64-bit hash from each of ``h``, one family for each seed."""
    z = h + np.uint64(int(_ODD[0]) * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * _ODD[1]
    z = (z ^ (z >> np.uint64(27))) * _ODD[2]
    return z ^ (z >> np.uint64(31))


def word_hashes(text: str | None, known: _Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def hashed_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words of each text of a block."""
    known = _Hashes()
    return (word_hashes(x.as_py(), known) for x in column)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The different shingles of a text with these word hashes, ascending; fewer words than ``width`` are one shingle."""
    n = min(width, len(words))
    if not n:
        return np.empty(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _ODD[1] + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(h))


def _majorities(h: np.ndarray, seeds: int) -> list[int]:
    """A fingerprint of the distinct hashes ``h`` for each seed: a bit is set if it is in over half of them."""
    ones = np.zeros((seeds, 64), np.int64)
    for k in range(0, len(h), _RUN):
        for s in range(seeds):
            bits = np.unpackbits(_mixed(h[k : k + _RUN], s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[s] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view(np.int64).reshape(-1).tolist()


def parity(shingles: np.ndarray, words: int = PARITY) -> np.ndarray:
    """A bit for each cell of hashes, set if an odd number of shingles is in it; ``words`` is a power of two."""
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fine_parity(shingles: np.ndarray) -> np.ndarray:
    """A parity sketch of a word for each 32 shingles or fewer."""
    return parity(shingles, 1 << max(4, (len(shingles) // 32).bit_length()))


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that two parity sketches differ in, the longer one folded to the length of the other."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def may_differ(a, b, least: float):
    """In how many shingles sets of these sizes can differ when they are similar."""
    return (1 - least) / (1 + least) * (a + b) + 1e-9


def prefix(shingles: np.ndarray, hot: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in one order of all, the frequent ones (``hot``, ascending) last: sets of similarity ``least`` share one of theirs.

    A set that is similar to another has ``least`` of its shingles in common with
    it, so of the first of both, one more than the rest of each can miss, one is
    common. That holds for any order; this one keeps the buckets small.
    """
    n = len(shingles)
    take = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        rank = np.where(hot[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, rank))[:take]]


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that texts most often share within a block of texts, ascending, and how often; they only set an order."""

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words, width) for words in hashed_texts(batch.column(0))]
        s, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["s", "n"])

    met = per_batch(rows.select("text"), go, "s long, n long", by=0).groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(_HOT).toArrow()
    s, n = met.column("s").to_numpy().view(np.uint64), met.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


#: Tells texts apart; a null text counts as empty.
_HASHED = "xxhash64(coalesce(text, '')) h"


def _sketches(rows: DataFrame, width: int, least: float) -> DataFrame:
    """``id, h, node, size, p0, ..., tables, prefix`` for each row; rows of one ``node`` have one set of shingles."""
    sent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, width))  # at most _HOT shingles

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, keyed, size, odd, firsts = [], [], [], [], []
        for words in hashed_texts(batch.column(1)):
            shingles = shingle_set(words, width)
            node.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
            keyed.append(_majorities(np.unique(words), TABLES))
            size.append(len(shingles))
            odd.append(parity(shingles))
            firsts.append(prefix(shingles, *sent.value, least).view(np.int64))
        cols = [pa.array([p[k] for p in odd], pa.int64()) for k in range(PARITY)]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (keyed, firsts)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), *cols, *lists], names=["id", "h", "node", "size", *_PARITY, "tables", "prefix"])

    return per_batch(rows.selectExpr("id", "text", _HASHED), go, "id long, h long, node long, size long, " + "".join(f"{p} long, " for p in _PARITY) + "tables array<long>, prefix array<long>", by=1)


# Candidates.


def set_pairs(node: np.ndarray, held: np.ndarray, least: float, every: bool, tile: int = 16) -> np.ndarray:
    """``(a, b)`` of different groups whose sets can have the similarity ``least``: all, or for each node the first one.

    ``held`` are rows of a group, the size of the set and its parity.
    """
    c, size, x = held[:, 0], held[:, 1], held[:, 2:].view(np.uint64)
    out = [np.empty((0, 2), np.int64)]
    for a in range(0, len(node), tile):
        mine = size[a : a + tile, None]
        # What the sizes differ in is the least that the sets can.
        near = (np.abs(mine - size) <= may_differ(mine, size, least)) & (c[a : a + tile, None] != c)
        i, j = np.nonzero(near)
        if len(i):
            bits = np.bitwise_count(x[i + a] ^ x[j]).sum(axis=1, dtype=np.int64)
            near[i, j] = bits <= may_differ(size[i + a], size[j], least)
        if every:
            i, j = np.nonzero(near & (node[a : a + tile, None] < node))
        else:
            i = np.nonzero(near.any(axis=1))[0]
            j = near[i].argmax(axis=1)
        out.append(np.stack([node[i + a], node[j]], axis=1))
    return np.concatenate(out)


def _pairs_within(members: DataFrame, least: float, every: bool) -> DataFrame:
    """``a, b`` of :func:`set_pairs` inside buckets; ``members(key, node, c, size, p0, ...)``, of bounded buckets."""
    on_workers(members.sparkSession)

    def go(batches):
        held = [np.empty(0, np.int64)] * (4 + PARITY)
        for batch in _ended(batches):
            if batch is not None:
                held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            key, node = held[:2]
            if not len(key):
                continue
            starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
            upto = len(starts) if batch is None else len(starts) - 1  # the last bucket may go on
            ends = np.r_[starts[1:], len(key)]
            rest = np.stack(held[2:], axis=1)
            out = [set_pairs(node[a:b], rest[a:b], least, every) for a, b in zip(starts[:upto].tolist(), ends[:upto].tolist(), strict=True) if b - a > 1]
            keep = len(key) if batch is None else starts[-1]
            held = [h[keep:] for h in held]
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        release()

    return members.repartition("key").sortWithinPartitions("key", "node").mapInArrow(go, "a long, b long")


def _ended(batches):
    yield from batches
    yield None


def _shared(keyed: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """``key, node, c, n, lo`` of the keys in ``keyed(key, node, c)`` that nodes of different groups have; cut off.

    ``n`` is the bucket's size, ``lo`` its least group. Keys are met by partial
    aggregation, so a hot one is never brought together; what is shared is
    written first, so that the join knows its size and the hot keys.
    """
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "n", "lo")
    met = cut(met, "near-keys")
    out = cut(counted_join(keyed, met, "key", "n", "node", hot), "near-shared")
    uncut(met)
    return out


def _leaders(shared: DataFrame, bucket: int) -> DataFrame:
    """Buckets of which each member meets one block of leaders."""
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    mine = shared.withColumn("mine", F.pmod(F.hash("node"), blocks)).withColumn("blocks", blocks)
    # A leader is in every block; the others are in their own.
    at = mine.withColumn("block", F.explode(F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))))
    return at.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "block"))).select("key", "node")


def _blocks(shared: DataFrame, bucket: int) -> DataFrame:
    """Buckets, crowded ones as pairs of blocks, in which all members of different groups meet.

    The group ``lo``, which is the one of the least node and so most often the largest, meets the others but not
    itself: a bucket costs its size times the number of those outside that group.
    """
    few = shared.where(F.col("n") <= bucket).select("key", "node")
    many = shared.where(F.col("n") > bucket)
    outside = many.where("c <> lo").groupBy("key").agg(F.count("*").alias("outside"))
    k, m = F.ceil(F.col("outside") / bucket).cast("int"), F.ceil((F.col("n") - F.col("outside")) / bucket).cast("int")
    at = many.join(outside, "key").withColumn("k", k).withColumn("m", m).withColumn("mine", F.when(F.col("c") == F.col("lo"), F.col("k") + F.pmod(F.hash("node"), F.col("m"))).otherwise(F.pmod(F.hash("node"), F.col("k"))))
    others = F.when(F.col("c") == F.col("lo"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") + F.col("m") - 1))
    met = at.withColumn("other", F.explode(others))
    return few.union(met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node"))


def _with_sketches(buckets: DataFrame, grouped: DataFrame) -> DataFrame:
    return buckets.join(grouped.select("node", "c", "size", *_PARITY), "node").select("key", "node", "c", "size", *_PARITY)


def _golay_keyed(grouped: DataFrame) -> DataFrame:
    """``key, node, c`` of the Golay keys of all fingerprints."""

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, c = (batch.column(k).to_numpy() for k in (0, 1))
        fps = np.stack([np.asarray(x.as_py(), np.int64) for x in batch.column(2)])
        keys, owners = zip(*(golay_keys(np.ascontiguousarray(fps[:, t])) for t in range(TABLES)), strict=True)
        owner = np.concatenate(owners)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key | t << 40 for t, key in enumerate(keys)])), pa.array(node[owner]), pa.array(c[owner])], names=["key", "node", "c"])

    return per_batch(grouped.select("node", "c", "tables"), go, "key long, node long, c long", rows=_KEYED)


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets of shingles have a Jaccard similarity of ``least`` or more; cut off."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "h"), "node"), "near-wanted")
    texts = screened(rows.selectExpr("text", _HASHED), "h", screen_of(wanted, "h")).join(wanted, "h").select("node", "text").dropDuplicates(["node"])

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words, width) for words in hashed_texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fine_parity(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "fine", "shingles"])

    sets = cut(per_batch(texts, of, "node long, fine binary, shingles binary", by=1), "near-sets")
    uncut(wanted)

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both)

    close = cut(_where(_joined(pairs, sets, "fine", "length(shingles) div 8 size"), lambda x, y, m, n: apart(x.view(np.int64), y.view(np.int64)) <= may_differ(m, n, least)), "near-close")
    uncut(pairs)
    out = cut(_where(_joined(close, sets, "shingles", "0L size"), lambda x, y, m, n: near(x, y)), "near-confirmed")
    uncut(close, sets)
    return out


def _joined(pairs: DataFrame, sets: DataFrame, column: str, size: str) -> DataFrame:
    """``a, b, of_a, of_b, n_a, n_b``: pairs with a column and the size of both sets."""
    of_a, of_b = (sets.selectExpr(f"node {k}", f"{column} of_{k}", size.replace(" size", f" n_{k}")) for k in "ab")
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b", "n_a", "n_b")


def _where(joined: DataFrame, keep: Callable) -> DataFrame:
    """``a, b`` of the rows whose values ``keep`` takes."""

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, x, y, m, n = batch.columns
        mask = [keep(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), i, j) for p, q, i, j in zip(x, y, m.to_pylist(), n.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return per_batch(joined, go, "a long, b long", by=3)


# Groups.


def _roots(links: list[DataFrame]) -> DataFrame:
    """``node, c`` of the nodes that links reach, with their component; cut off."""
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return cut(components(every).withColumnRenamed("root", "c"), "near-roots")


def _grouped(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with their component; those that no link reaches are their own."""
    return nodes.join(roots, "node", "left").withColumn("c", F.coalesce("c", "node"))


def similar(rows: DataFrame, width: int = 5, least: float = 0.8, bucket: int = 4096, hot: int = HOT_ROWS) -> DataFrame:
    """``id, component_id`` for each of ``rows(id, text)``, ids all different: the least id that links of similarity ``least`` reach.

    A key, a set or a group of over ``hot`` rows is joined in parts.
    """
    each = cut(_sketches(rows, width, least), "near-sketches")
    first = cut(each.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "near-first")
    # Of rows with one set the first stands for all; the others are left out of the search.
    copies = cut(counted_join(each.select("id", "node"), first, "node", "copies", "id", hot).where("id <> first_id").select("id", "node"), "near-copies")
    nodes = each.join(copies.select("id"), "id", "left_anti")
    confirmed = lambda buckets, grouped, every: _confirmed(_pairs_within(_with_sketches(buckets, grouped), least, every), nodes, rows, width, least)

    grouped = nodes.withColumn("c", F.col("node"))
    shared = _shared(_golay_keyed(grouped), hot)
    links = [confirmed(_leaders(shared, bucket), grouped, False)]
    uncut(shared)
    roots = _roots(links)
    grouped = _grouped(nodes, roots)

    rare = lambda grouped: grouped.select(F.explode("prefix").alias("key"), "node", "c")
    shared = _shared(rare(grouped), hot)
    if shared.where(F.col("n") > bucket).limit(1).count():
        # Large groups of near copies that the keys left in parts become one before their members are compared.
        links.append(confirmed(_leaders(shared.where(F.col("n") > bucket), bucket), grouped, False))
        uncut(shared, roots)
        roots = _roots(links)
        grouped = _grouped(nodes, roots)
        shared = _shared(rare(grouped), hot)
    links.append(confirmed(_blocks(shared, bucket), grouped, True))
    uncut(shared, roots)

    roots = _roots(links)
    ids = nodes.select("node", F.col("id").alias("first_id"))
    reached = cut(roots.join(ids, "node"), "near-reached")
    least_id = cut(reached.groupBy("c").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "near-least")
    component = counted_join(reached.select("node", "c"), least_id, "c", "n", "node", hot).select("node", "component_id")
    named = ids.join(component, "node", "left").join(first.select("node", "copies"), "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    named = cut(named, "near-names")
    out = cut(counted_join(each.select("id", "node"), named, "node", "copies", "id", hot).select("id", "component_id"), "near-components")
    uncut(each, first, copies, roots, reached, least_id, named, *links)
    return out


#: Files whose numbers are sent to all workers, at most.
_FILES = 100_000
#: Steps of a plan that give each row of a scan once or not at all.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View"}


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of files, of whose rows some may be left out but none comes twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROWWISE:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row that stays the same however often it is read.

    Rows of a scan of files are numbered by their file and place in it; any other rows, whose place could be that
    of several, are written first. No column of ``docs`` begins with ``name``.
    """
    files = len(docs.inputFiles()) if _is_scan(docs) else 0
    try:
        if not 0 < files <= _FILES:
            raise AnalysisException("not numbered by place")
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_place"))
    except AnalysisException:
        return cut(docs.withColumn(name, F.monotonically_increasing_id()), "near-rows")
    order = placed.select(f"{name}_file").distinct().withColumn(f"{name}_no", F.row_number().over(Window.orderBy(f"{name}_file")))  # at most _FILES rows
    return placed.join(F.broadcast(order), f"{name}_file").withColumn(name, F.shiftleft(F.col(f"{name}_no").cast("long"), 40) + F.col(f"{name}_place")).select(*docs.columns, name)


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, hot: int = HOT_ROWS) -> DataFrame:
    """One row of each component of similar texts with all columns of ``docs``: the one with the least ``doc_id``, of these the first.

    Rows are told apart by their place, so ids may repeat or be missing. Texts are not shuffled unless
    the numbers of the rows that go are too many to be sent to the workers.
    """
    name = "near_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    numbered = _numbered(docs, name)
    found = similar(numbered.select(F.col(name).alias("id"), "text"), width, least, hot=hot)
    ids = numbered.select(F.col(name).alias("id"), F.col("doc_id").cast("long").alias("doc_id"))
    sizes = cut(found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    many = cut(counted_join(found, sizes, "component_id", "n", "id", hot).join(ids, "id").select("component_id", "id", "doc_id"), "near-many")
    first = many.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"), F.count("*").alias("n"))
    first = cut(first.select("component_id", F.col("first.id").alias("kept"), "n"), "near-kept")
    gone = cut(counted_join(many, first, "component_id", "n", "id", hot).where("id <> kept").select(F.col("id").alias(name)), "near-gone")
    uncut(found, sizes, many, first)
    return numbered.join(gone, name, "left_anti").drop(name)
