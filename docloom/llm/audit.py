"""How five filters of documents act on each other, in every order they can be applied in.

Each document has five failure flags: A under 100 words; B different words under 80 % of all; C more than a tenth
of the characters in ``A-Z``; D any of ``#$%&*|``; E the text of a smaller ``doc_id``, anywhere in the table.
Documents are counted by part and flags, and ``CUBE`` over the five flags and the part sums these counts up: in the
grouping set of some flags, the row where all of them are false counts what survives those filters, whatever
their order. A step of an order is then a pair of subsets, before and after its filter.

Documents are shuffled by id, never by text, so copies of one text meet nowhere; texts themselves stay where they are read.
What is joined afterwards has 32 rows a part.

Defined cases: a null text is the empty text, a null ``lang`` the part ``""``. A null ``doc_id`` has no order: such a row
fails no E, and no other fails E for it; it has no label either. Rows that repeat a ``doc_id`` count each; of the same id and text none
is a copy of the other. Labels of repeated ids: any row's 1 counts; null labels are none. An empty table has no parts and gives no
rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
FULL = (1 << len(FILTERS)) - 1


def flags(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, A, B, C, D)`` of every document; only the digest of a text goes on."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    return words.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (n < 100).alias("A"), (100 * different < 80 * n).alias("B"),
        (100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > 10 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
    )


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and flags: ``(part, A, B, C, D, E, n, good, toxic)``."""
    d = flags(docs)
    # The row of a text that no smaller id has; joined by id and text, so that a text with many copies is no hot key.
    first = d.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    e = d.join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    return e.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """``(part, subset, n, good, toxic)`` for each part and each of the 32 subsets of filters, zeros included; bit ``i`` of ``subset`` is filter ``i``."""
    sums = counts.cube(*FILTERS, "part").agg(F.grouping_id().alias("gid"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    # The first of the six columns is the highest bit of the id; a bit is set where the column is not grouped by.
    subset = sum(F.when(F.expr(f"(gid & {1 << (len(FILTERS) - i)}) = 0"), 1 << i).otherwise(0) for i in range(len(FILTERS)))
    alive = sums.where("(gid & 1) = 0").where(" and ".join(f"not coalesce({c}, false)" for c in FILTERS)).select("part", subset.cast("int").alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(FULL))).alias("subset"))
    return every.join(alive, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")))


def gains(alive: DataFrame) -> DataFrame:
    """For each part, filter ``f`` and subset ``before`` without it: what ``f`` removes from the survivors; over all subsets, what it fails, fails alone and its Shapley sum."""
    k = len(FILTERS)
    before = alive.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_0") for c in ("n", "good", "toxic")), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f")).where("(shiftright(before, f) & 1) = 0")
    pairs = before.withColumn("subset", F.expr("before + shiftleft(1, f)")).join(alive, ["part", "subset"])
    one = pairs.select("part", "f", "before", F.col("n").alias("kept"), (F.col("n_0") - F.col("n")).alias("removed"), (F.col("good_0") - F.col("good")).alias("good_lost"), (F.col("toxic_0") - F.col("toxic")).alias("toxic_lost"))
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), F.bit_count("before") + 1)  # orders in which just ``before`` comes first
    of, here = Window.partitionBy("part", "f"), lambda where: F.when(where, F.col("removed"))
    return one.select(
        "*", F.max(here(F.col("before") == 0)).over(of).alias("fails"), F.max(here(F.bit_count("before") == k - 1)).over(of).alias("unique_fails"), F.sum(F.col("removed") * weight).over(of).alias("shapley")
    )


def steps() -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, f, before)``: five rows for each of the 120 orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, f in enumerate(order, 1):
            out.append((name, step, f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of filters and step; see the module's text."""
    g = gains(survivors(cut(counted(docs, labels), "audit")))  # read many times; 32 rows a part at most
    order = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, f int, before int")
    return g.join(F.broadcast(order), ["f", "before"]).select(  # 600 rows, whatever the tables
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
