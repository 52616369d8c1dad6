"""Pairs of similar texts by edit distance, without comparing all with all.

A text cut into ``most + 1`` pieces keeps one of them whole under ``most`` edits, and moves it by ``most`` places at most. So each text is
listed under its own pieces, and looks for those of texts of nearby lengths at the places where they may have gone to: an equi-join, of which
the few pairs that meet are compared. Texts that are equal are one until the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import written


def _pieces(most: int) -> str:
    """SQL for the array of ``(i, start, length)`` of the pieces of a text of length ``n``: the longer ones last."""
    k = most + 1
    return f"transform(sequence(0, {most}), i -> struct(i AS i, cast(i * (n div {k}) + greatest(0, i - ({k} - n % {k})) AS int) AS start, cast(n div {k} + if(i >= {k} - n % {k}, 1, 0) AS int) AS length))"


def similar_texts(df: DataFrame, c: str, most: int = 2) -> DataFrame:
    """``a, b, distance``: different texts of the column with an edit distance of ``most`` or less, once for each pair, ``a < b``.

    Distances count characters. Null texts are left out. Texts shorter than the number of pieces have empty ones, which they share
    with all texts of nearby lengths; such short texts are few kinds.
    """
    texts = written(df.select(F.col(c).cast("string").alias("t")).where("t is not null").distinct().withColumn("n", F.length("t")), "texts")
    listed = texts.select("t", "n", F.expr(f"explode({_pieces(most)})").alias("p")).select(F.col("t").alias("a"), F.col("n").alias("n_a"), "p.i", F.expr("substring(t, p.start + 1, p.length)").alias("piece"))
    nearby = texts.select(F.col("t").alias("b"), F.col("n").alias("n_b"), F.expr(f"explode(sequence(greatest(0, n - {most}), n + {most}))").alias("n"))
    probes = nearby.select("b", "n_b", F.col("n").alias("n_a"), F.expr(f"explode({_pieces(most)})").alias("p"))
    # Where a piece may have gone to.
    fits = probes.where(f"n_b >= p.length and n_b - p.length >= p.start - {most}")
    moved = fits.select("b", "n_a", "p.i", "p.length", F.expr(f"explode(sequence(greatest(0, p.start - {most}), least(n_b - p.length, p.start + {most})))").alias("at"))
    asked = moved.select("b", "n_a", "i", F.expr("substring(b, at + 1, length)").alias("piece")).distinct()
    met = listed.join(asked, ["n_a", "i", "piece"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0").select("a", "b", "distance")


def fuzzy_links(df: DataFrame, key: str, c: str, most: int = 2) -> DataFrame:
    """``key, text, n_same, n_near``: for each row how many rows share its text, itself included, and how many have another text that similar.

    Counted by text; rows of one text are never paired with each other.
    """
    rows = df.select(F.col(key), F.col(c).cast("string").alias("text"))
    size = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("n_same"))
    close = similar_texts(df, c, most).select("a", "b")
    both = close.unionAll(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.select(F.col("text").alias("b"), F.col("n_same").alias("n")), "b").groupBy(F.col("a").alias("text")).agg(F.sum("n").alias("n_near"))
    out = rows.join(size, "text", "left").join(near, "text", "left")
    return out.select(key, "text", F.coalesce("n_same", F.lit(0)).alias("n_same"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
