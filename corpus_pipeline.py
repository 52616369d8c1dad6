"""From raw documents to packed sequences: toxicity, repetition, near-duplicates, personal data, packing.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)``.
All but the last return rows of ``documents`` with its columns; each stage's
result is written as Parquet and read back as the next one's ``docs``.

Defined cases, in every stage: a null text counts as empty, and stays null where it is kept; texts
are taken whole; rows that repeat an id are documents of their own; columns beyond
``doc_id`` and ``text`` pass through whatever their names; an empty table goes through all
stages and gives no rows. What each stage adds to that is said at its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, neardup, packing, privacy, repetition, toxicity
from docloom.llm.common import cut, table, uncut


#: Pieces of text that a worker of the last stage remembers; what ran before has left it less memory than packing alone has.
MEMO = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain calls toxic; one at the cut-off is toxic, an empty one is not, and without labels none is."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.Settings())
    return toxicity.keep_civil(docs, chain)


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the repetition rules fail: too repetitive, or under ten words, empty ones among them; a share at its limit passes."""
    return repetition.keep_unrepetitive(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts with a similarity of 0.8 or more over five-word shingles.

    The one with the least id stays, of equal ids the first, and one without an id only if its group has none with one.
    """
    return neardup.keep_one(docs, width=5, least=0.8)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it in every text; ``n_chars`` follows, no row goes."""
    return privacy.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed sequences; an empty text is its end id alone."""
    spec = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.digests(packing.pack(docs, spec, memo=MEMO))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_repetitive),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: Models, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            uncut(before)
        before = docs
    return docs
