"""Selections for training: labelled pairs, what is still unlabelled, flags, instances, sets for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the store's items, and what the yearly extracts call them.
EXTRACT_COLUMNS = {
    "item_id": "earmark_id",
    "item_code": "earmark_code",
    "agency": "agency_title",
    "bureau": "bureau_title",
    "account": "account_title",
    "program": "program",
    "enacted_year": "enacted_year",
    "short_description": "short_description",
    "full_description": "earmark_description",
    "item_type": "earmark_type_name",
    "spendcom": "spendcom",
    "recipient": "recipient",
}


def labelled_pairs(labels: DataFrame, least: float = 0.1) -> DataFrame:
    """``item_id, entity_id, label`` of labels that stand for a match that was looked at: with a document, similar enough."""
    return labels.where((F.col("document_id") > 0) & (F.col("jaccard") > least)).select("item_id", "entity_id", "label")


def table_names(entities: DataFrame) -> DataFrame:
    """Distinct names of entities that come from tables."""
    return entities.where("source = 'table'").select("entity_inferred_name").distinct()


def unlabelled(items: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a label."""
    return items.join(labels.select(*keys).distinct(), keys, "left_anti")


def with_flags(entities: DataFrame, matches: DataFrame, negatives: DataFrame) -> DataFrame:
    """Entities with ``is_matched`` and ``is_negative``: whether a match, or a reader's no, names them."""
    m = matches.select(F.col("matched_entity_id").alias("entity_id"), F.lit(True).alias("is_matched")).distinct()
    n = negatives.select("entity_id", F.lit(True).alias("is_negative")).distinct()
    return entities.join(m, "entity_id", "left").join(n, "entity_id", "left").na.fill(False, ["is_matched", "is_negative"])


def clean_extract(df: DataFrame) -> DataFrame:
    """The twelve columns of an extract that the store keeps, under its names."""
    return df.select(*(F.col(old).alias(new) for new, old in EXTRACT_COLUMNS.items()))


def labelled_instances(pairs: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Labelled pairs with the attributes of both sides as structs ``item`` and ``entity``; pairs with a side missing are left out."""
    i = items.select("item_id", F.struct(*items.columns).alias("item"))
    e = entities.select("entity_id", F.struct(*entities.columns).alias("entity"))
    return pairs.join(i, "item_id").join(e, "entity_id")


def training_set(positives: DataFrame, negatives: DataFrame, label: str = "label") -> DataFrame:
    """Both sets one under the other with their label."""
    return positives.withColumn(label, F.lit(1)).unionByName(negatives.withColumn(label, F.lit(0)), allowMissingColumns=True)


def group_probe(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """For each group of ``test`` its size there and in ``train``; group 0 is no group."""
    a = test.where(F.col(key) != 0).groupBy(key).agg(F.count("*").alias("n_test"))
    b = train.where(F.col(key) != 0).groupBy(key).agg(F.count("*").alias("n_train"))
    return a.join(b, key, "left").na.fill(0, ["n_train"])


def to_relabel(scored: DataFrame, y: str, p: str, score: str, key: str, num: int = 20, least: float = 0.25) -> DataFrame:
    """The surest wrong alarms, which a reader should see again: a top-k by score."""
    wrong = scored.where((F.col(y) == 0) & (F.col(p) == 1) & (F.col(score) > least))
    return wrong.orderBy(F.col(score).desc(), key).limit(num)


def relabelled(labels: DataFrame, answers: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Labels with a reader's answers in place of what was there."""
    new = answers.select(*keys, F.col(label).alias("_answer"))
    return labels.join(new, keys, "left").withColumn(label, F.coalesce("_answer", label)).drop("_answer").select(*labels.columns)
