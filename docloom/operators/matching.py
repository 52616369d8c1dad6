"""Matching of items with the table rows of their documents: attribute bundles, and a matcher by rules.

A bundle is what matching asks of a record, worked out once: normalised texts and
their shingles, for entities also those of their cells. :func:`rule_matches` needs
no model: similarity above a threshold, and all that are best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.linkage import best_with_ties, exploded


def _bundle(df: DataFrame, fields: dict[str, Column], n: int) -> DataFrame:
    """``<name>_norm`` and ``<name>_grams`` of each field; words are a projection of their own, so that they are made once."""
    norm = df.withColumns({f"{k}_norm": T.normalize(c) for k, c in fields.items()})
    words = norm.withColumns({f"{k}_words": T.tokens(F.col(f"{k}_norm")) for k in fields})
    return words.withColumns({f"{k}_grams": T.shingles(F.col(f"{k}_words"), n) for k in fields}).drop(*(f"{k}_words" for k in fields))


def entity_attributes(df: DataFrame, name: str = "entity_inferred_name", n: int = 2) -> DataFrame:
    """Entities with ``name_norm``, ``name_grams``, ``cells_norm`` and ``cell_grams``; cells are parted by bars."""
    out = _bundle(df, {"name": F.coalesce(F.col(name), F.lit(""))}, n)
    out = out.withColumn("cells_norm", F.transform(T.cells(F.coalesce(F.col(name), F.lit(""))), T.normalize))
    return out.withColumn("cell_grams", F.transform("cells_norm", lambda c: T.shinglize(c, n)))


def item_attributes(df: DataFrame, fields: list[str], n: int = 2) -> DataFrame:
    """Items with ``<field>_norm`` and ``<field>_grams`` for each text field."""
    return _bundle(df, {f: F.coalesce(F.col(f), F.lit("")) for f in fields}, n)


def table_features(source: Column, name: Column) -> Column:
    """Whether the row is of a dotted table, and how many parts its name has between bars."""
    dotted = F.contains(source, F.lit("dot")).cast("double")
    return F.create_map(F.lit("DOTTED_TABLE"), dotted, F.lit("NUM_CELLS"), F.size(F.split(name, r"\|")).cast("double"))


@dataclass(frozen=True)
class ClassPairs:
    """Items and entities of equal texts as one class, and the similar classes of each document.

    ``scored``: ``document_id, item_class, entity_class, score, n`` (how many pairs of members it stands for); ``items`` and ``entities``: the members, with ``document_id``.
    A class is the SHA-256 of its normalised texts.
    """

    scored: DataFrame
    items: DataFrame
    entities: DataFrame

    def expanded(self, scored: DataFrame | None = None) -> DataFrame:
        """``item_id, document_id, entity_id, score`` of all members of the pairs, or of those in ``scored``."""
        pairs = (self.scored if scored is None else scored).select("document_id", "item_class", "entity_class", "score")
        items = pairs.join(self.items.hint("merge"), ["document_id", "item_class"]).drop("item_class")
        return items.join(self.entities.hint("merge"), ["document_id", "entity_class"]).select("item_id", "document_id", "entity_id", "score")


def _classed(df: DataFrame, keys: list[str], fields: dict[str, Column], name: str) -> DataFrame:
    """``df``'s keys with normalised fields, and their digest; a bar is in no normalised text, so it parts them."""
    norm = df.select(*keys, *(T.normalize(F.coalesce(c, F.lit(""))).alias(f) for f, c in fields.items()))
    return norm.withColumn(name, F.unhex(F.sha2(F.concat_ws("|", *fields), 256)))


def class_pairs(items: DataFrame, item_documents: DataFrame, entities: DataFrame, fields: list[str], n: int = 2) -> ClassPairs:
    """Pairs of classes of one document that share a shingle.

    The score is the largest similarity of the entity's name with one of the
    item's ``fields``. Only different texts meet, by document and shingle, and intersections are counted by
    partial aggregation; members are joined to what is left of the pairs. The size of a
    packed table tells nothing of what is made of it, so the joins ask for a sort-merge: nothing goes through the driver.
    """
    i = _classed(items, ["item_id"], {f: F.col(f) for f in fields}, "item_class")
    e = _classed(entities, ["document_id", "entity_id"], {"name": F.col("entity_inferred_name")}, "entity_class")
    members = i.select("item_id", "item_class").join(item_documents.select("item_id", "document_id").hint("merge"), "item_id").distinct()
    texts = i.select("item_class", *fields).distinct()
    words = texts.select("item_class", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x")).select("item_class", "x.field", T.tokens(F.col("x.text")).alias("words"))
    a = exploded(words.select("item_class", "field", T.shingles(F.col("words"), n).alias("grams")).withColumn("n_item", F.size("grams")))
    a = a.join(members.groupBy("document_id", "item_class").agg(F.count("*").alias("n_items")).hint("merge"), "item_class")
    names = e.groupBy("document_id", "entity_class", "name").agg(F.count("*").alias("n_entities")).withColumn("words", T.tokens(F.col("name")))
    b = exploded(names.select("document_id", "entity_class", "n_entities", T.shingles(F.col("words"), n).alias("grams")).withColumn("n_entity", F.size("grams")))
    sizes = ("n_item", "n_entity", "n_items", "n_entities")
    shared = a.join(b.hint("merge"), ["document_id", "gram"]).groupBy("document_id", "item_class", "entity_class", "field").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in sizes))
    score = F.col("shared") / (F.col("n_item") + F.col("n_entity") - F.col("shared"))
    scored = shared.groupBy("document_id", "item_class", "entity_class").agg(F.max(score).alias("score"), F.first(F.col("n_items") * F.col("n_entities")).alias("n"))
    return ClassPairs(scored, members, e.select("document_id", "entity_class", "entity_id"))


def scored_pairs(items: DataFrame, item_documents: DataFrame, entities: DataFrame, fields: list[str], n: int = 2) -> DataFrame:
    """``item_id, document_id, entity_id, score`` of items and entities of their documents that share a shingle, by :func:`class_pairs`. Ids are keys of their tables."""
    return class_pairs(items, item_documents, entities, fields, n).expanded()


def rule_matches(items: DataFrame, item_documents: DataFrame, entities: DataFrame, fields: list[str], threshold: float = 0.5, n: int = 2) -> DataFrame:
    """The best entities of each item in each of its documents, above the threshold; equals together. Chosen by class: members of a class have the same scores."""
    pairs = class_pairs(items, item_documents, entities, fields, n)
    return pairs.expanded(best_with_ties(pairs.scored, ["document_id", "item_class"], "score", threshold))


def to_store(matches: DataFrame, item_documents: DataFrame, manual: bool = False) -> DataFrame:
    """Matches as rows of the table of matched entities; only where the item and the document are linked."""
    linked = item_documents.groupBy("item_id", "document_id").agg(F.min("id").alias("item_document_id"))
    rows = matches.join(linked.hint("merge"), ["item_id", "document_id"])
    return rows.select("item_document_id", F.col("entity_id").alias("matched_entity_id"), F.lit(manual).alias("manual_match")).distinct()


def longest_match(df: DataFrame, keys: list[str], c: str, name: str = "longest") -> DataFrame:
    """The longest text of each key; of equally long ones the first by name."""
    best = F.min_by(F.col(c), F.struct(-F.length(c), F.col(c)))
    return df.groupBy(*keys).agg(best.alias(name))
