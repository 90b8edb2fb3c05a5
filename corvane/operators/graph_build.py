"""From extracted entities and relations to graph tables: parsing, filters, upserts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.ids import uuid5
from corvane.functions.text import normalized, relation_type

#: Names that stand for nothing, types and words of analogies, wordings that say nothing.
PLACEHOLDERS = ["name", "type", "relationship", "example", "entityname", "entitytype", "actualentityname", "relationshipdescription", "description", "...", "none", "n/a"]
NON_TECHNICAL = ["material", "ingredient", "object", "tool", "equipment", "recipe"]
ANALOGIES = ["cake", "butter", "flour", "sugar", "milk", "vanilla", "egg", "eggs", "baking powder", "oven", "pan", "toothpick", "frosting", "recipe", "batter", "ingredient", "kitchen", "bake"]
GENERIC = ["relates to", "relatesto", "depends on", "dependson"]
ENTITY_LINE, RELATION_LINE = r"(ENT_\d+)\s*\|\s*([^|]+)\|\s*([^|\n]+)", r"(ENT_\d+)\s*->\s*(ENT_\d+)\s*\(([^)]+)\)"


def is_placeholder(name: Column | str) -> Column:
    return F.lower(F.trim(name)).isin(*PLACEHOLDERS)


def is_analogy(name: Column | str, kind: Column | str) -> Column:
    found = F.coalesce(normalized(kind), F.lit("")).isin(*NON_TECHNICAL)
    for word in ANALOGIES:
        found = found | F.contains(F.coalesce(normalized(name), F.lit("")), F.lit(word))
    return found


def is_generic(relation: Column | str) -> Column:
    return normalized(relation).isin(*GENERIC)


def entity_key(entity_id: str, name: str) -> Column:
    """entity_id, else name, else "Unknown", stripped."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(entity_id), some(name), F.lit("Unknown"))


def upsert_entities(entities: DataFrame) -> DataFrame:
    """``document_id, key, uuid, name, type``: one row for each key of a document, the last by ``pos`` wins."""
    keyed = entities.withColumn("key", entity_key("entity_id", "name"))
    last = keyed.groupBy("document_id", "key").agg(F.max(F.struct("pos", "name", "type")).alias("e"))
    return last.select("document_id", "key", uuid5(F.concat_ws(":", "document_id", "key")).alias("uuid"), F.coalesce(F.col("e.name"), F.col("key")).alias("name"), F.col("e.type").alias("type"))


def upsert_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends are known in their document, with a default wording; each once."""
    a = entities.select("document_id", F.col("key").alias("source_id"), F.col("uuid").alias("source_uuid"))
    b = entities.select("document_id", F.col("key").alias("target_id"), F.col("uuid").alias("target_uuid"))
    label = F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("related_to"))
    return relations.join(a, ["document_id", "source_id"]).join(b, ["document_id", "target_id"]).select("document_id", "source_uuid", "target_uuid", label.alias("relation")).distinct()


def upsert_events(events: DataFrame) -> DataFrame:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(some("name"), some("title"), F.lit("Unknown"))
    return events.select("document_id", name.alias("name")).distinct().withColumn("uuid", uuid5("name"))


def merge_nodes(nodes: DataFrame, order: Column) -> DataFrame:
    """One node for each id, the last write wins."""
    return nodes.groupBy("id").agg(F.max(F.struct(order.alias("o"), "name", "type", "doc_id")).alias("n")).select("id", "n.name", "n.type", "n.doc_id")


def merge_edges(edges: DataFrame, nodes: DataFrame, by_relation: bool = True) -> DataFrame:
    """Edges whose ends exist, one for each key: with the relation in the key, or by ends alone, where the greatest
    wording of the last document wins."""
    ends = nodes.select("id").distinct()
    known = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "tgt"), "tgt", "left_semi").withColumn("relation", F.coalesce("relation", F.lit("")))
    if by_relation:
        return known.groupBy("src", "tgt", "relation").agg(F.max("doc_id").alias("doc_id"))
    return known.groupBy("src", "tgt").agg(F.max_by("relation", F.struct("doc_id", "relation")).alias("relation"))


def merge_properties(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Key-wise merge: for each column the last value that is not null."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*last)


def typed_edges(edges: DataFrame) -> DataFrame:
    """Edges with a relationship type and a default id."""
    kind = relation_type(F.coalesce("relation", F.lit("")))
    return edges.select(F.concat(F.col("doc_id"), F.lit(":rel:"), F.col("src"), F.lit("->"), F.col("tgt"), F.lit(":"), kind).alias("edge_id"), kind.alias("rel_type")).distinct()


def first_entities(entities: DataFrame) -> DataFrame:
    """The first of each normalised name and type in a document, by chunk and place; analogies and placeholders are
    dropped."""
    kept = entities.where(F.col("name").isNotNull() & ~is_placeholder("name") & ~is_analogy("name", "type"))
    w = Window.partitionBy("document_id", normalized("name"), F.coalesce(normalized("type"), F.lit(""))).orderBy("chunk_id", "pos")
    return kept.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def first_relations(relations: DataFrame) -> DataFrame:
    kept = relations.where(F.col("relation").isNotNull() & ~is_generic("relation"))
    w = Window.partitionBy("document_id", "source_id", "target_id", normalized("relation")).orderBy("chunk_id", "pos")
    return kept.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def parse_entity_lines(lines: DataFrame) -> DataFrame:
    """``ENT_n | name | type`` lines: ``chunk_id, line_no, raw_id, entity_id, name, type``."""
    part = lambda i: F.trim(F.regexp_extract("line", ENTITY_LINE, i))
    rows = lines.where(F.col("line").rlike(ENTITY_LINE)).select("chunk_id", "line_no", part(1).alias("raw_id"), part(2).alias("name"), F.trim(F.split(part(3), r"\(")[0]).alias("type"))
    rows = rows.withColumn("entity_id", F.concat(F.lit("c"), F.col("chunk_id").cast("string"), F.lit("_"), F.col("raw_id")))
    return rows.where(~is_placeholder("name") & ~is_analogy("name", "type"))


def parse_relation_lines(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """``ENT_a -> ENT_b (wording)`` lines whose ends are defined on earlier lines of the chunk."""
    part = lambda i: F.trim(F.regexp_extract("line", RELATION_LINE, i))
    rows = lines.where(F.col("line").rlike(RELATION_LINE)).select("chunk_id", "line_no", part(1).alias("a"), part(2).alias("b"), part(3).alias("relation"))
    known = entities.groupBy("chunk_id", "raw_id").agg(F.min("line_no").alias("at"))
    ka, kb = known.select("chunk_id", F.col("raw_id").alias("a"), F.col("at").alias("at_a")), known.select("chunk_id", F.col("raw_id").alias("b"), F.col("at").alias("at_b"))
    met = rows.join(ka, ["chunk_id", "a"]).join(kb, ["chunk_id", "b"]).where("at_a < line_no and at_b < line_no").where(~is_generic("relation"))
    return met.select("chunk_id", "line_no", F.col("a").alias("source_id"), F.col("b").alias("target_id"), "relation")
