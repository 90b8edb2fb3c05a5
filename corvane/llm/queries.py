"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import bpe_automaton, entity_matching, languages, near_copies, pack_containers, scan_repair, speaker_turns, split_items, text_quality, vector_neighbours
from corvane.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_pieces(spark, d):
    return split_items.split_oversized(table(spark, d, "chunks"), table(spark, d, "size_limits"))


def p1_found(spark, d):
    pieces = split_items.split_oversized(table(spark, d, "chunks"), table(spark, d, "size_limits"), only_oversized=True)
    return pieces.where("oversized and piece_no = 0").select("chunk_id")


def p2_found(spark, d):
    return near_copies.pairs_of_rows(*near_copies.near_copies(table(spark, d, "chunks")))


def p2_classes(spark, d):
    rows = near_copies.rows_with_links(*near_copies.near_copies(table(spark, d, "chunks")))
    return rows.select(F.col("id").alias("chunk_id"), "class_id", "copies", "links")


def language_items(spark, d):
    """Segments of pages (the latest row of each) and of chunks, with the labels of the pages."""
    profiles = languages.train(table(spark, d, "documents"))
    pages = scan_repair.distinct_pages(table(spark, d, "page_responses"), "primary_language").select("page_id", "natural_text", F.col("primary_language").alias("label"))
    of_pages = languages.segments(pages, profiles, "page_id", "natural_text").withColumn("source", F.lit("page"))
    of_chunks = languages.segments(table(spark, d, "chunks").where("chunk_id is not null"), profiles, "chunk_id", "text").withColumn("source", F.lit("chunk"))
    return pages, of_pages, of_chunks


def p3_segments(spark, d):
    _, of_pages, of_chunks = language_items(spark, d)
    every = of_pages.union(of_chunks).withColumnRenamed("id", "item_id")
    return every.dropDuplicates(["source", "item_id", "segment", "start"])


def p3_items(spark, d):
    """A row for every page_id and chunk_id, also of those without words."""
    _, of_pages, of_chunks = language_items(spark, d)
    pages = languages.every_item(table(spark, d, "page_responses"), "page_id", languages.documents_of(of_pages))
    chunks = languages.every_item(table(spark, d, "chunks"), "chunk_id", languages.documents_of(of_chunks))
    shown = lambda rows, source: rows.select(F.lit(source).alias("source"), F.col("id").alias("item_id"), "lang", "confidence", "languages")
    return shown(pages, "page").union(shown(chunks, "chunk"))


def p3_found(spark, d):
    pages, of_pages, of_chunks = language_items(spark, d)
    told = languages.documents_of(of_pages).join(pages.select(F.col("page_id").cast("string").alias("id"), languages.label_codes(F.col("label")).alias("code")), "id")
    case = lambda lang, kind: F.struct(lang.alias("lang"), kind.alias("kind"))
    further = F.transform(F.array_remove("languages", F.col("lang")), lambda x: case(x, F.lit("mixed")))
    label = F.when(F.col("code").isNull(), F.lit("missing")).when(F.col("code") != F.col("lang"), F.lit("wrong"))
    labels = F.when(label.isNotNull() & F.col("lang").isNotNull(), F.array(case(F.col("lang"), label))).otherwise(F.array().cast("array<struct<lang:string,kind:string>>"))
    of = lambda items, cases: items.select(F.col("id").alias("item_id"), F.explode(cases).alias("c")).select("item_id", "c.*")
    return of(told, F.concat(labels, further)).union(of(languages.documents_of(of_chunks), further))


def p4_rows(spark, d):
    return vector_neighbours.usable(table(spark, d, "vectors"))


def p4_found(spark, d):
    return vector_neighbours.mutual_pairs(vector_neighbours.neighbours(p4_rows(spark, d), least_cosine=0.9), 0.9)


def p4_neighbours(spark, d):
    """The queries are the rows whose chunk number is divisible by 20, against all rows."""
    rows = p4_rows(spark, d)
    asked = rows.where(F.pmod(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"), F.lit(20)) == 0)
    return vector_neighbours.neighbours(rows, asked)


def p5_matches(spark, d):
    return entity_matching.match_entities(table(spark, d, "extractions"), table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"))


def p5_found(spark, d):
    return p5_matches(spark, d).where("confidence > 0.5").select("document_id", "entity_id", "node_id").distinct()


def p6_turns(spark, d):
    return speaker_turns.speaker_turns(table(spark, d, "transcriptions"))


def p6_found(spark, d):
    return speaker_turns.turn_starts(table(spark, d, "transcriptions"))


def p7_pages(spark, d):
    from corvane.plans.lineage import cut

    return cut(scan_repair.distinct_pages(table(spark, d, "page_responses")))


def p7_found(spark, d):
    return scan_repair.faults(p7_pages(spark, d))


def p7_text(spark, d):
    return scan_repair.continuous_text(p7_pages(spark, d))


def p8_ids(spark, d):
    return bpe_automaton.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark, d):
    return pack_containers.pack(table(spark, d, "documents"))


def p10_quality(spark, d):
    return text_quality.quality(table(spark, d, "documents"), table(spark, d, "quality_labels"))


def p10_found(spark, d):
    return p10_quality(spark, d).where("kind <> 'prose'").select("doc_id", "kind").distinct()


NAMES = "p1_found p1_pieces p2_found p2_classes p3_found p3_segments p3_items p4_found p4_neighbours p5_found p5_matches p6_found p6_turns p7_found p7_text p8_ids p9_containers p10_found p10_quality".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        return run

    return {name: shipped(globals()[name]) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT chunk_id FROM (
                SELECT c.chunk_id, length(c.text) AS n, l.max_size,
                       row_number() OVER (PARTITION BY c.chunk_id ORDER BY coalesce(c.metadata['ingested_at'], '') DESC, coalesce(length(c.text), -1) DESC,
                                          c.document_id DESC NULLS LAST, c.start_pos DESC NULLS LAST, c.token_start DESC NULLS LAST, l.max_size DESC NULLS LAST) AS r
                FROM chunks c LEFT JOIN size_limits l ON lower(trim(l.content_type)) = coalesce(lower(trim(c.content_type)), 'mixed'))
            WHERE r = 1 AND n > max_size""",
        "p4_found": """
            WITH latest AS (
                SELECT id, max_by(embedding, created_at) AS v FROM vectors
                WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_min(embedding) <> list_max(embedding)
                GROUP BY id),
            wide AS (SELECT id, list_transform(v, lambda x: x::DOUBLE) AS v FROM latest),
            near AS (
                SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS c,
                       row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS r
                FROM wide a JOIN wide b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.9)
            SELECT x.id AS chunk_id_a, x.other AS chunk_id_b FROM near x JOIN near y ON x.id = y.other AND x.other = y.id
            WHERE x.r <= 10 AND y.r <= 10 AND x.id < x.other""",
    }
