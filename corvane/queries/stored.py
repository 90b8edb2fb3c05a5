"""Stored tables: lookups, filters, upserts, deletes and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.ids import chunk_key, document_id, uuid5
from corvane.functions.text import extension, stem
from corvane.functions import vectors
from corvane.operators import lifecycle
from corvane.plans.lineage import folder_for, written
from corvane.plans.numbering import numbered
from corvane.queries.graphs import UUID
from corvane.queries.registry import query

UNIQUE = "c AS (SELECT chunk_id, max_by(text, coalesce(metadata['ingested_at'], '')) AS text, max_by(document_id, coalesce(metadata['ingested_at'], '')) AS document_id FROM chunks GROUP BY chunk_id)"


def unique_chunks(t):
    age = F.coalesce(F.col("metadata")["ingested_at"], F.lit(""))
    return lifecycle.last_of_key(t.chunks.select("chunk_id", "text", "document_id", age.alias("age")), ["chunk_id"], F.col("age"))


@query("K01_write_chunks", f"SELECT chunk_id, {UUID.format('chunk_id')} AS uuid, max(coalesce(metadata['ingested_at'], '')) AS age FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2")
def write_chunks(t):
    """Chunks by their deterministic uuid, the latest delivery of each, merged into a stored table and read from it."""
    path = folder_for(t.spark, "chunks")
    lifecycle.write_upsert(unique_chunks(t).where("chunk_id is not null").select("chunk_id", uuid5("chunk_id").alias("uuid"), "text", "document_id", "age"), path, ["uuid"])
    return lifecycle.read_table(t.spark, path).select("chunk_id", "uuid", "age")


@query("K02_import_text_docs", "SELECT doc_id, coalesce(nullif(session_id, ''), 'default') AS session_id, coalesce(document_id || '_chunk_' || page_num, md5(coalesce(text, ''))) AS chunk_id FROM documents")
def import_docs(t):
    return t.documents.select("doc_id", F.coalesce(F.nullif("session_id", F.lit("")), F.lit("default")).alias("session_id"), F.coalesce(chunk_key(F.col("document_id"), F.col("page_num")), F.md5(F.coalesce("text", F.lit("")))).alias("chunk_id"))


@query("K09_safe_metadata_project", "SELECT DISTINCT chunk_id, metadata['file_path'] AS file_path, metadata['session_id'] AS session_id FROM chunks WHERE metadata IS NOT NULL")
def safe_metadata(t):
    kept = lifecycle.safe_metadata("metadata", ["file_path", "session_id"])
    return t.chunks.where("metadata is not null").select("chunk_id", kept.alias("m")).select("chunk_id", F.col("m")["file_path"].alias("file_path"), F.col("m")["session_id"].alias("session_id")).distinct()


@query("K10_image_upsert", "SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS squared FROM (SELECT id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM (SELECT id, max_by(embedding, created_at) AS e FROM vectors WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY id) WHERE sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y::DOUBLE))) > 1e-10)")
def image_upsert(t):
    """Finite vectors, unit length, the latest of each id."""
    finite = t.vectors.where(F.col("embedding").isNotNull() & vectors.finite("embedding"))
    last = finite.groupBy("id").agg(F.max_by("embedding", "created_at").alias("e")).where(vectors.norm("e") > 1e-10)
    return last.select("id", vectors.unit("e").alias("v")).select("id", F.round(vectors.dot("v", "v"), 4).alias("squared"))


@query("K11_delete_document", "SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM extractions WHERE document_id IS NOT NULL)")
def delete(t):
    return lifecycle.delete_documents(t.chunks.where("document_id is not null"), t.extractions.where("document_id is not null")).select("chunk_id")


RESOLVED = "w AS (SELECT DISTINCT metadata['file_path'] AS path FROM chunks WHERE metadata['file_path'] IS NOT NULL UNION SELECT '/data/new/' || source || '.md' FROM documents), st AS (SELECT DISTINCT metadata['file_path'] AS path, document_id FROM chunks WHERE metadata['file_path'] IS NOT NULL), r AS (SELECT path, 1 AS p, document_id FROM w JOIN st USING (path) UNION ALL SELECT path, 2, md5(path) FROM w WHERE md5(path) IN (SELECT document_id FROM chunks) UNION ALL SELECT path, 3, md5(path) FROM w), m AS (SELECT path, p, document_id, row_number() OVER (PARTITION BY path ORDER BY p, document_id) AS n FROM r)"


def wanted(t):
    known = t.chunks.select(F.col("metadata")["file_path"].alias("path")).where("path is not null")
    return known.union(t.documents.select(F.concat(F.lit("/data/new/"), F.col("source"), F.lit(".md")))).distinct()


@query("K12_resolve_document_uuids", f"WITH {RESOLVED} SELECT path, document_id, p AS priority FROM m WHERE n = 1")
def resolve(t):
    return lifecycle.resolve_documents(wanted(t), t.chunks)


@query("K13_delete_by_filename", f"WITH {RESOLVED} SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM m WHERE n = 1 AND contains(path, '/drafts/'))")
def delete_files(t):
    gone = lifecycle.resolve_documents(wanted(t), t.chunks).where(F.contains("path", F.lit("/drafts/"))).select("document_id")
    return lifecycle.delete_documents(t.chunks.where("document_id is not null"), gone).select("chunk_id")


@query("K14_document_uuid_map", "WITH s AS (SELECT DISTINCT metadata['session_id'] AS session_id, document_id FROM chunks WHERE metadata['session_id'] IS NOT NULL) SELECT x.document_id, coalesce(min(s.session_id), 'default') AS session_id FROM (SELECT DISTINCT document_id FROM chunks) x LEFT JOIN s USING (document_id) GROUP BY 1")
def uuid_map(t):
    s = t.chunks.select("document_id", F.col("metadata")["session_id"].alias("session_id")).where("session_id is not null").distinct()
    return t.chunks.select("document_id").distinct().join(s, "document_id", "left").groupBy("document_id").agg(F.coalesce(F.min("session_id"), F.lit("default")).alias("session_id"))


@query("K17_write_markdown_pages", "SELECT document_id, string_agg('### ' || page_id || '.png' || chr(10) || text, chr(10) || chr(10) ORDER BY page_id) AS markdown FROM (SELECT page_id, any_value(document_id) AS document_id, max(coalesce(natural_text, '')) AS text FROM page_responses GROUP BY page_id) GROUP BY 1")
def write_pages(t):
    rows = t.page_responses.groupBy("page_id").agg(F.first("document_id").alias("document_id"), F.max(F.coalesce("natural_text", F.lit(""))).alias("text"))
    line = F.concat(F.lit("### "), F.col("page_id").cast("string"), F.lit(".png\n"), F.col("text"))
    texts = rows.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("markdown"))
    return written(texts, "json")


@query("K18_write_graph_json", """SELECT document_id, entities, relations, first_name FROM (
    SELECT document_id, len(list_filter(e, lambda x: x IS NOT NULL)) AS entities, coalesce(len(r), 0) AS relations, e[1].name AS first_name FROM (SELECT document_id, max_by(entities, extracted_at) AS e, arg_max_null(relations, extracted_at) AS r FROM extractions GROUP BY 1))""")
def graph_json(t):
    """One JSON line for each document, written once and read back with the reader's schema."""
    told = F.when(F.col("entities").isNotNull(), F.col("extracted_at"))  # a delivery without entities leaves those before
    last = t.extractions.groupBy("document_id").agg(F.max_by("entities", told).alias("entities"), F.max_by("relations", "extracted_at").alias("relations"))
    read = written(last, "json")
    return read.select("document_id", F.size(F.filter("entities", lambda x: x.isNotNull())).alias("entities"), F.coalesce(F.size("relations"), F.lit(0)).alias("relations"), F.get("entities", F.lit(0))["name"].alias("first_name"))


@query("K19_merge_metadata_files", "SELECT folder, min(path) AS title, count(*) AS files FROM (SELECT DISTINCT metadata['file_path'] AS path, regexp_extract(metadata['file_path'], '^(.*)/[^/]+$', 1) AS folder FROM chunks WHERE metadata['file_path'] IS NOT NULL) GROUP BY folder")
def merge_metadata(t):
    rows = t.chunks.select(F.col("metadata")["file_path"].alias("path")).where("path is not null").distinct()
    return rows.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).agg(F.min("path").alias("title"), F.count(F.lit(1)).alias("files"))


@query("A18_group_by_parent_folder", "SELECT folder, count(DISTINCT document_id) AS documents FROM (SELECT document_id, regexp_extract(metadata['file_path'], '^(.*)/[^/]+$', 1) AS folder FROM chunks WHERE metadata['file_path'] IS NOT NULL) GROUP BY folder")
def by_folder(t):
    rows = t.chunks.select("document_id", F.col("metadata")["file_path"].alias("path")).where("path is not null").select("document_id", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    return rows.groupBy("folder").agg(F.countDistinct("document_id").alias("documents"))


@query("K20_catalog_backup_retention", "SELECT event_id, name FROM (SELECT event_id, 'catalog.json.' || strftime(ts, '%Y%m%d%H%M%S') || '.bak' AS name, ts FROM events) WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(t):
    rows = t.events.select("event_id", F.concat(F.lit("catalog.json."), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".bak")).alias("name"), "ts")
    last = t.events.agg(F.max("ts").alias("m")).first()["m"]
    return rows.where(F.col("ts") < F.lit(last) - F.expr("INTERVAL 10 DAYS")).select("event_id", "name")


@query("K22_write_file_catalog", "SELECT count(DISTINCT metadata['file_path']) AS total_files, 1.0::DOUBLE AS version FROM chunks")
def write_catalog(t):
    """The files as JSON lines beside a header, both written and read back."""
    files = written(t.chunks.select(F.col("metadata")["file_path"].alias("path")).where("path is not null").distinct(), "json")
    header = files.agg(F.count(F.lit(1)).alias("total_files")).withColumn("version", F.lit(1.0))
    return written(header, "json")


@query("S10_fetch_by_id", "SELECT w.id, coalesce(n.name, w.id) AS name FROM (SELECT DISTINCT src AS id FROM graph_edges) w LEFT JOIN (SELECT id, min(name) AS name FROM graph_nodes GROUP BY id) n USING (id)")
def fetch(t):
    n = t.graph_nodes.groupBy("id").agg(F.min("name").alias("name"))
    return t.graph_edges.select(F.col("src").alias("id")).distinct().join(n, "id", "left").select("id", F.coalesce("name", "id").alias("name"))


@query("S11_fetch_objects", "SELECT doc_id, source FROM documents WHERE lang = 'ko' ORDER BY doc_id LIMIT 50")
def fetch_objects(t):
    return t.documents.where("lang = 'ko'").select("doc_id", "source").orderBy("doc_id").limit(50)


@query("S12_migrate_by_source", "SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source")
def migrate(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("S14_collection_counts", "SELECT 'chunks' AS name, count(*) AS n FROM chunks UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'graph_nodes', count(*) FROM graph_nodes")
def collections(t):
    counted = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("chunks", "documents", "graph_nodes")]
    return counted[0].union(counted[1]).union(counted[2])


@query("S05_scan_graph_json", "SELECT document_id, len(max_by(entities, extracted_at)) AS n FROM extractions GROUP BY 1")
def graph_files(t):
    """Written as JSON and read back with the reader's schema."""
    from corvane.sources.files import GRAPH

    last = t.extractions.groupBy("document_id").agg(F.max_by("entities", "extracted_at").alias("entities"))
    read = last.select("document_id", F.from_json(F.to_json(F.struct("document_id", "entities")), GRAPH).alias("g"))
    return read.select("document_id", F.size("g.entities").alias("n"))


@query("F01_doc_filter", "SELECT doc_id FROM documents WHERE document_id IN (SELECT document_id FROM extractions)")
def doc_filter(t):
    return t.documents.join(t.extractions.select("document_id").distinct(), "document_id", "left_semi").select("doc_id")


@query("F02_uuid_where", "SELECT doc_id FROM documents WHERE source IN ('upload_desk_main', 'image_ocr_manen')")
def uuid_where(t):
    return t.documents.where(F.col("source").isin("upload_desk_main", "image_ocr_manen")).select("doc_id")


@query("F03_like_filter", "SELECT chunk_id FROM chunks WHERE contains(metadata['file_path'], '/scans/') OR starts_with(chunk_id, 'a')")
def like(t):
    return t.chunks.where(F.contains(F.col("metadata")["file_path"], F.lit("/scans/")) | F.col("chunk_id").startswith("a")).select("chunk_id")


@query("F06_column_projection", "SELECT doc_id, source, page_num FROM documents")
def projection(t):
    return t.documents.select("doc_id", "source", "page_num")


@query("F11_image_index_filter", r"SELECT chunk_id, body, kind FROM (SELECT DISTINCT chunk_id, CASE WHEN contains(trim(regexp_replace(text, '\s+', ' ', 'g')), chunk_id) THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE chunk_id || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) END AS body, CASE WHEN contains(metadata['file_path'], 'chart') THEN 'chart' ELSE 'image' END AS kind FROM chunks WHERE metadata['file_path'] IS NOT NULL AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> '')")
def image_index(t):
    path = F.col("metadata")["file_path"]
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = t.chunks.where(path.isNotNull() & (body != "")).select("chunk_id", body.alias("b"), path.alias("path"))
    return rows.select("chunk_id", F.when(F.contains("b", F.col("chunk_id")), F.col("b")).otherwise(F.concat_ws(" ", "chunk_id", "b")).alias("body"), F.when(F.contains("path", F.lit("chart")), "chart").otherwise("image").alias("kind")).distinct()


@query("F14_skip_existing_resume", "SELECT DISTINCT document_id FROM documents WHERE document_id NOT IN (SELECT document_id FROM extractions WHERE document_id IS NOT NULL) AND document_id IS NOT NULL")
def resume(t):
    return lifecycle.not_done(t.documents.where("document_id is not null").select("document_id").distinct(), t.extractions, ["document_id"])


@query("J09_doc_uuid_left_join", f"WITH d AS (SELECT DISTINCT document_id FROM documents), e AS (SELECT DISTINCT document_id, {UUID.format('document_id')} AS document_uuid FROM extractions WHERE document_id IS NOT NULL) SELECT document_id, document_uuid FROM d LEFT JOIN e USING (document_id)")
def uuid_join(t):
    e = t.extractions.where("document_id is not null").select("document_id").distinct().withColumn("document_uuid", lifecycle.document_uuid("document_id"))
    return t.documents.select("document_id").distinct().join(e, "document_id", "left")


@query("J10_mixed_zip_cyclic", "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS j, count(*) OVER () AS n FROM supplier) SELECT c_custkey, s_suppkey FROM a JOIN b ON i % n = j")
def cyclic(t):
    n = t.supplier.count()
    a = numbered(t.customer.select("c_custkey"), F.col("c_custkey")).select("c_custkey", ((F.col("number") - 1) % max(n, 1)).alias("j"))
    b = numbered(t.supplier.select("s_suppkey"), F.col("s_suppkey")).select("s_suppkey", (F.col("number") - 1).alias("j"))
    return a.join(b, "j").select("c_custkey", "s_suppkey")


@query("U07_line_dedupe")
def lines(t):
    from corvane.operators.chunking import distinct_lines

    return t.documents.where("text is not null").select("doc_id", distinct_lines("text").alias("text"))


@query("W12_sorted_unique", "SELECT DISTINCT metadata['file_path'] AS path FROM chunks WHERE metadata['file_path'] IS NOT NULL ORDER BY path")
def sorted_unique(t):
    return t.chunks.select(F.col("metadata")["file_path"].alias("path")).where("path is not null").distinct().orderBy("path")


@query("X12_scalar_ids_paths", f"SELECT DISTINCT metadata['file_path'] AS path, md5(metadata['file_path']) AS md5, {UUID.format(chr(109) + 'etadata[' + chr(39) + 'file_path' + chr(39) + ']')} AS uuid, regexp_extract(metadata['file_path'], '([^/]+?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(metadata['file_path'], '[^/](\\.[^./]+)$', 1)) AS extension FROM chunks WHERE metadata['file_path'] IS NOT NULL")
def ids(t):
    rows = t.chunks.select(F.col("metadata")["file_path"].alias("path")).where("path is not null").distinct()
    return rows.select("path", document_id("path").alias("md5"), uuid5("path").alias("uuid"), stem("path").alias("stem"), extension("path").alias("extension"))
