"""Graph construction, traversal, and merging of branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions.text import bm25_query
from corvane.operators import context, graph, graph_build, reasoning, retrieval
from corvane.queries.registry import Tables, query
from corvane.queries.search import CLEANED, bm25_sql

NODES = "n AS (SELECT id, min(name) AS name, min(type) AS type, min(doc_id) AS doc_id FROM graph_nodes GROUP BY id)"
EDGES = "e AS (SELECT DISTINCT src, tgt, coalesce(relation, '') AS relation, src || '|' || coalesce(relation, '') || '|' || tgt AS edge_id FROM graph_edges WHERE src IS NOT NULL AND tgt IS NOT NULL)"
BOTH = "b AS (SELECT src AS a, tgt AS b, edge_id FROM e UNION ALL SELECT tgt, src, edge_id FROM e WHERE src <> tgt)"
SEEDS = "s AS (SELECT DISTINCT id FROM n WHERE contains(lower(name), 'sensor') AND id IN (SELECT src FROM e UNION SELECT tgt FROM e))"
BFS = f"""WITH RECURSIVE {NODES}, {EDGES}, {BOTH}, {SEEDS},
    walk AS (SELECT id, 0 AS hop FROM s UNION SELECT b.b, walk.hop + 1 FROM walk JOIN b ON b.a = walk.id WHERE walk.hop < 3),
    reached AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id)"""


def nodes(t: Tables) -> DataFrame:
    return t.graph_nodes.groupBy("id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.min("doc_id").alias("doc_id"))


def edges(t: Tables) -> DataFrame:
    return graph.with_edge_ids(t.graph_edges)


def seeds(t: Tables, limit: int | None = None) -> DataFrame:
    terms = t.spark.createDataFrame([("sensor",)], "term string")
    return graph.seeds_by_term(nodes(t), edges(t), terms, limit)


@query("R10_crossref_traverse", BFS + " SELECT id, hop FROM reached")
def traverse(t):
    return graph.traverse(edges(t), seeds(t), 3)[0]


@query("R10_crossref_relations", BFS + " SELECT e.edge_id, min(r.hop) + 1 AS hop FROM reached r JOIN b ON b.a = r.id JOIN e ON e.edge_id = b.edge_id WHERE r.hop < 3 GROUP BY e.edge_id")
def traverse_relations(t):
    return graph.traverse(edges(t), seeds(t), 3)[1].select("edge_id", "hop")


@query("R11_crossref_search", BFS.replace("'sensor')", "'sensor') AND type IS NOT NULL") + " SELECT name, hop FROM reached JOIN n USING (id) WHERE hop > 0")
def crossref_search(t):
    """Seeds by name and type, two joins away from their names; seeds are not returned."""
    typed = seeds(t).join(nodes(t).where("type is not null").select("id"), "id", "left_semi")
    return graph.traverse(edges(t), typed, 3)[0].where("hop > 0").join(nodes(t), "id").select("name", "hop")


TRAILS = f"""WITH RECURSIVE {NODES}, {EDGES}, {BOTH}, {SEEDS}, starts AS (SELECT id FROM s ORDER BY id LIMIT 10),
    walk AS (SELECT id AS start, [id] AS ns, []::VARCHAR[] AS es, id AS at, 0 AS hops FROM starts
        UNION ALL SELECT start, list_append(ns, b.b), list_append(es, b.edge_id), b.b, hops + 1 FROM walk JOIN b ON b.a = walk.at WHERE hops < 6 AND NOT list_contains(es, b.edge_id)),
    p AS (SELECT DISTINCT start, ns, es, hops FROM walk WHERE hops > 0 ORDER BY start, hops, array_to_string(ns, '>'), array_to_string(es, '>') LIMIT 20)"""


def trails(t: Tables) -> DataFrame:
    return graph.paths(edges(t), seeds(t, 10), 6, 20)


@query("R12_deep_path_enumeration", TRAILS + " SELECT start, array_to_string(ns, '>') AS nodes, array_to_string(es, '>') AS edge_ids, hops FROM p")
def enumerate_paths(t):
    return trails(t).select("start", F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edge_ids"), "hops")


@query("R13_path_flatten_nodes", TRAILS + " SELECT name, type, doc_id AS document_id FROM (SELECT unnest(ns) AS id FROM p) LEFT JOIN n USING (id)")
def flatten_nodes(t):
    return graph.path_nodes(trails(t), nodes(t))


@query("R13_path_flatten_edges", TRAILS + " SELECT src, relation, tgt FROM (SELECT unnest(es) AS edge_id FROM p) JOIN e USING (edge_id)")
def flatten_edges(t):
    return graph.path_edges(trails(t), edges(t))


@query("W11_start_node_limit", f"WITH {NODES}, {EDGES}, {SEEDS} SELECT id FROM s ORDER BY id LIMIT 10")
def start_nodes(t):
    return seeds(t, 10)


@query("J06_seed_contains_join", f"WITH {NODES}, {EDGES}, {SEEDS} SELECT id FROM s")
def contains_join(t):
    return seeds(t)


@query("J01_reference_lookup", f"WITH {NODES}, {EDGES} SELECT e.src, e.tgt, e.relation, coalesce(a.name, '?') AS source_name, coalesce(b.name, '?') AS target_name FROM e LEFT JOIN n a ON a.id = e.src LEFT JOIN n b ON b.id = e.tgt")
def lookup(t):
    return graph.reference_lookup(edges(t), nodes(t))


@query("J02_endpoint_inner_join", f"WITH {NODES}, {EDGES} SELECT edge_id FROM e WHERE src IN (SELECT id FROM n) AND tgt IN (SELECT id FROM n)")
def endpoints(t):
    n = nodes(t).select("id")
    return edges(t).join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select("edge_id")


@query("J03_frontier_semi_join", f"WITH {NODES}, {EDGES}, {SEEDS} SELECT edge_id FROM e WHERE src IN (SELECT id FROM s) OR tgt IN (SELECT id FROM s)")
def frontier(t):
    return graph.touching(edges(t), seeds(t)).select("edge_id")


@query("J04_visited_anti_join", f"WITH {NODES}, {EDGES}, {BOTH}, {SEEDS} SELECT DISTINCT b.b AS id FROM b WHERE a IN (SELECT id FROM s) AND b.b NOT IN (SELECT id FROM s)")
def anti(t):
    s = seeds(t)
    return graph.both_ways(edges(t)).join(s.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(s, "id", "left_anti")


ENTITIES = """x AS (SELECT document_id, i - 1 AS pos, e.entity_id AS entity_id, e.name AS name, e.type AS type, e.chunk_id AS chunk_id FROM (
        SELECT document_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM (
            SELECT document_id, max_by(entities, extracted_at) AS entities, max_by(relations, extracted_at) AS relations FROM extractions GROUP BY document_id)))"""
RELATIONS = """y AS (SELECT document_id, i - 1 AS pos, r.source_id AS source_id, r.target_id AS target_id, r.relation AS relation, r.chunk_id AS chunk_id FROM (
        SELECT document_id, unnest(relations) AS r, generate_subscripts(relations, 1) AS i FROM (
            SELECT document_id, max_by(relations, extracted_at) AS relations FROM extractions GROUP BY document_id)))"""
NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
KEY = "coalesce(nullif(trim(entity_id), ''), nullif(trim(name), ''), 'Unknown')"
UUID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
    FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({})) AS h))"""
UPSERTED = f"{ENTITIES}, k AS (SELECT document_id, {KEY} AS key, max_by(name, pos) AS n, max_by(type, pos) AS type FROM x GROUP BY 1, 2), u AS (SELECT document_id, key, {UUID.format(chr(100) + 'ocument_id || ' + "':'" + ' || key')} AS uuid, coalesce(n, key) AS name, type FROM k)"


def latest(t: Tables) -> DataFrame:
    return t.extractions.groupBy("document_id").agg(F.max_by("entities", "extracted_at").alias("entities"), F.max_by("relations", "extracted_at").alias("relations"), F.max_by("events", "extracted_at").alias("events"))


def entities(t: Tables) -> DataFrame:
    return latest(t).select("document_id", F.posexplode("entities").alias("pos", "e")).select("document_id", "pos", "e.*")


def relations(t: Tables) -> DataFrame:
    return latest(t).select("document_id", F.posexplode("relations").alias("pos", "r")).select("document_id", "pos", "r.source_id", "r.target_id", "r.relation", "r.chunk_id")


@query("K03_upsert_entities_map", f"WITH {UPSERTED} SELECT document_id, key, uuid, name, type FROM u")
def upsert_entities(t):
    return graph_build.upsert_entities(entities(t))


@query("K04_upsert_relations_map", f"WITH {UPSERTED}, {RELATIONS} SELECT DISTINCT y.document_id, a.uuid AS source_uuid, b.uuid AS target_uuid, coalesce(nullif(trim(relation), ''), 'related_to') AS relation FROM y JOIN u a ON a.document_id = y.document_id AND a.key = source_id JOIN u b ON b.document_id = y.document_id AND b.key = target_id")
def upsert_relations(t):
    return graph_build.upsert_relations(relations(t), graph_build.upsert_entities(entities(t)))


@query("K05_upsert_events", f"""WITH v AS (SELECT document_id, unnest(events) AS e FROM (SELECT document_id, max_by(events, extracted_at) AS events FROM extractions GROUP BY document_id)),
    d AS (SELECT DISTINCT document_id, coalesce(nullif(trim(e.name), ''), nullif(trim(e.title), ''), 'Unknown') AS name FROM v) SELECT document_id, name, {UUID.format('name')} AS uuid FROM d""")
def upsert_events(t):
    return graph_build.upsert_events(latest(t).select("document_id", F.explode("events").alias("e")).select("document_id", "e.name", "e.title"))


@query("K06_graph_merge_A", f"WITH {NODES} SELECT src, tgt, coalesce(relation, '') AS relation, max(doc_id) AS doc_id FROM graph_edges WHERE src IN (SELECT id FROM n) AND tgt IN (SELECT id FROM n) GROUP BY 1, 2, 3")
def merge_a(t):
    return graph_build.merge_edges(t.graph_edges, nodes(t))


@query("K07_graph_merge_B", f"WITH {NODES} SELECT src, tgt, max_by(coalesce(relation, ''), doc_id || '|' || coalesce(relation, '')) AS relation FROM graph_edges WHERE src IN (SELECT id FROM n) AND tgt IN (SELECT id FROM n) GROUP BY 1, 2")
def merge_b(t):
    return graph_build.merge_edges(t.graph_edges, nodes(t), by_relation=False)


KIND = "CASE WHEN regexp_matches(replace(upper(trim(coalesce(relation, ''))), ' ', '_'), '^[A-Z_][A-Z0-9_]*$') THEN replace(upper(trim(coalesce(relation, ''))), ' ', '_') ELSE 'RELATION' END"


@query("K08_graph_merge_C", f"SELECT DISTINCT doc_id || ':rel:' || src || '->' || tgt || ':' || {KIND} AS edge_id, {KIND} AS rel_type FROM graph_edges")
def merge_c(t):
    return graph_build.typed_edges(t.graph_edges)


@query("K08_merge_properties", "SELECT document_id, max_by(content_type, chunk_index) FILTER (content_type IS NOT NULL) AS content_type, max_by(token_end, chunk_index) FILTER (token_end IS NOT NULL) AS token_end FROM (SELECT document_id, chunk_index, max(content_type) AS content_type, max(token_end) AS token_end FROM chunks GROUP BY 1, 2) GROUP BY 1")
def merge_properties(t):
    rows = t.chunks.groupBy("document_id", "chunk_index").agg(F.max("content_type").alias("content_type"), F.max("token_end").alias("token_end"))
    return graph_build.merge_properties(rows, "document_id", ["content_type", "token_end"], "chunk_index")


IS_PLACEHOLDER = "lower(trim(name)) IN (" + ", ".join(f"'{p}'" for p in graph_build.PLACEHOLDERS) + ")"
IS_ANALOGY = f"(coalesce({NORM.format('type')}, '') IN (" + ", ".join(f"'{p}'" for p in graph_build.NON_TECHNICAL) + ") OR " + " OR ".join(f"contains(coalesce({NORM.format('name')}, ''), '{w}')" for w in graph_build.ANALOGIES) + ")"
IS_GENERIC = f"{NORM.format('relation')} IN (" + ", ".join(f"'{p}'" for p in graph_build.GENERIC) + ")"


@query("F08_analogy_entity_filter", f"WITH {ENTITIES} SELECT document_id, entity_id FROM x WHERE NOT {IS_ANALOGY}")
def analogy(t):
    return entities(t).where(~graph_build.is_analogy("name", "type")).select("document_id", "entity_id")


@query("F09_placeholder_filter", f"WITH {ENTITIES} SELECT document_id, entity_id, name FROM x WHERE name IS NOT NULL AND NOT {IS_PLACEHOLDER}")
def placeholder(t):
    return entities(t).where(F.col("name").isNotNull() & ~graph_build.is_placeholder("name")).select("document_id", "entity_id", "name")


@query("F10_generic_relation_filter", f"WITH {RELATIONS} SELECT document_id, pos, relation FROM y WHERE relation IS NOT NULL AND NOT {IS_GENERIC}")
def generic(t):
    return relations(t).where(F.col("relation").isNotNull() & ~graph_build.is_generic("relation")).select("document_id", "pos", "relation")


@query("A03_distinct_entity_name_type", f"WITH {ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, {NORM.format('name')}, coalesce({NORM.format('type')}, '') ORDER BY chunk_id, pos) AS r FROM x WHERE name IS NOT NULL AND NOT {IS_PLACEHOLDER} AND NOT {IS_ANALOGY}) SELECT document_id, entity_id, name FROM r WHERE r = 1")
def first_entities(t):
    return graph_build.first_entities(entities(t)).select("document_id", "entity_id", "name")


@query("A04_distinct_relation", f"WITH {RELATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, source_id, target_id, {NORM.format('relation')} ORDER BY chunk_id, pos) AS r FROM y WHERE relation IS NOT NULL AND NOT {IS_GENERIC}) SELECT document_id, source_id, target_id, relation FROM r WHERE r = 1")
def first_relations(t):
    return graph_build.first_relations(relations(t)).select("document_id", "source_id", "target_id", "relation")


LINES = """l AS (SELECT c AS chunk_id, n AS line_no, CASE WHEN n % 3 = 2 THEN 'ENT_' || (n - 2) || ' -> ENT_' || (n - 1) || ' (' || CASE WHEN c % 5 = 0 THEN 'relates to' ELSE 'uses' END || ')' ELSE 'ENT_' || n || ' | ' || p_name || ' | ' || CASE WHEN n % 7 = 0 THEN 'recipe' ELSE p_type END || ' (' || p_brand || ')' END AS line
    FROM (SELECT p_partkey // 6 AS c, p_partkey % 6 AS n, p_name, p_type, p_brand FROM part))"""


def lines(t: Tables) -> DataFrame:
    rows = t.part.select(F.floor(F.col("p_partkey") / 6).cast("bigint").alias("chunk_id"), (F.col("p_partkey") % 6).alias("line_no"), "p_name", "p_type", "p_brand")
    n = F.col("line_no")
    relation = F.concat(F.lit("ENT_"), (n - 2).cast("string"), F.lit(" -> ENT_"), (n - 1).cast("string"), F.lit(" ("), F.when(F.col("chunk_id") % 5 == 0, "relates to").otherwise("uses"), F.lit(")"))
    entity = F.concat(F.lit("ENT_"), n.cast("string"), F.lit(" | "), F.col("p_name"), F.lit(" | "), F.when(n % 7 == 0, F.lit("recipe")).otherwise(F.col("p_type")), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return rows.select("chunk_id", "line_no", F.when(n % 3 == 2, relation).otherwise(entity).alias("line"))


PARSED = f"""{LINES}, pe AS (SELECT chunk_id, line_no, trim(regexp_extract(line, '(ENT_\\d+)\\s*\\|\\s*([^|]+)\\|\\s*([^|\\n]+)', 1)) AS raw_id, trim(regexp_extract(line, '(ENT_\\d+)\\s*\\|\\s*([^|]+)\\|\\s*([^|\\n]+)', 2)) AS name,
        trim(split_part(trim(regexp_extract(line, '(ENT_\\d+)\\s*\\|\\s*([^|]+)\\|\\s*([^|\\n]+)', 3)), '(', 1)) AS type FROM l WHERE regexp_matches(line, '(ENT_\\d+)\\s*\\|\\s*([^|]+)\\|\\s*([^|\\n]+)')),
    pk AS (SELECT * FROM pe WHERE NOT {IS_PLACEHOLDER} AND NOT {IS_ANALOGY})"""


@query("P07_entity_line_parse", f"WITH {PARSED} SELECT chunk_id, line_no, raw_id, name, type, 'c' || chunk_id || '_' || raw_id AS entity_id FROM pk")
def entity_lines(t):
    return graph_build.parse_entity_lines(lines(t))


@query("P08_relation_line_parse", f"""WITH {PARSED}, rl AS (SELECT chunk_id, line_no, regexp_extract(line, '(ENT_\\d+)\\s*->\\s*(ENT_\\d+)\\s*\\(([^)]+)\\)', 1) AS a, regexp_extract(line, '(ENT_\\d+)\\s*->\\s*(ENT_\\d+)\\s*\\(([^)]+)\\)', 2) AS b, regexp_extract(line, '(ENT_\\d+)\\s*->\\s*(ENT_\\d+)\\s*\\(([^)]+)\\)', 3) AS relation FROM l WHERE regexp_matches(line, '(ENT_\\d+)\\s*->\\s*(ENT_\\d+)'))
    SELECT rl.chunk_id, rl.line_no, a AS source_id, b AS target_id, relation FROM rl JOIN pk x ON x.chunk_id = rl.chunk_id AND x.raw_id = a AND x.line_no < rl.line_no JOIN pk z ON z.chunk_id = rl.chunk_id AND z.raw_id = b AND z.line_no < rl.line_no WHERE NOT {IS_GENERIC}""")
def relation_lines(t):
    return graph_build.parse_relation_lines(lines(t), graph_build.parse_entity_lines(lines(t)))


@query("P09_normalize_text", f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents")
def normalize(t):
    from corvane.functions.text import normalized

    return t.documents.select("doc_id", normalized("text").alias("normalized"))


#: A branch is an extraction's document within its session, scored by its number of entities.
BRANCHES = f"""{ENTITIES}, sess AS (SELECT document_id, max_by(session_id, extracted_at) AS question_id FROM extractions GROUP BY 1), be AS (SELECT question_id, document_id AS branch_id, name FROM x JOIN sess USING (document_id) WHERE name IS NOT NULL AND question_id IS NOT NULL),
    br AS (SELECT question_id, branch_id, round(count(*) / 10.0, 6) AS score FROM be GROUP BY 1, 2), pl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, branch_id) AS place FROM br)"""


def branches(t: Tables) -> tuple[DataFrame, DataFrame]:
    session = t.extractions.groupBy("document_id").agg(F.max_by("session_id", "extracted_at").alias("question_id"))
    rows = entities(t).where("name is not null").join(session.where("question_id is not null"), "document_id").select("question_id", F.col("document_id").alias("branch_id"), "name")
    return rows.groupBy("question_id", "branch_id").agg(F.round(F.count(F.lit(1)) / 10.0, 6).alias("score")), rows


@query("A08_top_k_merge", f"WITH {BRANCHES} SELECT be.question_id, be.branch_id, name FROM be JOIN pl USING (question_id, branch_id) WHERE place <= 2")
def top_merge(t):
    return reasoning.merge_top_k(*branches(t), 2)


@query("A07_weighted_union_merge", f"WITH {BRANCHES} SELECT question_id, name, max(score) AS score FROM be JOIN br USING (question_id, branch_id) GROUP BY 1, 2")
def weighted(t):
    return reasoning.merge_weighted(*branches(t))


@query("A06_vote_merge", f"""WITH {BRANCHES}, v AS (SELECT question_id, name, count(DISTINCT branch_id) AS votes FROM be GROUP BY 1, 2 HAVING count(DISTINCT branch_id) >= 2)
    SELECT question_id, name, votes FROM v UNION ALL SELECT question_id, name, 1 FROM (SELECT DISTINCT be.question_id, be.branch_id, name FROM be JOIN pl USING (question_id, branch_id) WHERE place = 1 AND be.question_id NOT IN (SELECT question_id FROM v))""")
def votes(t):
    return reasoning.merge_votes(*branches(t))


@query("A02_extend_unique", f"WITH {ENTITIES}, s AS (SELECT *, coalesce(nullif(entity_id, ''), nullif(name, '')) AS sig, row_number() OVER (PARTITION BY coalesce(nullif(entity_id, ''), nullif(name, '')) ORDER BY document_id || '|' || lpad(pos::VARCHAR, 6, '0')) AS r FROM x) SELECT document_id, entity_id FROM s WHERE r = 1")
def unique(t):
    rows = entities(t).withColumn("o", F.concat_ws("|", "document_id", F.lpad(F.col("pos").cast("string"), 6, "0")))
    return reasoning.extend_unique(rows, ["entity_id", "name"], "o").select("document_id", "entity_id")


@query("A09_counts", f"WITH {ENTITIES}, {RELATIONS} SELECT document_id, coalesce(ne, 0) AS entities, coalesce(nr, 0) AS relations FROM (SELECT document_id, count(*) AS ne FROM x GROUP BY 1) FULL JOIN (SELECT document_id, count(*) AS nr FROM y GROUP BY 1) USING (document_id)")
def counts(t):
    a = entities(t).groupBy("document_id").agg(F.count(F.lit(1)).alias("ne"))
    b = relations(t).groupBy("document_id").agg(F.count(F.lit(1)).alias("nr"))
    return a.join(b, "document_id", "full").select("document_id", F.coalesce("ne", F.lit(0)).alias("entities"), F.coalesce("nr", F.lit(0)).alias("relations"))


@query("A05_doc_source_set", f"WITH {NODES}, {EDGES}, {SEEDS} SELECT name, coalesce(string_agg(DISTINCT doc_id, ', ' ORDER BY doc_id), 'GraphRAG/cross_ref') AS sources FROM n GROUP BY name")
def source_set(t):
    return nodes(t).groupBy("name").agg(F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_set("doc_id")), ", "), F.lit("")), F.lit("GraphRAG/cross_ref")).alias("sources"))


OVERLAP = "len(list_intersect(qt, list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-zA-Z가-힣]+'))))"
WORDS = "['sensor', 'index', 'network', '색인']"


@query("R22_edge_prune", f"WITH {NODES}, qq AS (SELECT {WORDS} AS qt) SELECT id FROM n, qq WHERE {OVERLAP.format('name')} / len(qt) >= 0.2")
def prune(t):
    return reasoning.prune(nodes(t), F.lit("sensor index network 색인"), "name").select("id")


@query("R23_thought_score_fallback", f"""WITH qq AS (SELECT {WORDS} AS qt), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_agg(coalesce(name, '') || ' ' || coalesce(type, ''), ' ' ORDER BY id)), '[a-zA-Z가-힣]+')) AS rt FROM (SELECT id, min(name) AS name, min(type) AS type, min(doc_id) AS doc_id FROM graph_nodes GROUP BY id) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN len(rt) = 0 THEN 0.0 ELSE round(least(1.0, len(list_intersect(qt, rt)) / len(qt) + least(0.2, len(rt) / 100.0)), 6) END AS score FROM d, qq""")
def thought_score(t):
    text = F.concat_ws(" ", F.sort_array(F.collect_list(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("type", F.lit(""))))))
    return nodes(t).groupBy("doc_id").agg(text.alias("text")).select("doc_id", reasoning.coverage_score(F.lit("sensor index network 색인"), "text").alias("score"))


SNIPPETS = f"""WITH {NODES}, {EDGES}, sn AS (
    SELECT 0 AS kind, id AS pos, '[엔티티] ' || coalesce(nullif(name, ''), 'unknown') || coalesce(' (' || nullif(type, '') || ')', '') AS snippet FROM n
    UNION ALL SELECT 2, edge_id, '[관계] ' || coalesce(a.name, '?') || ' --[' || e.relation || ']--> ' || coalesce(b.name, '?') FROM e LEFT JOIN n a ON a.id = src LEFT JOIN n b ON b.id = tgt),
    ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snippet ORDER BY kind, pos) AS r FROM sn) WHERE r = 1)"""


def snippets(t: Tables) -> DataFrame:
    n = nodes(t).select(F.lit(0).alias("kind"), F.col("id").alias("pos"), context.entity_snippet("name", "type").alias("snippet"))
    ids = edges(t).select("src", "tgt", "relation", "edge_id")
    names = graph.reference_lookup(ids, nodes(t)).withColumn("edge_id", F.concat_ws("|", "src", "relation", "tgt"))
    e = names.select(F.lit(2).alias("kind"), F.col("edge_id").alias("pos"), context.relation_snippet("source_name", "relation", "target_name").alias("snippet"))
    return context.distinct_snippets(n.union(e), [])


@query("R26_context_snippets", SNIPPETS + " SELECT kind, pos, snippet FROM ds")
def context_snippets(t):
    return snippets(t).select("kind", "pos", "snippet")


@query("U04_snippet_distinct", SNIPPETS + " SELECT kind, count(*) AS n FROM ds GROUP BY kind")
def snippet_counts(t):
    return snippets(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("R27_graph_results_to_documents", SNIPPETS + " SELECT snippet AS text, CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '…' ELSE title END AS title, 1.0::DOUBLE AS score FROM (SELECT snippet, trim(regexp_replace(snippet, '^[^\\]]*\\]', '')) AS title FROM ds)")
def as_documents(t):
    return snippets(t).select(F.col("snippet").alias("text"), context.snippet_title("snippet").alias("title"), F.lit(1.0).alias("score"))


@query("R14_single_hop_search", f"WITH {NODES}, {EDGES}, {SEEDS} SELECT * FROM (SELECT 'entity' AS part, id AS key FROM s ORDER BY id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'relation', edge_id FROM e WHERE src IN (SELECT id FROM s) ORDER BY edge_id LIMIT 10)")
def single_hop(t):
    s = seeds(t)
    r = edges(t).join(s.withColumnRenamed("id", "src"), "src", "left_semi").orderBy("edge_id").limit(10)
    return s.orderBy("id").limit(5).select(F.lit("entity").alias("part"), F.col("id").alias("key")).union(r.select(F.lit("relation"), "edge_id"))


#: Questions of the whole searches over the graph.
ASKED = [(1, "the sensor of the vector store"), (2, "Which review did the scanner protocol have?"), (3, "프레임워크의 색인은 launch")]
ASKED_SQL = f"gq AS (SELECT query_id, {CLEANED} AS query FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in ASKED) + f") g(query_id, query)), {NODES}, {EDGES}, cn AS (SELECT id, name AS text FROM n), {bm25_sql('gq', 'cn', '_n')}"
TITLES = """ce AS (SELECT DISTINCT coalesce(nullif(trim(e.name), ''), nullif(trim(e.title), ''), 'Unknown') AS id, id AS text FROM (SELECT unnest(events) AS e FROM (SELECT max_by(events, extracted_at) AS events FROM extractions GROUP BY document_id)))"""


def asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ASKED, "query_id int, query string").select("query_id", bm25_query("query").alias("query"))


@query("R14_single_hop_whole", f"""WITH {ASKED_SQL}, {TITLES}, {bm25_sql("gq", "ce", "_e")},
    nr AS (SELECT DISTINCT query_id, edge_id FROM e JOIN hits_n h ON h.rank <= 5 AND h.id IN (src, tgt)),
    rr AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY edge_id) AS rank FROM nr)
    SELECT query_id, 'entity' AS part, id AS key, score, rank FROM hits_n WHERE rank <= 5 UNION ALL SELECT query_id, 'event', id, score, rank FROM hits_e WHERE rank <= 5
    UNION ALL SELECT query_id, 'relation', edge_id, NULL, rank FROM rr WHERE rank <= 10""")
def single_hop_whole(t):
    events = graph_build.upsert_events(latest(t).select("document_id", F.explode("events").alias("e")).select("document_id", "e.name", "e.title"))
    return single_hop_of(asked(t), nodes(t), events, edges(t))


def single_hop_of(questions: DataFrame, nodes: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """The five entities and the five events that BM25 finds for each question, and ten relations of these entities."""
    found = retrieval.bm25(nodes, questions, "id", "name", 5)
    titles = retrieval.bm25(events.select("name").distinct(), questions, "name", "name", 5)
    met = graph.both_ways(edges).join(found.select("query_id", F.col("id").alias("a")), "a").select("query_id", "edge_id").distinct()
    relations = retrieval.top_per(met, ["query_id"], [F.col("edge_id")], 10)
    shown = lambda rows, part, key, score: rows.select("query_id", F.lit(part).alias("part"), F.col(key).alias("key"), score.alias("score"), "rank")
    return shown(found, "entity", "id", F.col("score")).union(shown(titles, "event", "id", F.col("score"))).union(shown(relations, "relation", "edge_id", F.lit(None).cast("double")))


@query("R11_crossref_whole", f"""WITH RECURSIVE {ASKED_SQL}, {BOTH},
    walk AS (SELECT query_id, id, 0 AS hop FROM hits_n WHERE rank <= 10 UNION SELECT walk.query_id, b.b, walk.hop + 1 FROM walk JOIN b ON b.a = walk.id WHERE walk.hop < 3),
    reached AS (SELECT query_id, id, min(hop) AS hop FROM walk GROUP BY 1, 2)
    SELECT query_id, 'entity' AS part, id AS key, hop FROM reached JOIN n USING (id) WHERE hop > 0
    UNION ALL SELECT query_id, 'relation', edge_id, min(hop) + 1 FROM reached r JOIN b ON b.a = r.id WHERE hop < 3 GROUP BY query_id, edge_id""")
def crossref_whole(t):
    """R02 seeds, ten of each question, then R10; seeds are not returned."""
    n, e = nodes(t), edges(t)
    reached, relations = graph.traverse_each(e, retrieval.bm25(n, asked(t), "id", "name", 10), 3)
    entities = reached.where("hop > 0").join(n.select("id"), "id", "left_semi")
    return entities.select("query_id", F.lit("entity").alias("part"), F.col("id").alias("key"), "hop").union(relations.select("query_id", F.lit("relation").alias("part"), F.col("edge_id").alias("key"), "hop"))


RECENT = f"""WITH {ENTITIES}, r AS (SELECT document_id, name, row_number() OVER (PARTITION BY document_id ORDER BY pos DESC) AS back FROM x WHERE name IS NOT NULL), f AS (SELECT document_id, name, min(back) AS back FROM r WHERE back <= 8 GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY back) AS place FROM f)"""


def recent(t: Tables) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("pos")))
    rows = entities(t).where("name is not null").withColumn("back", back).where("back <= 8").groupBy("document_id", "name").agg(F.min("back").alias("back"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("back"))).where("place <= 5")


@query("W10_first_n_recent_reverse", RECENT + " SELECT document_id, name, place FROM p WHERE place <= 5")
def recent_names(t):
    return recent(t).select("document_id", "name", "place")


@query("R35_followup_query_build", RECENT + " SELECT document_id, string_agg(name, ' ' ORDER BY place) AS query FROM p WHERE place <= 5 GROUP BY 1")
def followup(t):
    return recent(t).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " ").alias("query"))


@query("R25_got_expand")
def got_expand(t):
    """Expansion over the graph: a candidate is a word; its branch are the nodes that bear it and their relations."""
    n, e = nodes(t).select("id", "name", "type"), edges(t).select("src", "relation", "tgt")

    def search(word):
        found = n.where(F.contains(F.lower("name"), F.lit(word)))
        return found, e.join(found.select(F.col("id").alias("src")), "src", "left_semi").select("src", "relation", "tgt"), []

    def score(question, found, _):
        text = F.concat_ws(" ", F.collect_set(F.lower("name")))
        return found.agg(reasoning.coverage_score(F.lit(question), text).alias("s")).first()["s"] or 0.0

    empty = reasoning.Thoughts("sensor of the vector store", n.limit(0), e.limit(0))
    return reasoning.expand(empty, search, score, ["sensor", "vector store", "nothing"]).entities


@query("A02_trap_relation_key", f"WITH {EDGES} SELECT src, relation, tgt FROM e")
def relation_key(t):
    return edges(t).select("src", "relation", "tgt")


@query("R32_uuid_scope_resolve", r"SELECT DISTINCT document_id, regexp_extract(metadata['file_path'], '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM chunks WHERE metadata['file_path'] IS NOT NULL")
def scope(t):
    from corvane.functions.text import stem

    return t.chunks.where(F.col("metadata")["file_path"].isNotNull()).select("document_id", stem(F.col("metadata")["file_path"]).alias("stem")).distinct()
