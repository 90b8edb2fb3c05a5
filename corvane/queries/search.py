"""Retrieval, ranking, fusion and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import vectors
from corvane.functions.text import PARTICLES, bm25_query
from corvane.operators import context, retrieval
from corvane.plans.numbering import numbered
from corvane.queries.registry import Tables, query

#: Questions are the distinct level-one headings of the first pages of files.
QUESTIONS = """SELECT DISTINCT md5(h) AS query_id, h AS query FROM (
    SELECT trim(regexp_extract(text, '^# ([^\\n]+)', 1)) AS h FROM documents WHERE page_num = 1 AND text IS NOT NULL) WHERE h <> ''"""


def questions(t: Tables) -> DataFrame:
    heading = F.trim(F.regexp_extract("text", r"\A# ([^\n]+)", 1))
    return t.documents.where("page_num = 1 and text is not null").select(heading.alias("query")).where("query <> ''").distinct().select(F.md5("query").alias("query_id"), "query")


BM25 = f"""WITH q AS ({QUESTIONS}),
    asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+|[가-힣]+')) AS term FROM q),
    words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+') AS w FROM documents WHERE text IS NOT NULL),
    corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
    post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM asked) GROUP BY term),
    scored AS (SELECT a.query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM asked a JOIN post p USING (term) JOIN df USING (term) CROSS JOIN corpus GROUP BY a.query_id, p.id),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


def bm25_sql(asked: str, corpus: str, tag: str) -> str:
    """``hits`` + tag: BM25 of the questions ``asked (query_id, query)`` over ``corpus (id, text)``."""
    return f"""asked{tag} AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+|[가-힣]+')) AS term FROM {asked}),
    words{tag} AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+') AS w FROM {corpus} WHERE text IS NOT NULL),
    corpus{tag} AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words{tag}),
    post{tag} AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM words{tag}) GROUP BY id, term),
    df{tag} AS (SELECT term, count(*) AS df FROM post{tag} GROUP BY term),
    scored{tag} AS (SELECT a.query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM asked{tag} a JOIN post{tag} p USING (term) JOIN df{tag} USING (term) CROSS JOIN corpus{tag} GROUP BY a.query_id, p.id),
    hits{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored{tag})"""


#: R01 as an expression of ``query``.
CLEANED = f"""(CASE WHEN len(list_concat(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_\\-]+'), list_filter(list_transform(regexp_extract_all(query, '[가-힣]+'), lambda w: regexp_replace(w, '({PARTICLES})$', '')), lambda w: length(w) >= 2))) > 0
    THEN array_to_string(list_concat(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_\\-]+'), list_filter(list_transform(regexp_extract_all(query, '[가-힣]+'), lambda w: regexp_replace(w, '({PARTICLES})$', '')), lambda w: length(w) >= 2)), ' ') ELSE query END)"""


def hits(t: Tables, k: int) -> DataFrame:
    return retrieval.bm25(t.documents, questions(t), "doc_id", "text", k)


@query("R01_bm25_query_preprocess", f"""SELECT text, CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') ELSE text END AS cleaned FROM (
    SELECT DISTINCT text, list_concat(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]+'),
        list_filter(list_transform(regexp_extract_all(text, '[가-힣]+'), lambda w: regexp_replace(w, '({PARTICLES})$', '')), lambda w: length(w) >= 2)) AS words
    FROM transcriptions WHERE text IS NOT NULL)""")
def bm25_preprocess(t):
    return t.transcriptions.where("text is not null").select("text").distinct().select("text", bm25_query("text").alias("cleaned"))


@query("R02_bm25_search", BM25 + " SELECT query_id, id, score, rank FROM hits WHERE rank <= 5")
def bm25_search(t):
    return hits(t, 5)


@query("R03_near_vector_topk", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT query_id, vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q)
    SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5""")
def near_vector(t):
    """The queries are the vectors whose id is divisible by 20, against all rows."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return retrieval.near_vectors(t.embeddings, asked, "vec_id", "embedding", 5)


RERANKED = """r AS (SELECT h.query_id, h.id, h.score AS original_score,
        CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, list_distinct(regexp_extract_all(lower(d.text), '[a-zA-Z가-힣]+')))) / len(qt), 6) END AS score
    FROM hits h JOIN documents d ON d.doc_id = h.id JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-zA-Z가-힣]+')) AS qt FROM q) USING (query_id) WHERE h.rank <= 10),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r)"""


def reranked(t: Tables, least: float, k: int, keep_best: bool) -> DataFrame:
    found = hits(t, 10).select("query_id", "id", "score").join(questions(t), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return retrieval.rerank(found, ["query_id"], retrieval.overlap_score("query", "text"), least, k, keep_best).select("query_id", "id", "original_score", "score", "rank")


@query("R06_text_rerank", BM25 + ", " + RERANKED + " SELECT query_id, id, original_score, score, rank FROM rr WHERE (score >= 0.3 OR rank = 1) AND rank <= 5")
def text_rerank(t):
    return reranked(t, 0.3, 5, True)


@query("R07_image_rerank", BM25 + ", " + RERANKED + " SELECT query_id, id, original_score, score, rank FROM rr WHERE score >= 0.7 AND rank <= 3")
def image_rerank(t):
    return reranked(t, 0.7, 3, False)


PIPELINE = """WITH q AS (SELECT vec_id AS query_id, label AS q_label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT query_id, q_label, vec_id AS id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM d),
    s AS (SELECT *, CASE WHEN distance <= 1 THEN round(1 - distance, 6) ELSE 0 END AS sim FROM n WHERE r <= 20),
    re AS (SELECT query_id, id, sim AS original_score, round(sim * 0.5 + CASE WHEN label = q_label THEN 0.5 ELSE 0 END, 6) AS score FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM re)"""


@query("R04_text_search_pipeline", PIPELINE + " SELECT query_id, id, original_score, score, rank FROM k WHERE (score >= 0.3 OR rank = 1) AND rank <= 5")
def text_search(t):
    """Nearest vectors, similarity, a second score by label, threshold, first five."""
    asked = t.embeddings.where("vec_id % 20 = 0")
    near = retrieval.near_vectors(t.embeddings, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), "vec_id", "embedding", 20)
    labelled = near.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    scored = labelled.withColumn("score", F.round(vectors.similarity_from_distance("distance"), 6)).select("query_id", "id", "label", "q_label", "score")
    second = F.round(F.col("original_score") * 0.5 + F.when(F.col("label") == F.col("q_label"), 0.5).otherwise(0.0), 6)
    return retrieval.rerank(scored, ["query_id"], second, 0.3, 5).select("query_id", "id", "original_score", "score", "rank")


@query("R05_image_search_pipeline", PIPELINE.replace("re AS (SELECT query_id, id, sim AS original_score", "re AS (SELECT query_id, id, label, sim AS original_score") + " SELECT query_id, id, score, rank FROM (SELECT query_id, id, original_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY original_score DESC, id) AS rank FROM k WHERE original_score >= 0.5 AND label % 2 = 0) WHERE rank <= 3")
def image_search(t):
    """Nearest vectors above 0.5 of the labels that stand for images, first three."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    near = retrieval.near_vectors(t.embeddings, asked, "vec_id", "embedding", 20).join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    found = near.withColumn("score", F.round(vectors.similarity_from_distance("distance"), 6)).where("score >= 0.5 and label % 2 = 0").select("query_id", "id", "score")
    return retrieval.top_per(found, ["query_id"], [F.desc("score"), F.col("id")], 3)


@query("R05_image_search_whole", PIPELINE + """, more AS (SELECT *, 3 + row_number() OVER (PARTITION BY query_id ORDER BY r) AS pos FROM s WHERE label % 3 = 0),
    u AS (SELECT query_id, id, sim, label, r AS pos, 0 AS part FROM s WHERE r <= 3 UNION ALL SELECT query_id, id, sim, label, pos, 1 FROM more WHERE pos <= 8),
    f AS (SELECT query_id, id, sim AS score, part, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM u WHERE sim >= 0.5 AND label % 2 = 0)
    SELECT query_id, id, score, part, rank FROM f WHERE rank <= 3""")
def image_search_whole(t):
    """R03, U02, F05, first three. Labels stand for kinds as in R05 and for images without session as in U02."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    near = retrieval.near_vectors(t.embeddings, asked, "vec_id", "embedding", 20).join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    scored = near.withColumn("score", F.round(vectors.similarity_from_distance("distance"), 6))
    found = retrieval.with_defaults(scored, ["query_id"], F.col("label") % 3 == 0, 3).where("score >= 0.5 and label % 2 = 0")
    return retrieval.top_per(found.select("query_id", "id", "score", "part", "pos"), ["query_id"], [F.col("pos")], 3).drop("pos")


@query("R08_format_passage", r"""SELECT chunk_id, concat_ws(chr(10), coalesce(nullif(text, ''), nullif(raw_text, ''), nullif(content_type, ''), nullif(chunk_id, '')), 'Title: ' || nullif(chunk_id, ''), 'File: ' || nullif(metadata['file_path'], '')) AS passage
    FROM (SELECT DISTINCT chunk_id, text, raw_text, content_type, metadata['file_path'] AS f, metadata FROM chunks)""")
def format_passage(t):
    rows = t.chunks.select("chunk_id", "text", "raw_text", "content_type", F.col("metadata")["file_path"].alias("file_path"), F.to_json("metadata").alias("m")).distinct()
    return rows.select("chunk_id", retrieval.passage("text", "raw_text", "content_type", "chunk_id", "file_path").alias("passage"))


FUSED = BM25 + """, pooled AS (SELECT query_id, id, score, rank AS pos FROM hits WHERE rank <= 5
        UNION ALL SELECT h.query_id, h.id, round(h.score * 0.9, 6), h.rank + 5 FROM hits h JOIN documents d ON d.doc_id = h.id WHERE h.rank <= 10 AND d.lang = 'en'),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, pos) AS r FROM pooled)"""


def fused(t: Tables) -> DataFrame:
    """Two searchers over each question: all documents, and English ones at nine tenths of the score."""
    found = hits(t, 10).select("query_id", "id", "score", "rank")
    first = found.where("rank <= 5").select("query_id", "id", "score", F.col("rank").alias("pos"))
    second = found.join(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_semi").select("query_id", "id", F.round(F.col("score") * 0.9, 6).alias("score"), (F.col("rank") + 5).alias("pos"))
    return first.unionByName(second)


@query("R09_parallel_fusion_search", FUSED + " SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM best WHERE r = 1) WHERE rank <= 5")
def fusion(t):
    best = retrieval.dedupe_max_score(fused(t), ["query_id", "id"])
    return retrieval.top_per(best, ["query_id"], [F.desc("score"), F.col("pos")], 5).select("query_id", "id", "score", "rank")


WHOLE = f"""WITH q AS ({QUESTIONS}),
    v AS (SELECT query_id, query, min(p) AS p FROM (SELECT query_id, query, 0 AS p FROM q UNION ALL SELECT query_id, lower(query), 1 FROM q UNION ALL SELECT query_id, {CLEANED}, 2 FROM q) GROUP BY 1, 2),
    rw AS (SELECT query_id AS question, p, query, query_id || '|' || p AS query_id, list_distinct(regexp_extract_all(lower(query), '[a-zA-Z가-힣]+')) AS qt FROM v),
    ct AS (SELECT doc_id AS id, text FROM documents), ci AS (SELECT page_id AS id, max_by(natural_text, received_at) AS text FROM page_responses WHERE is_diagram AND natural_text IS NOT NULL GROUP BY page_id),
    {bm25_sql("rw", "ct", "_t")}, {bm25_sql("rw", "ci", "_i")},
    o AS (SELECT h.*, rw.question, rw.p, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z가-힣]+')))) / len(qt), 6) END AS again
        FROM (SELECT 'text' AS searcher, hits_t.*, ct.text FROM hits_t JOIN ct USING (id) WHERE rank <= 10 UNION ALL SELECT 'image', hits_i.*, ci.text FROM hits_i JOIN ci USING (id) WHERE rank <= 10) h JOIN rw USING (query_id)),
    o2 AS (SELECT searcher, question, p, id, again AS score, row_number() OVER (PARTITION BY searcher, query_id ORDER BY again DESC, id) AS r FROM o),
    kept AS (SELECT searcher, question, id, score, p * 10 + r AS pos FROM o2 WHERE searcher = 'text' AND (score >= 0.3 OR r = 1) AND r <= 5
        UNION ALL SELECT searcher, question, id, score, p * 10 + r FROM o2 WHERE searcher = 'image' AND score >= 0.7 AND r <= 3),
    al AS (SELECT doc_id, document_id FROM documents WHERE session_id IN (SELECT session_id FROM transcriptions)),
    ok AS (SELECT * FROM kept WHERE (searcher = 'text' AND id IN (SELECT doc_id FROM al)) OR (searcher = 'image' AND id IN (SELECT page_id FROM page_responses WHERE document_id IN (SELECT document_id FROM al)))),
    best AS (SELECT *, row_number() OVER (PARTITION BY question, searcher, id ORDER BY score DESC, pos) AS r FROM ok),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question, searcher ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY question, searcher) AS results FROM best WHERE r = 1)"""


def searched(rewrites: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ten hits of each rewrite in ``corpus (id, text)`` by BM25, with both texts. Rewrites that have the same terms
    are searched once."""
    keyed = rewrites.withColumn("terms", F.array_join(F.array_sort(F.array_distinct(retrieval.terms_of("query"))), " "))
    found = retrieval.bm25(corpus, keyed.select(F.col("terms").alias("query_id"), F.col("terms").alias("query")).distinct(), "id", "text", 10)
    return keyed.join(found.select(F.col("query_id").alias("terms"), "id", "score"), "terms").drop("terms").join(corpus, "id")


def fused_whole(asked: DataFrame, texts: DataFrame, images: DataFrame, allowed_texts: DataFrame, allowed_images: DataFrame) -> DataFrame:
    """Rewrites of each question (the question, lower case, R01) to both searchers, each reranked; images through F12,
    all through F15, then A01 for each question and searcher. A question without results has a row with an error."""
    every = asked.select("query_id", F.posexplode(F.array("query", F.lower("query"), bm25_query("query"))).alias("p", "query")).groupBy("query_id", "query").agg(F.min("p").alias("p"))
    rewrites = every.select(F.col("query_id").alias("question"), "p", "query", F.concat_ws("|", "query_id", F.col("p").cast("string")).alias("query_id"))
    score = retrieval.overlap_score("query", "text")
    shown = lambda rows, name, place: rows.select("question", F.lit(name).alias("searcher"), "id", "score", (F.col("p") * 10 + F.col(place)).alias("pos"))
    text = retrieval.rerank(searched(rewrites, texts), ["query_id"], score, 0.3, 5)
    image = retrieval.two_stage_image_filter(searched(rewrites, images).withColumn("score", score).withColumn("reranked", F.lit(True)), ["query_id"])
    image = retrieval.top_per(image, ["query_id"], [F.desc("score"), F.col("id")], 3)
    pooled = shown(text, "text", "rank").join(allowed_texts, "id", "left_semi").unionByName(shown(image, "image", "rank").join(allowed_images, "id", "left_semi"))
    best = retrieval.dedupe_max_score(pooled, ["question", "searcher", "id"])
    ranked = retrieval.top_per(best, ["question", "searcher"], [F.desc("score"), F.col("pos")], 2**31 - 1)
    ranked = ranked.withColumn("results", F.count(F.lit(1)).over(Window.partitionBy("question", "searcher"))).withColumnRenamed("question", "query_id")
    return asked.select("query_id").join(ranked, "query_id", "left").select("query_id", "searcher", "id", "score", "rank", F.coalesce("results", F.lit(0)).alias("results"), F.when(F.col("id").isNull(), "검색 결과가 없습니다.").alias("error"))


@query("R09_parallel_fusion_whole", WHOLE + " SELECT q.query_id, searcher, id, score, rank, coalesce(results, 0) AS results, CASE WHEN id IS NULL THEN '검색 결과가 없습니다.' END AS error FROM q LEFT JOIN ranked ON question = q.query_id")
def fusion_whole(t):
    """Documents are searched for text and diagram pages for images; both by words, which stand for a model."""
    diagrams = t.page_responses.where("is_diagram and natural_text is not null").groupBy(F.col("page_id").alias("id")).agg(F.max_by("natural_text", "received_at").alias("text"))
    allowed = t.documents.join(t.transcriptions.select("session_id").distinct(), "session_id", "left_semi")
    pages = t.page_responses.join(allowed.select("document_id").distinct(), "document_id", "left_semi").select(F.col("page_id").alias("id")).distinct()
    return fused_whole(questions(t), t.documents.select(F.col("doc_id").alias("id"), "text"), diagrams, allowed.select(F.col("doc_id").alias("id")), pages)


@query("A01_dedupe_max_score", FUSED + " SELECT query_id, id, score FROM best WHERE r = 1")
def dedupe(t):
    return retrieval.dedupe_max_score(fused(t), ["query_id", "id"]).select("query_id", "id", "score")


@query("U01_union_all_hits", FUSED + " SELECT query_id, id, score, pos FROM pooled")
def union_hits(t):
    return fused(t).select("query_id", "id", "score", "pos")


@query("J08_fanout_queries_searchers", f"WITH q AS ({QUESTIONS}) SELECT query_id, searcher FROM q, (VALUES ('text'), ('image')) s(searcher)")
def fanout(t):
    return questions(t).select("query_id", F.explode(F.array(F.lit("text"), F.lit("image"))).alias("searcher"))


@query("F12_two_stage_image_filter", """WITH h AS (SELECT label AS query_id, vec_id AS id, round((vec_id * 37 % 101) / 100.0, 6) AS score, vec_id % 3 = 0 AS reranked FROM embeddings),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM h WHERE score >= 0.5)
    SELECT query_id, id, score FROM a WHERE r <= 3 AND (NOT reranked OR score >= 0.7)""")
def two_stage(t):
    rows = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.round((F.col("vec_id") * 37 % 101) / 100.0, 6).alias("score"), (F.col("vec_id") % 3 == 0).alias("reranked"))
    return retrieval.two_stage_image_filter(rows, ["query_id"]).select("query_id", "id", "score")


@query("F05_score_threshold", "SELECT vec_id, round((vec_id * 37 % 101) / 100.0, 6) AS score FROM embeddings WHERE round((vec_id * 37 % 101) / 100.0, 6) >= 0.5 AND CASE vec_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'chart' ELSE 'text' END IN ('image', 'chart')")
def score_threshold(t):
    score = F.round((F.col("vec_id") * 37 % 101) / 100.0, 6)
    kind = F.when(F.col("vec_id") % 4 == 0, "image").when(F.col("vec_id") % 4 == 1, "chart").otherwise("text")
    return t.embeddings.select("vec_id", score.alias("score"), kind.alias("kind")).where("score >= 0.5 and kind in ('image', 'chart')").drop("kind")


@query("F18_old_image_filter", "SELECT vec_id FROM embeddings WHERE round((vec_id * 37 % 101) / 100.0, 6) > 0.6")
def old_image_filter(t):
    return t.embeddings.where(F.round((F.col("vec_id") * 37 % 101) / 100.0, 6) > 0.6).select("vec_id")


@query("F04_similarity_from_distance", """SELECT event_id, CASE WHEN d IS NULL THEN 1.0 WHEN d <= 1 THEN round(1 - d, 6) ELSE 0.0 END AS similarity, CASE WHEN d IS NULL THEN 1.0 WHEN d BETWEEN 0 AND 1 THEN round(1 - d, 6) END AS valid_similarity
    FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value / 50.0 - 0.2, 6) END AS d FROM events)""")
def similarity(t):
    d = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.round(F.col("value") / 50.0 - 0.2, 6))
    rows = t.events.select("event_id", d.alias("d"))
    return rows.select("event_id", F.round(vectors.similarity_from_distance("d"), 6).alias("similarity"), F.round(vectors.similarity_from_distance("d", 0.0), 6).alias("valid_similarity"))


@query("W08_order_by_score_desc", BM25 + " SELECT query_id, id, row_number() OVER (ORDER BY score DESC, query_id, id) AS pos FROM hits WHERE rank = 1")
def ordered(t):
    rows = hits(t, 1).select("query_id", "id", "score")
    return numbered(rows, F.desc("score"), F.col("query_id"), F.col("id"), name="pos").select("query_id", "id", "pos")


@query("W09_top_k_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def top_k(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("A13_score_min_max_mean", BM25 + " SELECT query_id, min(score) AS least, max(score) AS most, round(avg(score), 5) AS mean FROM hits WHERE rank <= 10 GROUP BY query_id")
def score_stats(t):
    return hits(t, 10).groupBy("query_id").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 5).alias("mean"))


@query("R29_format_context", BM25 + r""" SELECT query_id, '## TEXT 검색 결과:' || chr(10) || string_agg(rank || '. ' || trim(regexp_extract(d.text, '^([^\n]*)', 1)) || ' (출처: ' || d.source || CASE WHEN d.page_num <> 0 THEN ', 페이지: ' || d.page_num ELSE '' END || ', 유사도: ' || printf('%.4f', score) || ')', chr(10) ORDER BY rank) AS context
    FROM hits JOIN documents d ON d.doc_id = hits.id WHERE rank <= 5 GROUP BY query_id""")
def format_context(t):
    rows = hits(t, 5).join(t.documents.select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"\A([^\n]*)", 1).alias("first"), "source", "page_num"), "id")
    line = context.text_line(F.col("rank"), F.col("first"), context.metadata_suffix(F.col("source"), F.col("page_num"), F.col("score")))
    return context.joined(rows.withColumn("line", line), ["query_id"], "line", "rank", "## TEXT 검색 결과:\n")


@query("U02_default_image_union", """WITH h AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY (vec_id * 37 % 1009), vec_id) AS pos FROM embeddings)
    SELECT id, pos, 0 AS part FROM h WHERE label % 3 = 1 UNION ALL SELECT id, pos, 1 FROM (SELECT * FROM h WHERE pos <= 20 AND label % 3 = 0 ORDER BY pos LIMIT 5)""")
def default_images(t):
    rows = numbered(t.embeddings.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") * 37 % 1009).alias("o")), F.col("o"), F.col("id"), name="pos")
    return rows.where("label % 3 = 1").select("id", "pos", F.lit(0).alias("part")).union(rows.where("pos <= 20 and label % 3 = 0").orderBy("pos").limit(5).select("id", "pos", F.lit(1)))


@query("U03_distinct_queries", f"WITH q AS ({QUESTIONS}), v AS (SELECT query_id, query, 0 AS p FROM q UNION ALL SELECT query_id, lower(query), 1 FROM q UNION ALL SELECT query_id, query, 2 FROM q), d AS (SELECT query_id, query, min(p) AS p FROM v GROUP BY 1, 2) SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place FROM d")
def distinct_queries(t):
    q = questions(t)
    every = q.select("query_id", F.posexplode(F.array("query", F.lower("query"), "query")).alias("p", "query"))
    return every.groupBy("query_id", "query").agg(F.min("p").alias("p")).select("query_id", "query", F.row_number().over(Window.partitionBy("query_id").orderBy("p")).alias("place"))


@query("F15_allowed_recheck", BM25 + " SELECT query_id, id FROM hits JOIN documents d ON d.doc_id = id WHERE rank <= 10 AND d.session_id IN (SELECT session_id FROM transcriptions)")
def recheck(t):
    allowed = t.documents.join(t.transcriptions.select("session_id").distinct(), "session_id", "left_semi").select(F.col("doc_id").alias("id"))
    return hits(t, 10).join(allowed, "id", "left_semi").select("query_id", "id")


@query("R36_embed_text")
def embed_text(t):
    from corvane.sources.scorers import embed

    return embed(t.documents.select("doc_id", "text"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.size("embedding").alias("width"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("P04_per_chunk_embed")
def chunk_embed(t):
    """A chunk without words has no vector and is left out."""
    from corvane.sources.scorers import embed

    return embed(t.chunks.select("chunk_id", "text").distinct(), "chunk_id", "text").where("embedding is not null").select(F.col("id").alias("chunk_id"), F.size("embedding").alias("width"))


@query("U08_image_doc_dedupe", "SELECT id, epoch_us(min(created_at)) AS created_us FROM vectors GROUP BY id")
def image_dedupe(t):
    return t.vectors.groupBy("id").agg(F.unix_micros(F.min("created_at")).alias("created_us"))


@query("U06_token_intersect", f"WITH q AS ({QUESTIONS}) SELECT query_id, len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[a-zA-Z가-힣]+')), ['report', 'graph', 'table', 'scanner', '결과'])) AS shared FROM q")
def token_intersect(t):
    from corvane.functions.text import letter_tokens

    words = F.array(*[F.lit(x) for x in ("report", "graph", "table", "scanner", "결과")])
    return questions(t).select("query_id", F.size(F.array_intersect(letter_tokens("query"), words)).alias("shared"))


@query("R34_max_score_over_texts", BM25 + " SELECT query_id, max(score) AS score FROM hits WHERE rank <= 10 GROUP BY query_id")
def max_over_texts(t):
    return hits(t, 10).groupBy("query_id").agg(F.max("score").alias("score"))
