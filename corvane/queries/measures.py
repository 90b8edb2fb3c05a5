"""Statistics, evaluation figures and sessions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corvane.functions import vectors
from corvane.operators import metrics
from corvane.queries.registry import query
from corvane.streaming.ingest import idle_sessions


@query("A12_rerank_running_avg", "SELECT event_id, round(avg(round(value * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS mean, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def running(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.avg(F.round(F.col("value") * 100)).over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("mean"), F.row_number().over(w).alias("n"))


@query("A14_nanmean_metrics", "SELECT user_id, round(avg(CASE WHEN event_id % 5 > 0 THEN value END), 4) AS mean FROM events GROUP BY 1")
def nanmean(t):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.groupBy("user_id").agg(F.round(metrics.mean_without_nan(x), 4).alias("mean"))


@query("A15_mean_over_valid", "SELECT event_type, round(avg(CASE WHEN value > 20 THEN value END), 4) AS mean FROM events GROUP BY 1")
def valid_mean(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 20, F.col("value"))), 4).alias("mean"))


@query("A17_processing_stats", "SELECT count(*) AS total, count(*) FILTER (starts_with(source, 'scan')) AS scans, count(*) FILTER (starts_with(source, 'image')) AS images, count(*) FILTER (coalesce(text, '') = '') AS failed FROM documents")
def processing(t):
    return t.documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source").startswith("scan")).alias("scans"), F.count_if(F.col("source").startswith("image")).alias("images"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("failed"))


@query("A19_embedding_stats", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS mean FROM embeddings")
def vector_stats(t):
    return t.embeddings.select("vec_id", F.round(vectors.norm("embedding"), 5).alias("norm"), F.round(vectors.mean("embedding"), 5).alias("mean"))


@query("E01_multi_scale_similarity", "SELECT vec_id, round(0.0448 * e[1] + 0.2856 * e[2] + 0.3001 * e[3] + 0.2363 * e[4] + 0.1333 * e[5], 5) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def scales(t):
    return t.embeddings.select("vec_id", F.round(metrics.multi_scale_similarity(F.transform("embedding", lambda x: x.cast("double"))), 5).alias("score"))


@query("E02_local_distortion", "SELECT label, round(avg(sqrt(x * x + y * y)), 5) AS distortion FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY 1")
def distortion(t):
    rows = t.embeddings.select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return rows.groupBy("label").agg(F.round(metrics.flow_magnitude("x", "y"), 5).alias("distortion"))


@query("E05_line_straightness", "SELECT user_id, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY 1")
def straight(t):
    return t.events.groupBy("user_id").agg(F.round(metrics.straightness("value"), 4).alias("deviation"))


@query("E06_character_error_rate", "SELECT p_partkey, levenshtein(p_name, p_type) AS edits, round(levenshtein(p_name, p_type) / nullif(length(p_type), 0), 6) AS rate FROM part")
def error_rate(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("edits"), F.round(metrics.character_error_rate("p_name", "p_type"), 6).alias("rate"))


@query("ST1_idle_session_timeout", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, s""")
def sessions(t):
    rows = idle_sessions(t.events, "user_id", "ts", "30 minutes")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("C01_rollup", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def rollup(t):
    return t.documents.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("C02_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("C03_rank_functions", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
def ranks(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("C04_asof_join", "SELECT event_id, max(o_orderdate) AS ordered FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id")
def asof(t):
    """The last order at or before each event: one union and a running maximum instead of an inequality join."""
    e = t.events.select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("timestamp_ntz").alias("ordered"))
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("bigint").alias("event_id"), F.col("o_orderdate").alias("ordered"))
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return e.union(o).withColumn("ordered", F.max("ordered").over(w)).where("event_id is not null and ordered is not null").select("event_id", "ordered")
