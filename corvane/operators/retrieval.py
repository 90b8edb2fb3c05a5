"""Search, ranking and fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.plans.lineage import cut

K1, B = 1.2, 0.75
#: Tables of at most so many rows are broadcast, after counting.
BROADCAST_ROWS = 100_000


TERMS = "[a-z0-9]+|[가-힣]+"


def terms_of(text: Column | str) -> Column:
    """Lower-case runs of Latin letters and digits or of Hangul."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERMS), F.lit(0))


def postings(documents: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """``id, term, tf, dl`` of every document, or of the ``wanted (term)`` only, which are kept before counting."""
    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), terms_of(text_col).alias("terms"))
    exploded = rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    if wanted is not None:
        exploded = exploded.join(wanted.select("term").distinct(), "term", "left_semi")
    return exploded.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(documents: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the k best documents of each query (``query_id, query``) by BM25.

    Only postings of query terms are kept, before anything is counted; the corpus contributes two numbers, its size
    and mean length. Postings are shuffled once, by document. Where the queries' terms are few, by count, they are
    broadcast to the postings, so that scores add up without a further shuffle; else both are joined by term. Ties
    are broken by id.
    """
    asked = cut(queries.select("query_id", F.explode(F.array_distinct(terms_of("query"))).alias("term")))
    few = asked.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    lengths = documents.where(F.col(text_col).isNotNull()).select(F.size(terms_of(text_col)).alias("dl"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = corpus["n"], corpus["mean"] or 1.0
    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), terms_of(text_col).alias("terms"))
    exploded = rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    wanted = cut(exploded.repartition("id").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")))
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))
    scored = wanted.join(small(weights), "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top_per(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each partition before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000


def near_vectors(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """``query_id, id, distance, rank``: exact k nearest by cosine distance for a stated set of queries
    (``query_id, v``) against all rows.

    Blocks of rows meet blocks of queries, each pair of blocks in one task of bounded size that multiplies two
    matrices and gives its k best; a query's bests are merged after."""
    parts, query_parts = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("i"), every(query_parts).alias("j"))
    right = queries.where(F.col("v").isNotNull()).select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("j"), every(parts).alias("i"))
    kinds = left.schema["id"].dataType.simpleString(), right.schema["query_id"].dataType.simpleString()

    def search(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if found.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        found = found.sort_values("id", kind="stable")
        unit = lambda column: (lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300))(np.stack(column.to_list()).astype(np.float64))
        distance = np.round(1 - unit(asked["v"]) @ unit(found["x"]).T, 6) + 0.0
        near = np.argsort(distance, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), near.shape[1]), "id": found["id"].to_numpy()[near.ravel()], "distance": np.take_along_axis(distance, near, 1).ravel()})

    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, f"query_id {kinds[1]}, id {kinds[0]}, distance double")
    return top_per(scored, ["query_id"], [F.asc("distance"), F.col("id")], k)


def dedupe_max_score(hits: DataFrame, keys: list[str], order: Column | str = "pos") -> DataFrame:
    """The best hit of each id, the first on ties; hits without an id are dropped."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order))
    return hits.where(F.col(keys[-1]).isNotNull()).withColumn("r", place).where("r = 1").drop("r")


def rerank(hits: DataFrame, keys: list[str], score: Column, least: float, k: int, keep_best: bool = True) -> DataFrame:
    """New scores with the old one kept; hits of at least ``least``, or the best one if none reaches it and
    ``keep_best``; the first k."""
    scored = hits.withColumnRenamed("score", "original_score").withColumn("score", score)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    kept = F.col("score") >= least
    if keep_best:
        kept = kept | (F.col("rank") == 1)
    return ranked.where(kept & (F.col("rank") <= k))


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Share of the query's distinct words that the text has: the offline stand-in for a scoring model."""
    from corvane.functions.text import letter_tokens

    q, t = letter_tokens(query), letter_tokens(text)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6)).otherwise(F.lit(0.0))


def two_stage_image_filter(hits: DataFrame, keys: list[str], least: float = 0.5, k: int = 3, least_reranked: float = 0.7) -> DataFrame:
    """Hits above a score, the first k; of reranked ones only those above a second score, then the first k."""
    first = top_per(hits.where(F.col("score") >= least), keys, [F.desc("score"), F.col("id")], k, "r1")
    return top_per(first.where(~F.col("reranked") | (F.col("score") >= least_reranked)), keys, [F.desc("score"), F.col("id")], k, "r2").drop("r1", "r2")


def with_defaults(near: DataFrame, keys: list[str], default: Column, k: int, most: int = 5) -> DataFrame:
    """The first k hits by ``rank``, ``part`` 0, and after them up to ``most`` of all that are ``default``, ``part`` 1;
    a hit may come in both."""
    first = near.where(F.col("rank") <= k).withColumn("pos", F.col("rank")).withColumn("part", F.lit(0))
    more = top_per(near.where(default), keys, [F.col("rank")], most, "pos").withColumn("pos", F.col("pos") + k).withColumn("part", F.lit(1))
    return first.unionByName(more)


def passage(row_text: str, caption: str, description: str, title: str, file_path: str) -> Column:
    """The first of text, caption, description and title that is not empty, with title and file lines."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    body = F.coalesce(some(row_text), some(caption), some(description), some(title))
    return F.concat_ws("\n", body, F.concat(F.lit("Title: "), some(title)), F.concat(F.lit("File: "), some(file_path)))
