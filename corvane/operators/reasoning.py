"""Scoring, merging and pruning of branches of search results, and the control loop over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.text import letter_tokens, without_think


def coverage_score(question: Column | str, results: Column | str) -> Column:
    """Share of the question's words among the results' words and a bonus for their number; 0 without words."""
    q, r = letter_tokens(question), letter_tokens(results)
    score = F.size(F.array_intersect(q, r)) / F.size(q) + F.least(F.lit(0.2), F.size(r) / 100.0)
    return F.when((F.size(q) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), score), 6))


def thought_score(reply: Column | str, found: Column | str, question: Column | str, results: Column | str) -> Column:
    """0 if no entities and events were found, else the number in the reply, else the coverage of the question."""
    found = F.col(found) if isinstance(found, str) else found
    number = F.nullif(F.regexp_extract(without_think(reply), r"([01]\.?\d*)", 1), F.lit("")).cast("double")
    told = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    return F.when(found == 0, F.lit(0.0)).otherwise(F.when(number.isNotNull(), told).otherwise(coverage_score(question, results)))


def prune(rows: DataFrame, question: Column | str, text: Column | str, least: float = 0.2) -> DataFrame:
    """Rows with enough of the question's words; all rows if the question has none."""
    q = letter_tokens(question)
    share = F.size(F.array_intersect(q, letter_tokens(F.coalesce(text, F.lit(""))))) / F.size(q)
    return rows.where((F.size(q) == 0) | (share >= least))


def top_branches(branches: DataFrame, k: int) -> DataFrame:
    """The k best branches of each question, earlier ones first on ties."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "branch_id")
    return branches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def merge_top_k(branches: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Entities (``question_id, branch_id, name``) of the k best branches (``question_id, branch_id, score``)."""
    return entities.join(top_branches(branches, k).select("question_id", "branch_id"), ["question_id", "branch_id"], "left_semi")


def merge_weighted(branches: DataFrame, entities: DataFrame) -> DataFrame:
    """Each name once with the best score of its branches."""
    return entities.join(branches, ["question_id", "branch_id"]).groupBy("question_id", "name").agg(F.max("score").alias("score"))


def merge_votes(branches: DataFrame, entities: DataFrame, votes: int = 2) -> DataFrame:
    """Names found in at least ``votes`` branches; if a question has none, the names of its best branch."""
    named = entities.join(branches, ["question_id", "branch_id"]).select("question_id", "branch_id", "name").distinct()
    counted = named.groupBy("question_id", "name").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= votes)
    rest = branches.join(counted.select("question_id").distinct(), "question_id", "left_anti")
    fallback = merge_top_k(rest, named, 1).select("question_id", "name", F.lit(1).cast("bigint").alias("votes"))
    return counted.union(fallback)


def extend_unique(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each signature: the first key that is not empty, else a hash of the row."""
    some = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys]
    signature = F.coalesce(*some, F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns if c != order]))).cast("string"))
    w = Window.partitionBy("signature").orderBy(order)
    return rows.withColumn("signature", signature).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "signature")


@dataclass
class Thoughts:
    """State of the expansion loop; each table has what was found so far."""

    question: str
    entities: DataFrame
    relations: DataFrame
    score: float = 0.0
    steps: int = 0
    failures: int = 0
    notes: list[str] = field(default_factory=list)


def expand(state: Thoughts, search, score, candidates: list[str], most_steps: int = 5, width: int = 3, least: float = 0.3, patience: int = 2) -> Thoughts:
    """Graph-of-thought expansion: at most ``most_steps`` rounds over at most ``width`` candidate queries.

    ``search(query)`` gives ``(entities, relations, next queries)`` and ``score(question, entities, relations)`` a
    number. Branches below ``least`` are dropped, others are merged; after ``patience`` rounds without a branch the
    last good state is restored. Only scalars come to the driver.
    """
    queue, good = list(candidates), state
    while queue and state.steps < most_steps:
        batch, queue = queue[:width], queue[width:]
        kept = []
        for query in batch:
            entities, relations, following = search(query)
            value = score(state.question, entities, relations)
            if value >= least:
                kept.append((value, entities, relations, following))
        entities, relations = state.entities, state.relations
        for value, e, r, following in sorted(kept, key=lambda x: -x[0]):
            entities, relations = entities.unionByName(e).distinct(), relations.unionByName(r).distinct()
            queue += [f for f in following if f not in queue]
        failures = 0 if kept else state.failures + 1
        best = max([state.score, *(v for v, *_ in kept)])
        state = Thoughts(state.question, entities, relations, best, state.steps + 1, failures, [*state.notes, f"step {state.steps + 1}: {len(kept)} of {len(batch)} kept"])
        if kept:
            good = state
        if failures >= patience:
            return Thoughts(good.question, good.entities, good.relations, good.score, state.steps, failures, [*state.notes, "restored"])
    return state
