"""Traversal of graphs held in DataFrames: ``nodes (id, name, type, doc_id)`` and ``edges (src, tgt, relation, doc_id)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.plans.lineage import cut


#: Most terms of one search for seeds.
TERMS = 200


def both_ways(edges: DataFrame) -> DataFrame:
    """``a, b, edge_id`` in both directions."""
    e = edges.select("src", "tgt", "edge_id")
    return e.select(F.col("src").alias("a"), F.col("tgt").alias("b"), "edge_id").union(e.where("src <> tgt").select(F.col("tgt").alias("a"), F.col("src").alias("b"), "edge_id"))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Distinct edges with both endpoints, each with an id made of its key."""
    rows = edges.where(F.col("src").isNotNull() & F.col("tgt").isNotNull()).select("src", "tgt", F.coalesce("relation", F.lit("")).alias("relation")).distinct()
    return rows.withColumn("edge_id", F.concat_ws("|", "src", "relation", "tgt"))


def seeds_by_term(nodes: DataFrame, edges: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes with an edge whose name contains one of the terms (``term``), in order of id.

    The terms are a stated set of at most TERMS, else an error is raised; they become one pattern, so no pairs of nodes
    and terms are made."""
    words = [r["term"] for r in terms.select(F.lower("term").alias("term")).where("term is not null").distinct().orderBy("term").limit(TERMS + 1).collect()]
    if len(words) > TERMS:
        raise ValueError(f"more than {TERMS} terms")
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower("name"), F.lit(w))
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("tgt").alias("id"))).distinct()
    rows = nodes.where(F.col("name").isNotNull() & found).join(ends, "id", "left_semi").select("id").distinct()
    return rows.orderBy("id").limit(limit) if limit else rows


def touching(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Edges with either end among ``visited (id)``: two equi-joins instead of one with OR."""
    a = edges.join(visited.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    b = edges.join(visited.select(F.col("id").alias("tgt")), "tgt", "left_semi").select(*edges.columns)
    return a.union(b).distinct()


def traverse(edges: DataFrame, seeds: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search by levels: ``(reached (id, hop), relations (edge, hop))``.

    A node has the hop at which it is first reached, seeds 0; an edge the hop at which it is first followed. Each
    level joins the frontier with the edges and keeps what is not yet visited; lineage is cut at every level, and the
    search ends when a frontier is empty.
    """
    steps = cut(both_ways(edges))
    visited = cut(seeds.select("id", F.lit(0).alias("hop")))
    frontier, followed = visited, None
    for hop in range(1, max_hops + 1):
        met = steps.join(frontier.select(F.col("id").alias("a")), "a").select("b", "edge_id")
        hops = met.select("edge_id", F.lit(hop).alias("hop")).distinct()
        followed = hops if followed is None else followed.union(hops)
        frontier = cut(met.select(F.col("b").alias("id")).distinct().join(visited, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        visited = cut(visited.union(frontier))
    if followed is None:
        return visited, edges.withColumn("hop", F.lit(None).cast("int")).limit(0)
    relations = followed.groupBy("edge_id").agg(F.min("hop").alias("hop"))
    return visited, edges.join(relations, "edge_id")


def traverse_each(edges: DataFrame, seeds: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """``traverse`` for many questions at once, from ``seeds (query_id, id)``: ``(reached (query_id, id, hop),
    relations (query_id, edge_id, hop))``."""
    steps = cut(both_ways(edges))
    visited = cut(seeds.select("query_id", "id", F.lit(0).alias("hop")).distinct())
    frontier, followed = visited, None
    for hop in range(1, max_hops + 1):
        met = steps.join(frontier.select("query_id", F.col("id").alias("a")), "a").select("query_id", "b", "edge_id")
        hops = met.select("query_id", "edge_id", F.lit(hop).alias("hop")).distinct()
        followed = hops if followed is None else followed.union(hops)
        frontier = cut(met.select("query_id", F.col("b").alias("id")).distinct().join(visited, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        visited = cut(visited.union(frontier))
    if followed is None:
        followed = visited.select("query_id", F.lit("").alias("edge_id"), "hop").limit(0)
    return visited, followed.groupBy("query_id", "edge_id").agg(F.min("hop").alias("hop"))


def paths(edges: DataFrame, starts: DataFrame, max_hops: int, limit: int | None = None) -> DataFrame:
    """``start, nodes, edge_ids, hops``: all trails of 1 to ``max_hops`` steps in either direction that use no edge
    twice, in order of start, hops, nodes and edges.

    With a ``limit``, no more than the first are built: a start that has as many trails is not followed further, as
    longer ones come after them, nor is any start after it. So the trails that are extended are fewer than ``limit`` for
    each start, whatever the hubs; the counts of at most ``limit`` starts are read after each level.
    """
    steps = cut(both_ways(edges))
    schema = "start string, nodes array<string>, edge_ids array<string>, hops int"
    current = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_ids"), F.col("id").alias("a")).distinct()
    every, counts = None, {}
    order = ["start", "hops", F.array_join("nodes", ">"), F.array_join("edge_ids", ">")]
    for hop in range(1, max_hops + 1):
        longer = current.join(steps, "a").where(~F.array_contains("edge_ids", F.col("edge_id")))
        current = longer.select("start", F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.col("b").alias("a"))
        current = cut(current.distinct())
        found = current.select("start", "nodes", "edge_ids", F.lit(hop).alias("hops"))
        if limit:
            place = F.row_number().over(Window.partitionBy("start").orderBy(*order[1:]))
            for r in current.groupBy("start").agg(F.count(F.lit(1)).alias("n")).orderBy("start").limit(limit).collect():
                counts[r["start"]] = counts.get(r["start"], 0) + r["n"]
            total, last = 0, None
            for start in sorted(counts):
                total += counts[start]
                if counts[start] >= limit or total >= limit:
                    last = start  # the trails up to this start are enough
                    break
            kept = F.col("start") <= last if last is not None else F.lit(True)
            found = found.where(kept).withColumn("place", place).where(F.col("place") <= limit).drop("place")
            full = [s for s, n in counts.items() if n >= limit]
            current = current.where(kept & ~F.col("start").isin(full))
        every = found if every is None else every.union(found)
    if every is None:
        return edges.sparkSession.createDataFrame([], schema)
    return every.orderBy(*order).limit(limit) if limit else every


def path_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of paths as rows ``name, type, document_id``, once for each place in each path."""
    ids = found.select(F.explode("nodes").alias("id"))
    return ids.join(nodes, "id", "left").select("name", "type", F.col("doc_id").alias("document_id"))


def path_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    ids = found.select(F.explode("edge_ids").alias("edge_id"))
    return ids.join(edges, "edge_id").select("src", "relation", "tgt")


def reference_lookup(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends, '?' for a missing node or name."""
    name = nodes.select("id", "name")
    s, t = name.select(F.col("id").alias("src"), F.col("name").alias("source_name")), name.select(F.col("id").alias("tgt"), F.col("name").alias("target_name"))
    return edges.join(s, "src", "left").join(t, "tgt", "left").select("src", "tgt", "relation", F.coalesce("source_name", F.lit("?")).alias("source_name"), F.coalesce("target_name", F.lit("?")).alias("target_name"))


def term_words(question: Column | str) -> Column:
    """ASCII words of three letters or more, lower case, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z]{3,}"), F.lit(0)))
