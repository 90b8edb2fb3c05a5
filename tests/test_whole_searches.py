"""The whole composed searches: parts that the searches over a smaller job leave out."""

from pyspark.sql import functions as F

from corvane.operators import graph, retrieval
from corvane.queries import graphs, search


def test_single_hop_has_events_and_bm25_order(spark):
    nodes = spark.createDataFrame([("a", "vector store"), ("b", "vector review board of the old town"), ("c", "other")], "id string, name string")
    events = spark.createDataFrame([("d", "Tehax review"), ("d2", "Tehax review"), ("d", "Launch")], "document_id string, name string")
    edges = graph.with_edge_ids(spark.createDataFrame([("c", "a", "uses"), ("c", "c", "is")], "src string, tgt string, relation string"))
    asked = spark.createDataFrame([(1, "vector review")], "query_id int, query string")
    got = {(r["part"], r["key"]): r["rank"] for r in graphs.single_hop_of(asked, nodes, events, edges).collect()}
    assert got == {("entity", "a"): 2, ("entity", "b"): 1, ("event", "Tehax review"): 1, ("relation", "c|uses|a"): 1}


def test_traversal_of_each_question(spark):
    edges = graph.with_edge_ids(spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("x", "y", "r")], "src string, tgt string, relation string"))
    seeds = spark.createDataFrame([(1, "a"), (2, "x"), (2, "c")], "query_id int, id string")
    reached, followed = graph.traverse_each(edges, seeds, 3)
    assert {(r["query_id"], r["id"], r["hop"]) for r in reached.collect()} == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0), (2, "y", 1), (2, "c", 0), (2, "b", 1), (2, "a", 2)}
    assert {(r["query_id"], r["edge_id"], r["hop"]) for r in followed.collect()} == {(1, "a|r|b", 1), (1, "b|r|c", 2), (2, "x|r|y", 1), (2, "b|r|c", 1), (2, "a|r|b", 2)}


def test_default_images_are_appended(spark):
    near = spark.createDataFrame([(1, i, i, i % 2 == 0) for i in range(1, 21)], "query_id int, id int, rank int, free boolean")
    got = [(r["id"], r["part"]) for r in retrieval.with_defaults(near, ["query_id"], F.col("free"), 3).orderBy("pos").collect()]
    assert got == [(1, 0), (2, 0), (3, 0), (2, 1), (4, 1), (6, 1), (8, 1), (10, 1)]


def test_fusion_of_both_searchers(spark):
    asked = spark.createDataFrame([("q", "결과는 Report"), ("none", "zzz")], "query_id string, query string")
    texts = spark.createDataFrame([(1, "report of the year"), (2, "결과 report"), (3, "report 결과")], "id bigint, text string")
    images = spark.createDataFrame([(7, "결과 report"), (8, "결과 only")], "id bigint, text string")
    allowed = spark.createDataFrame([(1,), (2,), (7,), (8,)], "id bigint")
    got = {(r["query_id"], r["searcher"], r["id"]): (r["score"], r["rank"], r["results"], r["error"] is None) for r in search.fused_whole(asked, texts, images, allowed, allowed).collect()}
    assert got == {("q", "text", 2): (1.0, 1, 2, True), ("q", "text", 1): (0.5, 2, 2, True), ("q", "image", 7): (1.0, 1, 1, True), ("none", None, None): (None, None, 0, False)}
