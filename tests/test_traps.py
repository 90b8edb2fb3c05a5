"""Where the described behaviour has defects, these tests fix the side that was chosen."""

from pyspark.sql import functions as F

from corvane.operators import graph, graph_build, lifecycle, reasoning, retrieval
from corvane.queries.registry import QUERIES
import corvane.queries  # noqa: F401
from corvane.sources import scorers

ENTITIES = "document_id string, pos int, entity_id string, name string, type string, chunk_id int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_entity_ids_are_qualified_by_document(spark):
    df = spark.createDataFrame([("a", 0, "c1_ENT_1", "X", "t", 1), ("b", 0, "c1_ENT_1", "Y", "t", 1)], ENTITIES)
    got = graph_build.upsert_entities(df).collect()
    assert len({r["uuid"] for r in got}) == 2


def test_a_second_upsert_changes_nothing(spark):
    df = spark.createDataFrame([("a", 0, " e ", "X", "t", 1), ("a", 1, "e", "Z", None, 1), ("a", 2, "", " n ", "t", 1), ("a", 3, None, None, None, 1)], ENTITIES)
    once = graph_build.upsert_entities(df)
    twice = graph_build.upsert_entities(df.union(df))
    assert rows(once.drop("type")) == rows(twice.drop("type"))
    assert sorted(r["key"] for r in once.collect()) == ["Unknown", "e", "n"]
    assert [r["name"] for r in once.collect() if r["key"] == "e"] == ["Z"]


def test_duplicates_keep_the_id_of_the_first(spark):
    df = spark.createDataFrame([("a", 0, "c1_ENT_1", "Alpha", "Model", 1), ("a", 1, "c2_ENT_1", " alpha ", "MODEL", 2)], ENTITIES)
    assert [r["entity_id"] for r in graph_build.first_entities(df).collect()] == ["c1_ENT_1"]


def test_relations_without_ends_are_dropped_and_worded(spark):
    entities = graph_build.upsert_entities(spark.createDataFrame([("a", 0, "x", "X", None, 1), ("a", 1, "y", "Y", None, 1)], ENTITIES))
    r = spark.createDataFrame([("a", "x", "y", None), ("a", "x", "gone", "uses"), ("b", "x", "y", "uses")], "document_id string, source_id string, target_id string, relation string")
    assert [x["relation"] for x in graph_build.upsert_relations(r, entities).collect()] == ["related_to"]


def test_relations_of_one_wording_stay_apart(spark):
    e = spark.createDataFrame([("a", "b", "uses", "d"), ("b", "c", "uses", "d"), ("a", "b", "uses", "e")], "src string, tgt string, relation string, doc_id string")
    assert graph.with_edge_ids(e).count() == 2


def test_merging_edges_by_ends_keeps_one(spark):
    n = spark.createDataFrame([("a", "A", None, "d"), ("b", "B", None, "d")], "id string, name string, type string, doc_id string")
    e = spark.createDataFrame([("a", "b", "uses", "d1"), ("a", "b", "extends", "d2"), ("a", "z", "uses", "d1")], "src string, tgt string, relation string, doc_id string")
    assert graph_build.merge_edges(e, n).count() == 2
    assert rows(graph_build.merge_edges(e, n, by_relation=False)) == [("a", "b", "extends")]


def test_the_hop_limit_is_honoured(spark):
    e = graph.with_edge_ids(spark.createDataFrame([(str(i), str(i + 1), "r", "d") for i in range(9)], "src string, tgt string, relation string, doc_id string"))
    seeds = spark.createDataFrame([("0",)], "id string")
    assert graph.traverse(e, seeds, 2)[0].count() == 3
    assert graph.paths(e, seeds, 2).agg(F.max("hops")).first()[0] == 2


def test_relation_search_follows_the_hits(spark):
    e = graph.with_edge_ids(spark.createDataFrame([("a", "b", "r", "d"), ("b", "c", "r", "d"), ("c", "d", "r", "d")], "src string, tgt string, relation string, doc_id string"))
    hits = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(r["edge_id"] for r in graph.touching(e, hits).collect()) == ["a|r|b", "b|r|c"]


def test_failed_embeddings_are_null():
    assert scorers.hashed_embedding("") is None and scorers.hashed_embedding(None) is None and scorers.hashed_embedding("!!") is None
    assert abs(sum(x * x for x in scorers.hashed_embedding("one two")) - 1) < 1e-9


def test_image_filter_has_no_fallback(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, True), ("q", 2, 0.65, True), ("q", 3, 0.55, False), ("q", 4, 0.52, False), ("q", 5, 0.4, False)], "query_id string, id int, score double, reranked boolean")
    assert sorted(r["id"] for r in retrieval.two_stage_image_filter(hits, ["query_id"]).collect()) == [1, 3]


def test_top_k_is_prefix_closed(spark, data):
    t = spark.read.parquet(f"{data}/documents.parquet")
    q = spark.createDataFrame([("a", "report scanner"), ("b", "graph of the index"), ("c", "?!")], "query_id string, query string")
    key = lambda df: {(r["query_id"], r["rank"]): r["id"] for r in df.collect()}
    three, seven = key(retrieval.bm25(t, q, "doc_id", "text", 3)), key(retrieval.bm25(t, q, "doc_id", "text", 7))
    assert three == {k: v for k, v in seven.items() if k[1] <= 3} and not any(k[0] == "c" for k in seven)


def test_votes_fall_back_to_the_best_branch(spark):
    b = spark.createDataFrame([("q", "x", 0.4), ("q", "y", 0.9), ("p", "x", 0.1), ("p", "y", 0.1)], "question_id string, branch_id string, score double")
    e = spark.createDataFrame([("q", "x", "n1"), ("q", "y", "n2"), ("q", "y", "n2"), ("p", "x", "m"), ("p", "y", "m"), ("p", "y", "k")], "question_id string, branch_id string, name string")
    assert sorted((r["question_id"], r["name"]) for r in reasoning.merge_votes(b, e).collect()) == [("p", "m"), ("q", "n2")]
    assert rows(reasoning.merge_weighted(b, e)) == [("p", "k", 0.1), ("p", "m", 0.1), ("q", "n1", 0.4), ("q", "n2", 0.9)]


def test_pruning_without_words_keeps_all(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert reasoning.prune(df, F.lit("?!"), "t").count() == 2
    assert reasoning.prune(df, F.lit("a z"), "t").count() == 1


def test_resolving_prefers_the_stored_path(spark):
    import hashlib

    m = lambda p: {"file_path": p}
    md5 = hashlib.md5(b"/b").hexdigest()
    chunks = spark.createDataFrame([("d1", m("/a")), (md5, None)], "document_id string, metadata map<string,string>")
    wanted = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    got = {r["path"]: (r["document_id"], r["priority"]) for r in lifecycle.resolve_documents(wanted, chunks).collect()}
    assert got == {"/a": ("d1", 1), "/b": (md5, 2), "/c": (hashlib.md5(b"/c").hexdigest(), 3)}


def test_page_markers_are_read_with_or_without_blank(spark, data):
    got = QUERIES["J07_crossref_page_text"](spark, data)
    assert got.where("page is not null").count() > 0
