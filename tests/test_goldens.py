"""Expected values of single inputs."""

import uuid

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.ids import uuid5
from corvane.functions.vectors import similarity_from_distance
from corvane.operators import chunking, graph_build, layout, routing, tables, tools, transcript
from corvane.sources import files, scorers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("expression,value", [("10 + 20 * 3", 70.0), ("-(2 ** 3) % 5", 2.0), ("1/4", 0.25)])
def test_calculator(expression, value):
    assert tools.calculate(expression) == value


@pytest.mark.parametrize("expression", ["2 ^ 3", "__import__('os')", "a + 1", "", "(-8) ** 0.5"])
def test_calculator_refuses(expression):
    with pytest.raises((ValueError, SyntaxError)):
        tools.calculate(expression)


@pytest.mark.parametrize("statement", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "CREATE TABLE t (a INT)"])
def test_only_select_runs(spark, statement):
    with pytest.raises(ValueError):
        tools.run_select(spark, statement)


def test_select_runs(spark):
    assert tools.run_select(spark, "SELECT 1 AS a").first()["a"] == 1


@pytest.mark.parametrize("question,hops", [("a -> b -> c", 4), ("PPO vs DPO, RLHF", 3), ("what is PPO?", 1), ("전체 경로 -> 흐름, a/b, 비교", 6)])
def test_hops(spark, question, hops):
    assert one(spark, routing.hops_by_patterns("q"), q=question) == hops


@pytest.mark.parametrize("length,hops", [(80, 1), (81, 3), (201, 4), (501, 6)])
def test_hops_by_length(spark, length, hops):
    assert one(spark, routing.hops_by_length("q"), q="x" * length) == hops


@pytest.mark.parametrize("hops,path", [(2, "vector"), (3, "cross_ref"), (5, "cross_ref"), (6, "graph_db")])
def test_route(spark, hops, path):
    assert one(spark, routing.route("h"), h=hops) == path


def test_intent_matches_inside_words(spark):
    assert one(spark, routing.intent("q"), q="please summarise 2024 results") == "calculation"


def test_math_expression(spark):
    assert one(spark, T.math_expression("q"), q="what is (3+4)*2 ?") == "(3+4)*2"


def test_bm25_query(spark):
    assert one(spark, T.bm25_query("q"), q="DPO는 무엇인가 학습에서") == "DPO 무엇 학습"
    assert one(spark, T.bm25_query("q"), q="?!") == "?!"


@pytest.mark.parametrize("distance,similarity", [(0.25, 0.75), (1.5, 0.0)])
def test_similarity(spark, distance, similarity):
    assert one(spark, similarity_from_distance("d"), d=distance) == similarity
    assert spark.range(1).select(similarity_from_distance(F.lit(None).cast("double")).alias("x")).first()["x"] == 1.0


@pytest.mark.parametrize("answer,context,score,improve", [("a" * 120, "c", 0.76, False), ("a" * 10, "", 0.55, True), ("", "c", 0.5, True)])
def test_answer_scores(spark, answer, context, score, improve):
    s = routing.answer_scores("a", "c")
    row = spark.createDataFrame([(answer, context)], "a string, c string").select(s["overall_score"].alias("o"), s["needs_improvement"].alias("n")).first()
    assert abs(row["o"] - score) < 1e-9 and row["n"] == improve


def test_greedy_chunks(spark):
    df = spark.createDataFrame([(["aaaa", "bbbb", "cccc"],)], "s array<string>")
    assert df.select(chunking.greedy_chunks("s", 10).alias("x")).first()["x"] == ["\n\naaaa\n\nbbbb", "cccc"]
    assert spark.createDataFrame([([],)], "s array<string>").select(chunking.greedy_chunks("s", 10).alias("x")).first()["x"] == []


def test_chunk_boundaries_reconstruct(spark):
    text = "one two\n\nthree four\nfive"
    df = spark.createDataFrame([(text,)], "t string").withColumn("c", chunking.greedy_chunks(chunking.line_sections("t"), 9))
    row = df.select("c", chunking.boundaries("c", "t").alias("b")).first()
    assert [text[b["start"] : b["end"]] for b in row["b"]] == [c.strip() for c in row["c"]]


def test_distinct_lines(spark):
    text = "A\n\na \nb\n| x |\n| x |\nB"
    assert one(spark, chunking.distinct_lines("t"), t=text) == "A\n\nb\n| x |\n| x |"


def test_split_long(spark):
    df = spark.createDataFrame([("r", 0.0, 40.0, "s")], "recording_id string, start double, end_time double, speaker string")
    assert [(r["start"], r["end_time"]) for r in transcript.split_long(df).orderBy("piece").collect()] == [(0, 15), (15, 30), (30, 40)]


def test_gap_fill(spark):
    df = spark.createDataFrame([("r", 1.0, 2.0, "a"), ("r", 2.3, 3.0, "b")], "recording_id string, start double, end_time double, speaker string")
    lasts = spark.createDataFrame([("r", 5.0), ("silent", 2.0)], "recording_id string, duration double")
    got = sorted((r["recording_id"], r["start"], r["end_time"], r["speaker"]) for r in transcript.gap_fill(df, lasts).collect())
    assert got == [("r", 0.0, 1.0, "UNKNOWN"), ("r", 1.0, 2.0, "a"), ("r", 2.3, 3.0, "b"), ("r", 3.0, 5.0, "UNKNOWN"), ("silent", 0.0, 2.0, "UNKNOWN")]


def test_box_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 13.0, 14.0, 20.0, 20.0)], ["ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2"])
    assert df.select(layout.distance("a", "b").alias("d")).first()["d"] == 5.0


def test_kept_pages(spark):
    toc = spark.createDataFrame([("d", 1, 1), ("d", 2, 3), ("d", 1, 5)], "doc string, level int, page int")
    pages = spark.createDataFrame([("d", i) for i in range(1, 7)] + [("e", 1)], "doc string, page int")
    assert sorted((r["doc"], r["page"]) for r in layout.kept_pages(toc, pages).collect()) == [("d", 3), ("d", 4), ("e", 1)]


@pytest.mark.parametrize("relation,kind", [("depends on", "DEPENDS_ON"), ("3x", "RELATION"), ("", "RELATION")])
def test_relation_type(spark, relation, kind):
    assert one(spark, T.relation_type("r"), r=relation) == kind


def test_rerank_keeps_the_best(spark):
    from corvane.operators.retrieval import rerank

    df = spark.createDataFrame([("q", 1, 0.9, 0.2), ("q", 2, 0.8, 0.1)], "query_id string, id int, score double, new double")
    assert [r["id"] for r in rerank(df, ["query_id"], F.col("new"), 0.3, 5).collect()] == [1]
    assert rerank(df, ["query_id"], F.col("new"), 0.3, 5, keep_best=False).count() == 0


@pytest.mark.parametrize("name", ["a", "한국어", "https://x/y?z=1", ""])
def test_uuid5(spark, name):
    assert one(spark, uuid5("n"), n=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_think(spark):
    assert one(spark, T.without_think("t"), t="<think>x</think> a <Think>open") == "a"
    assert one(spark, T.after_think("t"), t="<think>x</think> a") == "a"


def test_tables_round_trip():
    matrix = "<table><tr><td>a</td><td><l></td><td>b</td></tr><tr><td><t></td><td><lt></td><td>c</td></tr></table>"
    spans = tables.spans_of(matrix)
    assert spans == '<table><tr><td rowspan="2" colspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>'
    assert tables.spans_of(tables.matrix_of(spans)) == spans
    with pytest.raises(ValueError):
        tables.spans_of("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>")


@pytest.mark.parametrize("raw,text", [('{"natural_text": "a"}', "a"), ('{"natural_text": "a\\u12', "a"), ('{"primary_language": "en", "natural_text": "b', "b"), ("", ""), (None, ""), ('x "natural_text": "q\\"r" y', 'q"r')])
def test_page_repair(raw, text):
    assert scorers.repaired_page(raw)["natural_text"] == text


def test_extraction_lines():
    assert scorers.extraction_lines("<think>t</think>Okay ENT_1 | A | B ENT_2 | C | D\n\nENT_1 -> ENT_2 (uses)") == ["ENT_1 | A | B", "ENT_2 | C | D", "ENT_1 -> ENT_2 (uses)"]


def test_parse_lines(spark):
    lines = spark.createDataFrame([(1, 0, "ENT_1 | Alpha | Model (x)"), (1, 1, "ENT_2 | name | Type"), (1, 2, "ENT_3 | Beta | Tooling"), (1, 3, "ENT_1 -> ENT_3 (uses)"), (1, 4, "ENT_1 -> ENT_9 (uses)"), (1, 5, "ENT_1 -> ENT_3 (relates  to)")], "chunk_id int, line_no int, line string")
    entities = graph_build.parse_entity_lines(lines)
    assert sorted((r["entity_id"], r["name"], r["type"]) for r in entities.collect()) == [("c1_ENT_1", "Alpha", "Model"), ("c1_ENT_3", "Beta", "Tooling")]
    assert [(r["source_id"], r["target_id"]) for r in graph_build.parse_relation_lines(lines, entities).collect()] == [("ENT_1", "ENT_3")]


@pytest.mark.parametrize("path,kind", [("a/B.PDF", "pdf"), ("x.hwpx", "office"), ("x.webp", "image"), ("x.mp4", "sound"), ("x", "unsupported"), ("a.pdf/x", "unsupported")])
def test_kind_of(spark, path, kind):
    assert one(spark, files.kind_of("p"), p=path) == kind


def test_best_path_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("x, y, z", 1, []), ("plain", 2, ["graph_db", "cross_ref"])], "q string, h int, left array<string>")
    got = {r["q"]: r["path"] for r in routing.best_path(df, "q", "q", "h", "left").collect()}
    assert got == {"x, y, z": "vector", "plain": "graph_db"}


def test_gate_does_not_choose_the_current_path(spark):
    df = spark.createDataFrame([("q", 0.1, 0, "vector", [], 1)], "k string, quality double, backtracks int, path string, tried array<string>, h int")
    row = routing.quality_gate(df, "quality", "backtracks", "path", "tried", "k", "h", "k").first()
    assert row["passed"] is False and row["next_path"] != "vector"
