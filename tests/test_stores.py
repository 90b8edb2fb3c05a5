"""Upserts, sources, streaming and traversal on small fixtures."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from corvane.operators import graph, lifecycle, reasoning
from corvane.plans.lineage import cut, ensure_checkpoint_dir
from corvane.plans.numbering import numbered
from corvane.sources import files
from corvane.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_write_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    lifecycle.write_upsert(a, path, ["k"])
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for _ in range(2):
        lifecycle.write_upsert(b, path, ["k"])
        assert rows(lifecycle.read_table(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_keeps_one_row_of_a_key(spark):
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "x", 1), (None, "y", 2), (1, "c", 1)], "k int, v string, t int")
    old = spark.createDataFrame([(None, "old", 0), (1, "old", 9), (2, "old", 0)], "k int, v string, t int")
    want = [(1, "b", 2), (2, "old", 0), (None, "y", 2)]
    got = lifecycle.upsert(old, new, ["k"], F.col("t"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    again = lifecycle.upsert(got, new, ["k"], F.col("t"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)
    assert lifecycle.upsert(None, new.limit(0), ["k"]).count() == 0
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert lifecycle.upsert(keys, keys, ["k"]).count() == 2


def test_a_merge_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    lifecycle.write_upsert(spark.createDataFrame([(i, "a") for i in range(200)], "k int, v string"), path, ["k"], buckets=16)
    before = lifecycle._manifest(spark, path)[1]["buckets"]
    lifecycle.write_upsert(spark.createDataFrame([(7, "b"), (7, "c"), (None, "d")], "k int, v string"), path, ["k"])
    after = lifecycle._manifest(spark, path)[1]["buckets"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) <= 2
    got = {r["k"]: r["v"] for r in lifecycle.read_table(spark, path).collect()}
    assert got[7] == "c" and got[None] == "d" and len(got) == 201


def test_zero_hops(spark):
    e = graph.with_edge_ids(spark.createDataFrame([("a", "b", "r", "d")], "src string, tgt string, relation string, doc_id string"))
    reached, followed = graph.traverse(e, spark.createDataFrame([("a",)], "id string"), 0)
    assert rows(reached) == [("a", 0)] and followed.count() == 0


def test_limited_paths_are_the_first_of_all(spark):
    import random

    rng = random.Random(6)
    pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)] + [("hub", f"n{i}") for i in range(14)]
    e = graph.with_edge_ids(spark.createDataFrame([(a, b, "r", "d") for a, b in pairs], "src string, tgt string, relation string, doc_id string"))
    starts = spark.createDataFrame([("n1",), ("n3",), ("lonely",), ("hub",)], "id string")
    every = [tuple(r) for r in graph.paths(e, starts, 3).collect()]
    key = lambda r: (r[0], r[3], ">".join(r[1]), ">".join(r[2]))
    for limit in (1, 5, 40):
        assert [tuple(r) for r in graph.paths(e, starts, 3, limit).collect()] == sorted(every, key=key)[:limit]


def test_tables_are_created_and_dropped(spark):
    lifecycle.ensure_table(spark, "t_corvane", "a INT")
    lifecycle.ensure_table(spark, "t_corvane", "a INT")
    assert spark.catalog.tableExists("t_corvane")
    lifecycle.drop_tables(spark, ["t_corvane"])
    assert not spark.catalog.tableExists("t_corvane")


def test_cut_keeps_rows(spark):
    ensure_checkpoint_dir(spark)
    assert cut(spark.range(5)).count() == 5


def test_numbering(spark):
    df = spark.range(0, 1000, 1, 7).select(F.xxhash64("id").alias("h"), "id")
    got = numbered(df, F.desc("h"), F.col("id")).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1, 1001)) and [r["h"] for r in got] == sorted((r["h"] for r in got), reverse=True)
    assert numbered(df.limit(0), F.col("id")).count() == 0


def test_blocked_search_equals_one_block(spark, monkeypatch):
    import numpy as np

    from corvane.operators import retrieval

    x = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(999, None)], "id int, e array<double>")
    asked = df.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("e").alias("v"))
    whole = rows(retrieval.near_vectors(df, asked, "id", "e", 4))
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 10)
    assert rows(retrieval.near_vectors(df, asked, "id", "e", 4)) == whole and len(whole) == 4 * 43
    c = np.round(1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[0] / np.linalg.norm(x[0])), 6)
    assert [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == 0] == np.argsort(c, kind="stable")[:4].tolist()


def test_sources(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "x.md").write_text("no")
    (tmp_path / "a.md").write_text("# H\n\nPara one\nmore\n\n- item\n\n> quote\n\n```\ncode\n```\n")
    (tmp_path / "d1.graph.json").write_text(json.dumps({"entities": [{"entity_id": "e", "name": "n"}], "relations": None}))
    (tmp_path / "layout_003.json").write_text(json.dumps({"input_path": "p", "boxes": [{"label": "image", "coordinate": [1, 2, 3, 4]}]}))
    (tmp_path / "i_metadata.json").write_text(json.dumps({"metadata": {"k1": {"title": "t"}}}))
    (tmp_path / "p.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00000000"))
    (tmp_path / "bad.png").write_bytes(b"no image")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        ns = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
        f.writestr("Contents/section0.xml", f"<r {ns}><hp:p><hp:t>Body</hp:t></hp:p><hp:p><hp:tbl><hp:tr><hp:tc><hp:p><hp:t>c1</hp:t></hp:p></hp:tc><hp:tc><hp:p><hp:t>c2</hp:t></hp:p></hp:tc></hp:tr></hp:tbl></hp:p></r>")
    (tmp_path / "h.hwpx").write_bytes(z.getvalue())
    (tmp_path / "broken.hwpx").write_bytes(b"x")
    root = str(tmp_path)
    assert not any("metadata/x.md" in r["path"] for r in files.scan_files(spark, root).select("path").collect())
    got = [(r["kind"], r["text"]) for r in files.sections_of(files.scan_markdown(spark, root).select("path", F.lit("x").alias("text")).limit(0)).collect()]
    assert got == []
    kinds = [r["kind"] for r in files.scan_markdown(spark, root).where(F.col("path").endswith("a.md")).orderBy("section").collect()]
    assert kinds == ["paragraph", "item", "quote", "code"]
    assert [r["document_id"] for r in files.scan_graph_json(spark, root).collect()] == ["d1"]
    assert [(r["page"], r["x2"]) for r in files.scan_layout_json(spark, root).collect()] == [(3, 3.0)]
    assert [(r["id"], r["title"]) for r in files.scan_image_metadata_json(spark, root).collect()] == [("k1", "t")]
    assert [r["path"].rsplit("/", 1)[1] for r in files.scan_images(spark, root).collect()] == ["p.png"]
    blocks = sorted(((r["kind"] or "", r["text"] or "", r["error"] or "") for r in files.scan_hwpx(spark, root).collect()))
    assert blocks == [("", "", "BadZipFile"), ("paragraph", "Body", ""), ("table", "c1\tc2", "")]
    row = files.file_catalog(files.scan_files(spark, root, "p.png")).first()
    assert row["extension"] == ".png" and row["kind"] == "image" and row["size"] == 12


def test_incremental_ingest_continues(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "a")], "k int, v string").coalesce(1).write.parquet(source)
    run = lambda: ingest.incremental(spark, source, "k int, v string", checkpoint, lambda b: b, target, ["k"]).awaitTermination()
    run()
    spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string").coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows(lifecycle.read_table(spark, target)) == [(1, "b"), (2, "c")]


def test_session_stream_equals_batch(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    batch = ingest.idle_sessions(spark.read.parquet(f"{data}/events.parquet"), "user_id", "ts", "30 minutes")
    stream = ingest.session_stream(spark, data, schema, "user_id", "ts", "30 minutes", "1 hour")
    q = stream.writeStream.format("memory").queryName("sessions_test").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("sessions_test")) == rows(batch)


def test_traversal_is_by_levels(spark):
    e = graph.with_edge_ids(spark.createDataFrame([("a", "b", "r", "d"), ("b", "c", None, "d"), ("c", "a", "r", "d"), ("c", "d", "r", "d"), ("x", "y", "r", "d"), (None, "a", "r", "d")], "src string, tgt string, relation string, doc_id string"))
    seeds = spark.createDataFrame([("a",)], "id string")
    reached, relations = graph.traverse(e, seeds, 3)
    assert rows(reached) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert {r["edge_id"]: r["hop"] for r in relations.collect()} == {"a|r|b": 1, "c|r|a": 1, "b||c": 2, "c|r|d": 2}
    found = graph.paths(e, seeds, 3)
    assert all(len(set(r["edge_ids"])) == r["hops"] for r in found.collect())
    assert found.where("hops = 3").count() == 3


def test_expansion_restores_after_failures(spark):
    empty = spark.createDataFrame([], "name string")
    state = reasoning.Thoughts("q", empty, empty)
    search = lambda w: (spark.createDataFrame([(w,)], "name string"), empty, ["z"] if w == "good" else [])
    out = reasoning.expand(state, search, lambda q, e, r: 0.9 if e.first()["name"] == "good" else 0.0, ["good", "b", "c", "d", "e"], width=1)
    assert rows(out.entities) == [("good",)] and out.notes[-1] == "restored"


def test_islands_equal_a_loop(spark):
    import random

    from corvane.plans.islands import islands

    rng = random.Random(6)
    data = [("k" if rng.random() < 0.9 else None, i, rng.choice(["a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, i int, v string")
    got = {(r["k"], r["i"]): r["n"] for r in islands(df, "k", [F.col("i")], "v", F.floor(F.col("i") / 37), "n").collect()}
    for key in ("k", None):
        n, last = 0, object()
        for k, i, v in data:
            if k == key:
                n += v is None or v != last
                last = v
                assert got[k, i] == n
