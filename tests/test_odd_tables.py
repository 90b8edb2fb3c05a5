"""Queries over tables that are stored or filled in other ways than the test tables, against their SQL."""

from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from oracle import same

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
EXTRACTIONS = "document_id string, extracted_at timestamp, entities array<struct<entity_id:string,name:string>>, relations array<struct<source_id:string>>"


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def test_graphs_without_entities(spark, tmp_path):
    day = lambda n: datetime(2030, 1, n)
    rows = [
        ("none", day(1), [], []), ("missing", day(1), None, None), ("gap", day(1), [None, ("e", "n")], [("s",)]), ("unnamed", day(1), [("e", None)], []),
        ("lost", day(1), [("e", "old")], [("s",)]), ("lost", day(2), None, None), ("late", None, [("e", "n")], []), (None, day(1), [("e", "n")], [("s",), None]),
    ]
    spark.createDataFrame(rows, EXTRACTIONS).write.parquet(str(tmp_path / "extractions.parquet"))
    same(QUERIES["K18_write_graph_json"](spark, str(tmp_path)), connect(tmp_path), SQL["K18_write_graph_json"])


@pytest.mark.parametrize("files", ["one", "folder", "empty", "no extension"])
def test_ingest_of_tables_in_any_files(spark, tmp_path, files):
    table = tmp_path / "documents.parquet"
    rows = spark.range(0, 0 if files == "empty" else 40, 1, 3).selectExpr("concat('d', id) AS doc_id", "if(id % 5 = 0, NULL, 's') AS source", "'x' AS text")
    rows.write.parquet(str(tmp_path / "parts"))
    parts = sorted((tmp_path / "parts").glob("part-*.parquet"))
    if files == "one":
        parts[0].rename(table)
    else:
        table.mkdir()
        for i, part in enumerate(parts):
            part.rename(table / (f"part-{i}" if files == "no extension" else part.name))
    found = sorted(map(tuple, QUERIES["ST2_incremental_ingest"](spark, str(tmp_path)).collect()))
    con = connect(tmp_path) if files != "no extension" else duckdb.connect()
    if files == "no extension":
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{table}/part-*')")
    assert found == sorted(con.execute(SQL["ST2_incremental_ingest"]).fetchall()) and bool(found) == (files != "empty")
