import pytest

from corvane.llm import queries as llm
from oracle import connect, same


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, data, name):
    same(llm.queries()[name](spark, data), connect(data), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in llm.NAMES if n.endswith("_found") or n in ("p8_ids", "p9_containers")])
def test_rows_are_distinct(spark, data, name):
    df = llm.queries()[name](spark, data)
    rows = [str(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
