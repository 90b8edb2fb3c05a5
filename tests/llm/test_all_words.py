"""Repair of scans with all words of the corpus, also those that are not shipped to every task."""

from datetime import datetime

from corvane.llm import scan_repair

PAGES = "page_id bigint, document_id string, page_num int, natural_text string, received_at timestamp"


def pages(spark):
    body = "Here the quick network measures the report of the company.\nAgain the quick network measures the report of the company."
    texts = [body] * 9 + ["Here the qulck nctwork measures the rcp0rt of the com-\npany. Again the\nnctw0rk of the company.", *["Some tbing is here."] * 4, *["Some thing is here."] * 8]
    return scan_repair.distinct_pages(spark.createDataFrame([(i, f"d{i}", 1, t, datetime(2030, 1, 1)) for i, t in enumerate(texts)], PAGES))


def test_words_beyond_the_most_frequent(spark, monkeypatch):
    rows = pages(spark)
    found = lambda: {(r["page_id"], r["line_no"], r["kind"]) for r in scan_repair.faults(rows).collect()}
    texts = lambda: {r["page_id"]: r["text"] for r in scan_repair.continuous_text(rows).collect()}
    want, repaired = found(), texts()
    assert {(9, 1, "bad_char"), (9, 1, "hyphen"), (9, 3, "bad_char")} <= want and "quick network measures the report of the company" in repaired[9]
    monkeypatch.setattr(scan_repair, "WORDS", 3)
    assert found() == want and texts() == repaired


def test_own_count_of_rare_words(spark):
    """A word seen four times is not corrected to one that is seen eight times only."""
    got = {r["page_id"] for r in scan_repair.faults(pages(spark)).where("kind = 'bad_char'").collect()}
    assert not got & set(range(10, 14))


def test_misreadings_invert_readings():
    for word in ("nctw0rk", "modern", "rnill", "(ouse", "iiii"):
        assert all(word in scan_repair.misreadings(x) for x in scan_repair.readings(word))
        assert all(word in scan_repair.readings(x) for x in scan_repair.misreadings(word))
