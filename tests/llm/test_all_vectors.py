"""All usual words have vectors, whether the driver fits them or the tasks, shipped or joined."""

import random

import numpy as np

from corvane.llm import scan_repair

PAGES = "page_id bigint, document_id string, page_num int, natural_text string, received_at timestamp"


def test_words_beyond_the_drivers_are_told_by_context(spark, monkeypatch):
    """"modem" is rare in one context and "modern" misread in the other; both words and their neighbours lie beyond the
    words whose vectors the driver fits."""
    rng = random.Random(3)
    houses = "house street garden window tower bridge square church market harbour".split()
    wires = "cable signal router plug socket packet antenna port switch cabinet".split()
    line = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows, true, false = [], set(), set()
    for i in range(300):
        texts = ["very often here. " * 4, f"{line(houses, 3)} modern {line(houses, 3)}.", f"{line(wires, 7)}.", f"{line(houses, 7)}."]
        if i % 50 < 2:
            own, kind = (true, houses) if i % 50 == 0 else (false, wires)
            texts.append(f"{line(kind, 3)} modem {line(kind, 3)}.")
            own.add((i, 5))
        rows.append((i, f"d{i}", 1, "\n".join(texts), None))
    pages = scan_repair.distinct_pages(spark.createDataFrame(rows, PAGES))

    def found():
        return {(r["page_id"], r["line_no"]) for r in scan_repair.faults(pages).where("kind = 'bad_char'").collect()}

    want = found()
    assert len(want & true) >= 5 and not want & false
    monkeypatch.setattr(scan_repair, "VECTORS", 3)
    assert found() == want
    monkeypatch.setattr(scan_repair, "WORDS", 3)
    assert found() == want


def test_blocks_equal_the_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    size, rows = 130, []
    for _ in range(900):
        a, b = (int(x) for x in (rng.random(2) ** 2 * (size - 2)).astype(int))  # the last two words have no neighbours
        rows.append((a * size + b, int(rng.integers(1, 9))))
    pairs = spark.createDataFrame(rows, "pair bigint, n bigint").groupBy("pair").sum("n").toDF("pair", "n")
    monkeypatch.setattr(scan_repair, "AT_ONCE", 2 * size)
    matrix, blocks = scan_repair.Matrix.of(pairs, size), scan_repair.Blocks.of(pairs, size)
    assert len(matrix) == len(blocks) == size and np.array_equal(matrix.sums, blocks.sums)
    both = [rng.normal(0, 0.5, (size, scan_repair.DIMENSIONS)).astype(np.float32) for _ in range(2)]
    for a, b in zip(matrix.slopes(*both), blocks.slopes(*both)):
        assert np.allclose(a, b, atol=1e-5)
    for shift in (-3, 0, 3):  # the least fit below, around and above zero
        moved = [np.hstack([x, np.full((size, 1), k)]).astype(np.float64) for x, k in zip(both, (1, shift * 5))]
        least, near = matrix.least_fit(*moved), blocks.least_fit(*moved)
        assert near <= least and abs(near - least) < 1e-5
    nothing = scan_repair.Blocks.of(pairs.limit(0), size)
    assert not np.any(scan_repair.climb(nothing)[0]) and nothing.least_fit(*both) == 0.0
