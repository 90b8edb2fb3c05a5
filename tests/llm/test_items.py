"""Splitting, encoding and packing: round trips, bounds, and defined results for odd rows."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from corvane.llm import bpe_automaton, pack_containers, split_items

VOCABULARY = bpe_automaton.default_vocabulary()
CHUNKS = "chunk_id string, document_id string, text string, start_pos int, token_start int, content_type string, metadata map<string,string>, max_size string, kind int, rest string"
LIMITS = "content_type string, unit string, max_size int, overlap int"


@pytest.fixture(scope="module")
def reference():
    encoder = bpe_automaton.automaton(*VOCABULARY)
    return encoder, tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab <|endoftext|>'\n1", max_size=60))
def test_automaton_equals_merging(text):
    encoder = bpe_automaton.automaton(*VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=encoder.ranks, special_tokens={})
    ids = encoder.encode(text)
    assert ids == other.encode_ordinary(text)
    assert encoder.decode(ids) == text


def test_automaton_on_the_corpus(reference, data):
    import pyarrow.parquet as pq

    encoder, other = reference
    for text in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist():
        if text:
            assert encoder.encode(text) == other.encode_ordinary(text)


def test_long_runs(reference):
    encoder, other = reference
    for text in ("a" * 20_000, "안녕" * 5_000, "the cat " * 5_000, " " * 3_000 + "x"):
        assert encoder.encode(text) == other.encode_ordinary(text)


def test_encode_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "x"), (3, "<|endoftext|>", "x")], "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe_automaton.encode_corpus(df).collect()]
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) > 1
    assert bpe_automaton.encode_corpus(df.limit(0)).collect() == []


def packed(spark, texts, capacity=64):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("x", "x")
    return pack_containers.pack(df, capacity).collect()


def test_packing_bounds(spark):
    rng = random.Random(5)
    texts = ["word " * rng.choice([0, 1, 3, 10, 30, 60, 200, 900]) for _ in range(900)] + [None, ""]
    rows = packed(spark, texts)
    size = {}
    for r in rows:
        if r["container_id"] is not None:
            size[r["container_id"]] = size.get(r["container_id"], 0) + r["n_tokens"]
    assert max(size.values()) <= 64
    encoder = bpe_automaton.automaton(*VOCABULARY)
    for i, t in enumerate(texts):
        mine = sorted((r["piece_no"], r["token_start"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        n = len(encoder.encode(t))
        assert sum(m[2] for m in mine) == n and [m[0] for m in mine] == list(range(len(mine)))
        assert len(mine) == max(1, -(-n // 64)) and all(m[2] == 64 for m in mine[:-1])
    total = sum(size.values())
    assert total / 64 / len(size) > 0.95


def test_differencing_is_nearly_equal():
    sizes = np.random.default_rng(1).integers(1, 500, 200)
    window, sums = pack_containers.difference(sizes, 10)
    assert (np.bincount(window, sizes, 10) == sums).all() and sums.max() - sums.min() <= 5
    assert pack_containers.fill(np.array([5]), 10).tolist() == [0]


def test_packing_empty(spark):
    assert packed(spark, []) == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n,文。", max_size=400), st.integers(4, 60), st.integers(0, 30))
def test_cuts_cover_the_text(text, size, overlap):
    pieces = split_items.cuts(text, size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= size for a, b in pieces)
    kept = max(0, min(overlap, size // 2 - 1))
    assert all(q[0] == p[1] - kept and q[1] > p[1] for p, q in zip(pieces, pieces[1:]))


def test_cuts_are_natural():
    topic = lambda words: " ".join(f"The {w} is a {w}." for w in words)
    text = topic(["apple", "pear"] * 6) + "\n\n" + topic(["engine", "wheel"] * 6)
    (_, end), *_ = split_items.cuts(text, len(text) * 2 // 3, 0)
    assert text[:end].rstrip().endswith(".")
    assert abs(end - text.index("\n\n")) < 60


def test_split_rows(spark):
    meta = {"ingested_at": "2"}
    rows = [
        ("c1", "d", "One two. " * 30, 10, 5, " TEXT ", meta, "clash", 1, "r"), ("c1", "d", "One two. " * 30, 10, 5, " TEXT ", {"ingested_at": "1"}, "clash", 1, "r"),
        ("c2", "d", None, None, None, None, None, None, None, None), ("c3", "d", "", -4, -1, "code", None, None, None, None), ("c4", "d", "x" * 250, 0, 0, None, None, None, None, None), ("c5", "d", "y" * 999, 0, 0, "poem", None, None, None, None),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    limits = spark.createDataFrame([("text", "characters", 100, 10), ("mixed", "characters", 200, 0), ("code", "characters", 50, 5)], LIMITS)
    got = {}
    for r in split_items.split_oversized(chunks, limits).collect():
        got.setdefault(r["chunk_id"], []).append(r)
    one = sorted(got["c1"], key=lambda r: r["piece_no"])
    text = rows[0][2]
    for r in one:
        assert text[r["start_pos"] - 10 : r["end_pos"] - 10] == r["text"] and len(r["text"]) <= 100
        words = text.split()
        assert r["text"].split()[0] in words[r["token_start"] - 5] and r["oversized"]
    assert [len(got[c]) for c in ("c2", "c3", "c4", "c5")] == [1, 1, 2, 1]
    assert got["c2"][0]["text"] is None and got["c3"][0]["start_pos"] == 0
    assert [r["chunk_id"] for r in split_items.split_oversized(chunks, limits, only_oversized=True).where("piece_no = 0").orderBy("chunk_id").collect()] == ["c1", "c4"]
    assert split_items.split_oversized(chunks.limit(0), limits).count() == 0


def test_the_latest_row_is_measured(spark):
    """A chunk delivered long and then short is not oversized, one delivered short and then long is."""
    rows = [("c", "d", "One two. " * 30, 0, 0, "text", {"ingested_at": "2024"}, None, None, None), ("c", "d", "One two.", 0, 0, "text", {"ingested_at": "2025"}, None, None, None)]
    rows += [("e", "d", "One two.", 0, 0, "text", {"ingested_at": "2024"}, None, None, None), ("e", "d", "One two. " * 30, 0, 0, "text", {"ingested_at": "2025"}, None, None, None)]
    limits = spark.createDataFrame([("text", "characters", 100, 10)], LIMITS)
    for only in (True, False):
        pieces = split_items.split_oversized(spark.createDataFrame(rows, CHUNKS), limits, only_oversized=only)
        assert {r["chunk_id"] for r in pieces.where("oversized").collect()} == {"e"}


def test_pieces_are_bounded_overlap_and_cohere():
    """Cuts lie where the blocks before and after are less alike than at other pauses."""
    rng = random.Random(4)
    topics = [["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(12)] for _ in range(30)]
    text = "  ".join(" ".join(f"{' '.join(rng.choice(t) for _ in range(8))}." for _ in range(9)) for t in topics)
    pieces = split_items.cuts(text, 900, 40)
    assert all(b - a <= 900 for a, b in pieces) and all(q[0] == p[1] - 40 for p, q in zip(pieces, pieces[1:]))
    assert all(text[:b].rstrip().endswith(".") for _, b in pieces[:-1])
    gaps, _ = split_items.gaps_of(text)
    depth = dict(zip(gaps.tolist(), split_items.cohesion_depths(text, gaps)))
    assert np.mean([depth[b] for _, b in pieces[:-1]]) > 2 * np.mean(list(depth.values()))
