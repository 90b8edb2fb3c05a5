"""Splitting oversized texts at natural boundaries by lexical cohesion.

Gaps between sentences (or, where there are none, between clauses or words) are candidate cuts. Two blocks of words
slide along the text; where the similarity of the words before and after a gap falls into a valley between two
peaks, the topic changes. Within each size window the deepest valley is cut. The next piece begins ``overlap``
characters before the cut.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK_WORDS = 24
#: Natural pauses from strong to weak: paragraph, line, sentence, clause, word.
PAUSES = [
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n[ \t]*"),
    re.compile(r"(?<=[.!?…])[\"'”’)\]»]*\s+|(?<=[。！？])[」』”）]*"),
    re.compile(r"(?<=[,;:，、；：])\s*|\s(?=[–—-]\s)"),
    re.compile(r"\s+|(?<=[぀-ヿ一-鿿])(?=[一-鿿])"),
]
WORDS = re.compile(r"[^\W\d_]+|\d+")
WIDE = re.compile(r"[぀-ヿ一-鿿]")


def gaps_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in ascending order and the strength of each (0 strongest)."""
    strength: dict[int, int] = {}
    for rank, pattern in enumerate(PAUSES[:4]):
        for m in pattern.finditer(text):
            strength.setdefault(m.end(), rank)
    if len(strength) < len(text) // 200 + 1:
        for m in PAUSES[4].finditer(text):
            strength.setdefault(m.end(), 4)
    at = np.array(sorted(p for p in strength if 0 < p < len(text)), np.int64)
    return at, np.array([strength[p] for p in at.tolist()], np.int64)


def cohesion_depths(text: str, gaps: np.ndarray) -> np.ndarray:
    """Depth of the valley of block similarity at each gap."""
    if len(gaps) == 0:
        return np.zeros(0)
    starts, words = [], []
    for m in WORDS.finditer(text):
        w = m.group().lower()
        if len(w) > 3 and WIDE.search(w):  # scripts without spaces: pairs of characters are words
            for i in range(len(w) - 1):
                starts.append(m.start() + i)
                words.append(w[i : i + 2])
        else:
            starts.append(m.start())
            words.append(w)
    if not words:
        return np.zeros(len(gaps))
    ids: dict[str, int] = {}
    token = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    at = np.searchsorted(np.array(starts, np.int64), gaps)
    # Pairs of equal words are the inner product of two blocks; frequent words weigh less.
    weight = 1.0 / np.bincount(token)
    similarity = np.empty(len(gaps))
    for j, p in enumerate(at.tolist()):
        a, b = token[max(0, p - BLOCK_WORDS) : p], token[p : p + BLOCK_WORDS]
        if len(a) == 0 or len(b) == 0:
            similarity[j] = 0.0
            continue
        same = a[:, None] == b[None, :]
        similarity[j] = (same * weight[a][:, None]).sum() / np.sqrt(weight[a].sum() * weight[b].sum())
    n = len(similarity)
    left, right = np.empty(n), np.empty(n)
    peak = -1.0
    for j in range(n):  # climb from the gap as long as the similarity rises
        peak = similarity[j] if j == 0 or similarity[j - 1] < similarity[j] else max(peak, similarity[j])
        left[j] = peak
    peak = -1.0
    for j in range(n - 1, -1, -1):
        peak = similarity[j] if j == n - 1 or similarity[j + 1] < similarity[j] else max(peak, similarity[j])
        right[j] = peak
    return (left - similarity) + (right - similarity)


def cuts(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece. Every piece has at most ``max_size`` characters; a piece after the first begins
    ``overlap`` characters before the end of the one before."""
    n = len(text)
    if n <= max_size:
        return [(0, n)]
    overlap = max(0, min(overlap, max_size // 2 - 1)) if max_size > 3 else 0
    gaps, strength = gaps_of(text)
    depth = cohesion_depths(text, gaps)
    pieces, start = [], 0
    while n - start > max_size:
        low, high = start + max(max_size // 2, overlap + 1), start + max_size
        a, b = np.searchsorted(gaps, [low, high + 1])
        if a == b:  # no pause in the window: a wider window, then a hard cut
            a = np.searchsorted(gaps, start + overlap + 1)
        end = high
        if a < b:
            window = strength[a:b]
            kind = max(2, int(window.min()))  # paragraphs, lines and sentences compete by depth
            among = np.flatnonzero(window <= kind) + a
            d = depth[among]
            end = int(gaps[among[np.flatnonzero(d >= d.max() - 1e-12)[-1]]])
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def latest_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row for each chunk_id: the latest ``metadata['ingested_at']``, of these the longest text, then the greatest of
    the other columns in their order, the last being the text. Aggregated before the shuffle."""
    age = F.coalesce(F.col("metadata")["ingested_at"], F.lit(""))
    rest = F.struct(*[F.col(c) for c in columns])
    return chunks.groupBy("chunk_id").agg(F.max(F.struct(age.alias("age"), F.coalesce("n", F.lit(-1)).alias("n"), rest.alias("rest"))).alias("kept")).select("chunk_id", "kept.n", "kept.rest.*")


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``max_size`` and ``overlap`` by content type, read without regard to case and blanks; null means mixed.
    ``limits`` is small and fixed; Spark broadcasts it only if it is."""
    kind = F.coalesce(F.lower(F.trim("content_type")), F.lit("mixed"))
    sizes = limits.where("lower(trim(unit)) = 'characters'").groupBy(F.lower(F.trim("content_type")).alias("kind")).agg(F.min("max_size").alias("max_size"), F.min_by("overlap", "max_size").alias("overlap"))
    return chunks.withColumn("kind", kind).join(sizes, "kind", "left").drop("kind")


PIECES = "chunk_id string, document_id string, piece_no int, text string, start_pos int, end_pos int, token_start int, token_end int, oversized boolean"


def split_oversized(chunks: DataFrame, limits: DataFrame, only_oversized: bool = False) -> DataFrame:
    """Pieces of every chunk, numbered from 0 within the chunk.

    ``start_pos`` and ``end_pos`` count code points from the chunk's own start_pos, ``token_start`` and
    ``token_end`` whitespace-separated tokens from its token_start; null or negative positions count as 0. A token
    that is cut belongs to both pieces. A chunk within its limit, or of a type without a limit, is one piece; null
    and empty texts give one piece with that text. Rows delivered repeatedly count once, the latest wins; other
    columns, whatever their names, are not read. Pieces are cut in the task that holds the row: one aggregation by
    chunk_id, combined before the shuffle, is the only exchange.
    """
    fields = ["document_id", "text", "start_pos", "token_start", "content_type"]
    rows = with_limits(chunks.select("chunk_id", "metadata", *fields), limits)
    rows = rows.withColumn("n", F.length("text"))
    long = F.col("n") > F.col("max_size")
    if only_oversized:  # the latest row decides, so the others go along, but without their texts
        rows = rows.withColumn("text", F.when(long, F.col("text")))
    rows = latest_chunks(rows, "document_id", "start_pos", "token_start", "max_size", "overlap", "text")
    if only_oversized:
        rows = rows.where(long)
    rows = rows.select("chunk_id", "document_id", "text", "start_pos", "token_start", "max_size", "overlap")

    def run(frames):
        for frame in frames:
            out = []
            for chunk, document, text, start, token, size, overlap in frame.itertuples(index=False, name=None):
                start, token = int(start) if start == start and start and start > 0 else 0, int(token) if token == token and token and token > 0 else 0
                if not isinstance(text, str) or size != size or size is None or len(text) <= size:
                    text = text if isinstance(text, str) else None
                    n = len(text) if text else 0
                    out.append((chunk, document, 0, text, start, start + n, token, token + (len(text.split()) if text else 0), False))
                    continue
                seen, counted = 0, 0  # whitespace tokens before position `seen`
                for number, (a, b) in enumerate(cuts(text, int(size), int(overlap) if overlap == overlap and overlap else 0)):
                    counted += tokens_begun(text, seen, a)
                    seen = a
                    first = counted - (1 if a and not text[a - 1].isspace() and not text[a].isspace() else 0)
                    out.append((chunk, document, number, text[a:b], start + a, start + b, token + first, token + first + len(text[a:b].split()), True))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInPandas(run, PIECES)


def tokens_begun(text: str, a: int, b: int) -> int:
    """How many whitespace-separated tokens begin in text[a:b]."""
    inside = len(text[a:b].split())
    return inside - (1 if inside and a and not text[a - 1].isspace() and not text[a].isspace() else 0)
