"""Near-duplicate records by multi-index hashing.

The fingerprint of a text has 64 symbols: its five-character substrings, each with its number of occurrence, are
hashed into 64 bins and the least hash of a bin is its symbol, so that two symbols agree with the probability of the
multiset Jaccard similarity. The fingerprint is cut into segments. For each segment the Hamming ball of radius one
is enumerated: two segments differ in at most one symbol exactly if they agree after one and the same position is
left out, so each table is keyed by a segment without one position. Rows that meet in any table are compared over
their whole fingerprints; what passes is verified on the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.plans.lineage import cut

GRAM, SYMBOLS, SEGMENTS, WIDTH = 5, 64, 10, 6
MIN_CHARS, SIMILARITY = 200, 0.7
#: Of 64 two-bit symbols, a pair at the threshold differs in 14.4 on average; this is 3.8 deviations above it.
MOST_SYMBOLS = 27
#: With four bits of each symbol 18 differ on average; this is 3.3 deviations above it.
MOST_COMPLETE = 30
PLANES = ("plane_0", "plane_1", "plane_2", "plane_3")
GRAMS_AT_ONCE = 1_500_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def normal(text: str) -> str:
    """Lower case, each run of whitespace one space, stripped."""
    return " ".join(text.lower().split())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def gram_keys(texts: list[str], owner: np.ndarray | None = None) -> np.ndarray:
    """Sorted keys (owner in the upper 20 bits, 44 bits of hash) of all five-character substrings. ``owner`` numbers
    the texts; by default each is its own."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * MIX[0] + codes[i : i + n] + np.uint64(1)
    at = np.repeat(np.arange(len(texts)), lengths)[:n]
    left = np.cumsum(lengths)[at] - np.arange(n)  # characters from here to the end of the text
    keep = left >= GRAM
    who = at[keep] if owner is None else owner[at[keep]]
    return np.sort((who.astype(np.uint64) << np.uint64(44)) | (mixed(h[keep]) >> np.uint64(20)))


def occurrence(keys: np.ndarray) -> np.ndarray:
    """0 for the first of equal sorted keys, 1 for the second and so on."""
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    place = np.arange(len(keys))
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return place - np.maximum.accumulate(np.where(first, place, 0))


def fingerprints(texts: list[str]) -> np.ndarray:
    """uint16 symbols, one row of 64 for each text."""
    keys = gram_keys(texts)
    symbols = np.zeros((len(texts), SYMBOLS), np.uint16)
    if len(keys) == 0:
        return symbols
    doc = keys >> np.uint64(44)
    h = mixed((keys & np.uint64((1 << 44) - 1)) + occurrence(keys).astype(np.uint64) * MIX[0])
    key = np.sort((doc << np.uint64(44)) | (h >> np.uint64(20)))  # doc, then 6 bits of bin, then 38 of value
    cell = key >> np.uint64(38)
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    value = mixed(key[first] & np.uint64((1 << 38) - 1)) >> np.uint64(48)
    where = cell[first]
    symbols[(where >> np.uint64(6)).astype(np.int64), (where & np.uint64(63)).astype(np.int64)] = value
    return symbols


def similarities(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Multiset Jaccard similarity of the substrings of two normalised texts."""
    coded, n = [], []
    for side in (0, 1):
        keys = gram_keys([p[side] for p in pairs])
        owner = keys >> np.uint64(44)
        n.append(np.bincount(owner.astype(np.int64), minlength=len(pairs)))
        coded.append((owner << np.uint64(44)) | (mixed(keys + occurrence(keys).astype(np.uint64) * MIX[0]) >> np.uint64(20)))
    keys = np.sort(np.concatenate(coded))  # a substring and its number is once in a text, so equal keys are shared
    shared = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)).astype(np.int64), minlength=len(pairs))
    union = n[0] + n[1] - shared
    same = np.array([a == b for a, b in pairs], bool)
    return np.where(union > 0, shared / np.maximum(union, 1), same * 1.0)


def groups_of_grams(texts: list[str], sizes: list[int]):
    """Slices whose substrings are counted together; a longer text is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > GRAMS_AT_ONCE:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def sketches(rows: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``id, copy (md5 of the normalised text), n (substrings), plane_0 to plane_3 (four bits of each symbol),
    symbols`` of the rows that are long enough."""

    def run(batches):
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            sizes = [max(0, len(t) - GRAM + 1) for t in texts]
            rows = []
            for a, b in groups_of_grams(texts, sizes):
                rows.append(fingerprints(texts[a:b]))
            symbols = np.concatenate(rows) if rows else np.zeros((0, SYMBOLS), np.uint16)
            planes = [pa.array(np.packbits(((symbols >> i) & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64).ravel()) for i in range(4)]
            packed = symbols[:, : SEGMENTS * WIDTH].astype(">u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array(sizes, pa.int32()), *planes, pa.array([r.tobytes() for r in packed], pa.binary())],
                names=["id", "copy", "n", *PLANES, "symbols"],
            )

    long_enough = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    return long_enough.mapInArrow(run, "id string, copy binary, n int, " + ", ".join(f"{p} bigint" for p in PLANES) + ", symbols binary")


def ball_keys() -> F.Column:
    """The keys of all tables: each segment without each of its positions, hashed together with both numbers."""

    def key(i):
        segment, out = F.floor(i / WIDTH), i % WIDTH
        start, left_out = (segment * (2 * WIDTH) + 1).cast("int"), (out * 2).cast("int")
        return F.xxhash64(i, F.col("symbols").substr(start, left_out), F.col("symbols").substr(start + left_out + 2, F.lit(2 * WIDTH - 2) - left_out))

    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS * WIDTH - 1)), key))


def class_links(sketched: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes of exact copies (``copy, class_id, members``) and the links between their representatives
    (``class_a < class_b, similarity``). ``texts``: ``id, text``."""
    k = F.conv(F.hex(F.substring("copy", 1, 8)), 16, -10).cast("bigint").alias("k")
    classes = cut(sketched.groupBy("copy").agg(F.min("id").alias("class_id"), F.first(F.struct("n", *PLANES, "symbols")).alias("s")).select("copy", k, "class_id", "s.*"))
    table = classes.select(ball_keys().alias("key"), "k", *PLANES[:2])
    a, b = table.alias("a"), table.alias("b")

    def differing(x: str, y: str, planes: tuple[str, ...]):
        out = F.lit(0).cast("bigint")
        for p in planes:
            out = out.bitwiseOR(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}")))
        return F.bit_count(out)

    met = a.join(b, F.col("a.key") == F.col("b.key")).where("a.k < b.k").where(differing("a.", "b.", PLANES[:2]) <= MOST_SYMBOLS).select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb")).distinct()
    side = lambda s: classes.select(*[F.col(c).alias(c + s) for c in ("k", "class_id", "n", *PLANES)])
    complete = differing("xx_", "yy_", PLANES)
    xs, ys = side("a"), side("b")
    for c in PLANES:
        xs, ys = xs.withColumnRenamed(c + "a", "xx_" + c), ys.withColumnRenamed(c + "b", "yy_" + c)
    near = met.join(xs, "ka").join(ys, "kb").where(complete <= MOST_COMPLETE).where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    pairs = near.select(F.least("class_ida", "class_idb").alias("class_a"), F.greatest("class_ida", "class_idb").alias("class_b"))
    pairs = cut(pairs)
    involved = pairs.select(F.col("class_a").alias("id")).union(pairs.select(F.col("class_b").alias("id"))).distinct()
    read = texts.join(involved, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    read = cut(read)
    both = pairs.join(read.select(F.col("id").alias("class_a"), F.col("text").alias("text_a")), "class_a").join(read.select(F.col("id").alias("class_b"), F.col("text").alias("text_b")), "class_b")

    def verify(batches):
        for batch in batches:
            ids_a, ids_b, ta, tb = (c.to_pylist() for c in batch.columns)
            ta, tb = [normal(t) for t in ta], [normal(t) for t in tb]
            keep, value = [], []
            for start, end in groups_of_grams(ta, [len(x) + len(y) for x, y in zip(ta, tb)]):
                s = similarities(list(zip(ta[start:end], tb[start:end])))
                for i in np.flatnonzero(s >= threshold - 1e-12).tolist():
                    keep.append(start + i)
                    value.append(float(s[i]))
            yield pa.RecordBatch.from_arrays([pa.array([ids_a[i] for i in keep], pa.string()), pa.array([ids_b[i] for i in keep], pa.string()), pa.array(value, pa.float64())], names=["class_a", "class_b", "similarity"])

    links = both.select("class_a", "class_b", "text_a", "text_b").mapInArrow(verify, "class_a string, class_b string, similarity double")
    members = sketched.select("copy", "id").distinct().join(classes.select("copy", "class_id"), "copy").select("class_id", "id")
    return cut(members), cut(links)


def near_copies(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text", min_chars: int = MIN_CHARS, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members has ``class_id, id`` of every row of at least ``min_chars`` code points, where a
    class holds the rows of one normalised text and is named by its least id; links has ``class_a, class_b,
    similarity`` for every two classes of at least ``threshold``.

    Null and shorter texts, and rows without an id, take no part. A row delivered repeatedly counts once. Copies
    are never paired with each other, so a text that a third of all rows repeat costs one row each. The tables are
    joined by key; the join is left to adaptive execution, which splits keys that many texts share. Other columns
    are not read.
    """
    sketched = cut(sketches(rows, id_col, text_col, min_chars))
    texts = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= min_chars)
    return class_links(sketched, texts, threshold)


def pairs_of_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """``chunk_id_a < chunk_id_b``: every two rows that are linked or copies of one text."""
    m = members.withColumnRenamed("id", "member")
    across = links.join(m.select(F.col("class_id").alias("class_a"), F.col("member").alias("x")), "class_a").join(m.select(F.col("class_id").alias("class_b"), F.col("member").alias("y")), "class_b")
    repeated = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("class_id")
    again = m.join(repeated, "class_id")
    within = again.select("class_id", F.col("member").alias("x")).join(again.select("class_id", F.col("member").alias("y")), "class_id").where("x < y")
    every = across.select("x", "y").union(within.select("x", "y"))
    return every.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def rows_with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, class_id, copies, links``: one line for each row, with the number of its copies and of linked classes."""
    degree = links.select(F.col("class_a").alias("class_id")).union(links.select(F.col("class_b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("copies"))
    return members.join(sizes.join(degree, "class_id", "left"), "class_id").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
