"""Nearest vectors of every vector: inverted file, product-quantised residuals, exact reranking.

A coarse quantiser with one centroid for each list and codebooks for the residuals are trained on a bounded sample.
Lists are grouped into cells of neighbouring lists; a vector is indexed in its list, and a query goes once to each
cell that holds one of its nearest lists. In a cell, asymmetric distance tables rank the members of the probed lists
by their codes, and the best are ranked again by their exact cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.plans.lineage import cut

DIM, K = 64, 10
LIST_SIZE, MAX_LISTS, LISTS_IN_CELL = 200, 4096, 24
#: Lists searched for a query, and members of one list and of one cell that are ranked exactly.
PROBES, FROM_LIST, RERANKED = 8, 64, 200
SUBSPACES, CODES = 32, 16
#: The centroids are fitted on at most so many vectors, the codebooks on so many of them, drawn at random.
TRAINING, FITTED = 40_000, 20_000
ROWS_IN_BLOCK, QUERIES_AT_ONCE = 40_000, 1024


def usable(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", time_col: str = "created_at", dim: int = DIM) -> DataFrame:
    """``id, v``: one row for each id, its latest usable vector. Null, non-finite and constant vectors and those of
    another width do not take part."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v"), F.col(time_col).alias("t")).where(
        F.col("id").isNotNull() & x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.array_min(x) != F.array_max(x))
    )
    last = rows.groupBy("id").agg(F.max(F.struct("t", "v")).alias("kept"))
    return cut(last.select("id", "kept.v"))


def far_copies(rows: DataFrame, k: int) -> DataFrame:
    """``id, like`` of rows whose vector more than k lesser ids have. Nobody has them among the k nearest, and their own
    neighbours are those of ``like``, the (k + 1)-th id with their vector."""
    h = rows.select("id", F.xxhash64("v").alias("h"))
    crowd = h.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h")
    crowded = h.join(crowd, "h", "left_semi")
    least = crowded.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
    last = least.groupBy("h").agg(F.max("id").alias("like"))
    return crowded.join(last, "h").where(F.col("id") > F.col("like")).select("id", "like")


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """k-means; an empty cluster takes a far point."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].astype(np.float32).copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        total = np.zeros((k, x.shape[1]), np.float64)
        order = np.argsort(near, kind="stable")
        filled, start = np.unique(near[order], return_index=True)
        total[filled] = np.add.reduceat(x[order].astype(np.float64), start, axis=0)
        count = np.bincount(near, minlength=k)
        centres[count > 0] = (total[count > 0] / count[count > 0, None]).astype(np.float32)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the squared distance to it (less the row's own square)."""
    half = (centres.astype(np.float64) ** 2).sum(1).astype(np.float32)
    near, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for a in range(0, len(x), 4096):
        d = half - 2 * (x[a : a + 4096] @ centres.T)
        near[a : a + 4096] = d.argmin(1)
        far[a : a + 4096] = d.min(1)
    return near, far


class Index:
    """What is trained: list centroids, the cell of each list, residual codebooks, and blocks for crowded cells."""

    def __init__(self, sample: np.ndarray, total: int):
        lists = int(min(MAX_LISTS, max(1, total // LIST_SIZE), max(1, len(sample) // 8)))
        self.centroids = lloyd(sample, lists, 8)
        cells = max(1, lists // LISTS_IN_CELL)
        cell_centres = lloyd(self.centroids, cells, 10, seed=11)
        self.cell = nearest(self.centroids, cell_centres)[0].astype(np.int32)
        near, _ = nearest(sample, self.centroids)
        residual = sample - self.centroids[near]
        width = sample.shape[1] // SUBSPACES
        residual = residual[np.random.default_rng(5).permutation(len(residual))[:FITTED]]
        self.books = np.stack([lloyd(residual[:, m * width : (m + 1) * width], min(CODES, len(residual)), 6, seed=m) for m in range(SUBSPACES)])
        rows = np.bincount(self.cell[near], minlength=cells) * (total / max(1, len(sample)))
        self.blocks = np.maximum(1, np.ceil(rows / ROWS_IN_BLOCK)).astype(np.int64)

    def codes(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        residual, width = x - self.centroids[near], x.shape[1] // SUBSPACES
        return np.stack([nearest(residual[:, m * width : (m + 1) * width], self.books[m])[0] for m in range(SUBSPACES)], 1).astype(np.uint8)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, DIM))
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)) if n else x


def train(rows: DataFrame, total: int) -> Index:
    """Fit on at most about TRAINING rows, chosen by hash of the id."""
    share = min(1.0, TRAINING / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v").toArrow().sort_by("id")
    return Index(matrix(sample.column("v")).astype(np.float32), total)


def search_cell(index: Index, members: pa.Table, queries: pa.Table, k: int, least: float) -> pa.Table:
    """The k nearest members of the probed lists of this cell for each query."""
    x, q = matrix(members.column("v")), matrix(queries.column("v"))
    ids, query_ids = np.array(members.column("id").to_pylist(), object), np.array(queries.column("id").to_pylist(), object)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(x) and len(q):
        x32, q32 = x.astype(np.float32), q.astype(np.float32)
        home = nearest(x32, index.centroids)[0]
        codes = index.codes(x32, home)
        codes = codes[:, 0::2] * CODES + codes[:, 1::2]  # two subspaces share a table of all their pairs
        by_list = np.argsort(home, kind="stable")
        names, starts = np.unique(home[by_list], return_index=True)
        inside = dict(zip(names.tolist(), np.split(by_list, starts[1:])))
        probes = queries.column("lists").to_pylist()
        for a in range(0, len(q), QUERIES_AT_ONCE):
            found += search_block(index, x, x32, codes, inside, q, q32, probes, a, least)
    out_q, out_n, out_c = [], [], []
    if found:
        bq, bm, bc = (np.concatenate(c) for c in zip(*found))
        differs = ids[bm] != query_ids[bq]
        bq, bm, bc = bq[differs], bm[differs], bc[differs]
        rank_of_id = np.empty(len(ids), np.int64)
        rank_of_id[np.argsort(ids)] = np.arange(len(ids))
        order = np.lexsort((rank_of_id[bm], -np.round(bc, 12), bq))
        bq, bm, bc = bq[order], bm[order], bc[order]
        start = np.flatnonzero(np.concatenate([[True], bq[1:] != bq[:-1]])) if len(bq) else np.zeros(0, np.int64)
        place = np.arange(len(bq)) - np.repeat(start, np.diff(np.append(start, len(bq))))
        keep = place < k
        out_q, out_n, out_c = query_ids[bq[keep]].tolist(), ids[bm[keep]].tolist(), bc[keep].tolist()
    return pa.table({"id": pa.array(out_q, pa.string()), "neighbour": pa.array(out_n, pa.string()), "cosine": pa.array(out_c, pa.float64())})


def search_block(index: Index, x: np.ndarray, x32: np.ndarray, codes: np.ndarray, inside: dict[int, np.ndarray], q: np.ndarray, q32: np.ndarray, probes: list[list[int]], first: int, least: float) -> list[tuple]:
    """Asymmetric distances of one block of queries to the members of their lists, then exact cosines of the best."""
    part = q32[first : first + QUERIES_AT_ONCE]
    n, width = len(part), part.shape[1] // SUBSPACES
    halves = np.zeros((SUBSPACES, n, CODES), np.float32)  # few training vectors make fewer codewords
    for m in range(SUBSPACES):
        halves[m, :, : len(index.books[m])] = part[:, m * width : (m + 1) * width] @ index.books[m].T
    tables = [(halves[m][:, :, None] + halves[m + 1][:, None, :]).reshape(n, -1) for m in range(0, SUBSPACES, 2)]
    rows = probes[first : first + n]
    own = np.repeat(np.arange(n), [len(r) for r in rows])
    place = np.concatenate([np.arange(len(r)) for r in rows]) if len(own) else own
    lists = np.array([i for r in rows for i in r], np.int64)
    best = np.full((n, max((len(r) for r in rows), default=0), FROM_LIST), -np.inf, np.float32)
    which = np.full(best.shape, -1, np.int32)
    order = np.argsort(lists, kind="stable")
    cuts = np.flatnonzero(np.diff(lists[order])) + 1
    for pairs in np.split(order, cuts) if len(order) else []:
        members = inside.get(int(lists[pairs[0]]))
        if members is None:
            continue
        mine, at = own[pairs], place[pairs]
        score = np.repeat((part[mine] @ index.centroids[lists[pairs[0]]])[:, None], len(members), 1)
        for m, table in enumerate(tables):
            score += np.take(table[mine], codes[members, m], axis=1)
        r = min(FROM_LIST, len(members))
        top = np.argpartition(-score, r - 1, axis=1)[:, :r]
        best[mine, at, :r] = np.take_along_axis(score, top, 1)
        which[mine, at, :r] = members[top]
    best, which = best.reshape(n, -1), which.reshape(n, -1)
    if best.shape[1] > RERANKED:
        top = np.argpartition(-best, RERANKED - 1, axis=1)[:, :RERANKED]
        which = np.take_along_axis(which, top, 1)
    at, slot = np.nonzero(which >= 0)
    m = which[at, slot]
    out = []
    for a in range(0, len(at), 200_000):
        qs, ms = at[a : a + 200_000], m[a : a + 200_000]
        near = np.einsum("nd,nd->n", part[qs], x32[ms]) >= least - 1e-5  # single precision first
        qs, ms = qs[near] + first, ms[near]
        exact = np.einsum("nd,nd->n", q[qs], x[ms])
        keep = exact >= least - 1e-12
        out.append((qs[keep], ms[keep], exact[keep]))
    return out


def neighbours(rows: DataFrame, queries: DataFrame | None = None, k: int = K, least_cosine: float = -1.0, probes: int = PROBES) -> DataFrame:
    """``id, neighbour, cosine, rank``: the k most similar other rows of every query, of at least ``least_cosine``.

    ``rows`` and ``queries`` have ``id, v`` (see ``usable``); without ``queries`` every row is one. Ties are broken by
    the lesser id. Every row is indexed; of rows with one vector, the k + 1 least ids are, as no other can be among
    the k nearest, and the others get the neighbours of the last of these. Only the trained index is shipped: at most 4,096 centroids and 32 x 16 codewords. A cell that
    the sample shows to be crowded is split into blocks of rows and of queries.
    """
    total = rows.count()
    if total == 0:
        return rows.sparkSession.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    far = cut(far_copies(rows, k))
    copied = not far.isEmpty()
    indexed = rows.join(far.select("id"), "id", "left_anti") if copied else rows
    asked = indexed if queries is None else queries
    if copied and queries is not None:
        far = far.join(queries.select("id"), "id", "left_semi")
        asked = queries.join(far.select("id"), "id", "left_anti").select("id", "v")
        asked = asked.union(indexed.join(far.select(F.col("like").alias("id")), "id", "left_semi").join(queries.select("id"), "id", "left_anti").select("id", "v"))
    index = train(rows, total)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def place(batches):
        index = shared.value
        for batch in batches:
            near = nearest(matrix(batch.column(1)).astype(np.float32), index.centroids)[0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index.cell[near].astype(np.int32)), pa.array(index.blocks[index.cell[near]].astype(np.int32))], names=["id", "v", "cell", "blocks"])

    def route(batches):
        index = shared.value
        half = (index.centroids.astype(np.float64) ** 2).sum(1).astype(np.float32)
        p = min(probes, len(index.centroids))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1)).astype(np.float32)
            own, cells, lists = [], [], []
            for a in range(0, len(x), 2048):
                near = np.argpartition(half - 2 * (x[a : a + 2048] @ index.centroids.T), p - 1, axis=1)[:, :p].astype(np.int32)
                for i, row in enumerate(near):
                    cell = index.cell[row]
                    for c in np.unique(cell):
                        own.append(a + i)
                        cells.append(c)
                        lists.append(row[cell == c])
            taken = batch.take(pa.array(own))
            lists = pa.array([r.tolist() for r in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cells, pa.int32()), pa.array(index.blocks[cells].astype(np.int32)), lists], names=["id", "v", "cell", "blocks", "lists"])

    # In a crowded cell, row block i meets query block j for all i and j.
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = indexed.select("id", "v").mapInArrow(place, "id string, v array<float>, cell int, blocks int").select("id", "v", "cell", block.alias("i"), every.alias("j"))
    sent = asked.select("id", "v").mapInArrow(route, "id string, v array<float>, cell int, blocks int, lists array<int>").select("id", "v", "lists", "cell", every.alias("i"), block.alias("j"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return search_cell(shared.value, left, right, k, least_cosine)

    found = members.groupBy("cell", "i", "j").cogroup(sent.groupBy("cell", "i", "j")).applyInArrow(search, "id string, neighbour string, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "neighbour"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    if not copied:
        return ranked
    of_far = far.join(ranked.withColumnRenamed("id", "like"), "like").select("id", "neighbour", "cosine", "rank")
    own = ranked if queries is None else ranked.join(queries.select("id"), "id", "left_semi").select(*ranked.columns)
    return own.select("id", "neighbour", "cosine", "rank").union(of_far)


def mutual_pairs(found: DataFrame, least_cosine: float) -> DataFrame:
    """``chunk_id_a < chunk_id_b``: two rows of at least ``least_cosine``, each among the other's nearest."""
    close = found.where(F.col("cosine") >= least_cosine).select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b"))
    return close.groupBy("chunk_id_a", "chunk_id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("chunk_id_a", "chunk_id_b")
