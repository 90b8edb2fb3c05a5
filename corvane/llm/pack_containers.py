"""Filling fixed-capacity containers by Karmarkar-Karp multiway differencing.

A partial partition is a row of k windows. Differencing takes the two partial partitions whose windows differ most
and adds them with opposing imbalances, the fullest window of one to the emptiest of the other, until one is left:
k windows of nearly equal sums. While one of them exceeds the capacity, the number of windows rises.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corvane.llm.bpe_automaton import count_tokens

CAPACITY = 2048
ITEMS_PER_BLOCK = 600


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and the sum of each window, for ``k`` windows; sizes in any order."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    if k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    order = np.argsort(-sizes, kind="stable")
    lefts, rights, made = [], [], n
    heap, rows = [], {}
    for rank, i in enumerate(order):
        # A window is a node of a merge tree: an item, -1 for nothing, or a number of two joined nodes.
        heap.append((-int(sizes[i]), rank))
        rows[rank] = (np.array([sizes[i]], np.int64), np.array([i], np.int64))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = rows.pop(a), rows.pop(b)
        if len(sa) + len(sb) <= k:  # only the windows in use are kept; the others are empty
            s, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:
            free = k - len(sa)
            s, nodes = np.concatenate([sa, sb[:free]]), np.concatenate([na, nb[:free]])
            rest_s, rest_n = sb[free:], nb[free:]
            m = len(rest_s)
            # sa ends with its emptiest window; they meet the fullest of what is left of b.
            if free == 0:
                at = np.arange(k - 1, k - 1 - m, -1)
            else:
                at = np.arange(len(sa) - 1, len(sa) - 1 - m, -1)
            lefts.append(nodes[at].copy())
            rights.append(rest_n)
            s[at] += rest_s
            nodes[at] = made + np.arange(m)
            made += m
        back = np.argsort(-s, kind="stable")
        s, nodes = s[back], nodes[back]
        low = int(s[-1]) if len(s) == k else 0
        rows[serial] = (s, nodes)
        heapq.heappush(heap, (low - int(s[0]), serial))
        serial += 1
    s, nodes = rows[heap[0][1]]
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    window = np.full(made, -1, np.int64)
    window[nodes] = np.arange(len(nodes))
    for j in range(len(left) - 1, -1, -1):
        window[left[j]] = window[right[j]] = window[n + j]
    sums = np.zeros(k, np.int64)
    sums[: len(s)] = s
    return window[:n], sums


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item so that none exceeds the capacity. No size may be over it."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    low, step = k - 1, 1
    window, sums = difference(sizes, k)
    while sums.max(initial=0) > capacity:  # rise in growing steps, then go back to the least that is enough
        low, k = k, k + step
        step *= 2
        window, sums = difference(sizes, k)
    while k - low > 1:
        mid = (low + k) // 2
        w, s = difference(sizes, mid)
        if s.max(initial=0) > capacity:
            low = mid
        else:
            k, window = mid, w
    return window


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", items_per_block: int = ITEMS_PER_BLOCK, blocks_per_partition: int = 10, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``container_id, <id_col>, piece_no, token_start, n_tokens``: where each document's tokens go.

    A document of at most ``capacity`` tokens is never cut; a larger one gives pieces of exactly ``capacity`` tokens,
    each a container of its own, and one remainder that is packed like a document. Null and empty texts take no
    space: one row with n_tokens 0 and a null container_id. Repeated rows are items of their own; ties in size are
    broken by id. Packing runs in blocks of ``items_per_block`` items that are formed while streaming through hash
    partitions, so no key and no group is ever collected and the cost is linear in the number of documents.
    """
    sized = count_tokens(docs, id_col, text_col, vocabulary, pattern).withColumnRenamed(id_col, "id")
    partitions = max(1, -(-docs.count() // (items_per_block * blocks_per_partition)))
    cap = F.lit(capacity)
    pieces = sized.select(
        "id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / cap) - 1).cast("int")),
                lambda p: F.struct(p.alias("piece_no"), (p * cap).cast("bigint").alias("token_start"), F.least(F.col("n_tokens") - p * cap, cap).cast("bigint").alias("n_tokens")),
            )
        ).alias("p"),
    ).select("id", "p.*")
    mixed = pieces.withColumn("order", F.xxhash64("id", "piece_no")).repartition(partitions, "order", "n_tokens").sortWithinPartitions("order", "id", "piece_no", "n_tokens")

    def place(block: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        sizes = block["n_tokens"].to_numpy()
        container = np.full(len(block), -1, np.int64)
        whole = sizes == capacity
        container[whole] = first + np.arange(whole.sum())
        first += int(whole.sum())
        loose = (sizes > 0) & ~whole
        if loose.any():
            window = np.unique(fill(sizes[loose], capacity), return_inverse=True)[1]
            container[loose] = first + window
            first += int(window.max()) + 1
        out = block[["id", "piece_no", "token_start", "n_tokens"]].copy()
        out.insert(0, "container_id", pd.array(np.where(container < 0, 0, container), dtype="Int64"))
        out.loc[container < 0, "container_id"] = pd.NA
        return out, first

    def run(frames):
        from pyspark import TaskContext

        context = TaskContext.get()
        first, rest = (context.partitionId() if context else 0) << 32, None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) >= 2 * items_per_block:
                done, first = place(rest.iloc[:items_per_block], first)
                rest = rest.iloc[items_per_block:]
                yield done
        if rest is not None and len(rest):
            yield place(rest, first)[0]

    kind = docs.schema[id_col].dataType.simpleString()
    return mixed.mapInPandas(run, f"container_id bigint, id {kind}, piece_no int, token_start bigint, n_tokens bigint").withColumnRenamed("id", id_col)
