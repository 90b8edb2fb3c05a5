"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton's states are the tokens that may be emitted last (and a start state); its arcs are labelled with
tokens. It accepts exactly one path for each byte string: the one that byte-pair merging produces. Merges enter it
one after the other as gadgets: the gadget of a merge (u, v) -> w removes every arc on which, at the time of w, a
u would stand directly before a v. Whether an arc (a, b) survives depends only on the right edge of a and the left
edge of b, so an arc is settled by running over both edges, and the result is kept in the transition table.
A byte trie over the tokens drives the reading; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

FOREVER = 1 << 60
MEMO_WORDS = 400_000


class TokenAutomaton:
    """``ranks``: token bytes -> id, lower ids merged first. ``pattern``: how text is pre-split into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.label = {i: b for b, i in ranks.items()}
        self.split_words = regex.compile(pattern).findall
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for word, token in ranks.items():
            node = 0
            for byte in word:
                step = self.trie[node].get(byte)
                if step is None:
                    step = len(self.trie)
                    self.trie[node][byte] = step
                    self.trie.append({})
                    self.ends.append(-1)
                node = step
            self.ends[node] = token
        self.arcs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.left_edges: dict[int, list[tuple[int, int]]] = {}
        self.right_edges: dict[int, list[tuple[int, int]]] = {}
        self.memo: dict[str, list[int]] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token in self.halves:
            return self.halves[token]
        word, found = self.label[token], None
        for at in range(1, len(word)):
            a, b = self.ranks.get(word[:at]), self.ranks.get(word[at:])
            if a is not None and b is not None and (a < token or at == 1) and (b < token or len(word) - at == 1):
                if self._survives(a, b, token):
                    found = (a, b)
                    break
        self.halves[token] = found
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is merged, each with the time it is used up."""
        kept = self.left_edges if side == 0 else self.right_edges
        if token not in kept:
            edge, now, until = [], token, FOREVER
            while True:
                edge.append((now, until))
                halves = self.parts(now)
                if halves is None:
                    break
                until, now = now, halves[side]
            kept[token] = edge
        return kept[token]

    def _survives(self, a: int, b: int, before: int) -> bool:
        """No gadget of a merge earlier than ``before`` joins the right edge of a with the left edge of b."""
        rights, lefts = self._edge(a, 1), self._edge(b, 0)
        for u, u_until in rights:
            for v, v_until in lefts:
                w = self.ranks.get(self.label[u] + self.label[v])
                # Equal merges run from left to right: one inside a comes first, one inside b comes later.
                if w is not None and w < before and w < u_until and w <= v_until:
                    return False
        return True

    def arc(self, a: int, b: int) -> bool:
        known = self.arcs.get((a, b))
        if known is None:
            known = self.arcs[a, b] = self._survives(a, b, FOREVER)
        return known

    def read(self, word: bytes) -> list[int]:
        """The accepted path over ``word``: for each prefix, the one token that can end it."""
        whole = self.ranks.get(word)
        if whole is not None and self.spells(whole):
            return [whole]
        n = len(word)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        trie, ends, arc = self.trie, self.ends, self.arcs
        for start in range(n):
            before = last[start]
            node = 0
            for i in range(start, n):
                node = trie[node].get(word[i], -1)
                if node < 0:
                    break
                token = ends[node]
                if token >= 0 and last[i + 1] < 0:
                    if start:
                        ok = arc.get((before, token))
                        if ok is None:
                            ok = self.arc(before, token)
                    else:
                        ok = self.spells(token)
                    if ok:
                        last[i + 1], came[i + 1] = token, start
        path, at = [], n
        while at:
            path.append(last[at])
            at = came[at]
        return path[::-1]

    def spells(self, token: int) -> bool:
        """The token is what its own bytes are merged into."""
        return len(self.label[token]) == 1 or self.parts(token) is not None

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; the empty list for empty and for null texts. Marker-like strings are ordinary text."""
        return list(chain.from_iterable(self.paths(text))) if text else []

    def paths(self, text: str) -> list[list[int]]:
        memo = self.memo
        words = self.split_words(text)
        try:
            return [memo[w] for w in words]
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.read(w.encode("utf-8"))
        return [memo[w] for w in words]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def automaton(path: str, pattern: str) -> TokenAutomaton:
    """One automaton for each Python process and vocabulary file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TokenAutomaton(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col, ids array<int>`` of every row. Null and empty texts give an empty list; repeated rows are encoded
    as often as they come; other columns are not read. One narrow stage, no shuffle."""
    path, words = vocabulary or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches):
        encoder = automaton(path, words)
        for batch in batches:
            flat, lengths = [], []
            for text in batch.column(1).to_pylist():
                before = len(flat)
                if text:
                    flat.extend(chain.from_iterable(encoder.paths(text)))
                lengths.append(len(flat) - before)
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col, n_tokens`` of every row; 0 for null and empty texts."""
    path, words = vocabulary or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches):
        encoder = automaton(path, words)
        for batch in batches:
            sizes = [sum(map(len, encoder.paths(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("id", id_col)
