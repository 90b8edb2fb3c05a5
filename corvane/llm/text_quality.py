"""Quality statistics of documents, with lines labelled prose, list, table or junk by a hidden Markov model.

Each line is observed by a few coarse statistics. A labelled sample of documents gives the first emission and
transition counts; labelling the sample's lines with the model and counting again refines them. Viterbi decoding
labels every line of a document, and the labels' shares of its characters tell what the document is.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.plans.lineage import cut

KINDS = ("prose", "list", "table", "junk")
#: Labelled documents the model is fitted on at most, and rounds; words of the corpus that are known and common.
LABELLED, ROUNDS, KNOWN, COMMON = 2000, 4, 30_000, 40
#: The model is fitted on so many characters of each labelled document.
FITTED_CHARS = 20_000
#: Every labelled document counts as so many lines, however long it is.
PER_DOCUMENT, STAY, TRUST = 6.0, 8.0, 4.0

WORDS = re.compile(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+")
ITEM = re.compile(r"\s*(?:[-*+•·▪◦●‣–—]\s|\(?\d{1,3}(?:\.\d{1,3})*[.)]\s|\(?[a-zA-Z]\)\s|[①-⑳]|\[[ xX]\])")
CONTENTS = re.compile(r"\S.*?(?:\.{3,}|…{2,}|(?:\. ){3,}|·{3,}|_{3,})\s*\d+\s*$")
CELL_MARKS = ("\t", ";", " | ", "<td", "</td", "<tr", "</tr")
WIDE_GAPS = re.compile(r"\S {2,}(?=\S)")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’)\]»」』）]*(?:\s|$)")
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-。，、]")
DIGITS = re.compile(r"\d")
MIXED = re.compile(r"[0-9!|@#$](?:(?<=[^\W\d_][0-9])|(?<=[0-9])(?=[^\W\d_])|(?<=[^\W_][!|@#$])(?=[^\W_]))")


def observe(line: str, words: list[str], known: set[str], common: set[str], seen: bool) -> tuple[tuple, int, int, bool]:
    """The coarse statistics of one line, each by its place in the tuple; common words, symbols, closed by a mark."""
    n, size, body = len(words), len(line), line.strip()
    cells = sum(map(line.count, CELL_MARKS))
    gaps = len(WIDE_GAPS.findall(body)) if "  " in body else 0
    form = 3 if body.startswith("<!--") else 4 if body[0] == "#" else 1 if ITEM.match(line) else 2 if body[-1].isdigit() and CONTENTS.match(line) else 0
    table = bisect((1, 2, 4), cells + (gaps if gaps > 1 else 0))
    ends = len(SENTENCE_END.findall(line))
    sentence = 0 if not ends else 1 if ends * 60 < n else 2
    tail = body[-1]
    close = 0 if tail in ".!?…。！？" else 1 if tail in ",;:，、" else 2 if tail.isalpha() else 3 if tail.isdigit() else 4
    usual, familiar = sum(map(common.__contains__, words)), sum(map(known.__contains__, words))
    symbols = len(SYMBOLS.findall(line))
    numbers = len(DIGITS.findall(line))
    odd = len(MIXED.findall(line)) if numbers or symbols or "!" in line else 0
    length, share, unknown = bisect((1, 4, 9, 25), n), bisect((0.02, 0.1, 0.2), usual / n if n else 0.0), bisect((0.1, 0.3, 0.6, 0.9), 1 - familiar / n if n else 1.0)
    variety = bisect((0.35, 0.6), len(set(words)) / n) if n > 12 else 3
    strange = bisect((0.05, 0.3), odd / n if n else 0.0)
    seen_by = (
        form, table, sentence, close, length, unknown, share, bisect((0.02, 0.08, 0.2, 0.5), symbols / size), bisect((0.02, 0.1, 0.3), numbers / size), strange, variety, int(seen), bisect((3, 9, 20, 60), size / (n or 1)),
        share * 15 + sentence * 5 + length, form * 6 + min(table, 2) * 2 + (sentence > 0), unknown * 4 + min(strange, 1) * 2 + (sentence > 0),
    )
    return seen_by, usual, symbols, close == 0


def lines_of(text: str, known: set[str], common: set[str]) -> tuple[list[tuple], list[int], dict]:
    """Observations and sizes of the lines that are not blank, and the document's statistics."""
    out, sizes, before = [], [], set()
    n_words = letters = usual = closed = symbols = 0
    for line in text.split("\n"):
        low = line.lower()
        key = low.strip()
        if not key:
            continue
        words = WORDS.findall(low)
        seen_by, common_here, symbols_here, ended = observe(line, words, known, common, len(key) > 12 and key in before)
        out.append(seen_by)
        before.add(key)
        sizes.append(len(line) - line.count(" "))
        n_words += len(words)
        letters += len("".join(words))
        usual += common_here
        symbols += symbols_here
        closed += ended
    stats = {
        "words": n_words, "mean_word_length": letters / n_words if n_words else 0.0, "symbol_ratio": symbols / len(text) if text else 0.0,
        "closed_lines": closed / len(out) if out else 0.0, "common_words": usual / n_words if n_words else 0.0,
    }
    return out, sizes, stats


class LineModel:
    """Emission tables for each statistic and transitions between the kinds of lines."""

    def __init__(self, emitted: Counter, moved: Counter):
        self.emitted, self.moved, self.memo = emitted, moved, {}
        self.totals = Counter()
        for (kind, place, _), c in emitted.items():
            self.totals[kind, place] += c
        row = [sum(moved[j, k] for k in range(4)) for j in range(-1, 4)]
        self.start = [math.log((moved[-1, k] + 1) / (row[0] + 4)) for k in range(4)]
        self.move = [[math.log((moved[j, k] + (STAY if j == k else 1) * 2) / (row[j + 1] + (STAY + 3) * 2)) for k in range(4)] for j in range(4)]

    def emission(self, seen: tuple) -> list[float]:
        got = self.memo.get(seen)
        if got is None:
            got = [0.5 * sum(math.log((self.emitted[k, i, x] + 0.3) / (self.totals[k, i] + 0.3 * 5)) for i, x in enumerate(seen)) for k in range(4)]
            if len(self.memo) < 200_000:
                self.memo[seen] = got
        return got

    def decode(self, lines: list[tuple], bonus: list[float] = (0.0, 0.0, 0.0, 0.0)) -> list[int]:
        back, score = [], None
        for seen in lines:
            e = self.emission(seen)
            if score is None:
                score = [self.start[k] + e[k] + bonus[k] for k in range(4)]
                continue
            new, came = [0.0] * 4, [0] * 4
            for k in range(4):
                best, at = max((score[j] + self.move[j][k], j) for j in range(4))
                new[k], came[k] = best + e[k] + bonus[k], at
            back.append(came)
            score = new
        if score is None:
            return []
        state = score.index(max(score))
        path = [state]
        for came in reversed(back):
            state = came[state]
            path.append(state)
        return path[::-1]

    @classmethod
    def fit(cls, documents: list[tuple[list[tuple], dict[int, float]]]) -> LineModel:
        """``documents``: observations of the lines, and how much each kind is voted for."""
        emitted, moved = Counter(), Counter()
        for lines, votes in documents:
            for kind, weight in votes.items():
                last = -1
                for seen in lines:
                    for i, x in enumerate(seen):
                        emitted[kind, i, x] += weight * PER_DOCUMENT / len(lines)
                    moved[last, kind] += weight * PER_DOCUMENT / len(lines)
                    last = kind
        model = cls(emitted, moved)
        for _ in range(ROUNDS):
            emitted, moved = Counter(), Counter()
            for lines, votes in documents:
                total = sum(votes.values())
                bonus = [math.log((votes.get(k, 0.0) + 0.15) / (total + 0.6)) * TRUST / max(1.0, len(lines) ** 0.5) for k in range(4)]
                last = -1
                for seen, kind in zip(lines, model.decode(lines, bonus)):
                    for i, x in enumerate(seen):
                        emitted[kind, i, x] += PER_DOCUMENT / len(lines)
                    moved[last, kind] += PER_DOCUMENT / len(lines)
                    last = kind
            model = cls(emitted, moved)
        return model


def corpus_words(documents: DataFrame, text_col: str, lang_col: str | None) -> tuple[set[str], set[str]]:
    """Known words (the KNOWN found in most documents, in five at least) and common words (the COMMON found in most
    documents of each language label). Counted over all documents; only these come to the driver."""

    def run(batches):
        for batch in batches:
            every: Counter[str] = Counter()
            counts: dict[str, Counter[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORDS.findall(text.lower()))
                every.update(words)
                if lang:
                    counts.setdefault(lang, Counter()).update(words)
            rows = [("", word, n) for word, n in every.items() if len(word) <= 40] + [(lang, word, n) for lang, c in counts.items() for word, n in c.items() if len(word) <= 12]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    lang = F.lower(F.trim(F.col(lang_col))) if lang_col else F.lit(None).cast("string")
    counts = documents.where(F.length(text_col) > 0).select(F.col(text_col).alias("t"), F.when(F.length(lang) <= 3, lang).alias("l")).mapInArrow(run, "lang string, word string, n bigint")
    counts = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n >= 5"))
    known = counts.where("lang = ''").orderBy(F.desc("n"), "word").limit(KNOWN).select("word").collect()  # a top-k in each task, then of these
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = counts.where("lang <> ''").withColumn("r", place).where(F.col("r") <= COMMON).select("word").collect()
    return {r["word"] for r in known if len(r["word"]) > 2 or not r["word"].isascii()}, {r["word"] for r in common}


def fit(documents: DataFrame, labels: DataFrame, known: set[str], common: set[str], id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """Fit on at most about LABELLED labelled documents, chosen by hash of the id, and on FITTED_CHARS characters of each,
    so on a bounded part of the labels. What is told with the model are whole texts."""
    votes = labels.where(F.col("kind").isin(*KINDS)).groupBy(F.col(id_col).alias("id"), "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("votes"))
    share = min(1.0, LABELLED / max(1, votes.count()))
    sample = votes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = documents.select(F.col(id_col).alias("id"), F.substring(F.col(text_col), 1, FITTED_CHARS).alias("text")).where(F.length(F.trim("text")) > 0).join(sample, "id").collect()
    fitted = []
    for r in sorted(rows, key=lambda r: str(r["id"])):
        lines = lines_of(r["text"], known, common)[0]
        if lines:
            fitted.append((lines, {KINDS.index(k): float(n) for k, n in r["votes"].items()}))
    return LineModel.fit(fitted)


QUALITY = "id bigint, kind string, words bigint, mean_word_length double, symbol_ratio double, closed_lines double, common_words double, prose double, list double, table double, junk double"


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``<id_col>, kind``, the statistics, and the share of each kind of line in the characters of the document.

    Null, empty and blank texts are junk with statistics of 0. Repeated rows come out as often as they come in; ties
    between kinds go to the first of prose, list, table, junk. Every text is read whole, in the task that holds its
    row; only the word lists and the model are shipped, both of bounded size.
    """
    known, common = corpus_words(documents, text_col, lang_col)
    model = fit(documents, labels, known, common, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast((known, common, model))

    def run(batches):
        known, common, model = shared.value
        for batch in batches:
            out = [[] for _ in range(11)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, sizes, stats = lines_of(text or "", known, common)
                weight = [0.0] * 4
                for kind, size in zip(model.decode(lines), sizes):
                    weight[kind] += size
                total = sum(weight)
                shares = [w / total for w in weight] if total else [0.0, 0.0, 0.0, 1.0]
                kind = KINDS[shares.index(max(shares))]
                for column, value in zip(out, (doc, kind, *stats.values(), *shares)):
                    column.append(value)
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), *[pa.float64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split()[0] for c in QUALITY.split(", ")])

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = QUALITY.replace("id bigint", f"id {source.schema['id'].dataType.simpleString()}", 1)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
