"""Repair of text from scanned pages.

Words are counted over all pages, and skip-gram vectors with negative sampling are learned from the counts of their
neighbours. The vector of a rare word is the sum of the context vectors of its neighbours. It is linked to frequent
words that plausible confusions of glyphs turn it into and whose vectors are near its own; the nearest corrects it, and
if none is near enough it is a word of its own. Page numbers and running heads are told by what the pages of a document
share; they are removed, broken words are joined, and lines are reflowed into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.plans.lineage import cut

#: Most frequent words that are shipped to all tasks (the others are joined to the pages that need them), words whose
#: vectors are fitted on the driver (more are fitted by the tasks), and what makes a word frequent.
WORDS, VECTORS, FREQUENT, RATIO = 65_536, 2048, 5, 8
#: A correction must fit its context as well as all but such a share of the neighbours in the text fit each other.
UNFIT = 0.02
#: A word with a capital is corrected only to one that has a capital in such a share; others are names.
CAPITALS, NAMES = 0.03, 2e-5
DIMENSIONS, STEPS, NEGATIVES, NEAR = 24, 60, 5, 2
#: Numbers that a task holds at once of a block of rows against all words.
AT_ONCE = 1 << 22
EDGE_LINES, HEAD_CHARS = 2, 90
#: Numbers that stand equally far from page_num are the pages' if so large a share of the pages has them, two at least.
NUMBERED = 0.05

#: What is read and what may have been printed.
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("m", "in"), ("in", "m"), ("b", "h"), ("h", "b"),
    ("c", "e"), ("e", "c"), ("i", "l"), ("l", "i"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("@", "a"), ("†", "t"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("(", "c"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("q", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("i", "t"), ("f", "t"), ("í", "i"), ("é", "e"), ("ó", "o"), ("á", "a"),
]
HYPHENS = "-‐‑¬­"
STRUCTURE = re.compile(r"\s*(?:#|\||<|```|\t)|.*\|.*\||.*\t|.*</t")
TOKEN = re.compile(r"[^\s]+")
STRIP_LEFT, STRIP_RIGHT = "\"'“”‘’„«»([{<¿¡*_~-–—", "\"'“”‘’„«»)]}>.,;:?…*_~–—。，、"
WIDE = re.compile(r"[　-鿿가-힯＀-￯]")
SYMBOL_IN_WORD = re.compile(r"[^\W\d_][0156@!†|$][^\W\d_]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*$")
NUMBERS = re.compile(
    r"^\W*(?:(?P<form>page|seite|página|pagina|pág\.?|p\.|s\.|folio|-\s|—\s|–\s|\[|第)\s*)?(?P<n>[0-9OoIlSBZ]{1,5})(?P<tail>\s*(?:ページ|页|頁|쪽|페이지))?(?P<of>\s*(?:/|of|von|de|sur)\s*[0-9OolI]{1,5})?\W*$", re.IGNORECASE
)
ROMAN = re.compile(r"^[^\w]*(?=[ivxlc])(c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))[^\w]*$", re.IGNORECASE)
ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
DIGITS = str.maketrans("OoIlSBZ", "0011582")


def folded(line: str) -> str:
    """A line without digits, case, accents and the usual misreadings; equal for lines that differ only in these."""
    text = unicodedata.normalize("NFKD", re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", " ", line).lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    for a, b in (("@", "a"), ("0", "o"), ("5", "s"), ("9", "g"), ("$", "s"), ("†", "t"), ("!", "i"), ("1", "l"), ("|", "l"), ("(", "c"), ("ri", "n"), ("rn", "m"), ("in", "m"), ("ii", "u"), ("vv", "w"), ("e", "c"), ("cl", "d"), ("li", "h"), ("b", "h"), ("l", "i")):
        text = text.replace(a, b)
    return re.sub(r"[\W\d_]+", "", unicodedata.normalize("NFC", text))


def page_number(line: str) -> tuple[int, bool] | None:
    """The number if the line has nothing else, and whether its form says that it is a page's number."""
    roman = ROMAN.match(line)
    if roman:
        values = [ROMAN_DIGITS[c] for c in roman[1].lower()]
        return sum(-v if w > v else v for v, w in zip(values, [*values[1:], 0])), False
    m = NUMBERS.match(line.strip())
    if not m or not any(c.isdigit() for c in m["n"]):
        return None
    formal = bool(m["form"] or m["tail"] or m["of"])
    return int(m["n"].translate(DIGITS)), formal


def head_like(line: str) -> bool:
    """Short, without structure, and not the end of a sentence."""
    body = line.strip()
    return len(body) <= HEAD_CHARS and not STRUCTURE.match(line) and (body[-1].isalnum() or body[-1] in "@!†|$~") and not re.match(r"\s*(?:[-*•+]|\d+[.)])\s", line)


def edges_of(text: str) -> list[tuple[int, str]]:
    """Number and text of the first and last lines that are not blank."""
    lines = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    return lines if len(lines) <= 2 * EDGE_LINES else lines[:EDGE_LINES] + lines[-EDGE_LINES:]


def distinct_pages(pages: DataFrame, *more: str) -> DataFrame:
    """The latest row of each page_id that has text: ``page_id, document_id, page_num, natural_text`` and ``more``."""
    kept = F.max_by(F.struct("document_id", "page_num", "natural_text", *more), F.coalesce("received_at", F.lit("1970-01-01").cast("timestamp")))
    return pages.where(F.col("page_id").isNotNull() & (F.length("natural_text") > 0)).groupBy("page_id").agg(kept.alias("p")).select("page_id", "p.*")


def furniture(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, kind`` of running heads and page numbers among the edge lines of ``distinct_pages``.

    A running head has the folded text of edge lines of other pages of the document, or is within two edits of such
    a text. A bare number is the page's if enough pages of the document stand equally far from their page_num, or if
    it is the page_num. All counts are aggregated by document and text before the shuffle.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for page, document, number, text in zip(*(c.to_pylist() for c in batch.columns)):
                for line_no, line in edges_of(text):
                    found = page_number(line)
                    stripped = line.strip()
                    key = folded(stripped) if found is None and head_like(line) else ""
                    if found is None and len(key) < 3:
                        continue
                    row = (page, document, number, line_no, key, None if found is None else found[0], None if found is None else found[1])
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["page_id", "document_id", "page_num", "line_no", "key", "number", "formal"])

    edges = cut(pages.select("page_id", "document_id", "page_num", "natural_text").mapInArrow(run, "page_id bigint, document_id string, page_num int, line_no int, key string, number bigint, formal boolean"))
    lines = edges.where(F.col("key") != "")
    by_text = lines.select("document_id", "key", "page_id").distinct().groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("pages"))
    shared = by_text.where("pages > 1").select("document_id", F.col("key").alias("head"))
    exact = lines.join(shared, (lines["key"] == shared["head"]) & lines["document_id"].eqNullSafe(shared["document_id"]), "left_semi").select("page_id", "line_no")
    # A text that only one page has may be a misreading of a shared one: equal beginnings or ends, few edits.
    single = lines.join(by_text.where("pages = 1"), ["document_id", "key"], "left_semi")
    ends = lambda c: F.explode(F.array(F.concat(F.lit("^"), F.substring(c, 1, 4)), F.concat(F.lit("$"), F.right(F.col(c), F.lit(4)))))
    close = single.withColumn("end", ends("key")).join(shared.where(F.length("head") >= 6).withColumn("end", ends("head")), ["document_id", "end"]).where(F.levenshtein("key", "head") <= F.greatest(F.lit(1), F.length("head") / 6)).select("page_id", "line_no")
    heads = exact.union(close).distinct().withColumn("kind", F.lit("running_head"))
    numbers = edges.where(F.col("number").isNotNull()).withColumn("away", F.col("number") - F.col("page_num"))
    steps = numbers.select("document_id", "away", "page_id").distinct().groupBy("document_id", "away").agg(F.count(F.lit(1)).alias("same"))
    sizes = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    steps = steps.join(sizes.withColumnRenamed("document_id", "d"), steps["document_id"].eqNullSafe(F.col("d"))).where(F.col("same") >= F.greatest(F.lit(2), F.col("pages") * NUMBERED)).drop("d", "pages")
    known = numbers.join(steps, (numbers["away"] == steps["away"]) & numbers["document_id"].eqNullSafe(steps["document_id"]), "left").where("formal or number = page_num or same is not null")
    return cut(heads.union(known.select("page_id", "line_no").distinct().withColumn("kind", F.lit("page_number"))))


def core_of(token: str) -> str:
    return token.lstrip(STRIP_LEFT).rstrip(STRIP_RIGHT)


def running_lines(text: str) -> list[tuple[int, str]]:
    """Number and text of the lines that are neither headings, tables nor markup."""
    return [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip() and not STRUCTURE.match(x)]


def count_words(pages: DataFrame) -> DataFrame:
    """``word, n, usual, capital`` of all words over all pages, written once. A word is usual if it is frequent and no
    name: words that always have a capital and are a small share are names, to which nothing is corrected. ``capital``
    is true of words that are also written with a capital."""

    def run(batches):
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                edges = {n for n, _ in edges_of(text)}
                for n, line in running_lines(text):
                    if n in edges and head_like(line):  # running heads would make their names frequent
                        continue
                    for token in TOKEN.findall(line):
                        word = core_of(token)
                        if WORD.match(word) and not WIDE.search(word):
                            counts[word] += 1
            words = [w.lower() for w in counts]
            capitals = [n if w[0].isupper() else 0 for w, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(capitals, pa.int64())], names=["word", "n", "capitals"])

    totals = cut(pages.select("natural_text").mapInArrow(run, "word string, n bigint, capitals bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals")))
    total = totals.where(F.col("n") >= FREQUENT).agg(F.sum("n").alias("n")).first()["n"] or 0
    name = (F.col("capitals") > (1 - CAPITALS) * F.col("n")) & (F.col("n") < NAMES * total)
    return totals.select("word", "n", ((F.col("n") >= FREQUENT) & ~name).alias("usual"), (F.col("capitals") >= CAPITALS * F.col("n")).alias("capital"))


def skip_grams(pages: DataFrame, words: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Vectors of all ``words``, the most frequent first, and of their contexts, and the least fit. Neighbour pairs are
    counted over all pages. The counts of at most VECTORS words come to the driver, those of more stay with the tasks;
    the same objective is climbed for both."""
    named = sorted(words, key=lambda w: (-words[w], w))
    ids = {w: i for i, w in enumerate(named)}
    size = len(named)
    shared = pages.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        ids = shared.value
        for batch in batches:
            counts: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                row = [ids.get(core_of(t).lower(), -1) for _, line in running_lines(text) for t in TOKEN.findall(line)]
                for k in range(1, NEAR + 1):
                    counts.update(a * size + b for a, b in zip(row, row[k:]) if a >= 0 and b >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    pairs = pages.select("natural_text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    seen = Matrix.of(pairs, size) if size <= VECTORS else Blocks.of(pairs, size)
    vectors, contexts = climb(seen)
    return named, vectors, contexts, seen.least_fit(vectors, contexts)


def odds_of(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


class Matrix:
    """How often words stand near each other, as a symmetric matrix."""

    def __init__(self, seen: np.ndarray):
        self.counts, self.sums = seen, seen.sum(0)
        noise = self.sums**0.75
        self.seen = seen.astype(np.float32)
        self.expected = (NEGATIVES * np.outer(self.sums, noise / max(noise.sum(), 1e-9))).astype(np.float32)
        self.weight = (1 / (self.sums[:, None] + 1)).astype(np.float32)

    def __len__(self) -> int:
        return len(self.sums)

    @classmethod
    def of(cls, pairs: DataFrame, size: int) -> Matrix:
        found = pairs.toArrow()
        pair, n = np.asarray(found.column("pair")), np.asarray(found.column("n"))
        seen = np.zeros((size, size))
        if size:
            np.add.at(seen, (pair // size, pair % size), n)
        return cls(seen + seen.T)

    def slopes(self, vectors: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = odds_of(vectors @ contexts.T)
        slope = (self.seen * (1 - p) - self.expected * p) * self.weight
        return slope @ contexts, slope.T @ vectors

    def least_fit(self, vectors: np.ndarray, contexts: np.ndarray) -> float:
        """The inner product that all but the share UNFIT of the neighbours in the text reach."""
        a, b = np.nonzero(self.counts)
        if len(a) == 0:
            return 0.0
        fit = np.einsum("nd,nd->n", vectors[a], contexts[b])
        order = np.argsort(fit)
        weight = np.cumsum(self.counts[a, b][order])
        return float(fit[order[np.searchsorted(weight, UNFIT * weight[-1])]])


class Blocks:
    """The same as ``Matrix``, but the pairs lie in blocks of rows with the tasks: row ``i`` in block ``i % number``. A
    task has the slopes of the vectors and, as the counts are symmetric, of the contexts of its rows."""

    def __init__(self, rows: DataFrame, sums: np.ndarray, number: int):
        self.rows, self.sums, self.number = rows, sums, number

    def __len__(self) -> int:
        return len(self.sums)

    @classmethod
    def of(cls, pairs: DataFrame, size: int) -> Blocks:
        tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
        number = max(4 * tasks, -(-size // 512))
        pairs = cut(pairs.select(F.expr(f"int(pair div {size})").alias("at"), F.expr(f"int(pair % {size})").alias("to"), "n"))
        both = pairs.union(pairs.select("to", "at", "n")).groupBy("at", "to").agg(F.sum("n").cast("double").alias("n"))
        rows = both.withColumn("block", F.col("at") % number).repartition(tasks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "to", "n"))).alias("p"))
        rows = cut(rows.select("block", "p.at", "p.to", "p.n"))
        found = rows.select(F.explode(F.arrays_zip("at", "n")).alias("p")).groupBy("p.at").agg(F.sum("p.n").alias("n")).toArrow()
        sums = np.zeros(size)
        sums[np.asarray(found.column("at"))] = np.asarray(found.column("n"))
        return cls(rows, sums, number)

    def run(self, work, schema: str, vectors: np.ndarray, contexts: np.ndarray):
        """Rows of ``work(block, at, to, n, vectors, contexts)``, which gives a batch for each block."""
        shared = self.rows.sparkSession.sparkContext.broadcast((vectors, contexts))

        def each(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield work(batch.column(0)[i].as_py(), *(batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3)), *shared.value)

        return self.rows.mapInArrow(each, schema), shared

    def slopes(self, vectors: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, number = len(self), self.number
        sums = self.sums.astype(np.float32)
        noise = self.sums**0.75
        expected, weight = (NEGATIVES * noise / max(noise.sum(), 1e-9)).astype(np.float32), (1 / (self.sums + 1)).astype(np.float32)

        def work(block, at, to, n, vectors, contexts):
            own, n = np.arange(block, size, number), n.astype(np.float32)
            of_vectors, of_contexts = [], []
            step = max(1, AT_ONCE // size)
            for k in range(0, len(own), step):
                here = own[k : k + step]
                first, last = np.searchsorted(at, [here[0], here[-1] + 1])
                r, c, m = (at[first:last] - here[0]) // number, to[first:last], n[first:last]
                p = odds_of(vectors[here] @ contexts.T)
                slope = -sums[here, None] * expected * p
                slope[r, c] += m * (1 - p[r, c])
                of_vectors.append((slope * weight[here, None]) @ contexts)
                p = odds_of(contexts[here] @ vectors.T)
                slope = -sums * expected[here, None] * p
                slope[r, c] += m * (1 - p[r, c])
                of_contexts.append((slope * weight) @ vectors)
            both = [pa.array([np.concatenate(x).astype(np.float32).tobytes()], pa.binary()) for x in (of_vectors, of_contexts)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *both], names=["block", "v", "c"])

        rows, shared = self.run(work, "block int, v binary, c binary", vectors, contexts)
        out = np.zeros_like(vectors), np.zeros_like(contexts)
        for r in rows.collect():
            for x, name in zip(out, ("v", "c")):
                x[r["block"] :: number] = np.frombuffer(r[name], np.float32).reshape(-1, x.shape[1])
        shared.destroy()
        return out

    def least_fit(self, vectors: np.ndarray, contexts: np.ndarray) -> float:
        """As that of ``Matrix``, to single precision: the upper half of its bits is found first, then the lower."""

        def work(block, at, to, n, vectors, contexts):
            bits = np.einsum("nd,nd->n", vectors[at], contexts[to]).astype(np.float32).view(np.int32).astype(np.int64)
            place = np.where(bits < 0, -1 - (bits & 0x7FFFFFFF), bits) + (1 << 31)  # rises with the number
            place, index = np.unique(place, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.bincount(index, n, len(place)), pa.float64())], names=["place", "n"])

        rows, shared = self.run(work, "place bigint, n double", vectors, contexts)
        below, upper, key = 0.0, None, F.col("place").bitwiseAND(0xFFFF)
        for digit in (F.shiftright("place", 16), key):
            found = (rows if upper is None else rows.where(F.shiftright("place", 16) == upper)).groupBy(digit.alias("digit")).agg(F.sum("n").alias("n")).orderBy("digit").collect()
            weight = below + np.cumsum([r["n"] for r in found])
            at = min(int(np.searchsorted(weight, UNFIT * self.sums.sum())), len(found) - 1) if found else -1
            if at < 0:
                return 0.0
            below = weight[at - 1] if at else below
            place = found[at]["digit"] if upper is None else (upper << 16) + found[at]["digit"]
            upper = place
        shared.destroy()
        place -= 1 << 31
        value = np.array([place if place >= 0 else (-1 - place) - (1 << 31)], np.int64).astype(np.int32).view(np.float32)[0]
        return float(np.nextafter(value, np.float32(-np.inf)))


def climb(seen: Matrix | Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors from neighbour counts: full-batch Adam on the expected negative-sampling objective."""
    size = len(seen)
    if size == 0 or seen.sums.sum() == 0:
        return np.zeros((size, DIMENSIONS)), np.zeros((size, DIMENSIONS))
    rng = np.random.default_rng(3)
    both = [rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) for _ in range(2)]
    first, second = [np.zeros_like(x) for x in both], [np.zeros_like(x) for x in both]
    for step in range(1, STEPS + 1):
        for i, g in enumerate(seen.slopes(*both)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            both[i] = both[i] + 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return both[0].astype(np.float64), both[1].astype(np.float64)


def readings(word: str) -> set[str]:
    """What one confusion of glyphs may have made of the printed word."""
    out = set()
    for read, printed in CONFUSIONS:
        at = word.find(read)
        while at >= 0:
            out.add(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
    return out


def misreadings(word: str) -> set[str]:
    """What one confusion of glyphs may make of the printed word: all texts of whose ``readings`` it is one."""
    out = set()
    for read, printed in CONFUSIONS:
        at = word.find(printed)
        while at >= 0:
            out.add(word[:at] + read + word[at + len(printed) :])
            at = word.find(printed, at + 1)
    return out


class Corrector:
    """Links rare words to frequent ones and chooses by context. ``words`` are usual words with their counts,
    ``others`` counts of further words; a word in neither occurs once at most."""

    def __init__(self, words: dict[str, int], named: list[str], vectors: np.ndarray, contexts: np.ndarray, least: float = -np.inf, capitals: set[str] = frozenset(), others: dict[str, int] | None = None):
        self.words, self.capitals, self.ids = words, capitals, {w: i for i, w in enumerate(named)}
        self.others = others or {}
        self.vectors, self.contexts, self.least = vectors, contexts, least
        self.memo: dict[str, list[str]] = {}
        self.near_page: dict[str, np.ndarray] = {}  # vectors of words that are joined to a page
        self.shipped = frozenset(self.words) | frozenset(self.others)
        self.usual, self.sound = frozenset(self.words), set()

    def is_sound(self, word: str) -> bool:
        """True of a shipped word without candidates; these are found among shipped words, as they are more frequent."""
        if word in self.sound:
            return True
        if word in self.usual and not self.candidates(word):
            self.sound.add(word)
            return True
        return False

    @contextmanager
    def knowing(self, facts: list[dict] | None):
        """Adds the words of a page that are not among the most frequent, and takes them away after."""
        for f in facts or []:
            (self.words if f["usual"] else self.others)[f["word"]] = f["n"]
            if f["capital"]:
                self.capitals.add(f["word"])
            if f["fit"] is not None:
                self.near_page[f["word"]] = np.reshape(f["fit"], (2, -1))
        yield self
        for f in facts or []:
            (self.words if f["usual"] else self.others).pop(f["word"], None)
            self.capitals.discard(f["word"])
        self.near_page.clear()

    def fit_of(self, word: str):
        """The vectors of a usual word and of its context."""
        i = self.ids.get(word)
        return self.near_page.get(word) if i is None else (self.vectors[i], self.contexts[i])

    def candidates(self, word: str) -> list[str]:
        """Frequent words that one or two confusions make of ``word``; none for a word that is frequent itself."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            own = self.words.get(word) or self.others.get(word, 1)
            good = lambda w: self.words.get(w, 0) >= max(FREQUENT, RATIO * own) and len(w) > 1
            one = readings(word) if 2 < len(word) <= 40 else set()
            found = [w for w in one if good(w)]
            if not found and len(word) > 4 and own < 50:
                found = [w for x in one for w in readings(x) if good(w) and w != word]
            self.memo[word] = sorted(set(found))
        return self.memo[word]

    def choose(self, word: str, before: list[str], after: list[str], capital: bool = False) -> str | None:
        found = [w for w in self.candidates(word) if not capital or w in self.capitals]
        if not found:
            return None
        near = [x[1] for w in before[-NEAR:] + after[:NEAR] if (x := self.fit_of(w)) is not None]
        own = np.mean(near, 0) if near else None  # the vector of the rare word, from where it stands

        def fit(w: str) -> float:
            return float(self.fit_of(w)[0] @ own) if near else 0.0

        if near and word.isalpha():  # a word with a digit or mark in it is no word of its own
            found = [w for w in found if fit(w) >= self.least]
        return max(found, key=lambda w: (0.5 * float(np.log(self.words[w])) + len(near) * fit(w), w)) if found else None


def joined_break(last: str, following: str, words: dict[str, int]) -> str | None:
    """The whole word if ``last`` ends with a mark of word division that does not belong to the word."""
    if len(last) < 2 or last[-1] not in HYPHENS or not last[-2].isalpha() or not following[:1].isalpha():
        return None
    whole, kept = last[:-1] + following, last[:-1] + "-" + following
    if last[-1] in "-‐‑":
        # The hyphen belongs to the word if the word is usual with it, or if both halves are words and the whole isn't.
        if words.get(kept, 0) > words.get(whole, 0):
            return None
        if whole not in words and "-" not in last[:-1] and words.get(last[:-1], 0) >= 50 and words.get(following, 0) >= 50 and last[-1] == "-":
            return None
    return whole


def inspect(text: str, corrector: Corrector) -> tuple[list[tuple[int, str]], dict[int, list[tuple[int, int, str]]]]:
    """Line numbers with ``hyphen`` and ``bad_char``, and the corrections (start, end, text) of each line."""
    lines = running_lines(text)
    words = corrector.words
    tokens = []  # line number, start, end, word
    for n, line in lines:
        for m in TOKEN.finditer(line):
            raw = m.group()
            if raw.isalpha():
                tokens.append((n, m.start(), m.end(), raw))
                continue
            word = core_of(raw)
            hyphen = raw[-1] if raw[-1] in HYPHENS else ""
            start = m.start() + len(raw) - len(raw.lstrip(STRIP_LEFT))
            core = (word.rstrip(HYPHENS) + hyphen) if hyphen else word
            if word and word.lower() not in words and m.start() < start and line[start - 1] == "(" and ")" not in raw and corrector.candidates("(" + word.lower()):
                start, core = start - 1, "(" + core
            tokens.append((n, start, start + len(core), core))
    flat = [t[3].lower() for t in tokens]
    marks, changes, skip = [], {}, set()
    ends = {}
    for i, t in enumerate(tokens):
        ends[t[0]] = i
    for i in ends.values():  # the last word of each line and the first of the next
        if i + 1 >= len(tokens):
            continue
        last, following = tokens[i], tokens[i + 1]
        if WIDE.search(last[3][-2:]):
            continue
        whole = joined_break(flat[i], flat[i + 1], words)
        if whole is not None:
            marks.append((last[0], "hyphen"))
            skip |= {i, i + 1}
            right = corrector.choose(whole, flat[:i][-NEAR:], flat[i + 2 : i + 2 + NEAR]) if whole not in words or corrector.candidates(whole) else None
            if right:
                differs = next((k for k, (a, b) in enumerate(zip(whole, right)) if a != b), len(whole))
                marks.append((last[0] if differs < len(last[3]) - 1 else following[0], "bad_char"))
            changes.setdefault(last[0], []).append((last[1], last[2], "\0" + (right or whole)))
        elif flat[i] + flat[i + 1] in words and (flat[i] not in words or flat[i + 1] not in words):
            skip |= {i, i + 1}
            changes.setdefault(last[0], []).append((last[1], last[2], "\0" + flat[i] + flat[i + 1]))
        elif flat[i] not in words and flat[i + 1] not in words and corrector.candidates(flat[i] + flat[i + 1]):
            skip |= {i, i + 1}
            whole = flat[i] + flat[i + 1]
            right = corrector.choose(whole, [], [])
            differs = next((k for k, (a, b) in enumerate(zip(whole, right)) if a != b), len(whole))
            marks.append((last[0] if differs < len(flat[i]) else following[0], "bad_char"))
    for i, (n, start, end, word) in enumerate(tokens):
        low = flat[i]
        if i in skip or len(word) < 2 or corrector.is_sound(low) or WIDE.search(word):
            continue
        if not any(c.isalpha() for c in low):
            continue
        right = corrector.choose(low, flat[max(0, i - NEAR) : i], flat[i + 1 : i + 1 + NEAR], word[:1].isupper() and word[1:].islower())
        if right is None and low not in words and low[-1:] == "!":
            low = low[:-1]
        if right is not None:
            marks.append((n, "bad_char"))
            changes.setdefault(n, []).append((start, end, right if word[:1] == word[:1].lower() else right[:1].upper() + right[1:]))
        elif low not in words and SYMBOL_IN_WORD.search(word) and "/" not in word and "=" not in word:
            marks.append((n, "bad_char"))
    return sorted(set(marks)), changes


def learn(pages: DataFrame) -> tuple[Corrector, DataFrame]:
    """A corrector that has the WORDS most frequent words with their vectors, and the table of all words with the vectors
    (``fit``) of the usual ones beyond them."""
    counts = count_words(pages)
    frequent = counts.where(F.col("n") >= FREQUENT)
    rows = frequent.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    usual = frequent.where("usual").select("word", "n").toArrow()
    named, vectors, contexts, least = skip_grams(pages, dict(zip(*(c.to_pylist() for c in usual.columns))))
    words = {r["word"]: r["n"] for r in rows if r["usual"]}
    capitals, names = {r["word"] for r in rows if r["capital"]}, {r["word"]: r["n"] for r in rows if not r["usual"]}
    k = len(words)  # these come first
    counts = counts.withColumn("fit", F.lit(None).cast("array<double>"))
    if k < len(named):
        both = np.hstack([vectors[k:], contexts[k:]])
        offsets = np.arange(0, both.size + 1, both.shape[1], dtype=np.int32)
        far = pages.sparkSession.createDataFrame(pa.table({"word": pa.array(named[k:], pa.string()), "fit": pa.ListArray.from_arrays(pa.array(offsets), pa.array(both.ravel()))}))
        counts = counts.drop("fit").join(far, "word", "left")
    return Corrector(words, named[:k], vectors[:k], contexts[:k], least, capitals, names), counts


def keys_of(text: str, known: frozenset[str]) -> set[str]:
    """All texts besides ``known`` whose counts ``inspect`` may ask for. Words are put together over the end of a line only
    if a mark divides them or one of them is unknown."""
    out: set[str] = set()
    last: tuple[str, ...] = ()
    for _, line in running_lines(text):
        first = True
        for m in TOKEN.finditer(line):
            raw = m.group()
            word = raw.lower() if raw.isalpha() else core_of(raw).lower()
            hyphen = raw[-1] in HYPHENS
            whole = word.rstrip(HYPHENS) + raw[-1] if hyphen else word
            forms = (whole, "(" + whole) if "(" in raw else (whole,)
            if hyphen or whole not in known:
                for x in forms:
                    out.add(x)
                    if x[-1:] in HYPHENS + "!":
                        out |= {x[:-1], x.rstrip(HYPHENS)}
            if first:
                for a in last:
                    if a[-1:] in HYPHENS or a not in known or whole not in known:
                        for b in forms:
                            out |= {a + b, a[:-1] + b, a[:-1] + "-" + b, a[:-1]}
                first = False
            last_here = forms
        last = last_here if not first else last
    return {x for x in out if x not in known and any(c.isalpha() for c in x)}


def blanked(text: str, dropped: list[int] | set[int] | None) -> str:
    gone = set(dropped or [])
    return "\n".join("" if n in gone else line for n, line in enumerate(text.split("\n"), 1)) if gone else text


def with_facts(pages: DataFrame, shared, counts: DataFrame) -> DataFrame:
    """``pages (page_id, natural_text, lines)`` with ``facts``: count, use, capital and vectors of the page's words that are not
    among those shipped, and of such words that one or two confusions make of any of them. Words are joined, none
    is left out; two confusions meet at the text between them."""

    def keys(batches):
        known = shared.value
        for batch in batches:
            ids, found = [], []
            for page, text, lines in zip(*(c.to_pylist() for c in batch.columns)):
                new = keys_of(blanked(text, lines), known.shipped)
                ids += [page] * len(new)
                found += new
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["page_id", "word"])

    def between(step, itself):
        def run(batches):
            for batch in batches:
                pairs = [(x, w) for w in batch.column(0).to_pylist() if 1 < len(w) <= 80 for x in (*step(w), *[w] * itself)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["between", "target" if itself else "word"])

        return run

    def unshipped(batches):
        known = shared.value
        for batch in batches:
            yield batch.filter(pa.array([w not in known.words and w not in known.others for w in batch.column(0).to_pylist()], pa.bool_()))

    asked = cut(pages.select("page_id", "natural_text", "lines").mapInArrow(keys, "page_id bigint, word string"))
    rest = counts.where("n > 1").mapInArrow(unshipped, "word string, n bigint, usual boolean, capital boolean, fit array<double>")
    facts = asked.join(rest, "word")
    targets = cut(rest.where("usual"))
    if not targets.isEmpty():
        left = asked.select("word").distinct().mapInArrow(between(readings, False), "between string, word string").distinct()
        right = targets.select("word").mapInArrow(between(misreadings, True), "between string, target string").distinct()
        links = left.join(right, "between").select("word", "target").distinct().where("word <> target")
        linked = asked.join(links, "word").select("page_id", F.col("target").alias("word")).distinct().join(targets, "word")
        facts = facts.unionByName(linked).distinct()
    by_page = facts.groupBy("page_id").agg(F.collect_list(F.struct("word", "n", "usual", "capital", "fit")).alias("facts"))
    return pages.join(by_page, "page_id", "left").select("page_id", "natural_text", "lines", "facts")


def faults(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, kind`` of broken words, misread characters and page furniture of ``distinct_pages``."""
    corrector, counts = learn(pages)
    shared = pages.sparkSession.sparkContext.broadcast(corrector)

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for page, text, _, facts in zip(*(c.to_pylist() for c in batch.columns)):
                with shared.value.knowing(facts) as known:
                    for n, kind in inspect(text, known)[0]:
                        for column, value in zip(out, (page, n, kind)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.string()))], names=["page_id", "line_no", "kind"])

    edges = furniture(pages)
    heads = edges.where("kind = 'running_head'").select("page_id", "line_no")
    numbers = edges.where("kind = 'page_number'").join(heads, ["page_id", "line_no"], "left_anti")
    rows = with_facts(pages.select("page_id", "natural_text", F.lit(None).cast("array<int>").alias("lines")), shared, counts)
    words = rows.mapInArrow(run, "page_id bigint, line_no int, kind string")
    words = words.join(edges.select("page_id", "line_no").distinct(), ["page_id", "line_no"], "left_anti")
    return words.union(heads.withColumn("kind", F.lit("running_head"))).union(numbers.select("page_id", "line_no", "kind"))


def repaired(text: str, dropped: set[int], corrector: Corrector) -> str:
    """Continuous paragraphs: furniture removed, words joined and corrected, lines reflowed."""
    kept = [(n, line) for n, line in enumerate(text.split("\n"), 1) if n not in dropped]
    _, changes = inspect(blanked(text, dropped), corrector)
    blocks, current, glue, eaten = [], "", False, False
    for n, line in kept:
        if eaten:  # the first word of this line went to the end of the line before
            line = re.sub(r"^\s*[^\W\d_]+", lambda m: " " * len(m.group()), line, count=1)
            eaten = False
        fixed, joins = line, False
        for start, end, new in sorted(changes.get(n, []), reverse=True):
            if new.startswith("\0"):
                first = line[start:end].rstrip(HYPHENS)
                fixed = fixed[:start] + first + new[1 + len(first) :] + fixed[end:]
                joins = True
            else:
                fixed = fixed[:start] + new + fixed[end:]
        if not line.strip() and not glue:
            blocks.append(current)
            current = ""
        elif STRUCTURE.match(line):
            blocks += [current, line.rstrip()]
            current = ""
        else:
            wide = current and WIDE.match(current[-1]) and WIDE.match(fixed.strip()[:1] or " ")
            current = current + ("" if not current or wide else " ") + re.sub(r"[ \t]+", " ", fixed.strip())
        eaten = joins
    blocks.append(current)
    return "\n\n".join(b for b in blocks if b)


def continuous_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page with text."""
    corrector, counts = learn(pages)
    shared = pages.sparkSession.sparkContext.broadcast(corrector)

    def run(batches):
        for batch in batches:
            ids, fixed = batch.column(0), []
            for _, text, lines, facts in zip(*(c.to_pylist() for c in batch.columns)):
                with shared.value.knowing(facts) as known:
                    fixed.append(repaired(text, set(lines or []), known))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fixed, pa.string())], names=["page_id", "text"])

    dropped = furniture(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("lines"))
    return with_facts(pages.select("page_id", "natural_text").join(dropped, "page_id", "left"), shared, counts).mapInArrow(run, "page_id bigint, text string")
