"""Languages of documents and of their segments by rank-order profiles of n-grams.

A profile lists the most frequent n-grams (one to three characters, words edged by blanks) of a language by rank.
The out-of-place distance of a text sums, over its own n-grams by rank, how far each stands from its place in the
profile; an n-gram the profile lacks costs the length of the profile. Sentences are told one by one, neighbouring
ones of one language make a segment, and a document has the language of its greater part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PROFILE = 500
#: At most so many labelled documents of a language are read for its profile, of each at most so many characters.
TRAINING_DOCS = 400
ORDERS = (1, 2, 3)
SURE = 0.07
GRAMS_AT_ONCE = 400_000

#: Names of languages as labels write them.
NAMES = {
    "en": "english englisch anglais inglés inglês 영어 英语 英語 eng",
    "ko": "korean koreanisch coréen coreano 한국어 韩语 韓国語 kor",
    "zh": "chinese chinesisch chinois chino chinês 중국어 中文 汉语 中国語 zho chi cmn",
    "de": "german deutsch allemand alemán alemão 독일어 德语 ドイツ語 deu ger",
    "fr": "french französisch français francais francés francês 프랑스어 法语 フランス語 fra fre",
    "es": "spanish spanisch espagnol español espanol espanhol 스페인어 西班牙语 スペイン語 spa",
    "ja": "japanese japanisch japonais japonés japonês 일본어 日语 日本語 jpn",
    "pt": "portuguese portugiesisch portugais portugués português portugues 포르투갈어 葡萄牙语 ポルトガル語 por",
    "it": "italian italiano italien italienisch ita",
    "nl": "dutch nederlands nld dut",
    "ru": "russian русский rus",
    "ar": "arabic العربية ara",
    "pl": "polish polski pol",
    "tr": "turkish türkçe tur",
    "vi": "vietnamese vie",
    "sv": "swedish svenska swe",
}
#: Further two-letter codes that name a language.
CODES = set(NAMES) | set("cs da el fa fi he hi hu id no ro th uk bg hr sk sl sr lt lv et ca eu gl ms bn ta te ur".split())
LABELS = {word: code for code, words in NAMES.items() for word in words.split()}

ITEM = re.compile(r"\s*(?:#|[-*+•·▪◦●‣–—]\s|\d{1,3}[.)]\s|\(?[a-zA-Z0-9]{1,3}\)\s|[①-⑳]|\||</?\w|!\[|```|\\(?:begin|end|\[))")
CELLS = re.compile(r"\.{4,}\s*\d|\t|\|.*\||</t[dr]>|\S {3,}\S.* {3,}\S|;\S[^;]*;\S")
SENTENCE_END = re.compile(r"[.!?…]+[\"'”’)\]»]*(?=\s|$)|[。！？]+[」』）”’]*")
ASIDE = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\]]*\]|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|‘[^’]*’|<[^<>]*>|\$[^$]*\$|\\\[.*?\\\]|https?://\S+")
BROKEN = re.compile(r"[-‐‑¬­]\n\s*")
NOT_LETTERS = re.compile(r"[\W\d_]+")
WIDE = re.compile(r"[぀-ヿ一-鿿가-힣]")


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names, or None."""
    if not isinstance(label, str):
        return None
    word = label.strip().lower()
    if word in LABELS:
        return LABELS[word]
    head = re.split(r"[-_ ]", word)[0]
    return head if head in CODES else LABELS.get(head)


def plain(text: str) -> str:
    """Lower-case words between single blanks, with a blank at both ends; wide letters are words of their own."""
    return " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def gram_hashes(text_codes: np.ndarray, order: int) -> np.ndarray:
    h = np.zeros(len(text_codes) - order + 1, np.uint64)
    for i in range(order):
        h = (h ^ text_codes[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h ^ np.uint64(order)) >> np.uint64(24)


def all_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every n-gram."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    who = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    owners, hashes = [], []
    for order in ORDERS:
        if len(codes) < order:
            continue
        n = len(codes) - order + 1
        inside = (ends[who[:n]] - np.arange(n)) >= order
        if order == 1:
            inside &= codes[:n] != 32
        owners.append(who[:n][inside])
        hashes.append(gram_hashes(codes, order)[inside])
    return np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def ranked(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, most frequent first: owner, hash, rank, count."""
    key = np.sort((owners.astype(np.uint64) << np.uint64(40)) | hashes)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    owner = (key >> np.uint64(40)).astype(np.int64)
    order = np.argsort(owner * (1 << 24) - np.minimum(count, (1 << 23)), kind="stable")
    owner, key, count = owner[order], key[order], count[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    return owner, key & np.uint64((1 << 40) - 1), rank, count


class Profiles:
    """Ranks of the n-grams of each language, looked up by hash."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.languages = sorted(counts)
        places: dict[int, list[int]] = {}
        for j, language in enumerate(self.languages):
            top = sorted(counts[language].items(), key=lambda x: (-x[1], x[0]))[:PROFILE]
            for rank, (h, _) in enumerate(top):
                places.setdefault(h, [-1] * len(self.languages))[j] = rank
        self.hashes = np.array(sorted(places), np.uint64)
        self.ranks = np.array([places[int(h)] for h in self.hashes], np.int32).reshape(len(self.hashes), len(self.languages))

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each text to each language, from 0 to 1; 1 for a text without n-grams."""
        out = np.ones((len(texts), len(self.languages)))
        start, total = 0, 0
        for i, t in enumerate([*texts, None]):
            if t is None or (total and total + len(t) > GRAMS_AT_ONCE):
                if i > start:
                    out[start:i] = self._distances(texts[start:i])
                start, total = i, 0
            total += len(t or "")
        return out

    def _distances(self, texts: list[str]) -> np.ndarray:
        owner, h, rank, _ = ranked(*all_grams(texts))
        if len(owner) == 0 or len(self.hashes) == 0:
            return np.ones((len(texts), len(self.languages)))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        n = np.bincount(owner, minlength=len(texts))
        out = np.empty((len(texts), len(self.languages)))
        own, places, rank = owner[known], self.ranks[at[known]], np.minimum(rank[known], PROFILE)
        for j in range(len(self.languages)):
            saved = np.where(places[:, j] >= 0, PROFILE - np.abs(places[:, j] - rank), 0)
            out[:, j] = 1 - np.bincount(own, saved, len(texts)) / (PROFILE * np.maximum(n, 1))
        return out


def train(documents: DataFrame, text_col: str = "text", label_col: str = "lang", docs_per_language: int = TRAINING_DOCS) -> Profiles:
    """Profiles from labelled documents: at most ``docs_per_language`` of each language, chosen by hash of the id."""
    code = F.lower(F.trim(label_col))
    labelled = documents.where(F.col(label_col).isNotNull() & (F.length(text_col) >= 100) & (F.length(text_col) < 20000) & code.isin(*NAMES)).select(code.alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    share = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each known code
    bound = F.lit(False)
    for row in share:
        # The hash is uniform: this keeps about docs_per_language documents of each language.
        bound = bound | ((F.col("lang") == row["lang"]) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, docs_per_language / row["n"]) * (1 << 30))))

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            proses = [plain(" ".join(clean(text[a:b]) for a, b, _ in sentences(text)) or text) for text in texts]
            where = np.array([names.index(x) for x in langs], np.int64)
            owner, h = all_grams(proses)
            owner, h, _, count = ranked(where[owner], h)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in owner]), pa.array(h.astype(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "h", "n"])

    grams = labelled.where(bound).select("lang", "text").mapInArrow(run, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    counts.update({row["lang"]: {} for row in share})
    # At most PROFILE rows of each language come to the driver.
    best = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).where(F.col("r") <= PROFILE)
    for row in best.collect():
        counts[row["lang"]][row["h"]] = row["n"]
    return Profiles(counts)


def clean(sentence: str) -> str:
    return ASIDE.sub(" ", BROKEN.sub("", sentence))


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """Start, end and wholeness of the pieces of running text; headings, list items and table rows are left out."""
    out: list[tuple[int, int, bool]] = []
    block, at = None, 0

    def close(end: int):
        if block is None:
            return
        last = block
        for m in SENTENCE_END.finditer(text, block, end):
            out.append((last, m.end(), True))
            last = m.end()
        if text[last:end].strip():
            out.append((last, end, False))

    for line in text.split("\n"):
        end = at + len(line)
        if not line.strip() or ITEM.match(line) or CELLS.search(line):
            close(at)
            block = None
        elif block is None:
            block = at
        at = end + 1
    close(len(text))
    return out


def is_sentence(words: str) -> bool:
    """At least four words, or eight wide letters."""
    return words.count(" ") >= 5 or len(WIDE.findall(words)) >= 8


SEGMENTS = "id string, segment int, start int, end int, lang string, confidence double, sentences int, chars bigint"


def segments(items: DataFrame, profiles: Profiles, id_col: str, text_col: str) -> DataFrame:
    """``id, segment, start, end, lang, confidence, sentences, chars`` of the runs of sentences in one language.

    Null and blank texts give no rows; a text without running text is one segment without sentences. Confidence is
    the lead of the nearest profile over the next, 0 where no profile fits. Text is read whole, in the task that
    holds the row; only the profiles (at most PROFILE ranks of each language) are shipped.
    """

    def run(batches):
        for batch in batches:
            rows, texts = [], []
            for number, text in enumerate(batch.column(1).to_pylist()):
                if not text or not text.strip():
                    continue
                found = sentences(text)
                if not any(whole for *_, whole in found):
                    found = [*found] or [(0, len(text), False)]
                for a, b, whole in found:
                    words = plain(clean(text[a:b]))
                    if len(words) > 2:
                        rows.append((number, a, b, whole and is_sentence(words), len(words) - 2 + len(WIDE.findall(words))))
                        texts.append(words)
            yield from assemble(batch, rows, profiles.distances(texts))

    def assemble(batch, rows, distance):
        if not profiles.languages:
            rows = []
        order = np.argsort(distance, axis=1, kind="stable")
        line = np.arange(len(rows))
        line = line[: len(rows)]
        first = distance[line, order[:, 0]] if len(rows) else np.zeros(0)
        second = distance[line, order[:, 1]] if len(rows) and distance.shape[1] > 1 else np.ones(len(rows))
        lead = np.where(first < 1, (second - first) / np.maximum(second, 1e-9), 0.0)
        ids, out, current = batch.column(0).to_pylist(), [], None
        for i, (number, a, b, whole, size) in enumerate(rows):
            language = profiles.languages[order[i, 0]] if first[i] < 1 else None
            whole = whole and lead[i] >= SURE
            if current and current[0] == number and (current[3] == language or (not whole and lead[i] < SURE)):
                current[2], current[4], current[5], current[6] = b, current[4] + lead[i] * size, current[5] + int(whole), current[6] + size
            else:
                if current:
                    out.append(current)
                current = [number, a, b, language, lead[i] * size, int(whole), size]
        if current:
            out.append(current)
        place, last = 0, None
        columns = [[] for _ in range(8)]
        for number, a, b, language, weight, count, size in out:
            place = place + 1 if number == last else 0
            last = number
            for column, value in zip(columns, (ids[number], place, a, b, language, float(weight / max(size, 1)), count, size)):
                column.append(value)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "segment", "start", "end", "lang", "confidence", "sentences", "chars"])

    source = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SEGMENTS)


def documents_of(segmented: DataFrame) -> DataFrame:
    """``id, lang, confidence, languages``: the language of the greater part, and those with a whole sentence."""
    by = segmented.where(F.col("lang").isNotNull()).groupBy("id", "lang").agg(F.sum("chars").alias("chars"), F.sum("sentences").alias("sentences"), F.sum(F.col("confidence") * F.col("chars")).alias("weight"))
    return by.groupBy("id").agg(
        F.max_by("lang", F.struct("chars", "lang")).alias("lang"),
        (F.max_by("weight", F.struct("chars", "lang")) / F.max("chars")).alias("confidence"),
        F.array_sort(F.collect_set(F.when(F.col("sentences") > 0, F.col("lang")))).alias("languages"),
    )


def every_item(items: DataFrame, id_col: str, told: DataFrame) -> DataFrame:
    """``documents_of`` with a row for each distinct id of ``items``: ``und`` with confidence 0 where nothing was told."""
    ids = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id")).distinct()
    return ids.join(told, "id", "left").select("id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"))


def label_codes(column: F.Column) -> F.Column:
    """``label_code`` as a column expression."""
    word = F.lower(F.trim(column))
    head = F.split(word, r"[-_ ]")[0]
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(table[word], F.when(head.isin(*sorted(CODES)), head), table[head])
