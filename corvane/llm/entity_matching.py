"""Matching entities across sources without keys by loopy belief propagation.

Nothing about kinds of things is given; it is learnt from all names. A word that stands beside many different words is
general, the others are proper. Two general parts that stand at the same proper names more often than chance are
spellings of one kind, two types likewise of one class; how much a kind or class says about another is the ratio of
how often they meet at a proper name to chance. Proper names within one edit lead to the most frequent of them.

A candidate is a pair of the mentions of one name in a document and a thing of the graph (nodes of one proper name and
kind). One-to-one factors say that mentions are at most one thing and that a thing has one name in a document; where two
candidates of a document are related in the extraction and in the graph, a pair factor supports both. Messages are
exchanged through joins until they no longer change, and the marginals are the confidences.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.plans.lineage import cut, written

#: Names that name nothing.
PLACEHOLDERS = re.compile(r"^(?:|name|entity ?name|type|none|null|nil|n a|na|unknown|untitled|entity|concept|tbd|test|(?:figure|table|image|fig) ?\d*|\W+)$")
#: Letters that do not decompose, and the Revised Romanization of Hangul.
PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "ı": "i"})
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()

#: A word is general if it stands beside words with so many different beginnings, and beside so many different words
#: as a share of the names.
COMPANIONS, GENERAL = 8, 5e-4
#: General parts and types are learnt if they have so large a share of the names; at most so many are clustered.
LEARNT, CLUSTERED = 2e-4, 600
#: Pairs are clustered while they meet so much more often than chance (natural logarithm); added to both counts.
TOGETHER, SMOOTH = 1.5, 0.25
#: Two kinds are different so far as the rarer was seen more often than so; the least probability that evidence gives.
SEEN, FLOOR = 10.0, 0.003
#: What each edit of a proper name costs in log-odds, and the least probability of a candidate.
EDIT, LEAST = 1.1, 0.02
#: Words of so many letters are compared with edits; names that share a key in greater numbers are keyed more closely.
EDITED, CROWD = 4, 64
#: Messages have settled when none changes by so much (log-odds).
PAIR_WEIGHT, DAMPING, SETTLED, FAR = 1.5, 0.15, 0.01, 200


def romanised(word: str) -> str:
    out = []
    for c in word:
        i = ord(c) - 0xAC00
        if 0 <= i < 11172:
            out += [INITIALS[i // 588], VOWELS[i // 28 % 21], FINALS[i % 28]]
        else:
            out.append(c)
    return "".join(out).replace("-", "")


def words_of(name: str | None) -> list[str] | None:
    """The words of a name without case, accents and marks, in Latin letters where it is Hangul; None for placeholders."""
    if not isinstance(name, str):
        return None
    text = unicodedata.normalize("NFKD", name.translate(PLAIN))
    text = unicodedata.normalize("NFC", "".join(c for c in text if not 0x300 <= ord(c) < 0x370))
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    if PLACEHOLDERS.match(" ".join(words)):
        return None
    return [romanised(w) for w in words]


def shortened(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


def spelled(names: DataFrame) -> DataFrame:
    """``name, words`` of distinct names; placeholders are dropped."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [words_of(n) for n in names]
            kept = [i for i, w in enumerate(found) if w]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in kept], pa.string()), pa.array([found[i] for i in kept], pa.list_(pa.string()))], names=["name", "words"])

    return names.select("name").where("name is not null").distinct().mapInArrow(run, "name string, words array<string>")


def general_words(words: DataFrame) -> set[str]:
    """Words that stand beside many different words. Counted over all names; as each has at least the share GENERAL of
    the names, their number is bounded by the mean length of a name over GENERAL. Misspellings of one word begin
    alike, so beginnings of two letters are counted too."""
    names = words.count()
    beside = words.select(F.explode("words").alias("w"), "words").select("w", F.explode(F.array_except("words", F.array("w"))).alias("v"))
    beside = cut(beside.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")))

    def wide(rows: DataFrame) -> set[str]:
        found = rows.withColumn("b", F.substring("v", 1, 2)).groupBy("w", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("w").agg(F.count(F.lit(1)).alias("beginnings"), F.sum("n").alias("n"))
        return {r["w"] for r in found.where((F.col("beginnings") >= COMPANIONS) & (F.col("n") >= GENERAL * names)).collect()}

    first = wide(beside)
    if not first:
        return first
    # A proper word of many things stands beside many general ones, but beside few that are not.
    listed = words.sparkSession.createDataFrame([(w,) for w in sorted(first)], "v string")
    return first & wide(beside.join(listed, "v", "left_anti").join(listed.withColumnRenamed("v", "w"), "w", "left_semi"))


class Parts:
    """Splits the words of a name into its proper name and its general part."""

    def __init__(self, general: set[str]):
        self.general = general
        self.near: dict[str, str] = {}
        for g in sorted(general):
            if len(g) >= 6:
                for s in [g, *shortened(g)]:
                    self.near.setdefault(s, g)

    def general_form(self, word: str) -> str | None:
        """The general word that ``word`` is, or is a misspelling of by one letter."""
        if word in self.general:
            return word
        if len(word) >= 6:
            for s in [word, *shortened(word)]:
                if s in self.near:
                    return self.near[s]
        return None

    def split(self, words: list[str]) -> tuple[str, str]:
        forms = [self.general_form(w) for w in words]
        own = [w for w, g in zip(words, forms) if g is None]
        if not own:
            own, forms = words, []
        if len(own) == 1 and len(own[0]) >= 10:  # two names written as one
            half = len(own[0]) // 2
            own = [own[0][:half], own[0][half:]]
        return f"{own[0]} {''.join(own[1:])}".strip(), "".join(g for g in forms if g)


def parted(words: DataFrame, general: set[str]) -> DataFrame:
    """``name, proper, part``."""
    shared = words.sparkSession.sparkContext.broadcast(Parts(general))

    def run(batches):
        parts = shared.value
        for batch in batches:
            both = [parts.split(w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([b[i] for b in both], pa.string()) for i in (0, 1)]], names=["name", "proper", "part"])

    return words.mapInArrow(run, "name string, proper string, part string")


class Kinds:
    """Kinds (clusters of general parts) and classes (clusters of types), and what each says about another.

    ``met`` has for every two descriptors how often they meet at one proper name. Number 0 of kinds and of classes
    stands for none. ``odds[a, b]`` are the log-odds that two records of one proper name are one thing."""

    def __init__(self, parts: list[str], types: list[str], met: np.ndarray):
        n = len(parts)
        labels = np.concatenate([clusters(met[:n, :n]), n + clusters(met[n:, n:])]) if len(met) else np.zeros(0, np.int64)
        _, group = np.unique(labels, return_inverse=True)
        self.kinds = int(group[:n].max()) + 1 if n else 0
        groups = int(group.max()) + 1 if len(group) else 0
        self.kind_of = {p: int(g) + 1 for p, g in zip(parts, group[:n])}
        self.class_of = {t: int(g) - self.kinds + 1 for t, g in zip(types, group[n:])}
        member = np.zeros((groups, len(group)))
        member[group, np.arange(len(group))] = 1
        joined = member @ met @ member.T
        k = self.kinds
        self.same = 0.8  # how probably two records of one proper name are one thing, whatever their kinds
        kk = joined[:k, :k]
        if kk.sum() > 0:
            self.same = float(np.clip(np.trace(kk) / kk.sum(), 0.5, 0.98))
        rarer = np.minimum.outer(kk.sum(1), kk.sum(1))
        seen, least, none = rarer / (rarer + SEEN), np.log(FLOOR / (1 - FLOOR)), np.log(self.same / (1 - self.same))
        self.kind_kind = self.odds(kk)
        self.kind_kind[1:, 1:] = np.where(np.eye(k, dtype=bool), self.kind_kind[1:, 1:], seen * least + (1 - seen) * none)
        self.kind_class, self.class_class = self.odds(joined[:k, k:]), self.odds(joined[k:, k:])
        self.none = float(np.log(self.same / (1 - self.same)))

    def odds(self, met: np.ndarray) -> np.ndarray:
        """Log-odds of being one thing, with a row and a column 0 for no descriptor. With a share ``same`` of one thing
        and else chance, the probability is 1 - (1 - same) * chance / met."""
        expected = met.sum(1, keepdims=True) * met.sum(0, keepdims=True) / max(met.sum(), 1e-9)
        ratio = (met + SMOOTH) / (expected + SMOOTH)
        p = np.clip(1 - (1 - self.same) / ratio, FLOOR, 1 - FLOOR)
        out = np.full((met.shape[0] + 1, met.shape[1] + 1), np.log(self.same / (1 - self.same)))
        out[1:, 1:] = np.log(p / (1 - p))
        return out

    def evidence(self, kind_x: np.ndarray, class_x: np.ndarray, kind_y: np.ndarray, class_y: np.ndarray) -> np.ndarray:
        """Kinds decide where both are known, else a kind and a class, else the classes."""
        of_classes = np.where(kind_x > 0, self.kind_class[kind_x, class_y], np.where(kind_y > 0, self.kind_class[kind_y, class_x], self.class_class[class_x, class_y]))
        return np.where((kind_x > 0) & (kind_y > 0), self.kind_kind[kind_x, kind_y], of_classes)


def clusters(met: np.ndarray) -> np.ndarray:
    """Descriptors are joined, those that meet most above chance first, while they meet far more often than chance."""
    n = len(met)
    label = np.arange(n)
    if n < 2 or met.sum() == 0:
        return label
    alive = list(np.argsort(-met.sum(1), kind="stable")[:CLUSTERED])
    m = met[np.ix_(alive, alive)].astype(float)
    total, names = m.sum(), np.array(alive)
    while len(m) > 1:
        r = m.sum(1)
        link = np.log((m + SMOOTH) / (np.outer(r, r) / total + SMOOTH))
        np.fill_diagonal(link, -np.inf)
        a, b = sorted(np.unravel_index(int(link.argmax()), link.shape))
        if link[a, b] < TOGETHER:
            break
        m[a] += m[b]
        m[:, a] += m[:, b]
        m = np.delete(np.delete(m, b, 0), b, 1)
        label[label == label[names[b]]] = label[names[a]]
        names = np.delete(names, b)
    return label


def learn(records: DataFrame) -> Kinds:
    """``records``: ``proper, part, type`` of every record. Which parts and types stand at one proper name is counted
    over all records, once for each name, with itself if two records have it; only the counts of learnt descriptors come to the driver: as each has at least
    the share LEARNT of the records, at most 1 / LEARNT parts and as many types."""
    d = records.select("proper", F.explode(F.array(F.concat(F.lit("p"), "part"), F.concat(F.lit("t"), "type"))).alias("d")).where(F.length("d") > 1)
    per_name = cut(d.groupBy("proper", "d").agg(F.count(F.lit(1)).alias("n")))
    total = records.count()
    rows = per_name.groupBy("d").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, LEARNT * total)).collect()
    names = sorted(r["d"] for r in rows)
    ids = {x: i for i, x in enumerate(names)}
    shared = records.sparkSession.sparkContext.broadcast(ids)
    size = len(names)

    def run(batches):
        ids = shared.value
        for batch in batches:
            left, right = [], []
            for found in batch.column(0).to_pylist():
                own = np.array([ids[x["d"]] for x in found], np.int64)
                a, b = np.nonzero(~np.diag([x["n"] < 2 for x in found]))
                left.append(own[a])
                right.append(own[b])
            code, n = np.unique(np.concatenate(left) * size + np.concatenate(right), return_counts=True) if left else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    learnt = per_name.join(records.sparkSession.createDataFrame([(x,) for x in names], "d string"), "d", "left_semi").groupBy("proper").agg(F.collect_list(F.struct("d", "n")).alias("found")).select("found")
    counts = learnt.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    met = np.zeros(size * size)
    met[np.asarray(counts.column("code"))] = np.asarray(counts.column("n"))
    return Kinds([x[1:] for x in names if x[0] == "p"], [x[1:] for x in names if x[0] == "t"], met.reshape(size, size))


def described(records: DataFrame, shared) -> DataFrame:
    """``part, type`` become ``kind, class`` (0 for none)."""
    others = [c for c in records.columns if c not in ("part", "type")]

    def run(batches):
        kinds = shared.value
        for batch in batches:
            columns = [batch.column(i) for i in range(len(others))]
            part, of_type = batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*columns, pa.array([kinds.kind_of.get(p, 0) for p in part], pa.int32()), pa.array([kinds.class_of.get(t, 0) for t in of_type], pa.int32())], names=[*others, "kind", "class"])

    schema = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in others)
    return records.select(*others, "part", "type").mapInArrow(run, f"{schema}, kind int, class int")


def edited(propers: DataFrame) -> DataFrame:
    """``p, q, np, nq, d``, both ways: proper names of which each of the two words may differ by an edit or by two
    neighbouring letters changed over, or one by two edits, with their numbers of records and the edits.

    Two words within one edit are equal after one letter is left out of one or both. A key is one word without one
    letter, or whole, with the first and last letter of the other, so names are lost only if an end of either word
    differs. Where many names share a key, what stands between those ends without up to two letters is added to it:
    other words within two edits meet there too, so all pairs are found whatever the size of a group."""
    less = lambda w: F.array_distinct(F.concat(F.array(F.col(w)), F.when(F.length(w) >= EDITED, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))))
    ends = lambda w: F.concat(F.substring(w, 1, 1), F.right(F.col(w), F.lit(1)))
    halves = propers.withColumn("a", F.split("proper", " ")[0]).withColumn("b", F.coalesce(F.get(F.split("proper", " "), F.lit(1)), F.lit("")))
    keyed = lambda w, other, side: F.transform(less(w), lambda x: F.struct(F.xxhash64(F.lit(side), x, ends(other)).alias("key"), F.lit(side).alias("side")))
    keys = F.concat(keyed("a", "b", 1), F.when(F.length("b") > 0, keyed("b", "a", 2)).otherwise(F.array().cast("array<struct<key:bigint,side:int>>")))
    table = halves.select(F.explode(keys).alias("k"), "proper", "n").select("k.*", F.col("proper").alias("p"), "n")
    met = cut(table.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("of > 1"))
    few, many = met.where(F.col("of") <= CROWD).select("key", "p", "n"), met.where(F.col("of") > CROWD)
    if not many.isEmpty():
        many = many.withColumn("w", F.coalesce(F.get(F.split("p", " "), F.when(F.col("side") == 1, 1).otherwise(0)), F.lit("")))
        out = lambda w: F.array_distinct(F.concat(F.array(w), F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))))
        inner = many.withColumn("w", F.when(F.length("w") > 2, F.substr("w", F.lit(2), F.length("w") - 2)).otherwise(F.lit("")))
        nearer = inner.withColumn("w", F.array_distinct(F.flatten(F.transform(out(F.col("w")), out))))
        few = few.union(nearer.select(F.explode(F.transform("w", lambda x: F.xxhash64("key", x))).alias("key"), "p", "n"))
    pairs = few.join(few.select("key", F.col("p").alias("q"), F.col("n").alias("nq")), "key").where("p < q").select("p", "q", F.col("n").alias("np"), "nq").distinct()
    word = lambda c, i: F.coalesce(F.get(F.split(c, " "), F.lit(i)), F.lit(""))
    edits = [F.levenshtein(word("p", i), word("q", i)) for i in (0, 1)]
    close = cut(pairs.withColumn("d", edits[0] + edits[1]).where((edits[0] <= 2) & (edits[1] <= 2) & (F.col("d") <= 4)))
    return close.union(close.select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("nq").alias("np"), F.col("np").alias("nq"), "d"))


def roots(edges: DataFrame) -> DataFrame:
    """``p, root`` of names that have a neighbour within an edit: a rare form leads to its most frequent neighbour, and
    so on. A form that is found half as often as its neighbour is a name of its own. Chains rise in frequency, so they
    end; they are halved until none is left."""
    leads = F.col("nq") >= 2 * F.col("np")
    single = (F.col("np") == 1) & ((F.col("nq") > 1) | (F.col("q") > F.col("p")))
    best = F.max(F.when((F.col("d") <= 2) & (leads | single), F.struct("nq", "q")))
    steps = written(edges.groupBy("p").agg(best.alias("best")).select("p", F.coalesce("best.q", "p").alias("root")))
    while True:
        further = steps.join(steps.select(F.col("p").alias("root"), F.col("root").alias("next")), "root", "left")
        new = written(further.select("p", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        steps = new.select("p", "root")
        if new.where("moved").isEmpty():
            return steps


def propagate(candidates: DataFrame, pairs: DataFrame, most: int = FAR) -> DataFrame:
    """``c, confidence`` from ``c, x, y, theta`` and the pair factors ``c, d`` (one row each).

    ``x`` and ``y`` are the groups of the two one-to-one factors. Messages are log-odds. A one-to-one factor tells a
    candidate ``-log(1 + sum of the odds of the others)``; a pair factor tells it how much more probable it is if the
    other holds. A candidate without rivals and without pairs has its marginal at once. The others exchange messages
    until none changes by more than SETTLED; messages are damped, more so after 20 rounds, and an error is raised if
    they have not settled after ``most`` rounds. With ``most`` 0 no messages are sent."""
    sigmoid = lambda t: 1 / (1 + F.exp(-t))
    if most == 0:
        return candidates.select("c", sigmoid(F.col("theta")).alias("confidence"))
    ends = pairs.select("c").union(pairs.select(F.col("d").alias("c"))).distinct().withColumn("paired", F.lit(True))
    size = lambda key: F.count(F.lit(1)).over(Window.partitionBy(key))
    known = written(candidates.select("c", "x", "y", "theta").withColumn("in_x", size("x")).withColumn("in_y", size("y")).join(ends, "c", "left"))
    alone = (F.col("in_x") == 1) & (F.col("in_y") == 1) & F.col("paired").isNull()
    settled = known.where(alone).select("c", sigmoid(F.col("theta")).alias("confidence"))
    zero = F.lit(0.0)
    box = pairs.select("c", "d").union(pairs.select(F.col("d").alias("c"), F.col("c").alias("d"))).groupBy("c").agg(F.collect_list(F.struct("d", zero.alias("m"))).alias("inbox"))
    empty = F.array().cast("array<struct<d:bigint,m:double>>")
    state = written(known.where(~alone).join(box, "c", "left").select("c", "x", "y", "theta", zero.alias("from_x"), zero.alias("from_y"), zero.alias("support"), F.coalesce("inbox", empty).alias("inbox")))
    if state.isEmpty():
        return settled
    odds = lambda e: F.exp(F.greatest(F.least(e, F.lit(30.0)), F.lit(-30.0)))
    others = lambda key, to: F.greatest(F.sum(to).over(Window.partitionBy(key)) - F.col(to), zero)
    for step in range(1, most + 1):
        keep = DAMPING if step <= 20 else min(0.95, DAMPING + 0.03 * (step - 20))
        damped = lambda old, new, keep=keep: F.col(old) * keep + new * (1 - keep)
        belief = F.col("theta") + F.col("from_x") + F.col("from_y") + F.col("support")
        sent = state.select("c", belief.alias("h"), F.explode("inbox").alias("i")).withColumn("h", F.col("h") - F.col("i.m"))
        told = F.log((1 + odds(F.col("h") + PAIR_WEIGHT)) / (1 + odds(F.col("h"))))
        boxes = sent.select(F.col("i.d").alias("c"), F.struct(F.col("c").alias("d"), told.alias("m")).alias("i")).groupBy("c").agg(F.collect_list("i").alias("inbox"))
        now = state.drop("inbox").join(boxes, "c", "left").withColumn("inbox", F.coalesce("inbox", empty)).withColumn("new", F.aggregate("inbox", zero, lambda s, i: s + i["m"]))
        now = now.withColumn("to_x", odds(F.col("theta") + F.col("from_y") + F.col("new"))).withColumn("to_y", odds(F.col("theta") + F.col("from_x") + F.col("new")))
        now = now.withColumn("new_x", damped("from_x", -F.log1p(others("x", "to_x")))).withColumn("new_y", damped("from_y", -F.log1p(others("y", "to_y"))))
        moved = F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in (("new_x", "from_x"), ("new_y", "from_y"), ("new", "support"))])
        state = written(now.select("c", "x", "y", "theta", F.col("new_x").alias("from_x"), F.col("new_y").alias("from_y"), F.col("new").alias("support"), "inbox", moved.alias("moved")))
        if state.agg(F.max("moved").alias("m")).first()["m"] < SETTLED:
            break
    else:
        raise RuntimeError(f"messages have not settled after {most} rounds")
    total = F.col("theta") + F.col("from_x") + F.col("from_y") + F.col("support")
    return settled.union(state.select("c", sigmoid(total).alias("confidence")))


def candidates_of(mentions: DataFrame, things: DataFrame, links: DataFrame, shared) -> DataFrame:
    """``m, thing, document_id, theta``: mentions ``(m, document_id, proper, kind, class)`` with the things
    ``(thing, root, kind, class)`` of the names that ``links (proper, root, d)`` lead to."""
    met = mentions.join(links, "proper").join(things.withColumnRenamed("kind", "kind_y").withColumnRenamed("class", "class_y"), "root")

    def run(batches):
        kinds = shared.value
        for batch in batches:
            kx, cx, ky, cy, d = (np.asarray(batch.column(i)) for i in range(3, 8))
            theta = kinds.evidence(kx, cx, ky, cy) - EDIT * d
            kept = theta >= np.log(LEAST / (1 - LEAST))
            columns = [batch.column(i) for i in range(3)] + [pa.array(theta, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["m", "thing", "document_id", "theta"]).filter(pa.array(kept))

    found = met.select("m", "thing", "document_id", "kind", "class", "kind_y", "class_y", "d").mapInArrow(run, "m bigint, thing bigint, document_id string, theta double")
    return found.groupBy("m", "thing").agg(F.max("theta").alias("theta"), F.first("document_id").alias("document_id"))


def with_kinds(nodes: DataFrame, kinds_of_roots: DataFrame, shared) -> DataFrame:
    """Nodes ``(node_id, root, kind, class)`` without a kind get the only one that any record of their name has and
    that their class does not speak against."""

    def run(batches):
        kinds = shared.value
        for batch in batches:
            c, k = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            fits = kinds.kind_class[k, c] > np.minimum(kinds.none, 0.5) - 1e-9
            yield batch.filter(pa.array(fits))

    told = nodes.where("kind = 0").select("node_id", "class", "root").join(kinds_of_roots, "root").select("node_id", "class", "k").mapInArrow(run, "node_id string, class int, k int")
    only = told.groupBy("node_id").agg(F.min("k").alias("k"), F.max("k").alias("last")).where("k = last").select("node_id", "k")
    return nodes.join(only, "node_id", "left").withColumn("kind", F.coalesce("k", "kind")).drop("k")


def match_entities(extractions: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = FAR) -> DataFrame:
    """``document_id, entity_id, node_id, confidence`` of every candidate match.

    A document delivered repeatedly counts once, the latest wins; repeated node rows count once. Null and
    placeholder names match nothing; null types are no evidence, and vague ones that stand at all names alike are none
    either. Names that many rows bear are compared once. Null relations, and edges to nodes that are not there, support
    nothing. Empty tables give no matches. Other columns are not read. ``most`` is the bound of ``propagate``.
    """
    spark = extractions.sparkSession
    latest = extractions.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max_by(F.struct("entities", "relations"), F.coalesce("extracted_at", F.lit("1970-01-01").cast("timestamp"))).alias("e")).select("document_id", "e.*")
    latest = cut(latest)
    entities = latest.select("document_id", F.explode("entities").alias("e")).where("e.entity_id is not null").select("document_id", "e.entity_id", "e.name", "e.type").distinct()
    known = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("name", "type")).alias("n")).select(F.col("id").alias("node_id"), "n.*")
    words = cut(spelled(entities.select("name").union(known.select("name"))))
    parts = cut(parted(words, general_words(words)))
    of_type = F.coalesce(F.lower(F.trim("type")), F.lit("")).alias("type")
    entities = cut(entities.join(parts, "name").select("document_id", "entity_id", "proper", "part", of_type))
    known = cut(known.join(parts, "name").select("node_id", "proper", "part", of_type))
    kinds = learn(entities.select("proper", "part", "type").union(known.select("proper", "part", "type")))
    shared = spark.sparkContext.broadcast(kinds)
    entities, known = described(entities, shared), described(known, shared)

    propers = entities.select("proper").union(known.select("proper")).groupBy("proper").agg(F.count(F.lit(1)).alias("n"))
    near = edited(propers)
    led = roots(near)
    to_root = lambda rows: rows.join(led.withColumnRenamed("p", "proper"), "proper", "left").withColumn("root", F.coalesce("root", "proper"))
    entities, known = cut(to_root(entities)), cut(to_root(known))
    kinds_of_roots = entities.where("kind > 0").select("root", F.col("kind").alias("k")).union(known.where("kind > 0").select("root", "kind")).distinct()
    alone = F.when(F.col("kind") == 0, F.col("class")).otherwise(F.lit(0))  # without a kind, the class is what is known
    node_rows = cut(with_kinds(known, kinds_of_roots, shared).withColumn("class", alone).select("node_id", "root", "kind", "class", F.xxhash64("root", "kind", "class").alias("thing")))
    things = node_rows.select("thing", "root", "kind", "class").distinct()

    mentions = cut(entities.withColumn("m", F.xxhash64("document_id", "root", "kind", alone)).select("document_id", "entity_id", "m", "proper", "root", "kind", "class"))
    reached = near.select("p", "q").join(led.select(F.col("p").alias("q"), "root"), "q").select(F.col("p").alias("proper"), "root")
    own = mentions.select("proper", "root")
    links = reached.union(own).distinct().withColumn("d", F.levenshtein("proper", "root"))
    names = mentions.select("m", "document_id", "proper", "kind", "class").distinct()
    found = candidates_of(names, things, links, shared)
    candidates = cut(found.select(F.xxhash64("m", "thing").alias("c"), F.col("m").alias("x"), F.xxhash64("document_id", "thing").alias("y"), "theta", "document_id", "m", "thing"))

    # Two candidates of one document support each other if their entities and their things are related.
    sides = latest.select("document_id", F.explode("relations").alias("r")).select("document_id", "r.source_id", "r.target_id").where("source_id is not null and target_id is not null").distinct()
    who = mentions.select("document_id", "entity_id", "m").join(candidates.select("m", "thing", "c"), "m").select("document_id", "entity_id", "thing", "c")
    related = sides.join(who.select("document_id", F.col("entity_id").alias("source_id"), F.col("thing").alias("t"), "c"), ["document_id", "source_id"]).join(who.select("document_id", F.col("entity_id").alias("target_id"), F.col("thing").alias("u"), F.col("c").alias("d")), ["document_id", "target_id"])
    at = node_rows.select("node_id", "thing")
    joined = edges.select("src", "tgt").distinct().join(at.select(F.col("node_id").alias("src"), F.col("thing").alias("t")), "src").join(at.select(F.col("node_id").alias("tgt"), F.col("thing").alias("u")), "tgt").select("t", "u").distinct()
    pairs = related.join(joined, ["t", "u"]).where("c <> d").select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()
    marginals = propagate(candidates, cut(pairs), most)
    decided = candidates.select("c", "m", "thing").join(marginals, "c").select("m", "thing", "confidence")
    return mentions.select("document_id", "entity_id", "m").join(decided, "m").join(node_rows.select("thing", "node_id"), "thing").select("document_id", "entity_id", "node_id", "confidence")
