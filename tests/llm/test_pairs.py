"""Near copies, neighbours and entity matches against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import entity_matching, near_copies, vector_neighbours


def jaccard(a, b):
    a, b = near_copies.normal(a), near_copies.normal(b)
    x, y = Counter(a[i : i + 5] for i in range(len(a) - 4)), Counter(b[i : i + 5] for i in range(len(b) - 4))
    return sum((x & y).values()) / sum((x | y).values())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(70)] for _ in range(60)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for edits in (1, 3, 6, 10):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return out + [out[0], "  " + out[0].upper() + " "]


def test_similarity_is_exact(texts):
    pairs = [(near_copies.normal(a), near_copies.normal(b)) for a, b in zip(texts, texts[1:])]
    assert np.allclose(near_copies.similarities(pairs), [jaccard(a, b) for a, b in pairs])
    assert near_copies.similarities([("ab", "ab"), ("ab", "abc"), ("aaaaaaa", "aaaaaaaaa")]).tolist() == [1.0, 0.0, 3 / 5]


def test_near_copies_against_brute_force(spark, texts):
    rows = [(f"k{i:03d}", t, "x") for i, t in enumerate(texts)]
    rows += [("short", "tiny", "x"), ("none", None, "x"), (None, texts[0], "x"), ("k000", texts[0], "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, copy string")
    members, links = near_copies.near_copies(df)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in near_copies.pairs_of_rows(members, links).collect()}
    true = {(a[0], b[0]) for i, a in enumerate(rows[: len(texts)]) for b in rows[i + 1 : len(texts)] if jaccard(a[1], b[1]) >= 0.7}
    assert got <= true and len(got & true) >= 0.97 * len(true)
    lines = near_copies.rows_with_links(members, links).collect()
    assert len(lines) == len(texts) and {r["class_id"] for r in lines if r["id"] in ("k000", "k300", "k301")} == {"k000"}


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert near_copies.pairs_of_rows(*near_copies.near_copies(df)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 64)) * 0.3).astype(np.float32)
    x[10:30] = x[10]  # more copies than there are neighbours
    rows = [(f"v{i:04d}", [float(c) for c in v], i) for i, v in enumerate(x)]
    odd = [("null", None, 1), ("wide", [1.0] * 32, 1), ("same", [0.5] * 64, 1), ("nan", [float("nan")] + [1.0] * 63, 1), ("inf", [float("inf")] + [1.0] * 63, 1), ("gap", [None] + [1.0] * 63, 1), ("v0001", [float(c) for c in x[1]], 9), (None, [float(c) for c in x[1]], 9)]
    return x.astype(np.float64), spark.createDataFrame(rows + odd, "id string, embedding array<float>, created_at int")


def test_neighbours_against_brute_force(spark):
    x, df = vectors(spark)
    rows = vector_neighbours.usable(df)
    assert rows.count() == len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 12)
    np.fill_diagonal(c, -2)
    true = {f"v{i:04d}": [f"v{j:04d}" for j in np.argsort(-c[i], kind="stable")[:10]] for i in range(len(x))}
    found = vector_neighbours.neighbours(rows)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert set(got) == set(true) and all(len(g) == 10 for g in got.values())
    cosine = lambda a, b: c[int(a[1:]), int(b[1:])]
    recall = sum(sum(cosine(i, j) >= cosine(i, true[i][-1]) - 1e-9 for j in got[i]) for i in true) / (10 * len(true))
    assert recall >= 0.9
    mutual = {(r["chunk_id_a"], r["chunk_id_b"]) for r in vector_neighbours.mutual_pairs(found, 0.9).collect()}
    exact = {(a, b) for a in true for b in true[a] if a < b and a in true[b] and c[int(a[1:]), int(b[1:])] >= 0.9}
    assert len(mutual & exact) >= 0.97 * len(exact) and len(mutual - exact) <= 0.01 * len(exact)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([], "id string, embedding array<float>, created_at int")
    assert vector_neighbours.neighbours(vector_neighbours.usable(df)).count() == 0
    one = spark.createDataFrame([("a", [float(i) for i in range(64)], 1), ("b", [float(i + 1) for i in range(64)], 1)], "id string, embedding array<float>, created_at int")
    assert sorted((r["id"], r["neighbour"]) for r in vector_neighbours.neighbours(vector_neighbours.usable(one)).collect()) == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize(
    "name,words",
    [("Index, Dorodu Nijano", "index dorodu nijano"), ("DoroduNijano Idx", "dorodu nijano idx"), ("the dorodu-nijano (Idx)", "the dorodu nijano idx"), ("게테조 지제디", "getejo jijedi"), ("Dørodu  Nijáno", "dorodu nijano"), ("n/a", None), (" ", None), (None, None), ("Figure 8", None), ("...", None)],
)
def test_words_of_names(name, words):
    assert entity_matching.words_of(name) == (words.split() if words else None)


EXTRACTIONS = "document_id string, entities array<struct<entity_id:string,name:string,type:string,chunk_id:int>>, relations array<struct<source_id:string,target_id:string,relation:string,chunk_id:int,document_id:string>>, extracted_at timestamp"
NODES, EDGES = "id string, name string, type string, doc_id string", "src string, tgt string, relation string, doc_id string"


def matched(spark, extractions, nodes, edges):
    df = entity_matching.match_entities(spark.createDataFrame(extractions, EXTRACTIONS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    return {(r["document_id"], r["entity_id"], r["node_id"]) for r in df.where("confidence > 0.5").collect()}


KINDS = {"Index": ("Idx", "Structure"), "Sensor": ("Sens", "Device"), "Laboratory": ("Lab", "Organisation"), "Protocol": ("Prot", "Standard"), "Encoder": ("Enc", "Model"), "Benchmark": ("Bench", "Data")}


def background(rng, things=240):
    """Documents and nodes that show which words are kinds and which spellings and types go together."""
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3)).title()
    docs, nodes, names = [], [], []
    for i in range(things):
        kind = rng.choice(sorted(KINDS))
        short, kind_of = KINDS[kind]
        name = f"{word()} {word()}"
        names.append((name, kind))
        docs.append((f"b{i}", [("e1", f"{name} {kind}", kind_of, 1)], None, None))
        docs.append((f"c{i}", [("e1", f"{name} {short}".upper() if i % 2 else f"{short}, {name}", rng.choice([kind_of, None, "Concept"]), 1)], None, None))
        nodes.append((f"b{i}", f"the {name} {rng.choice([kind, short])}", rng.choice([kind_of, "Concept", kind_of]), "x"))
    return docs, nodes, names, word


def test_matching(spark):
    from datetime import datetime

    docs, nodes, _, _ = background(random.Random(1))
    entities = [("e1", "Dorodu Nijano Index", "Structure", 1), ("e2", "Dorodu Nijano Sensor", "Device", 1), ("e3", "None", None, 1), ("e4", "Kapsai Hojebu Lab", "Organisation", 1), ("e5", "Zuzuta Wawami Index", "", 1), ("e6", "Mobibe Tatupi", "device", 1)]
    new = ("d", entities, [("e1", "e2", "uses", 1, "d")], datetime(2030, 1, 2))
    old = ("d", [("e9", "Dorodu Nijano Index", None, 1)], None, datetime(2030, 1, 1))
    nodes += [("n1", "dorodu nijano idx", None, "x"), ("n1", "dorodu nijano idx", None, "x"), ("n2", "Sensor, Dorodu Nijano", "device", "x"), ("n3", "Kapasi Hojebu Laboratory", "organisation", "x"), ("n4", "None", None, "x"), ("n5", None, None, "x"), ("n6", "MOBIBE TATUPI SENSOR", "Device", "x"), ("n7", "Mobibe Tatupi Protocol", "Standard", "x"), ("n8", "Dorodu Nijano Index", "Structure", "x")]
    got = matched(spark, [*docs, new, old, ("nothing", None, None, None)], nodes, [("n1", "n2", "uses", "x"), ("n1", "gone", None, "x")])
    assert {g for g in got if g[0] == "d"} == {("d", "e1", "n1"), ("d", "e1", "n8"), ("d", "e2", "n2"), ("d", "e4", "n3"), ("d", "e6", "n6")}
    rest = {g for g in got if g[0] != "d"}
    true = {(f"{s}{i}", "e1", f"b{i}") for i in range(240) for s in "bc"}
    assert len(rest & true) >= 0.98 * len(true) and len(rest - true) <= 0.02 * len(true)


def test_messages_decide_ambiguous_cases(spark):
    """Mentions without kind and type, of a name that two things have: only their relations tell which is meant."""
    docs, nodes, names, word = background(random.Random(2))
    edges, true = [], set()
    for i in range(40):
        name, (anchor, kind) = f"{word()} {word()}", names[i]
        nodes += [(f"x{i}", f"{name} Index", "Structure", "x"), (f"y{i}", f"{name} Sensor", "Device", "x")]
        meant = ("x", "y")[i % 2] + str(i)
        docs.append((f"a{i}", [("e1", f"{anchor} {kind}", None, 1), ("e2", name, None, 1)], [("e1", "e2", "uses", 1, "d")], None))
        edges.append((f"b{i}", meant, "uses", "x"))
        true.add((f"a{i}", "e2", meant))
    asked = {t[0] for t in true}
    tables = spark.createDataFrame(docs, EXTRACTIONS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)

    def scores(most):
        rows = entity_matching.match_entities(*tables, most=most).where("confidence > 0.5").select("document_id", "entity_id", "node_id").collect()
        got = {tuple(r) for r in rows if r[0] in asked and r[1] == "e2"}
        return len(got & true) / len(true), len(got & true) / max(1, len(got))

    with_messages, without = scores(entity_matching.FAR), scores(0)
    assert with_messages[0] >= 0.95 and with_messages[1] >= 0.95
    assert without[1] <= with_messages[1] - 0.2


def test_messages_that_do_not_settle(spark):
    c = spark.createDataFrame([(1, 1, 1, 2.0), (2, 1, 2, 2.0)], "c bigint, x bigint, y bigint, theta double")
    with pytest.raises(RuntimeError):
        entity_matching.propagate(c, spark.createDataFrame([], "c bigint, d bigint"), most=1)


def test_matching_nothing(spark):
    assert matched(spark, [], [], []) == set()


def test_one_to_one_factors(spark):
    """Two candidates of one entity share its belief."""
    c = spark.createDataFrame([(1, 1, 1, 2.0), (2, 1, 2, 2.0), (3, 2, 3, 2.0)], "c bigint, x bigint, y bigint, theta double")
    pairs = spark.createDataFrame([], "c bigint, d bigint")
    p = {r["c"]: r["confidence"] for r in entity_matching.propagate(c, pairs).collect()}
    assert abs(p[1] - p[2]) < 1e-6 and p[1] < 0.5 < p[3]
    z = 1 + 2 * np.exp(2.0)
    assert abs(p[1] - np.exp(2.0) / z) < 1e-3
