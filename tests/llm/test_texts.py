"""Languages, turns, scans and quality on small inputs."""

from datetime import datetime

import pytest

from corvane.llm import languages, scan_repair, speaker_turns, text_quality

SAMPLES = {
    "en": ["The old house stands near the river and nobody has lived there for years.", "We found that the weather was better than anyone had expected this morning."],
    "de": ["Das alte Haus steht am Fluss und niemand hat dort seit Jahren gewohnt.", "Wir haben festgestellt, dass das Wetter heute besser war als erwartet."],
    "es": ["La casa vieja está cerca del río y nadie ha vivido allí desde hace años.", "Hemos visto que el tiempo era mejor de lo que todos esperaban esta mañana."],
    "ko": ["오래된 집은 강가에 있고 여러 해 동안 아무도 살지 않았다.", "우리는 오늘 아침 날씨가 생각보다 좋다는 것을 알았다."],
    "ja": ["古い家は川の近くにあり、何年もの間だれも住んでいない。", "今朝の天気はみんなが思っていたよりもよかった。"],
}


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [((s + ' ') * 6, c) for c, texts in SAMPLES.items() for s in texts for _ in range(3)] + [(None, "en"), ("x" * 200, None), ("", "de")]
    return languages.train(spark.createDataFrame(rows, "text string, lang string"))


def test_labels(spark):
    cases = {"EN": "en", "en-GB": "en", "한국어": "ko", " Deutsch ": "de", "zh-Hans": "zh", "xx": None, "?": None, "": None, None: None, "und": None, "it": "it"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    for r in df.select("l", languages.label_codes(df["l"]).alias("c")).collect():
        assert r["c"] == cases[r["l"]] == languages.label_code(r["l"])


def test_segments_and_documents(spark, profiles):
    mixed = SAMPLES["en"][0] + " " + SAMPLES["en"][1] + "\n\n" + SAMPLES["de"][0]
    items = spark.createDataFrame([("a", mixed), ("b", None), ("c", "  "), ("d", SAMPLES["ko"][0] + ' ("the old house")'), ("e", "# " + SAMPLES["de"][0] + "\n\n" + SAMPLES["es"][0]), ("f", "12345"), ("g", "- " + SAMPLES["en"][0] + "\n" + SAMPLES["ja"][0])], "id string, text string")
    segs = languages.segments(items, profiles, "id", "text")
    docs = {r["id"]: r for r in languages.documents_of(segs).collect()}
    assert docs["a"]["lang"] == "en" and docs["a"]["languages"] == ["de", "en"]
    assert docs["d"]["languages"] == ["ko"] and docs["e"]["languages"] == ["es"] and docs["g"]["languages"] == ["ja"]
    assert "b" not in docs and "c" not in docs and all(0 <= r["confidence"] <= 1 for r in docs.values())
    spans = {(r["id"], r["segment"]): (r["start"], r["end"], r["lang"]) for r in segs.collect()}
    a, b, lang = spans["a", 1]
    assert lang == "de" and mixed[a:b].strip() == SAMPLES["de"][0]


def test_languages_without_training(spark):
    none = languages.train(spark.createDataFrame([], "text string, lang string"))
    items = spark.createDataFrame([("a", "Some words here.")], "id string, text string")
    assert languages.segments(items, none, "id", "text").count() == 0


TRANSCRIPT = "recording_id string, start double, end_time double, speaker string, text string, received_at timestamp, known string, part int"


def turns(spark, rows, full=False):
    df = spark.createDataFrame([(*r, None, "clash", 1) for r in rows], TRANSCRIPT)
    model = speaker_turns.TurnModel()
    out = (speaker_turns.speaker_turns if full else speaker_turns.turn_starts)(df, model).orderBy("recording_id", "turn_no")
    return [tuple(r) for r in out.collect()]


def test_turns(spark):
    rows = [
        ("r", 5.0, 9.0, "SPK_1", "uh, hello there"), ("r", 5.0, 9.0, "-", "uh, hello there"), ("r", 0.5, 4.0, "Speaker 0", "[00:00:00] good morning"),
        ("r", 10.0, 11.0, "SPEAKER_00", "[laughter] um..."), ("r", None, 14.0, "화자 1", "(00:12) again me. SPEAKER_OO: and me"), ("r", 2000.0, 2001.0, "[SPEAKER_00]", "still me"),
        ("r", 2003.9, 2004.0, None, "who is this"), ("r", 2005.0, 2006.0, "", "[Speaker 3] it is me"), ("s", 1.0, 2.0, "S2", "♪ (applause) <|nospeech|>"), (None, 1.0, 2.0, "S2", "x"), ("t", 1.0, 2.0, "S2", None),
    ]
    assert turns(spark, rows) == [("r", 1, "SPEAKER_00", 0), ("r", 2, "SPEAKER_01", 5), ("r", 3, "SPEAKER_00", 12), ("r", 4, "UNKNOWN", 2003), ("r", 5, "SPEAKER_03", 2005)]
    full = turns(spark, rows, full=True)
    assert full[1][5] == "hello there again me." and full[2][5] == "and me still me"


def test_turns_equal_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [("r", float(i * rng.choice([1, 400]) + i / 7), None, rng.choice(["S0", "S1", "S2"]), f"word{i}") for i in range(400)]
    want, last = [], None
    for r in sorted(rows, key=lambda r: (r[1], r[4])):
        if r[3] != last:
            want.append((f"SPEAKER_0{r[3][1]}", int(r[1])))
        last = r[3]
    assert [(t[2], t[3]) for t in turns(spark, rows)] == want


@pytest.mark.parametrize(
    "text,time,parts",
    [
        ("at 12:30 we met", None, [(None, "at 12:30 we met")]),
        ("12:30 we met there", 750.0, [(None, "we met there")]),
        ("the speaker 2 said it", None, [(None, "the speaker 2 said it")]),
        ("speaker 2: said it", None, [("SPEAKER_02", "said it")]),
        ("we saw it (the older of the two) there", None, [(None, "we saw it (the older of the two) there")]),
        ("we saw (applause) it there (Seite 12)", None, [(None, "we saw it there (Seite 12)")]),
        ("00:02:31,790 --> um... [music]", 151.79, []),
        ("so it was -- [SPEAKER_03] yes um, it was", None, [(None, "so it was"), ("SPEAKER_03", "yes it was")]),
        ("", None, []), ("?!", None, []), ("a" * 30_000, None, [(None, "a" * 30_000)]),
    ],
)
def test_neighbours_decide_what_a_token_is(text, time, parts):
    assert speaker_turns.parts_of(text, speaker_turns.TurnModel()) == (time, parts)


def test_transitions_decide():
    """On segments the model was not counted on, it loses much if each token takes its most probable state alone."""
    import random

    rng = random.Random(99)
    held_out = [speaker_turns.known_states(speaker_turns.tagged(rng)) for _ in range(400)]
    right = {}
    for moves in (True, False):
        model = speaker_turns.TurnModel(moves=moves, written=3000)
        told = [(a, b) for states, seen in held_out for a, b in zip(states, model.decode(seen))]
        right[moves] = sum(a == b for a, b in told) / len(told)
    assert right[True] >= 0.97 and right[False] <= right[True] - 0.02


def test_turns_of_nothing(spark):
    assert turns(spark, []) == []
    assert speaker_turns.turn_starts(spark.createDataFrame([], TRANSCRIPT)).count() == 0


PAGES = "page_id bigint, document_id string, page_num int, natural_text string, received_at timestamp, line_no int, kind string"


@pytest.fixture(scope="module")
def pages(spark):
    body = "The quick report describes the well-known network of the company. The network measures the report again."
    rows = [(i, "d", i, f"Chapter {i % 2}  Silent harbour\n\n{body}\n{body}\n\n— {i + 30} —", datetime(2030, 1, 1)) for i in range(1, 9)]
    rows.append((20, "d", 9, "Chapter 1  Silcnt harb0ur\n\nThe quick rep0rt describes the net-\nwork of the company. The nctwork mea¬\nsures the report.\nA well-\nknown fact.\n\n39", datetime(2030, 1, 1)))
    rows += [(20, "d", 9, "old text", datetime(2020, 1, 1)), (21, None, None, None, None), (22, "e", 1, "", None), (23, "f", None, "7", None)]
    return scan_repair.distinct_pages(spark.createDataFrame([(*r, 0, "clash") for r in rows], PAGES))


@pytest.mark.parametrize("line,number", [("12", 12), ("- 7 -", 7), ("— 4l —", 41), ("Page 3 of 9", 3), ("[15]", 15), ("第 7 页", 7), ("xiv", 14), (" ix ", 9), ("3O", 30), ("II", 2), ("I", 1), ("word", None), ("1 2", None), ("mix", None), ("", None), ("civil", None)])
def test_page_numbers(line, number):
    found = scan_repair.page_number(line)
    assert (found[0] if found else None) == number


def test_faults(pages):
    got = {(r["page_id"], r["line_no"], r["kind"]) for r in scan_repair.faults(pages).collect()}
    assert {(i, 1, "running_head") for i in range(1, 9)} <= got and {(i, 6, "page_number") for i in range(1, 9)} <= got
    assert {x for x in got if x[0] == 20} == {(20, 1, "running_head"), (20, 3, "hyphen"), (20, 3, "bad_char"), (20, 4, "hyphen"), (20, 4, "bad_char"), (20, 9, "page_number")}
    assert not any(x[0] in (21, 22) for x in got)


def test_vectors_tell_misread_words_from_rare_ones(spark):
    """"modem" is a rare word in one context and "modern" misread in another; glyphs and counts are alike for both."""
    import random

    import numpy as np

    rng = random.Random(3)
    houses = "house street garden window tower bridge square church market harbour".split()
    wires = "cable signal router plug socket packet antenna port switch cabinet".split()
    line = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows, true, false = [], set(), set()
    for i in range(300):
        texts = [f"{line(houses, 3)} modern {line(houses, 3)}.", f"{line(wires, 7)}.", f"{line(houses, 7)}."]
        if i % 50 == 0:
            texts.append(f"{line(houses, 3)} modem {line(houses, 3)}.")
            true.add((i, 4))
        if i % 50 == 1:
            texts.append(f"{line(wires, 3)} modem {line(wires, 3)}.")
            false.add((i, 4))
        rows.append((i, f"d{i}", 1, "\n".join(texts), None, 0, None))
    pages = scan_repair.distinct_pages(spark.createDataFrame(rows, PAGES))

    def found():
        got = {(r["page_id"], r["line_no"]) for r in scan_repair.faults(pages).where("kind = 'bad_char'").collect()}
        return len(got & true) / len(true), len(got & false) / len(false)

    with_vectors = found()
    kept, scan_repair.climb = scan_repair.climb, lambda seen: (np.zeros((len(seen), 2)), np.zeros((len(seen), 2)))
    try:
        without = found()
    finally:
        scan_repair.climb = kept
    assert with_vectors[0] >= 0.8 and with_vectors[1] <= 0.2
    assert without == (1.0, 1.0)


def test_continuous_text(pages):
    got = {r["page_id"]: r["text"] for r in scan_repair.continuous_text(pages).collect()}
    assert got[20].startswith("The quick report describes the network of the company. The network measures the report.")
    assert "harb" not in got[20] and "39" not in got[20] and "well-" in got[20]


def test_faults_of_nothing(spark):
    empty = scan_repair.distinct_pages(spark.createDataFrame([], PAGES))
    assert scan_repair.faults(empty).count() == 0


def test_quality(spark):
    prose = "The house stands near the river. It was built by the old farmer, and the garden is full of trees.\n"
    rows = []
    for i in range(12):
        rows += [(prose * 4, "prose"), ("\n".join(f"- item {j} of {i}" for j in range(8)), "list"), ("\n".join(f"a{j}\t{j * 7}\t{i}" for j in range(8)), "table"), ("".join(f"{(i * 31 + j * 17) % 256:02x} " for j in range(90)), "junk")]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, (t, _) in enumerate(rows)] + [(900, None, None, "x"), (901, " \n", None, "x"), (902, prose * 3000, "en", "x"), (0, rows[0][0], "en", "x")], "doc_id bigint, text string, lang string, kind string")
    labels = spark.createDataFrame([(i, "a1", k) for i, (_, k) in enumerate(rows)] + [(1, "a2", "prose"), (5, "a1", None), (77777, "a1", "junk")], "doc_id bigint, annotator string, kind string")
    got = text_quality.quality(docs, labels).collect()
    kinds = {r["doc_id"]: r["kind"] for r in got}
    assert sum(kinds[i] == k for i, (_, k) in enumerate(rows)) >= 0.95 * len(rows)
    assert kinds[900] == kinds[901] == "junk" and kinds[902] == "prose" and len(got) == len(rows) + 4
    assert all(abs(r["prose"] + r["list"] + r["table"] + r["junk"] - 1) < 1e-9 for r in got)
    r = next(r for r in got if r["doc_id"] == 0)
    assert r["closed_lines"] == 1.0 and r["words"] == 80


def test_quality_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, annotator string, kind string")
    assert text_quality.quality(docs, labels).count() == 0
