"""Speech transcripts into clean speaker turns by a hidden Markov model over tokens.

Each token of a segment belongs to a speaker label, a timestamp, an annotation, a filler or to speech. What is observed
of a token says nothing of that: it is a punctuation mark, a number with its count of digits, a word that the model
knows by itself, or a run of other words with its length; with case, what follows, and whether it is glued to the token
before. Labels, timestamps, annotations and fillers have states for their first, inner, last and only token, so that the
transitions carry their grammar. Probabilities are counted on sentences with known states that a small grammar writes. Viterbi
decoding gives the states; what is speech makes parts of one speaker, and consecutive parts of one speaker a turn.
"""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.plans.lineage import cut

#: States of the first, inner, last and only token of each kind, and speech.
KINDS, SPEECH = ("speaker", "time", "annotation", "filler"), 16
STATES = SPEECH + 1
#: Sentences the grammar writes to count on.
WRITTEN = 6000
#: Rows of one recording are numbered in spans of so many seconds, so that a long recording is many small groups.
SPAN_S = 900.0
#: The form of a long run of words.
LONG = "4 words"
#: Decoded sequences that a worker remembers.
REMEMBERED = 200_000

#: Words that head a speaker label, fillers that are also words, and fillers.
VOICES = "speaker spkr spk s sprecher sprecherin locuteur intervenant hablante locutor orador falante 화자 발화자 話者 说话人".split()
DOUBTFUL = "um er ah 어 그".split()
FILLERS = "uh uhh uhm umm hm hmm hmmm mm erm äh ähm öhm eh ehm euh 음 어어 呃 嗯 えー えーと ええと あの あのー".split()
NAMED = re.compile("|".join(sorted((v for v in VOICES if len(v) > 1), key=len, reverse=True)) + r"|^\W*s\W*[\doO]", re.IGNORECASE)
NUMBER = re.compile(r"([0-9oO]{1,3})\W*$")
KNOWN = {*VOICES, *DOUBTFUL, *FILLERS}
#: A word, or another token. Words that are not known make runs.
TOKEN = re.compile(r"((?<=[_#-])[oO]{1,3}(?![^\W\d_]))|(?<=\s)(OO)(?!\w)|([^\W\d_]+)|\d+|[\[\](){}<>（）|*♪♫♬#_:：]|-+>|(?<!\S)[-–—]+(?=\s)|(?<=[^\W\d_])-(?=[\doO])|(?<=\d)[.,](?=\d)")
WORD = 3
LETTER = re.compile(r"[^\W\d_]")
ELLIPSIS = re.compile(r"\s*(?:\.\.+|…+)")
COMMA = re.compile(r"[,，、]")
SPACE = re.compile(r"\s+")
LABEL_MARKS = re.compile(r"[\[\]*:>：-]")
AFTER_FILLER = re.compile(r"\s*(?:\.\.+|…+|[,，、])")
LEAST = 0.05


def observe(text: str) -> tuple[list[tuple[int, int]], tuple]:
    """The places of the tokens, and for each its form (with a blank before it unless it is glued to the text before), its
    case, and what follows."""
    spans, seen, at, words = [], [], 0, 0

    def run(a: int) -> None:
        space = "" if at > 0 and not text[at].isspace() else " "
        spans.append((at, a))
        seen.append((f"{space}{min(words, 4)} words", "", ""))

    for m in TOKEN.finditer(text):
        token = m.group()
        if m.lastindex == WORD and token.lower() not in KNOWN:
            words += 1 + len(token) // 12  # scripts without spaces: a long piece is many words
            continue
        a, b = m.span()
        if words:
            run(a)
            words = 0
        space = "" if a > 0 and not text[a - 1].isspace() else " "
        if token[0].isdigit():
            seen.append((f"{space}{min(b - a, 4)} digits", "", ""))
        elif m.lastindex:
            following = "dots" if ELLIPSIS.match(text, b) else "comma" if COMMA.match(text, b) else "space" if text[b : b + 1].isspace() else "end" if b == len(text) else "glued"
            seen.append((space + token.lower(), "upper" if token.isupper() else "title" if token[0].isupper() else "lower", following))
        else:
            seen.append((space + token, "", ""))
        spans.append((a, b))
        at = b
    if words:
        run(len(text))
    return spans, tuple(seen)


def tagged(rng: random.Random) -> list[tuple[str, int]]:
    """A segment of the grammar as pieces of text with their kind (its place in KINDS, 4 for speech)."""
    pick = rng.choice
    words = lambda a, b: " ".join(pick(("model", "Reihe", "texte", "datos", "표본을", "記録", "the", "de", "et")) for _ in range(rng.randint(a, b)))

    def label(inside: bool) -> str:
        name = pick(VOICES)
        name = pick((name.upper(), name.title(), name.lower()))
        number = pick(("{}", "0{}", "00{}")).format(rng.randint(0, 9)) if rng.random() < 0.85 else pick(("OO", "O1", "0O"))
        text = name + pick((" ", "_", "-", "#", "")) + number if len(name) > 1 else name + number
        forms = ["[{}]", "{}:", "**{}:**", "[{}]:", "{}>", "{}：", "**{}**:", "{} -"]
        return ("-- " if inside and rng.random() < 0.8 else "") + pick(forms).format(text)

    def clock() -> str:
        h, m, s = rng.randint(0, 2), rng.randint(0, 59), rng.randint(0, 59)
        short, long = f"{pick((m, f'{m:02d}'))}:{s:02d}", f"{pick((h, f'{h:02d}'))}:{m:02d}:{s:02d}"
        text = pick((f"[{long}]", f"({short})", short, f"{long},{rng.randint(0, 999):03d} -->", f"<{long}>", f"[{long}]", f"{long}.{rng.randint(0, 999):03d}", f"[{short}]", long))
        return text + (" -" if rng.random() < 0.2 and text[-1] != ">" else "")

    def note() -> str:
        return pick(("[{}]", "({})", "{{{}}}", "*{}*", "<|{}|>", "({})", "[{}]")).format(pick(("laughter", "music", "웃음", "background noise", "sighs", "nospeech", "拍手"))) if rng.random() < 0.9 else pick(("♪", "♪♪", "♫"))

    def filler() -> str:
        word = pick(FILLERS) if rng.random() < 0.6 else pick(DOUBTFUL)
        return word + pick((",", ",", "...", "", "…", ",", ""))

    def sounds(n: int) -> list[tuple[str, int]]:
        return [(filler(), 3) if rng.random() < 0.7 else (note(), 2) for _ in range(n)]

    def speech() -> list[tuple[str, int]]:
        out = []
        for _ in range(rng.randint(1, 4)):
            out.append((words(2, 9), 4))
            r = rng.random()
            if r < 0.16:
                out.append((f"{rng.randint(1, 400)} of {rng.randint(100, 900)}", 4))
            elif r < 0.26:
                out.append((pick(("(Seite {})", "({})", "({}쪽)", "（第{}页）", "(p. {})")).format(rng.randint(1, 900)), 4))
            elif r < 0.30:
                out.append((pick(("the speaker", "the speaker,", "speaker {}", "Speaker {} said", "un locuteur", "der Sprecher,", "o orador", "the speaker:")).format(rng.randint(1, 4)), 4))
            elif r < 0.33:
                out.append((f"at {rng.randint(1, 12)}:{rng.randint(10, 59)} we", 4))
            elif r < 0.36:
                out.append((pick(("um die Zahl", "de um modelo", "er hat", "그 표를", "well: it")), 4))
            elif r < 0.40:
                out.append((f"({words(3, 6)})", 4))
            elif r < 0.43:
                out.append((pick(("- and so", "3.5 points", "low-resource", "1,200 rows")), 4))
            elif r < 0.87:
                out += sounds(1 if rng.random() < 0.8 else 2)
        return out

    out = []
    r = rng.random()
    if r < 0.3:
        out.append((clock(), 1))
    if rng.random() < 0.2:
        out.append((label(False), 0))
    if rng.random() < 0.25:
        out += sounds(rng.randint(1, 3))
    if rng.random() < 0.85 or not out:
        out += speech()
        if rng.random() < 0.12:
            out += [(label(True), 0), *speech()]
    return out


class TurnModel:
    """Log-probabilities of the forms in each state and of the moves between states, counted on written segments.
    Without ``moves`` each token takes its most probable state by itself."""

    def __init__(self, moves: bool = True, written: int = WRITTEN):
        emitted = [[{} for _ in range(3)] for _ in range(STATES)]
        moved = [[0.0] * STATES for _ in range(STATES + 1)]
        rng = random.Random(11)
        for _ in range(written):
            states, seen = known_states(tagged(rng))
            before = STATES
            for k, token in zip(states, seen):
                for f, value in enumerate(token):
                    emitted[k][f][value] = emitted[k][f].get(value, 0) + 1
                moved[before][k] += 1
                before = k
        sizes = [len({v for e in emitted for v in e[f]}) + 1 for f in range(3)]
        self.emit = [[({v: math.log((n + LEAST) / (sum(c.values()) + LEAST * size)) for v, n in c.items()}, math.log(LEAST / (sum(c.values()) + LEAST * size))) for c, size in zip(e, sizes)] for e in emitted]
        share = [sum(row[k] for row in moved) for k in range(STATES)]
        total = sum(share)
        self.prior = [math.log(x / total) if x else -1e9 for x in share]
        # A token within a label, a clock or a note is followed by one of the same; the rest may follow each other.
        seldom = 1e-4 * total  # states the grammar hardly writes, such as a label of one token, are none
        may = lambda j, k: share[k] > seldom and ((k // 4 == j // 4 and k % 4 in (1, 2)) if j < SPEECH and j % 4 < 2 else k == SPEECH or k % 4 in (0, 3))
        rows = [[moved[j][k] + LEAST if may(SPEECH if j == STATES else j, k) else 0.0 for k in range(STATES)] for j in range(STATES + 1)]
        logs = [[math.log(x / sum(row)) if x else None for x in row] if any(row) else [None] * STATES for row in rows]
        self.start = [-1e9 if x is None else x for x in logs[STATES]]
        self.came = [[(j, logs[j][k]) for j in range(STATES) if logs[j][k] is not None] for k in range(STATES)]
        self.open = [k for k in range(SPEECH) if k % 4 < 2]
        self.moves, self.memo, self.forms = moves, {}, {}

    def emission(self, token: tuple) -> list[float]:
        e = self.forms.get(token)
        if e is None:
            e = [sum(table.get(value, rest) for value, (table, rest) in zip(token, tables)) for tables in self.emit]
            if token[0].endswith(LONG):  # the grammar has longer runs of words in speech alone
                e = [e[k] if k == SPEECH else -1e9 for k in range(STATES)]
            self.forms[token] = e
        return e

    def decode(self, seen: tuple) -> list[int]:
        """The most probable states of the tokens. Every path goes through speech at a long run of words, so what lies
        between two of them is decoded by itself, and remembered."""
        if not self.moves:
            return [max(range(STATES), key=lambda k, e=self.emission(t): e[k] + self.prior[k]) for t in seen]
        path, a = [], 0
        for b, token in enumerate(seen):
            if b + 1 == len(seen) or token[0].endswith(LONG):
                piece = seen[a : b + 1]
                part = self.memo.get(piece)
                if part is None:
                    part = self.viterbi(piece)
                    if len(self.memo) < REMEMBERED:
                        self.memo[piece] = part
                path += part[1:] if path else part
                a = b
        return path

    def viterbi(self, seen: tuple) -> list[int]:
        score, back = None, []
        for token in seen:
            e = self.emission(token)
            if score is None:
                score = [a + b for a, b in zip(self.start, e)]
                continue
            new, came = [], []
            for k, before in enumerate(self.came):
                best, at = -1e30, 0
                for j, move in before:
                    x = score[j] + move
                    if x > best:
                        best, at = x, j
                new.append(best + e[k])
                came.append(at)
            score = new
            back.append(came)
        if score is None:
            return []
        for k in self.open:  # nothing ends within a label, a clock or a note
            score[k] -= 1e6
        path = [score.index(max(score))]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def known_states(pieces: list[tuple[str, int]]) -> tuple[list[int], tuple]:
    """States and observations of the tokens of a written segment."""
    text, ends = "", []
    for piece, kind in pieces:
        text += (" " if text else "") + piece
        ends.append((len(text), kind))
    spans, seen = observe(text)
    places = []
    for a, b in spans:  # a run may begin with the blank or the comma of the piece before
        m = LETTER.search(text, a, b)
        places.append(next(i for i, (end, _) in enumerate(ends) if (m.start() if m else a) < end))
    states = []
    for i, place in enumerate(places):
        first, last = i == 0 or places[i - 1] != place, i == len(places) - 1 or places[i + 1] != place
        kind = ends[place][1]
        states.append(SPEECH if kind == 4 else kind * 4 + (3 if first and last else 0 if first else 2 if last else 1))
    return states, seen


def voice(label: str | None) -> str | None:
    """``SPEAKER_nn`` of a label in any spelling; None if it names no speaker."""
    number = NUMBER.search(label.strip()) if label else None
    if not number or not NAMED.search(label):
        return None
    return f"SPEAKER_{int(number.group(1).lower().replace('o', '0')):02d}"


def clock_seconds(token: str) -> float:
    parts = re.findall(r"\d+", token.replace("-->", " ").split()[0] if "-->" in token else token)
    tail = re.search(r"\d[.,](\d+)", token)
    if tail:
        parts = parts[: len(re.split(r":", re.sub(r"[^\d:.,].*$", "", token.strip("[(< ")).strip()))]
    total = 0.0
    for p in parts:
        total = total * 60 + int(p)
    return total + (float("0." + tail.group(1)) if tail else 0.0)


def parts_of(text: str, model: TurnModel) -> tuple[float | None, list[tuple[str | None, str]]]:
    """The time written in the text, and its speech by speaker label; None stands for the segment's own label."""
    spans, seen = observe(text)
    states = model.decode(seen)
    time, speaker, parts, words = None, None, [], []
    i, n = 0, len(spans)

    def close():
        said = SPACE.sub(" ", "".join(words)).strip()
        if LETTER.search(said) or any(c.isdigit() for c in said):
            parts.append((speaker, said))

    while i < n:
        a, b = spans[i]
        state = states[i]
        i += 1
        if state == SPEECH:
            # With what follows up to the next token: marks without letters are no token.
            words.append(text[a : spans[i][0]] if i < n else text[a:])
            continue
        while state % 4 < 2 and i < n and states[i] < SPEECH and states[i] // 4 == state // 4 and states[i] % 4 in (1, 2):
            state, b = states[i], spans[i][1]
            i += 1
        kind = KINDS[state // 4]
        if kind == "speaker":
            found = voice(LABEL_MARKS.sub(" ", text[a:b]).strip())
            if found is None:  # no number
                words.append(text[a:b] + " ")
            else:
                close()
                words, speaker = [], found
        elif kind == "time" and time is None and ":" in text[a:b]:
            time = clock_seconds(text[a:b])
        elif kind == "filler":  # with its comma or dots
            m = AFTER_FILLER.match(text, b)
            if m and i < n and m.end() > spans[i][0]:
                spans[i] = (m.end(), max(m.end(), spans[i][1]))
        words.append(" ")
    close()
    return time, parts


def parts(segments: DataFrame, model: TurnModel | None = None) -> DataFrame:
    """One row for each stretch of speech of one speaker within a segment. Segments delivered repeatedly, also under
    another spelling of the speaker, count once; a known speaker wins. Segments without words give none."""
    model = model or TurnModel()
    once = (
        segments.where(F.col("recording_id").isNotNull() & F.col("text").isNotNull())
        .withColumn("known", F.col("speaker").rlike(r"\d|[oO]{2}"))
        .groupBy("recording_id", "start", "text")
        .agg(F.min("end_time").alias("end_time"), F.max(F.when(F.col("known"), F.col("speaker"))).alias("speaker"))
    )

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for recording, start, text, end, speaker in zip(*(c.to_pylist() for c in batch.columns)):
                time, found = parts_of(text, model)
                own = voice(speaker)
                if start is None or start != start:
                    start = time if time is not None else end
                for n, (said, words) in enumerate(found):
                    for column, value in zip(out, (recording, start, end, n, said or own or "UNKNOWN", words)):
                        column.append(value)
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["recording_id", "start", "end_time", "part", "speaker", "words"])

    return cut(once.select("recording_id", "start", "text", "end_time", "speaker").mapInArrow(run, "recording_id string, start double, end_time double, part int, speaker string, words string"))


def numbered(spoken: DataFrame) -> DataFrame:
    """Adds ``turn_no``, counted from 1 in each recording. Within a span of a recording, turns are counted in order;
    the spans' own counts, first and last speakers are few rows and tell where each span begins to count."""
    order = [F.coalesce("start", F.lit(float("inf"))), F.col("end_time"), F.col("part"), F.col("words")]
    spans = spoken.withColumn("span", F.floor(F.coalesce("start", F.lit(1e15)) / SPAN_S))
    w = Window.partitionBy("recording_id", "span").orderBy(*order)
    local = spans.withColumn("before", F.lag("speaker").over(w)).withColumn("begins", (F.col("before").isNull() | (F.col("before") != F.col("speaker"))).cast("int"))
    local = local.withColumn("local", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order)
    sums = local.groupBy("recording_id", "span").agg(F.sum("begins").alias("n"), F.min_by("speaker", key).alias("first"), F.max_by("speaker", key).alias("last"))
    v = Window.partitionBy("recording_id").orderBy("span")
    sums = sums.withColumn("joins", F.coalesce((F.lag("last").over(v) == F.col("first")).cast("int"), F.lit(0)))
    sums = sums.withColumn("offset", F.coalesce(F.sum(F.col("n") - F.col("joins")).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("joins"))
    return local.join(sums.select("recording_id", "span", "offset"), ["recording_id", "span"]).withColumn("turn_no", (F.col("offset") + F.col("local")).cast("int")).drop("before", "begins", "local", "offset", "span")


def speaker_turns(segments: DataFrame, model: TurnModel | None = None) -> DataFrame:
    """``recording_id, turn_no, speaker, start_s, end_s, text`` of every turn, by time.

    A label in the text holds for what follows it in its segment, else the segment's own label; words with neither
    belong to UNKNOWN. A null start is taken from the text, else from end_time. Ties in time are ordered by end, place
    in the segment and text. Rows without recording_id or text are left out; segments without words belong to no
    turn and end none. Other columns are not read.
    """
    rows = numbered(parts(segments, model))
    order = F.struct(F.coalesce("start", F.lit(float("inf"))).alias("s"), "end_time", "part", "words")
    return rows.groupBy("recording_id", "turn_no").agg(
        F.min_by("speaker", order).alias("speaker"),
        F.floor(F.min("start")).cast("bigint").alias("start_s"),
        F.max("end_time").alias("end_s"),
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(order)), lambda x: x["words"])).alias("text"),
    )


def turn_starts(segments: DataFrame, model: TurnModel | None = None) -> DataFrame:
    """``recording_id, turn_no, speaker, start_s`` alone, without gathering the words."""
    rows = numbered(parts(segments, model))
    return rows.groupBy("recording_id", "turn_no").agg(F.min("speaker").alias("speaker"), F.floor(F.min("start")).cast("bigint").alias("start_s"))
