"""Routing of questions as column expressions: a whole table of questions is decided in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import occurrences, without_think

#: Patterns and keywords by which questions are told apart.
DEEP = [r"이어지는|흐름|전체.*경로|체인|파이프라인|단계.*거쳐", r"모든.*연결|병목|end.to.end|전파|순서대로", r"어떻게.*거쳐|경유|다단계|멀티.?홉|multi.?hop"]
MIDDLE = [r"비교|차이|관계|의존|영향|상호작용|연관", r"어떻게.*다른|versus|vs\b|trade.?off", r"장단점|pros.*cons|결합|통합"]
SIMPLE = ["무엇", "what", "정의", "definition", "설명", "explain", "describe"]
RELATION = ["관계", "비교", "차이", "연관", "영향", "상호작용", "relate", "compare", "difference", "connection", "impact", "versus", "vs", "trade-off", "장단점", "pros", "cons"]
CHAIN = ["경로", "흐름", "단계", "체인", "파이프라인", "전체", "모든", "path", "flow", "chain", "pipeline", "end-to-end", "trace", "거쳐", "경유", "순서", "과정", "process", "이어지는"]
CALCULATE = ["sum", "plus", "minus", "곱", "더해", "빼", "계산", "나눠", "%", "^", "×", "÷"]
DATABASE = ["sql", "select", "join", "database", "쿼리", "테이블", "insert", "update", "delete"]
API = ["api", "endpoint", "request", "curl", "http", "호출", "fetch"]
PROGRAM = ["code", "python", "script", "실행", "run", "function", "에러", "execute"]
PATHS = ["vector", "cross_ref", "graph_db"]
TOOLS = {"calculation": "calculator", "database": "sql_executor", "api_call": "api_caller", "code_exec": "code_runner"}


def any_of(column: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(column, F.lit(w))
    return out


def separators(q: Column) -> Column:
    return occurrences(q, "/") + occurrences(q, ",")


def hops_by_patterns(question: Column | str) -> Column:
    """Two for each arrow, three for each deep and two for each middle pattern, one for each separator; 1 to 6."""
    q = F.lower(question)
    score = (occurrences(q, "→") + occurrences(q, "->")) * 2 + separators(q)
    for patterns, points in ((DEEP, 3), (MIDDLE, 2)):
        for p in patterns:
            score = score + F.when(q.rlike(p), points).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(6), score))


def hops_by_length(question: Column | str) -> Column:
    n = F.length(question)
    return F.when(n > 500, 6).when(n > 200, 4).when(n > 80, 3).otherwise(1)


def hops_from_reply(reply: Column | str) -> Column:
    """The first digit from 1 to 6 outside reasoning tags, or null."""
    return F.nullif(F.regexp_extract(without_think(reply), "[1-6]", 0), F.lit("")).cast("int")


def route(hops: Column | str) -> Column:
    h = F.col(hops) if isinstance(hops, str) else hops
    return F.when(h <= 2, "vector").when(h <= 5, "cross_ref").otherwise("graph_db")


def path_scores(question: Column | str, hops: Column | str) -> dict[str, Column]:
    q = F.col(question) if isinstance(question, str) else question
    h = F.col(hops) if isinstance(hops, str) else hops
    low, seps = F.lower(q), separators(F.lower(q))
    points = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(F.lit(0.0))
    return {
        "vector": points(h <= 2, 3) + points(any_of(low, SIMPLE), 1) + points(seps == 0, 0.5),
        "cross_ref": points(h.between(3, 5), 3) + points(any_of(low, RELATION), 2) + points(seps.between(1, 3), 1),
        "graph_db": points(h >= 6, 3) + points(any_of(low, CHAIN), 2) + points(any_of(q, ["→", "->", "=>"]), 1.5) + points(seps >= 3, 1),
    }


def with_scores(questions: DataFrame, question: Column | str, hops: Column | str) -> DataFrame:
    """Adds ``_scores``, the points of each path, as a column of its own, so that they are counted once for each row."""
    scores = path_scores(question, hops)
    return questions.withColumn("_scores", F.map_from_arrays(F.array(*[F.lit(p) for p in PATHS]), F.array(*[scores[p] for p in PATHS])))


def best_of(remaining: Column | str) -> Column:
    """``struct(minus, i, path)`` of the remaining path with most points by ``_scores``, the earlier in the list on ties;
    null if none remains."""
    left = F.col(remaining) if isinstance(remaining, str) else remaining
    return F.array_min(F.transform(left, lambda p, i: F.struct((-F.col("_scores")[p]).alias("minus"), i.alias("i"), p.alias("path"))))


def best_path(questions: DataFrame, key: str, question: str, hops: str, remaining: str) -> DataFrame:
    """``key, path, path_score``: the remaining path with most points, the earlier in the list on ties; vector if
    none remains."""
    best = best_of(remaining)
    return with_scores(questions, question, hops).select(key, F.coalesce(best["path"], F.lit("vector")).alias("path"), (-best["minus"]).alias("path_score"))


def delegate(path: Column | str, snippets: Column | str, quality: Column | str) -> Column:
    """``graph`` if another path than vector was taken, gave snippets, and their quality is at least 0.3."""
    path, snippets, quality = (F.col(c) if isinstance(c, str) else c for c in (path, snippets, quality))
    return F.when((path != "vector") & (snippets > 0) & (quality >= 0.3), "graph").otherwise("vector")


def intent_from_reply(reply: Column | str) -> Column:
    """The first of the intents, in their fixed order, that the reply names, or null."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    return F.coalesce(*[F.when(F.contains(reply, F.lit(i)), F.lit(i)) for i in TOOLS])


def searchers_for(loaded: Column | str) -> Column:
    """``array(text, image)`` of those of them that are loaded, in this order, else ``array(default)``."""
    found = F.array_intersect(F.array(F.lit("text"), F.lit("image")), loaded)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("default")))


def quality_from_reply(reply: Column | str) -> Column:
    """The first number that begins with 0 or 1, at most 1; 0 if there is none."""
    found = F.nullif(F.regexp_extract(without_think(reply), r"([01]\.?\d*)", 1), F.lit(""))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found.cast("double"))), F.lit(0.0))


def quality_gate(rows: DataFrame, quality: str, backtracks: str, path: str, tried: str, question: str, hops: str, key: str, least: float = 0.3, most: int = 2) -> DataFrame:
    """``key, passed, next_path``: pass on enough quality or after ``most`` retries, else the best path untried; the
    current path counts as tried."""
    done = F.array_union(F.col(tried), F.array(F.col(path)))
    left = F.array_except(F.array(*[F.lit(p) for p in PATHS]), done)
    passed = (F.col(quality) >= least) | (F.col(backtracks) >= most) | (F.size(left) == 0)
    chosen = F.coalesce(best_of(left)["path"], F.lit("vector"))
    return with_scores(rows, question, hops).select(key, passed.alias("passed"), F.when(~passed, chosen).alias("next_path"))


def intent(question: Column | str) -> Column:
    q = F.lower(question)
    return F.when(any_of(q, CALCULATE) & q.rlike(r"\d"), "calculation").when(any_of(q, DATABASE), "database").when(any_of(q, API), "api_call").when(any_of(q, PROGRAM), "code_exec").otherwise("knowledge")


def tool_of(intent_name: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TOOLS.items() for x in pair])
    return F.coalesce(table[F.col(intent_name) if isinstance(intent_name, str) else intent_name], F.lit(""))


def rewrites(reply: Column | str, original: Column | str, most: int = 2) -> Column:
    """The original question, then the numbered lines of a reply without their numbers."""
    lines = F.filter(F.split(reply, "\n"), lambda x: F.trim(x).rlike(r"^[0-9]") & F.contains(x, F.lit(".")))
    found = F.slice(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^.]*\.", ""))), 1, most)
    return F.array_distinct(F.concat(F.array(original), found))


def answer_scores(answer: Column | str, context: Column | str, question: Column | str | None = None) -> dict[str, Column]:
    """Rule scores of an answer; 0.5 throughout for an empty one."""
    a = F.col(answer) if isinstance(answer, str) else answer
    c = F.col(context) if isinstance(context, str) else context
    empty = F.coalesce(F.length(a), F.lit(0)) == 0
    if question is not None:
        empty = empty | (F.coalesce(F.length(question), F.lit(0)) == 0)
    rule = lambda cond, yes, no: F.when(empty, F.lit(0.5)).when(cond, F.lit(yes)).otherwise(F.lit(no))
    relevance, accuracy = rule(F.length(a) > 50, 0.8, 0.5), rule(F.coalesce(F.length(c), F.lit(0)) > 0, 0.7, 0.5)
    completeness, made_up = rule(F.length(a) > 100, 0.8, 0.6), F.when(empty, F.lit(0.5)).otherwise(F.lit(0.2))
    overall = F.round(F.when(empty, F.lit(0.5)).otherwise(relevance * 0.3 + accuracy * 0.4 + completeness * 0.2 + (1 - made_up) * 0.1), 6)
    return {"relevance": relevance, "accuracy": accuracy, "completeness": completeness, "hallucination": made_up, "overall_score": overall, "needs_improvement": overall < 0.7}
