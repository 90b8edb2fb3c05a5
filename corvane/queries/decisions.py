"""Routing, gates, tools and reply parsing: decision tables over questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions import text as T
from corvane.operators import reasoning, routing, tools
from corvane.queries.registry import Tables, query

#: Fixed values, written out once more so that the SQL does not take them from the library.
DEEP = [r"이어지는|흐름|전체.*경로|체인|파이프라인|단계.*거쳐", r"모든.*연결|병목|end.to.end|전파|순서대로", r"어떻게.*거쳐|경유|다단계|멀티.?홉|multi.?hop"]
MIDDLE = [r"비교|차이|관계|의존|영향|상호작용|연관", r"어떻게.*다른|versus|vs\b|trade.?off", r"장단점|pros.*cons|결합|통합"]
SIMPLE = ["무엇", "what", "정의", "definition", "설명", "explain", "describe"]
RELATION = ["관계", "비교", "차이", "연관", "영향", "상호작용", "relate", "compare", "difference", "connection", "impact", "versus", "vs", "trade-off", "장단점", "pros", "cons"]
CHAIN = ["경로", "흐름", "단계", "체인", "파이프라인", "전체", "모든", "path", "flow", "chain", "pipeline", "end-to-end", "trace", "거쳐", "경유", "순서", "과정", "process", "이어지는"]
CALCULATE = ["sum", "plus", "minus", "곱", "더해", "빼", "계산", "나눠", "%", "^", "×", "÷"]
DATABASE = ["sql", "select", "join", "database", "쿼리", "테이블", "insert", "update", "delete"]
API = ["api", "endpoint", "request", "curl", "http", "호출", "fetch"]
PROGRAM = ["code", "python", "script", "실행", "run", "function", "에러", "execute"]

Q = "q AS (SELECT DISTINCT text FROM transcriptions WHERE text IS NOT NULL)"


def asked(t: Tables) -> DataFrame:
    """Every distinct utterance as a question."""
    return t.transcriptions.where("text is not null").select("text").distinct()


def _count(column: str, needle: str) -> str:
    return f"((length({column}) - length(replace({column}, '{needle}', ''))) // {len(needle)})"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _patterns(column: str, patterns: list[str], points: int) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN {points} ELSE 0 END" for p in patterns)


SEPS = f"({_count('lower(text)', '/')} + {_count('lower(text)', ',')})"
HOPS = f"greatest(1, least(6, ({_count('lower(text)', '→')} + {_count('lower(text)', '->')}) * 2 + {SEPS} + {_patterns('lower(text)', DEEP, 3)} + {_patterns('lower(text)', MIDDLE, 2)}))"
ROUTE = "CASE WHEN h <= 2 THEN 'vector' WHEN h <= 5 THEN 'cross_ref' ELSE 'graph_db' END"
SCORES = {
    "vector": f"CASE WHEN h <= 2 THEN 3.0 ELSE 0 END + CASE WHEN {_any('lower(text)', SIMPLE)} THEN 1.0 ELSE 0 END + CASE WHEN {SEPS} = 0 THEN 0.5 ELSE 0 END",
    "cross_ref": f"CASE WHEN h BETWEEN 3 AND 5 THEN 3.0 ELSE 0 END + CASE WHEN {_any('lower(text)', RELATION)} THEN 2.0 ELSE 0 END + CASE WHEN {SEPS} BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END",
    "graph_db": f"CASE WHEN h >= 6 THEN 3.0 ELSE 0 END + CASE WHEN {_any('lower(text)', CHAIN)} THEN 2.0 ELSE 0 END + CASE WHEN {_any('text', ['→', '->', '=>'])} THEN 1.5 ELSE 0 END + CASE WHEN {SEPS} >= 3 THEN 1.0 ELSE 0 END",
}
HQ = f"{Q}, hq AS (SELECT text, {HOPS} AS h FROM q), sc AS (SELECT *, ({SCORES['vector']})::DOUBLE AS sv, ({SCORES['cross_ref']})::DOUBLE AS sx, ({SCORES['graph_db']})::DOUBLE AS sg FROM hq)"


def with_hops(t: Tables) -> DataFrame:
    return asked(t).withColumn("h", routing.hops_by_patterns("text"))


@query("R15_hop_classify_heuristic", f"WITH {Q} SELECT text, ({HOPS})::INT AS hops FROM q")
def hops(t):
    return asked(t).select("text", routing.hops_by_patterns("text").cast("int").alias("hops"))


@query("R16_hop_classify_length", "SELECT doc_id, CASE WHEN length(text) > 500 THEN 6 WHEN length(text) > 200 THEN 4 WHEN length(text) > 80 THEN 3 ELSE 1 END AS hops FROM documents")
def hops_length(t):
    return t.documents.select("doc_id", routing.hops_by_length("text").alias("hops"))


@query("R17_hop_parse_llm", f"WITH {Q}, r AS (SELECT text, '<think>maybe 9 or 1</think> hops: ' || (length(text) % 9) || ' <think>open' AS reply FROM q) SELECT text, nullif(regexp_extract(regexp_replace(regexp_replace(reply, '(?s)<[tT]hink>.*?</[tT]hink>', '', 'g'), '(?s)<[tT]hink>.*', ''), '[1-6]'), '')::INT AS hops FROM r")
def hops_reply(t):
    reply = F.concat(F.lit("<think>maybe 9 or 1</think> hops: "), (F.length("text") % 9).cast("string"), F.lit(" <think>open"))
    return asked(t).select("text", routing.hops_from_reply(reply).alias("hops"))


@query("R18_route_by_hops", f"WITH {HQ} SELECT text, {ROUTE} AS path FROM hq")
def route(t):
    return with_hops(t).select("text", routing.route("h").alias("path"))


BEST = "CASE WHEN sv >= sx AND sv >= sg THEN 'vector' WHEN sx >= sg THEN 'cross_ref' ELSE 'graph_db' END"


@query("R19_path_score_select", f"WITH {HQ} SELECT text, {BEST} AS path, greatest(sv, sx, sg) AS path_score FROM sc")
def best(t):
    rows = with_hops(t).withColumn("left", F.array(*[F.lit(p) for p in routing.PATHS]))
    return routing.best_path(rows, "text", "text", "h", "left")


@query("R20_quality_eval", f"WITH {Q} SELECT text, coalesce(greatest(0.0, least(1.0, nullif(regexp_extract('score 0.' || (length(text) % 10) || (length(text) % 7), '([01]\\.?\\d*)', 1), '')::DOUBLE)), 0.0) AS quality FROM q")
def quality(t):
    reply = F.concat(F.lit("score 0."), (F.length("text") % 10).cast("string"), (F.length("text") % 7).cast("string"))
    return asked(t).select("text", routing.quality_from_reply(reply).alias("quality"))


GATE = f"""WITH {HQ}, g AS (SELECT *, (length(text) % 10) / 10.0 AS quality, (length(text) % 4)::INT AS backtracks, {ROUTE} AS cur FROM sc)
    SELECT text, (quality >= 0.3 OR backtracks >= 2) AS passed, CASE WHEN NOT (quality >= 0.3 OR backtracks >= 2) THEN
        CASE cur WHEN 'vector' THEN CASE WHEN sx >= sg THEN 'cross_ref' ELSE 'graph_db' END WHEN 'cross_ref' THEN CASE WHEN sv >= sg THEN 'vector' ELSE 'graph_db' END ELSE CASE WHEN sv >= sx THEN 'vector' ELSE 'cross_ref' END END END AS next_path FROM g"""


@query("R21_quality_gate", GATE)
def gate(t):
    """The path that was just tried is not chosen again."""
    rows = with_hops(t).withColumn("quality", (F.length("text") % 10) / 10.0).withColumn("backtracks", F.length("text") % 4).withColumn("path", routing.route("h")).withColumn("tried", F.array().cast("array<string>"))
    return routing.quality_gate(rows, "quality", "backtracks", "path", "tried", "text", "h", "text")


@query("R28_pipeline_delegation", f"WITH {HQ} SELECT text, CASE WHEN {ROUTE} <> 'vector' AND length(text) % 5 > 0 AND (length(text) % 10) / 10.0 >= 0.3 THEN 'graph' ELSE 'vector' END AS source FROM hq")
def delegation(t):
    return with_hops(t).select("text", routing.delegate(routing.route("h"), F.length("text") % 5, (F.length("text") % 10) / 10.0).alias("source"))


@query("U05_remaining_paths", f"WITH {HQ} SELECT text, array_to_string(list_filter(['vector', 'cross_ref', 'graph_db'], lambda p: p <> {ROUTE}), ',') AS remaining FROM hq")
def remaining(t):
    return with_hops(t).select("text", F.array_join(F.array_except(F.array(*[F.lit(p) for p in routing.PATHS]), F.array(routing.route("h"))), ",").alias("remaining"))


ANSWER = """SELECT doc_id, CASE WHEN e THEN 0.5 WHEN length(text) > 50 THEN 0.8 ELSE 0.5 END AS relevance, CASE WHEN e THEN 0.5 WHEN source <> '' THEN 0.7 ELSE 0.5 END AS accuracy, CASE WHEN e THEN 0.5 WHEN length(text) > 100 THEN 0.8 ELSE 0.6 END AS completeness, e FROM (SELECT doc_id, text, coalesce(lang, '') AS source, coalesce(length(text), 0) = 0 AS e FROM documents)"""


@query("R30_rule_evaluation", f"SELECT doc_id, relevance::DOUBLE AS relevance, accuracy::DOUBLE AS accuracy, completeness::DOUBLE AS completeness, CASE WHEN e THEN 0.5 ELSE round(relevance * 0.3 + accuracy * 0.4 + completeness * 0.2 + 0.08, 6) END::DOUBLE AS overall_score, CASE WHEN e THEN true ELSE round(relevance * 0.3 + accuracy * 0.4 + completeness * 0.2 + 0.08, 6) < 0.7 END AS needs_improvement FROM ({ANSWER})")
def evaluation(t):
    scores = routing.answer_scores("text", "lang")
    return t.documents.select("doc_id", *[scores[k].alias(k) for k in ("relevance", "accuracy", "completeness", "overall_score", "needs_improvement")])


@query("R31_feedback_loop", f"SELECT doc_id, CASE WHEN e OR round(relevance * 0.3 + accuracy * 0.4 + completeness * 0.2 + 0.08, 6) < 0.7 THEN 1 ELSE 0 END AS loops FROM ({ANSWER})")
def feedback(t):
    return t.documents.select("doc_id", F.when(routing.answer_scores("text", "lang")["needs_improvement"], 1).otherwise(0).alias("loops"))


@query("R37_query_rewrite_parse", f"WITH {Q} SELECT text, CASE WHEN text = 'first way' THEN 'first way|second' ELSE text || '|first way|second' END AS rewrites FROM q")
def rewrite(t):
    reply = F.lit("Here are some:\n1. first way\n 2. second\n3. third\nnot 4. this")
    return asked(t).select("text", F.array_join(routing.rewrites(reply, "text"), "|").alias("rewrites"))


INTENT = f"CASE WHEN {_any('lower(text)', CALCULATE)} AND regexp_matches(text, '[0-9]') THEN 'calculation' WHEN {_any('lower(text)', DATABASE)} THEN 'database' WHEN {_any('lower(text)', API)} THEN 'api_call' WHEN {_any('lower(text)', PROGRAM)} THEN 'code_exec' ELSE 'knowledge' END"


@query("X01_intent_classify_heuristic", f"WITH {Q} SELECT text, {INTENT} AS intent FROM q")
def intent(t):
    return asked(t).select("text", routing.intent("text").alias("intent"))


@query("X03_intent_to_tool", f"WITH {Q}, i AS (SELECT text, {INTENT} AS intent FROM q) SELECT text, intent, CASE intent WHEN 'calculation' THEN 'calculator' WHEN 'database' THEN 'sql_executor' WHEN 'api_call' THEN 'api_caller' WHEN 'code_exec' THEN 'code_runner' ELSE '' END AS tool FROM i")
def tool(t):
    return asked(t).select("text", routing.intent("text").alias("intent")).select("text", "intent", routing.tool_of("intent").alias("tool"))


@query("X02_intent_from_reply", f"WITH {Q}, r AS (SELECT text, CASE length(text) % 3 WHEN 0 THEN 'it is a database or calculation' WHEN 1 THEN 'api_call' ELSE 'hm' END AS reply FROM q) SELECT text, CASE WHEN contains(reply, 'calculation') THEN 'calculation' WHEN contains(reply, 'database') THEN 'database' WHEN contains(reply, 'api_call') THEN 'api_call' END AS intent FROM r")
def intent_reply(t):
    reply = F.when(F.length("text") % 3 == 0, "it is a database or calculation").when(F.length("text") % 3 == 1, "api_call").otherwise("hm")
    return asked(t).withColumn("reply", reply).select("text", routing.intent_from_reply("reply").alias("intent"))


@query("X04_extract_math_expression", f"WITH {Q} SELECT text, trim(regexp_replace(regexp_replace(text, '[^0-9+\\-*/().%^]', ' ', 'g'), '\\s+', ' ', 'g')) AS expression FROM q")
def math(t):
    return asked(t).select("text", T.math_expression("text").alias("expression"))


@query("X05_calculator", "SELECT p_partkey, (p_size + 3 * p_partkey - p_retailprice / 2)::DOUBLE AS result FROM part")
def calculator(t):
    expression = F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("+ 3 *"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_retailprice").cast("string"), F.lit("/ 2"))
    return t.part.select("p_partkey", tools.calculator()(expression).alias("c")).select("p_partkey", F.col("c.result").alias("result"))


@query("X06_sql_executor", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def sql_executor(t):
    t.supplier.createOrReplaceTempView("tool_supplier")
    t.nation.createOrReplaceTempView("tool_nation")
    return tools.run_select(t.spark, "SELECT n_name, count(*) AS suppliers FROM tool_supplier JOIN tool_nation ON s_nationkey = n_nationkey GROUP BY n_name")


@query("X09_extract_url", """SELECT doc_id, nullif(regexp_replace(regexp_extract('see https://host/' || source || '/' || doc_id || '. ' || coalesce(text, ''), 'https?://[\\w\\-._~:/?#\\[\\]@!$&''()*+,;=%]+'), '[.,)]+$', ''), '') AS url FROM documents""")
def url(t):
    line = F.concat(F.lit("see https://host/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(". "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", T.first_url(line).alias("url"))


@query("X10_tool_dispatch", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'remote' END AS ran, CASE WHEN event_id % 3 = 1 THEN 'not_implemented' ELSE 'ok' END AS status FROM events")
def dispatch(t):
    """Only an error of the remote tool falls back to the local one."""
    remote = F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 3 == 1, "not_implemented").otherwise("ok")
    told = tools.dispatched("remote")
    return t.events.withColumn("remote", remote).select("event_id", told["ran"].alias("ran"), told["status"].alias("status"))


@query("X11_summarize_result", "SELECT event_id, left(props, 400) AS summary FROM events")
def summarize(t):
    return t.events.select("event_id", tools.summary("props").alias("summary"))


@query("X08_tool_registry", "SELECT * FROM (VALUES ('calculator', 'expression'), ('sql_executor', 'sql'), ('api_caller', 'url,method'), ('code_runner', 'snippet')) v(tool, inputs)")
def registry(t):
    return tools.registry(t.spark).select("tool", F.array_join("inputs", ",").alias("inputs"))


@query("P29_think_tag_strip", f"WITH {Q}, r AS (SELECT text, '<think>a' || chr(10) || 'b</think>' || text || '<Think>c</Think>' AS reply FROM q) SELECT text, trim(regexp_replace(regexp_replace(reply, '(?s)<[tT]hink>.*?</[tT]hink>', '', 'g'), '(?s)<[tT]hink>.*', '')) AS answer, trim(split_part(reply, '</think>', 2)) AS after FROM r")
def think(t):
    reply = F.concat(F.lit("<think>a\nb</think>"), F.col("text"), F.lit("<Think>c</Think>"))
    return asked(t).select("text", T.without_think(reply).alias("answer"), T.after_think(reply).alias("after"))


@query("R24_thought_score_llm", f"WITH {Q} SELECT text, CASE length(text) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN CASE WHEN regexp_matches(text, '[a-zA-Z가-힣]') THEN 1.0 ELSE 0.0 END ELSE (length(text) % 10) / 10.0 END::DOUBLE AS score FROM q")
def thought(t):
    """Some questions found nothing, some replies have no number; those fall back to the coverage."""
    reply = F.when(F.length("text") % 4 == 1, "no idea").otherwise(F.concat(F.lit("0."), (F.length("text") % 10).cast("string")))
    return asked(t).select("text", reasoning.thought_score(reply, F.length("text") % 4, F.col("text"), F.col("text")).alias("score"))


@query("R33_router_searchers", "SELECT label, CASE label % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE 'text,image' END AS searchers FROM (SELECT DISTINCT label FROM embeddings)")
def router(t):
    """The label stands for what is loaded: bit 0 for text, bit 1 for image."""
    loaded = F.filter(F.array(F.when(F.col("label").bitwiseAND(2) > 0, "image"), F.when(F.col("label").bitwiseAND(1) > 0, "text")), lambda x: x.isNotNull())
    return t.embeddings.select("label").distinct().select("label", F.array_join(routing.searchers_for(loaded), ",").alias("searchers"))
