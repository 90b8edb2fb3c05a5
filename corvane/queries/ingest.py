"""Files, chunking, layout, scans and transcripts."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import text as T
from corvane.operators import chunking, layout, lifecycle, tables, transcript
from corvane.plans.lineage import folder_for, written
from corvane.plans.numbering import numbered
from corvane.queries.registry import Tables, query
from corvane.sources import files, scorers
from corvane.streaming.ingest import incremental as ingest

LATEX = " OR ".join(f"regexp_matches(text, '(?s){p}')" for p in T.LATEX)


@query("P01_content_type_classify", f"SELECT doc_id, CASE WHEN {LATEX} THEN 'latex' WHEN regexp_matches(text, '(?s){T.TABLE}') THEN 'table' WHEN regexp_matches(text, '(?s){T.CODE}') THEN 'code' ELSE 'text' END AS content_type FROM documents WHERE text IS NOT NULL")
def content_type(t):
    return t.documents.where("text is not null").select("doc_id", T.content_type("text").alias("content_type"))


SECTIONS = "s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"
CHUNKS = f"""WITH RECURSIVE {SECTIONS}, f AS (SELECT doc_id, s, 0 AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS done FROM s
    UNION ALL SELECT doc_id, s, i + 1, CASE WHEN length(cur) + length(s[i + 1]) > 1000 THEN s[i + 1] ELSE cur || chr(10) || chr(10) || s[i + 1] END, CASE WHEN length(cur) + length(s[i + 1]) > 1000 AND cur <> '' THEN list_append(done, cur) ELSE done END FROM f WHERE i < len(s)),
    c AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS cs FROM f WHERE i = len(s))"""


@query("P02_greedy_section_chunk", CHUNKS + " SELECT doc_id AS id, generate_subscripts(cs, 1)::INT - 1 AS chunk_index, unnest(cs) AS text FROM c")
def chunks(t):
    return chunking.numbered_chunks(t.documents, "doc_id", "text")


@query("P03_chunk_boundaries")
def boundaries(t):
    rows = t.documents.where("text is not null").select("doc_id", "text", chunking.greedy_chunks(chunking.line_sections("text")).alias("cs"))
    return rows.select("doc_id", F.posexplode(chunking.boundaries("cs", "text")).alias("chunk_index", "b")).select("doc_id", "chunk_index", "b.*")


@query("P05_wrap_text_chunks")
def wrap(t):
    @F.pandas_udf("array<string>")
    def wrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: textwrap.wrap(x, 800, break_long_words=False, replace_whitespace=False) if isinstance(x, str) else [])

    return t.documents.select("doc_id", F.posexplode(wrapped("text")).alias("chunk", "text"))


@query("P06_llm_output_clean")
def clean_output(t):
    @F.pandas_udf("array<string>")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(scorers.extraction_lines)

    reply = F.concat(F.lit("<think>so</think>Let me see. ENT_1 | "), F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit(" ENT_2 | x | y ENT_1 -> ENT_2 (uses)"))
    return t.part.select("p_partkey", F.posexplode(cleaned(reply)).alias("line_no", "line"))


@query("P10_retry_chunk_once")
def retry(t):
    """A batch that fails twice comes out with its error instead of ending the job."""

    def scorer(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["p_partkey"] % 2 == 0).any():
            raise ValueError("down")
        return pd.DataFrame({"p_partkey": frame["p_partkey"], "reply": "ok"})

    return scorers.score(t.part.select("p_partkey"), scorer, "p_partkey bigint, reply string, error string")


@query("P11_ocr_json_repair", "SELECT page_id, coalesce(primary_language, 'ko') AS primary_language, rotation_correction, natural_text FROM (SELECT DISTINCT page_id, primary_language, coalesce(rotation_correction, 0) AS rotation_correction, coalesce(natural_text, '') AS natural_text FROM page_responses)")
def json_repair(t):
    rows = t.page_responses.select("page_id", "primary_language", F.coalesce("rotation_correction", F.lit(0)).alias("rotation_correction"), F.coalesce("natural_text", F.lit("")).alias("natural_text")).distinct()
    raw = rows.select("page_id", F.to_json(F.struct("primary_language", "rotation_correction", "natural_text")).alias("raw"))
    return scorers.parse_pages(raw, "page_id", "raw").select(F.col("id").alias("page_id"), "primary_language", "rotation_correction", "natural_text")


@query("P12_ocr_postprocess", "SELECT DISTINCT page_id, concat_ws(chr(10) || chr(10), CASE WHEN is_table THEN '<table></table>' END, nullif(replace(natural_text, '<image>', ''), '')) AS markdown FROM page_responses")
def postprocess(t):
    text = F.nullif(F.replace("natural_text", F.lit("<image>"), F.lit("")), F.lit(""))
    return t.page_responses.select("page_id", F.concat_ws("\n\n", F.when(F.col("is_table"), F.lit("<table></table>")), text).alias("markdown")).distinct()


def matrices(t: Tables) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    mark = F.when(F.col("p_partkey") % 2 == 0, F.lit("<td><l></l></td>")).otherwise(cell("p_size"))
    return t.part.select("p_partkey", F.concat(F.lit("<table><tr>"), cell("p_name"), mark, F.lit("</tr><tr>"), cell("p_brand"), cell("p_type"), F.lit("</tr></table>")).alias("html"))


SPANS = "SELECT p_partkey, '<table><tr>' || CASE WHEN p_partkey % 2 = 0 THEN '<td colspan=\"2\">' || p_name || '</td>' ELSE '<td>' || p_name || '</td><td>' || p_size || '</td>' END || '</tr><tr><td>' || p_brand || '</td><td>' || p_type || '</td></tr></table>' AS html FROM part"


@query("P13_table_matrix_to_html", SPANS)
def to_spans(t):
    return matrices(t).select("p_partkey", tables.to_spans()("html").alias("r")).select("p_partkey", "r.html")


@query("P14_table_html_to_matrix", "SELECT p_partkey, '<table><tr><td>' || p_name || '</td>' || CASE WHEN p_partkey % 2 = 0 THEN '<td><l></td>' ELSE '<td>' || p_size || '</td>' END || '</tr><tr><td>' || p_brand || '</td><td>' || p_type || '</td></tr></table>' AS html FROM part")
def to_matrix(t):
    spans = matrices(t).select("p_partkey", tables.to_spans()("html").alias("r"))
    return spans.select("p_partkey", tables.to_matrix()("r.html").alias("r")).select("p_partkey", "r.html")


@query("P15_translate_markdown_tables", f"SELECT p_partkey, 'before' || chr(10) || chr(10) || html AS text FROM ({SPANS})")
def translate(t):
    rows = matrices(t).withColumn("md", F.concat(F.lit("before\n\n"), F.col("html")))
    return rows.select("p_partkey", tables.translate_blocks()("md").alias("r")).select("p_partkey", F.col("r.html").alias("text"))


#: Boxes of pages made from order lines: one page for each order.
BOXES = """b AS (SELECT l_orderkey AS page, l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'image' WHEN 'N' THEN 'chart' ELSE 'figure_title' END AS label, l_quantity * 10 AS x1, (l_partkey * 7 % 400)::DOUBLE AS y1, l_quantity * 10 + l_suppkey * 13 % 900 AS x2, (l_partkey * 7 % 400 + l_suppkey * 29 % 300)::DOUBLE AS y2, l_tax * 10 AS score FROM lineitem)"""


def boxes(t: Tables) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "image").when(F.col("l_returnflag") == "N", "chart").otherwise("figure_title")
    x1, y1 = F.col("l_quantity") * 10, (F.col("l_partkey") * 7 % 400).cast("double")
    return t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), label.alias("label"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_suppkey") * 13 % 900).alias("x2"), (y1 + F.col("l_suppkey") * 29 % 300).alias("y2"), (F.col("l_tax") * 10).alias("score"))


DIST = "sqrt(pow(greatest(0, o.x1 - a.x2, a.x1 - o.x2), 2) + pow(greatest(0, o.y1 - a.y2, a.y1 - o.y2), 2))"
TITLES = f"{BOXES}, m AS (SELECT a.page, a.pos, o.pos AS title_pos, {DIST} AS d FROM b a JOIN b o ON a.page = o.page WHERE a.label IN ('image', 'chart') AND o.label = 'figure_title' AND {DIST} <= 50), nt AS (SELECT page, pos, title_pos, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, pos ORDER BY d, title_pos DESC) AS r FROM m) WHERE r = 1)"


@query("J05_nearest_title_join", f"WITH {TITLES} SELECT page, pos, title_pos, distance FROM nt")
def titles(t):
    return layout.nearest_titles(boxes(t))


@query("F07_box_size_filter", f"WITH {BOXES} SELECT page, pos, abs(x2 - x1) AS w, abs(y2 - y1) AS h FROM b WHERE label IN ('image', 'chart') AND NOT (abs(x2 - x1) < 40 AND abs(y2 - y1) < 40) AND abs(x2 - x1) <= 800 AND abs(y2 - y1) <= 850")
def sizes(t):
    return layout.keep_boxes(boxes(t)).select("page", "pos", "w", "h")


@query("W05_per_page_sequence_number", f"WITH {TITLES} SELECT b.page, b.pos, b.label, nt.pos IS NOT NULL AS titled, lpad((row_number() OVER (PARTITION BY b.page, nt.pos IS NOT NULL, b.label ORDER BY b.pos))::VARCHAR, 2, '0') AS number FROM b LEFT JOIN nt ON nt.page = b.page AND nt.pos = b.pos WHERE b.label IN ('image', 'chart')")
def numbers(t):
    return layout.numbered_in_page(boxes(t))


@query("W06_global_numbering", f"WITH {BOXES} SELECT page, pos, row_number() OVER (ORDER BY page, pos) AS number FROM b WHERE label = 'image'")
def global_numbers(t):
    return numbered(boxes(t).where("label = 'image'").select("page", "pos"), F.col("page"), F.col("pos")).select("page", "pos", "number")


@query("W07_page_number_in_batch", "SELECT doc_id, page_num, ((row_number() OVER (PARTITION BY document_id ORDER BY page_num, doc_id) - 1) % 4 + 1)::INT AS place FROM documents")
def in_batch(t):
    w = Window.partitionBy("document_id").orderBy("page_num", "doc_id")
    return t.documents.select("doc_id", "page_num", ((F.row_number().over(w) - 1) % 4 + 1).alias("place"))


@query("A10_label_counts", f"WITH {BOXES} SELECT page, label, count(*) AS n FROM b GROUP BY 1, 2")
def label_counts(t):
    return boxes(t).groupBy("page", "label").agg(F.count(F.lit(1)).alias("n"))


@query("P16_bbox_distance", f"WITH {BOXES} SELECT a.page, a.pos, o.pos AS other, round({DIST}, 6) AS distance FROM b a JOIN b o ON a.page = o.page AND o.pos = a.pos + 1")
def distances(t):
    a = boxes(t).select("page", "pos", *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    o = boxes(t).select("page", F.col("pos").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(o, "page").where("other = pos + 1").select("page", "pos", "other", F.round(layout.distance("a", "o"), 6).alias("distance"))


@query("P17_crop_metadata", f"WITH {TITLES} SELECT b.page, b.pos, b.page || '_' || label AS id, 'doc_' || b.page || '_' || lpad(b.pos::VARCHAR, 2, '0') AS file_name, label AS con_type, nt.title_pos AS subtitle FROM b LEFT JOIN nt ON nt.page = b.page AND nt.pos = b.pos WHERE label IN ('image', 'chart')")
def crop_metadata(t):
    rows = boxes(t).where(F.col("label").isin(*layout.TARGETS)).join(layout.nearest_titles(boxes(t)).drop("distance"), ["page", "pos"], "left")
    return rows.select("page", "pos", F.concat_ws("_", F.col("page").cast("string"), "label").alias("id"), F.concat(F.lit("doc_"), F.col("page").cast("string"), F.lit("_"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("file_name"), F.col("label").alias("con_type"), F.col("title_pos").alias("subtitle"))


@query("P18_crop_pad_clip", f"WITH {BOXES} SELECT page, pos, greatest(0, x1 - 5) AS x1, greatest(0, y1 - 5) AS y1, least(1000, x2 + 5) AS x2, least(600, y2 + 5) AS y2 FROM b")
def pad(t):
    return boxes(t).select("page", "pos", *layout.padded("", F.lit(1000.0), F.lit(600.0)))


@query("P19_resize_scale", "SELECT p_partkey, floor((p_size * 40) * (1280.0 / greatest(p_size * 40, p_partkey % 900 + 100)))::INT AS new_width, floor((p_partkey % 900 + 100) * (1280.0 / greatest(p_size * 40, p_partkey % 900 + 100)))::INT AS new_height FROM part")
def resize(t):
    return t.part.select("p_partkey", *layout.fitted(F.col("p_size") * 40, F.col("p_partkey") % 900 + 100))


@query("P22_hwpx_unit_to_px", "SELECT p_partkey, greatest(1, floor(p_partkey::DOUBLE / 100 * 3.78)::INT) AS px FROM part")
def unit(t):
    return t.part.select("p_partkey", layout.unit_pixels("p_partkey").alias("px"))


@query("P23_layout_threshold", f"WITH {BOXES} SELECT page, pos FROM b WHERE score >= CASE label WHEN 'formula' THEN 0.3 WHEN 'seal' THEN 0.45 WHEN 'paragraph_title' THEN 0.3 ELSE 0.5 END")
def threshold(t):
    return layout.above_threshold(boxes(t)).select("page", "pos")


@query("P27_base64_data_url", "SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS url FROM documents WHERE length(text) > 0")
def data_url(t):
    body = F.encode("text", "UTF-8")
    return t.documents.where("length(text) > 0").select("doc_id", F.replace(F.replace(files.data_url(F.lit("a.png"), body), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")).alias("url"))


@query("P30_grid_normalise", "SELECT vec_id, list_transform(list_transform(embedding, lambda x: x::DOUBLE), lambda x: round((x - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE), 6)) AS grid FROM embeddings")
def grid(t):
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round((x.cast("double") - low) / (high - low), 6)).alias("grid"))


MARKERS = "SELECT doc_id, i::INT - 1 AS part, trim(p) AS body FROM (SELECT doc_id, unnest(string_split(text, '### image_')) AS p, generate_subscripts(string_split(text, '### image_'), 1) AS i FROM documents WHERE contains(text, '### image_'))"


@query("P28_page_marker_split", MARKERS)
def markers(t):
    return t.documents.where(F.contains("text", F.lit("### image_"))).select("doc_id", F.posexplode(F.split("text", "### image_")).alias("part", "p")).select("doc_id", "part", F.trim("p").alias("body"))


@query("J07_crossref_page_text", f"SELECT doc_id, nullif(regexp_extract(body, '^([0-9]+)', 1), '')::INT AS page, trim(regexp_replace(body, '^[0-9]+\\.png', '')) AS text FROM ({MARKERS}) WHERE part > 0")
def page_text(t):
    """The text between a page's marker and the next; the marker is read with or without a blank."""
    rows = markers(t).where("part > 0")
    return rows.select("doc_id", F.nullif(F.regexp_extract("body", r"\A([0-9]+)", 1), F.lit("")).cast("int").alias("page"), F.trim(F.regexp_replace("body", r"\A[0-9]+\.png", "")).alias("text"))


#: Tables of contents: the headings of a file's pages.
TOC = "toc AS (SELECT document_id AS doc, (doc_id % 3 + 1)::INT AS level, page_num AS page FROM documents WHERE page_num IS NOT NULL AND doc_id % 4 > 0), pages AS (SELECT DISTINCT document_id AS doc, page_num AS page FROM documents WHERE page_num IS NOT NULL)"
KEPT = f"WITH {TOC}, o AS (SELECT doc, page, min(level) AS own FROM toc GROUP BY 1, 2), d AS (SELECT doc, max(level) >= 2 AS deep FROM toc GROUP BY 1), w AS (SELECT p.doc, p.page, last_value(o.own IGNORE NULLS) OVER (PARTITION BY p.doc ORDER BY p.page ROWS UNBOUNDED PRECEDING) AS level FROM pages p LEFT JOIN o ON o.doc = p.doc AND o.page = p.page)"


def toc(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.documents.where("page_num is not null")
    return rows.where("doc_id % 4 > 0").select(F.col("document_id").alias("doc"), (F.col("doc_id") % 3 + 1).cast("int").alias("level"), F.col("page_num").alias("page")), rows.select(F.col("document_id").alias("doc"), F.col("page_num").alias("page")).distinct()


@query("F13_toc_page_filter", KEPT + " SELECT w.doc, w.page, w.level FROM w LEFT JOIN d USING (doc) WHERE NOT coalesce(deep, false) OR level IS NULL OR level <> 1")
def toc_filter(t):
    return layout.kept_pages(*toc(t))


@query("W01_carry_forward_level", KEPT + " SELECT doc, page, level FROM w")
def carry(t):
    entries, pages = toc(t)
    own = entries.groupBy("doc", "page").agg(F.min("level").alias("own"))
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.join(own, ["doc", "page"], "left").select("doc", "page", F.last("own", ignorenulls=True).over(w).alias("level"))


@query("A11_toc_level_counts", f"WITH {TOC} SELECT doc, level, count(*) AS n FROM toc GROUP BY 1, 2")
def toc_counts(t):
    return toc(t)[0].groupBy("doc", "level").agg(F.count(F.lit(1)).alias("n"))


SEGMENTS = "s AS (SELECT recording_id, start, end_time, max(speaker) AS speaker, text FROM transcriptions WHERE recording_id IS NOT NULL AND start IS NOT NULL AND end_time IS NOT NULL AND text IS NOT NULL GROUP BY recording_id, start, end_time, text)"


def segments(t: Tables) -> DataFrame:
    rows = t.transcriptions.where("recording_id is not null and start is not null and end_time is not null and text is not null")
    return rows.groupBy("recording_id", "start", "end_time", "text").agg(F.max("speaker").alias("speaker"))


@query("W02_gap_fill_segments", f"WITH {SEGMENTS}, g AS (SELECT *, coalesce(lag(end_time) OVER (PARTITION BY recording_id ORDER BY start, end_time), 0.0) AS cur FROM s) SELECT recording_id, start, end_time, speaker FROM s UNION ALL SELECT recording_id, cur, start, 'UNKNOWN' FROM g WHERE start > cur + 0.5 UNION ALL SELECT recording_id, e, d, 'UNKNOWN' FROM (SELECT recording_id, last(end_time ORDER BY start, end_time) AS e, ceil(max(end_time) / 60) * 60.0 AS d FROM s GROUP BY 1) WHERE d > e + 0.5")
def gap_fill(t):
    """A recording lasts to the end of the minute in which its last segment ends."""
    rows = segments(t)
    lasts = rows.groupBy("recording_id").agg((F.ceil(F.max("end_time") / 60) * 60.0).alias("duration"))
    return transcript.gap_fill(rows, lasts)


@query("W03_split_long_segments", f"WITH {SEGMENTS}, p AS (SELECT *, unnest(range(greatest(1, ceil((end_time - start) / 15.0))::BIGINT)) AS i FROM s) SELECT recording_id, text, speaker, i::INT AS piece, round(start + i * 15.0, 6) AS start, round(least(end_time, start + (i + 1) * 15.0), 6) AS end_time FROM p")
def split(t):
    return transcript.split_long(segments(t))


@query("F16_min_audio_segment", f"WITH {SEGMENTS} SELECT recording_id, start, end_time, text FROM s WHERE end_time > start + 0.1")
def long_enough(t):
    return transcript.long_enough(segments(t)).select("recording_id", "start", "end_time", "text")


@query("F17_transcript_clean", f"WITH {SEGMENTS} SELECT recording_id, start, trim(text) AS text FROM s WHERE trim(text) <> '' AND NOT starts_with(trim(text), '<|')")
def spoken(t):
    return transcript.spoken(segments(t)).select("recording_id", "start", "text")


MERGED = f"""WITH {SEGMENTS}, m AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT NULL AND lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY start, end_time, text)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start, end_time, text ROWS UNBOUNDED PRECEDING) AS island FROM m),
    t AS (SELECT recording_id, island::BIGINT AS island, any_value(speaker) AS speaker, first(start ORDER BY start, end_time, text) AS start, last(end_time ORDER BY start, end_time, text) AS end_time, string_agg(text, ' ' ORDER BY start, end_time, text) AS text FROM i GROUP BY 1, 2),
    k AS (SELECT * FROM t WHERE NOT (coalesce(speaker, '') = 'UNKNOWN' AND trim(text) = ''))"""


def merged(t: Tables) -> DataFrame:
    return transcript.merge_adjacent(segments(t), ["start", "end_time", "text"])


@query("W04_merge_adjacent_same_speaker", MERGED + " SELECT recording_id, island, speaker, start, end_time, text FROM k")
def merge(t):
    return merged(t).select("recording_id", "island", "speaker", "start", "end_time", "text")


@query("A16_group_by_speaker", MERGED + " SELECT recording_id, speaker, count(*) AS turns, round(sum(end_time - start), 4) AS seconds FROM k GROUP BY 1, 2")
def by_speaker(t):
    return merged(t).groupBy("recording_id", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.round(F.sum(F.col("end_time") - F.col("start")), 4).alias("seconds"))


@query("K21_write_transcript", MERGED + r" SELECT recording_id, string_agg('### ' || coalesce(speaker, 'None') || ' (' || printf('%.2f', start) || 's - ' || printf('%.2f', end_time) || 's)' || chr(10) || text, chr(10) || chr(10) ORDER BY island) AS markdown FROM k GROUP BY 1")
def write_transcript(t):
    """Written as JSON lines, one for each recording, and read back."""
    return written(transcript.timeline(merged(t)), "json")


@query("P26_speech_plain_text", MERGED + " SELECT recording_id, string_agg(text, chr(10) ORDER BY island) AS text FROM k WHERE speaker <> 'UNKNOWN' GROUP BY 1")
def plain(t):
    return transcript.plain_text(merged(t))


@query("S03_file_type_route", "SELECT document_id, path, CASE WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.hwp', '.hwpx') THEN 'office' WHEN e IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.tif', '.webp') THEN 'image' WHEN e IN ('.wav', '.mp3', '.ogg', '.flac', '.webm', '.mp4', '.mov', '.avi', '.wmv') THEN 'sound' ELSE 'unsupported' END AS kind FROM (SELECT DISTINCT document_id, metadata['file_path'] || CASE chunk_index % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.hwpx' WHEN 2 THEN '.Png' WHEN 3 THEN '.mp4' ELSE '' END AS path, CASE chunk_index % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.hwpx' WHEN 2 THEN '.png' WHEN 3 THEN '.mp4' ELSE '.md' END AS e FROM chunks WHERE metadata['file_path'] IS NOT NULL AND chunk_index IS NOT NULL)")
def file_route(t):
    i = F.col("chunk_index") % 5
    ending = F.when(i == 0, ".PDF").when(i == 1, ".hwpx").when(i == 2, ".Png").when(i == 3, ".mp4").otherwise("")
    rows = t.chunks.where(F.col("metadata")["file_path"].isNotNull() & F.col("chunk_index").isNotNull()).select("document_id", F.concat(F.col("metadata")["file_path"], ending).alias("path")).distinct()
    return rows.select("document_id", "path", files.kind_of("path").alias("kind"))


@query("S04_scan_markdown")
def markdown(t):
    return files.sections_of(t.documents.select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("S01_scan_recursive_files")
def scan(t):
    return files.scan_files(t.spark, t.folder(), "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("S02_file_catalog")
def catalog(t):
    return files.file_catalog(files.scan_files(t.spark, t.folder(), "size_limits.parquet")).select("name", "size", "extension", "md5", "kind")


@query("S06_scan_layout_json", "SELECT vec_id, (vec_id + 1)::INT AS page FROM embeddings")
def layout_names(t):
    return t.embeddings.select("vec_id", files.layout_page(F.concat(F.lit("layout_"), (F.col("vec_id") + 1).cast("string"), F.lit(".json"))).alias("page"))


@query("S07_scan_image_metadata_json", "SELECT 'item_0' AS id, p_name AS title, 'img/' || p_partkey || '.png' AS file_path FROM part")
def image_items(t):
    item = F.struct(F.struct(F.col("p_name").alias("title"), F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("file_path")).alias("metadata"))
    return files.image_metadata(t.part.select(F.to_json(F.array(item)).alias("value"))).select("id", "title", "file_path")


@query("S13_find_image_file", "WITH k AS (SELECT DISTINCT metadata['file_path'] AS path FROM chunks WHERE metadata['file_path'] IS NOT NULL), b AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS base FROM k), w AS (SELECT DISTINCT base AS name FROM b) SELECT name, 2 AS priority, min(path) AS path FROM w JOIN b ON base = name GROUP BY 1")
def find_image(t):
    known = t.chunks.where(F.col("metadata")["file_path"].isNotNull()).select(F.col("metadata")["file_path"].alias("path")).distinct()
    return files.resolve_images(known.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).distinct(), known)


@query("S08_scan_hwpx_xml", "SELECT p_partkey || '.hwpx' AS path, 0 AS block, 'paragraph' AS kind, p_name AS text FROM part UNION ALL SELECT p_partkey || '.hwpx', 1, 'table', p_brand || chr(9) || p_type FROM part")
def hwpx(t):
    """Zipped documents made from parts, then parsed."""

    def pack(frames):
        import io
        import zipfile

        for frame in frames:
            contents = []
            for name, brand, kind in zip(frame["p_name"], frame["p_brand"], frame["p_type"]):
                cell = lambda x: f"<hp:tc><hp:p><hp:t>{x}</hp:t></hp:p></hp:tc>"
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("Contents/section0.xml", f'<s xmlns:hp="{files.PARAGRAPH[1:-1]}"><hp:p><hp:t>{name}</hp:t></hp:p><hp:tbl><hp:tr>{cell(brand)}{cell(kind)}</hp:tr></hp:tbl></s>')
                contents.append(buffer.getvalue())
            yield pd.DataFrame({"path": frame["p_partkey"].astype(str) + ".hwpx", "content": contents})

    return files.parse_hwpx(t.part.mapInPandas(pack, "path string, content binary")).select("path", "block", "kind", "text")


@query("S09_scan_images", "SELECT p_partkey || '.png' AS path, 12 AS length FROM part WHERE p_partkey % 3 = 0")
def images(t):
    content = F.when(F.col("p_partkey") % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A00000000"))).otherwise(F.encode(F.lit("no image"), "UTF-8"))
    rows = t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), content.alias("content"))
    return files.image_files(rows.withColumn("length", F.octet_length("content")))


@query("P24_region_ocr", f"WITH {BOXES} SELECT page, pos::INT AS pos, 'box ' || pos AS text FROM b WHERE label NOT IN ('image', 'chart', 'seal', 'formula', 'table')")
def regions(t):
    def reader(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[["page", "pos"]].assign(text="box " + frame["pos"].astype(str))

    return scorers.region_texts(boxes(t).withColumn("pos", F.col("pos").cast("int")), reader).select("page", "pos", "text")


@query("P20_pdf_to_png", "SELECT DISTINCT document_id AS doc, page_num AS page, document_id || '/' || page_num || '.png' AS path FROM documents WHERE page_num IS NOT NULL")
def rendered(t):
    def renderer(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(path=frame["doc"] + "/" + frame["page"].astype(str) + ".png")

    return scorers.rendered_pages(toc(t)[1], renderer).select("doc", "page", "path")


@query("ST2_incremental_ingest", "SELECT doc_id, source FROM documents")
def incremental(t):
    """The documents folder as a stream of files, upserted by one run over what is available."""
    place = folder_for(t.spark, "ingest")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.documents.schema)
    ingest(t.spark, t.folder() + "/documents.parquet", schema, place + "/checkpoint", lambda b: b.select("doc_id", "source"), place + "/table", ["doc_id"], "*").awaitTermination()
    return lifecycle.read_table(t.spark, place + "/table")
