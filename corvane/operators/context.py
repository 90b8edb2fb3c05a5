"""Formatting of results as context for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def entity_snippet(name: str, kind: str, description: str | None = None) -> Column:
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    out = F.concat(F.lit("[엔티티] "), F.coalesce(some(name), F.lit("unknown")), F.coalesce(F.concat(F.lit(" ("), some(kind), F.lit(")")), F.lit("")))
    return F.concat(out, F.coalesce(F.concat(F.lit(": "), some(description)), F.lit(""))) if description else out


def event_snippet(title: str) -> Column:
    return F.concat(F.lit("[이벤트] "), F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit("unknown")))


def relation_snippet(source: str, relation: str, target: str) -> Column:
    return F.concat(F.lit("[관계] "), F.coalesce(source, F.lit("?")), F.lit(" --["), F.coalesce(relation, F.lit("관련")), F.lit("]--> "), F.coalesce(target, F.lit("?")))


def distinct_snippets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First appearance of each snippet by ``kind`` and ``pos``."""
    w = Window.partitionBy(*keys, "snippet").orderBy("kind", "pos")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def snippet_title(snippet: Column | str, most: int = 60) -> Column:
    title = F.trim(F.regexp_replace(snippet, r"^[^\]]*\]", ""))
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("…"))).otherwise(title)


def metadata_suffix(source: Column, page: Column, score: Column) -> Column:
    shown = F.when(page.isNotNull() & (page != 0), F.concat(F.lit("페이지: "), page.cast("string")))
    parts = F.concat_ws(", ", F.concat(F.lit("출처: "), F.nullif(source, F.lit(""))), shown, F.when(score.isNotNull(), F.concat(F.lit("유사도: "), F.format_string("%.4f", score.cast("double")))))
    return F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(F.lit(""))


def text_line(rank: Column, text: Column, suffix: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". "), F.trim(text), suffix)


def image_line(rank: Column, title: Column, path: Column, caption: Column, suffix: Column) -> Column:
    name = F.split(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), "_")[0]
    none = lambda c: F.when(~F.lower(F.trim(c)).isin("none", ""), F.trim(c))
    shown = F.coalesce(none(title), F.nullif(name, F.lit("")), F.lit("이미지"))
    return F.concat(rank.cast("string"), F.lit(". "), shown, suffix, F.coalesce(F.concat(F.lit("\n   - "), none(caption)), F.lit("")))


def joined(rows: DataFrame, keys: list[str], line: str, order: str, header: str) -> DataFrame:
    """One context for each key: a header and the lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(line)))), lambda x: x[line])
    return rows.groupBy(*keys).agg(F.concat(F.lit(header), F.array_join(lines, "\n")).alias("context"))
