"""Segments of recordings: ``recording_id, start, end_time, speaker, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.plans.islands import islands

#: Rows of one recording are numbered in spans of so many seconds.
SPAN_S = 900.0


def gap_fill(segments: DataFrame, durations: DataFrame | None = None, gap: float = 0.5, key: str = "recording_id") -> DataFrame:
    """Segments and, where one begins more than ``gap`` after the end of the one before, an UNKNOWN one between; likewise
    after the last one of a recording whose ``duration`` is known."""
    w = Window.partitionBy(key).orderBy("start", "end_time")
    before = segments.withColumn("current", F.coalesce(F.lag("end_time").over(w), F.lit(0.0)))
    unknown = lambda rows, a, b: rows.select(key, F.col(a).alias("start"), F.col(b).alias("end_time"), F.lit("UNKNOWN").alias("speaker"))
    filled = segments.select(key, "start", "end_time", "speaker").union(unknown(before.where(F.col("start") > F.col("current") + gap), "current", "start"))
    if durations is None:
        return filled
    last = segments.groupBy(key).agg(F.max_by("end_time", F.struct("start", "end_time")).alias("current"))
    ends = durations.join(last, key, "left").withColumn("current", F.coalesce("current", F.lit(0.0)))
    return filled.union(unknown(ends.where(F.col("duration") > F.col("current") + gap), "current", "duration"))


def split_long(segments: DataFrame, most: float = 15.0) -> DataFrame:
    """Pieces of at most ``most`` seconds."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end_time") - F.col("start")) / most)).cast("int")
    rows = segments.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(*[c for c in segments.columns if c not in ("start", "end_time")], F.col("i").alias("piece"), F.round(F.col("start") + F.col("i") * most, 6).alias("start"), F.round(F.least(F.col("end_time"), F.col("start") + (F.col("i") + 1) * most), 6).alias("end_time"))


def long_enough(segments: DataFrame, least: float = 0.1) -> DataFrame:
    return segments.where(F.col("end_time") > F.col("start") + least)


def spoken(segments: DataFrame) -> DataFrame:
    """Stripped texts; blank ones and those that begin with a control mark are dropped."""
    return segments.withColumn("text", F.trim("text")).where((F.col("text") != "") & ~F.col("text").startswith("<|"))


def merge_adjacent(segments: DataFrame, order: list[str], key: str = "recording_id") -> DataFrame:
    """Consecutive segments of one speaker become one, with their texts joined; UNKNOWN ones without text are dropped.
    ``order`` begins with ``start``."""
    span = F.floor(F.coalesce("start", F.lit(1e15)) / SPAN_S)
    numbered = islands(segments, key, [F.col(c) for c in order], "speaker", span)
    at = F.struct(*order)
    merged = numbered.groupBy(key, "island").agg(F.first("speaker").alias("speaker"), F.min_by("start", at).alias("start"), F.max_by("end_time", at).alias("end_time"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("said")))), lambda x: x["said"]), " ").alias("text"))
    return merged.where(~((F.coalesce("speaker", F.lit("")) == "UNKNOWN") & (F.trim("text") == "")))


def timeline(merged: DataFrame, key: str = "recording_id") -> DataFrame:
    """One Markdown text for each recording: a heading with speaker and times before each turn."""
    line = F.format_string("### %s (%.2fs - %.2fs)\n%s", F.coalesce("speaker", F.lit("None")), "start", "end_time", "text")
    rows = merged.withColumn("line", line)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))


def plain_text(merged: DataFrame, key: str = "recording_id") -> DataFrame:
    """The text of known speakers, one turn a line."""
    rows = merged.where("speaker <> 'UNKNOWN'")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "text"))), lambda x: x["text"]), "\n").alias("text"))
