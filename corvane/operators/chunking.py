"""Sections and chunks of documents without a UDF: folds over arrays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def greedy_chunks(sections: Column | str, most: int = 1000) -> Column:
    """Sections joined by blank lines until the next would make a chunk longer than ``most`` characters; a longer
    section stays whole. A chunk that was begun empty starts with a blank line, and blank lines are counted."""
    sections = F.col(sections) if isinstance(sections, str) else sections
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(state, section):
        full = F.length(state["current"]) + F.length(section) > most
        flushed = F.when(state["current"] != "", F.concat(state["done"], F.array(state["current"]))).otherwise(state["done"])
        return F.struct(F.when(full, flushed).otherwise(state["done"]).alias("done"), F.when(full, section).otherwise(F.concat(state["current"], F.lit("\n\n"), section)).alias("current"))

    return F.aggregate(sections, empty, step, lambda s: F.when(s["current"] != "", F.concat(s["done"], F.array(s["current"]))).otherwise(s["done"]))


def line_sections(text: Column | str) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def numbered_chunks(documents: DataFrame, id_col: str, text_col: str, most: int = 1000) -> DataFrame:
    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(greedy_chunks(line_sections(text_col), most)).alias("chunk_index", "text"))
    return rows.select("id", "chunk_index", "text")


def boundaries(chunks: Column | str, text: Column | str) -> Column:
    """Start and end of each chunk's stripped text in the whole text, searched from the end of the one before; where
    it isn't found, it starts there."""
    text = F.col(text) if isinstance(text, str) else text
    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("at"))

    def step(state, chunk):
        body = F.trim(F.regexp_replace(chunk, r"^\s+|\s+$", ""))
        found = F.call_function("locate", body, text, state["at"] + 1)
        start = F.when(found > 0, found - 1).otherwise(state["at"])
        end = start + F.length(body)
        return F.struct(F.concat(state["done"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("done"), end.alias("at"))

    return F.aggregate(chunks, empty, step, lambda s: s["done"])


def distinct_lines(text: Column | str) -> Column:
    """Lines repeated without regard to case and blanks are dropped; blank lines and table rows are kept."""
    lines = F.split(text, "\n")
    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(state, line):
        key = F.lower(F.trim(line))
        fixed = (key == "") | (F.substring(key, 1, 1) == "|")
        repeated = ~fixed & F.array_contains(state["seen"], key)
        return F.struct(F.when(fixed | repeated, state["seen"]).otherwise(F.concat(state["seen"], F.array(key))).alias("seen"), F.when(repeated, state["out"]).otherwise(F.concat(state["out"], F.array(F.when(key == "", F.lit("")).otherwise(line)))).alias("out"))

    return F.aggregate(lines, empty, step, lambda s: F.array_join(s["out"], "\n"))
