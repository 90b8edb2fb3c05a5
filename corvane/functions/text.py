"""Text expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Particles that are cut from the end of Korean query words, in matching order.
PARTICLES = "은|는|이|가|을|를|의|에|에서|로|으로|와|과|도|만|까지|부터|에게|한테|께|라|이라|란|이란|처럼|같이|보다|마다|밖에|뿐|조차|마저|야|이야|요|이요|하고|이고|며|이며|든지|이든지|나|이나|라도|이라도|대로|뭔데|인데|인가|일까"
ENGLISH_WORD, KOREAN_WORD = r"[A-Za-z][A-Za-z0-9_\-]+", "[가-힣]+"
LETTERS = "[a-zA-Z가-힣]+"
#: Forms of mathematics, tables and code in Markdown or HTML.
LATEX = [r"\\\((.*?)\\\)", r"\$([^$]+)\$", r"\\\[(.*?)\\\]", r"\$\$(.*?)\$\$"]
TABLE, CODE = r"(?i)<table.*?</table>", r"```.*?```"


def _all(column: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def normalized(column: Column | str) -> Column:
    """Whitespace runs to one blank, stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def letter_tokens(column: Column | str) -> Column:
    """Distinct lower-case runs of Latin or Hangul letters."""
    return F.array_distinct(_all(F.lower(column), LETTERS))


def bm25_query(column: Column | str) -> Column:
    """English words, then Korean words without a trailing particle, two characters at least; the text itself if
    there are none."""
    column = F.col(column) if isinstance(column, str) else column
    korean = F.filter(F.transform(_all(column, KOREAN_WORD), lambda w: F.regexp_replace(w, f"({PARTICLES})$", "")), lambda w: F.length(w) >= 2)
    words = F.concat(_all(column, ENGLISH_WORD), korean)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(column)


def without_think(column: Column | str) -> Column:
    """Closed reasoning tags and their contents are removed, then an unclosed one with all that follows."""
    closed = F.regexp_replace(column, "(?s)<[tT]hink>.*?</[tT]hink>", "")
    return F.trim(F.regexp_replace(closed, "(?s)<[tT]hink>.*", ""))


def after_think(column: Column | str) -> Column:
    """What follows the first closing tag, or the text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.contains(column, F.lit("<think>")) & F.contains(column, F.lit("</think>")), F.trim(F.split(column, "</think>")[1])).otherwise(column)


def content_type(column: Column | str) -> Column:
    """latex, table, code or text, in this order."""
    column = F.col(column) if isinstance(column, str) else column
    latex = F.lit(False)
    for pattern in LATEX:
        latex = latex | column.rlike(f"(?s){pattern}")
    return F.when(latex, "latex").when(column.rlike(f"(?s){TABLE}"), "table").when(column.rlike(f"(?s){CODE}"), "code").otherwise("text")


def relation_type(column: Column | str) -> Column:
    """Upper case with underscores; RELATION for what is not an identifier."""
    name = F.regexp_replace(F.upper(F.trim(column)), " ", "_")
    return F.when(name.rlike("^[A-Z_][A-Z0-9_]*$"), name).otherwise("RELATION")


def math_expression(column: Column | str) -> Column:
    """All but digits, operators, points and brackets replaced by blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"[^0-9+\-*/().%^]", " "), r"\s+", " "))


def first_url(column: Column | str) -> Column:
    """The first http address without trailing punctuation; null if there is none."""
    url = F.regexp_replace(F.regexp_extract(column, r"https?://[\w\-._~:/?#\[\]@!$&'()*+,;=%]+", 0), r"[.,)]+$", "")
    return F.nullif(url, F.lit(""))


def stem(column: Column | str) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(column, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(column: Column | str) -> Column:
    """Lower-case extension with its point, or an empty string."""
    return F.lower(F.regexp_extract(column, r"[^/](\.[^./]+)$", 1))


def occurrences(column: Column | str, needle: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return ((F.length(column) - F.length(F.replace(column, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
