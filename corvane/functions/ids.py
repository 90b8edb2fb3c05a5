"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column | str, namespace: str = DNS_NAMESPACE) -> Column:
    """Version 5 UUID of a name, equal to that of the standard library."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.shiftright(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), 0).bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def document_id(path: Column | str) -> Column:
    return F.md5(path)


def chunk_key(document: Column | str, index: Column | str) -> Column:
    return F.concat(document, F.lit("_chunk_"), F.col(index).cast("string") if isinstance(index, str) else index.cast("string"))
