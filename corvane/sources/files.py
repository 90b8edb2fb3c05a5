"""Files as tables: every reader is a Spark source with a narrow parse on top."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.text import extension, stem

#: Extensions by kind of file, in order of dispatch.
KINDS = {
    "pdf": [".pdf"],
    "office": [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".hwp", ".hwpx"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp"],
    "sound": [".wav", ".mp3", ".ogg", ".flac", ".webm", ".mp4", ".mov", ".avi", ".wmv"],
}
PARAGRAPH = "{http://www.hancom.co.kr/hwpml/2011/paragraph}"


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under ``root`` without those in metadata folders: ``path, length, modificationTime, content``. The
    content is read only where it is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.where(~F.col("path").rlike(r"/metadata/"))


def file_catalog(files: DataFrame) -> DataFrame:
    """Name, folder, size, extension, MD5, kind and time of each file."""
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.col("length").alias("size"),
        extension("path").alias("extension"), F.md5("content").alias("md5"), kind_of("path").alias("kind"), F.col("modificationTime").alias("modified_at"),
    )


def kind_of(path: Column | str, mime: Column | None = None) -> Column:
    """pdf, office, image, sound or unsupported: by extension, then by MIME type if given."""
    e = extension(path)
    out = F.when(e.isin(*KINDS["pdf"]), "pdf").when(e.isin(*KINDS["office"]), "office").when(e.isin(*KINDS["image"]), "image").when(e.isin(*KINDS["sound"]), "sound")
    if mime is not None:
        out = out.when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").when(mime.rlike("^(audio|video|sound)/"), "sound")
    return out.otherwise("unsupported")


def markdown_sections(text: str) -> list[tuple[str, str, str]]:
    """Paragraphs, list items, code, quotes and tables in order: (kind, text, source)."""
    out, lines, i = [], text.replace("\r\n", "\n").split("\n"), 0
    inline = lambda s: re.sub(r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", r"\1", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)).strip()
    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append(("code", "\n".join(lines[i + 1 : end]).strip(), "\n".join(lines[i : end + 1])))
            i = end + 1
        elif re.match(r"\s*([-*+]|\d+[.)])\s+", line):
            out.append(("item", inline(re.sub(r"^\s*([-*+]|\d+[.)])\s+", "", line)), line))
            i += 1
        elif line.startswith("#") or not line.strip():
            i += 1
        else:
            end = i
            while end < len(lines) and lines[end].strip() and not lines[end].startswith(("#", "```")) and not re.match(r"\s*([-*+]|\d+[.)])\s+", lines[end]):
                end += 1
            body = "\n".join(lines[i:end])
            kind = "quote" if line.startswith(">") else "table" if line.lstrip().startswith("|") or "<table" in body.lower() else "paragraph"
            out.append((kind, inline(re.sub(r"(?m)^>\s?", "", body)) if kind != "table" else body.strip(), body))
            i = end
    return [s for s in out if s[1]]


def _sections(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(p, i, *s) for p, t in zip(frame["path"], frame["text"]) for i, s in enumerate(markdown_sections(t or ""))]
        yield pd.DataFrame(rows, columns=["path", "section", "kind", "text", "raw_text"])


SECTIONS = "path string, section int, kind string, text string, raw_text string"


def sections_of(texts: DataFrame) -> DataFrame:
    """Sections of ``path, text`` rows."""
    return texts.select("path", "text").mapInPandas(_sections, SECTIONS)


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return sections_of(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


GRAPH = "document_id string, entities array<struct<entity_id:string,name:string,type:string,chunk_id:int>>, events array<struct<name:string,title:string>>, relations array<struct<source_id:string,target_id:string,relation:string,chunk_id:int,document_id:string>>"


def scan_graph_json(spark: SparkSession, root: str, documents: DataFrame | None = None) -> DataFrame:
    """Extraction results in ``*.graph.json``; the document is named by the file, its uuid joined if known."""
    rows = spark.read.schema(GRAPH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.graph.json").json(root)
    rows = rows.withColumn("document_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.graph\.json$", ""))
    return rows if documents is None else rows.join(documents.select("document_id", "document_uuid"), "document_id", "left")


LAYOUT = "input_path string, boxes array<struct<label:string,coordinate:array<double>,text:string,score:double>>"


def scan_layout_json(spark: SparkSession, root: str) -> DataFrame:
    """Boxes of ``layout_*.json``: ``folder, page, pos, label, x1, y1, x2, y2, text, score``."""
    rows = spark.read.schema(LAYOUT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "layout_*.json").json(root)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"), layout_page(F.col("_metadata.file_name")).alias("page"), F.posexplode("boxes").alias("pos", "b"))
    at = lambda i: F.get(F.col("b.coordinate"), F.lit(i))
    return rows.select("folder", "page", "pos", "b.label", at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"), "b.text", "b.score")


def layout_page(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(name, r"layout_([0-9]+)", 1), F.lit("")).cast("int")


def image_metadata(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Items of the three forms of image metadata: a map under "metadata", a list of {"metadata": ...}, a list."""

    def run(frames):
        for frame in frames:
            rows = []
            for text in frame["value"]:
                try:
                    data = json.loads(text)
                except (TypeError, ValueError):
                    continue
                if isinstance(data, dict) and isinstance(data.get("metadata"), dict):
                    items = [{**v, "id": k} for k, v in data["metadata"].items() if isinstance(v, dict)]
                else:
                    items = [x.get("metadata", x) for x in data if isinstance(x, dict)] if isinstance(data, list) else []
                for i, item in enumerate(items):
                    text_of = lambda k: None if item.get(k) is None else str(item[k])  # noqa: B023, E731
                    rows.append((text_of("id") or f"item_{i}", text_of("title"), text_of("file_path"), text_of("text"), text_of("con_type")))
            yield pd.DataFrame(rows, columns=["id", "title", "file_path", "text", "con_type"])

    return raw.select(F.col(json_col).alias("value")).mapInPandas(run, "id string, title string, file_path string, text string, con_type string")


def scan_image_metadata_json(spark: SparkSession, root: str) -> DataFrame:
    return image_metadata(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_metadata.json").text(root, wholetext=True))


def hwpx_blocks(content: bytes) -> list[tuple[str, str]]:
    """Paragraphs and tables (rows of cells joined by tabs) of a zipped document, in order. A paragraph inside a
    table is part of the table only."""
    out = []
    text_of = lambda node: " ".join(t.text.strip() for t in node.iter(PARAGRAPH + "t") if t.text and t.text.strip())

    def walk(node):
        for child in node:
            if child.tag == PARAGRAPH + "tbl":
                rows = ["\t".join(text_of(c) for c in r.findall(PARAGRAPH + "tc")) for r in child.findall(PARAGRAPH + "tr")]
                out.append(("table", "\n".join(rows)))
            elif child.tag == PARAGRAPH + "p" and child.find(".//" + PARAGRAPH + "tbl") is None:
                if text := text_of(child):
                    out.append(("paragraph", text))
            else:
                walk(child)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.search(r"section\d*\.xml$", n)):
            walk(ElementTree.fromstring(z.read(name)))
    return out


def parse_hwpx(zipped: DataFrame) -> DataFrame:
    """``path, block, kind, text, error`` of ``path, content`` rows; an unreadable file gives one row with its error."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path, i, kind, text, None) for i, (kind, text) in enumerate(hwpx_blocks(bytes(content)))]
                except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, type(e).__name__))
            out = pd.DataFrame(rows, columns=["path", "block", "kind", "text", "error"]).astype({"block": "Int32"})
            yield out.assign(**{c: out[c].astype(object).where(out[c].notna(), None) for c in ("kind", "text", "error")})

    return zipped.select("path", "content").mapInPandas(run, "path string, block int, kind string, text string, error string")


def scan_hwpx(spark: SparkSession, root: str) -> DataFrame:
    return parse_hwpx(scan_files(spark, root, "*.hwpx"))


def decodable(content: Column | str) -> Column:
    """The bytes begin like a PNG, JPEG, GIF, BMP, TIFF or WebP image."""
    magic = F.hex(F.substring(content, 1, 12))
    return magic.rlike("^(89504E47|FFD8FF|47494638|424D|49492A00|4D4D002A|52494646.{8}57454250)")


def image_files(found: DataFrame) -> DataFrame:
    """Image files by extension and signature, each once in order of path."""
    return found.where((kind_of("path") == "image") & decodable("content")).select("path", "length").distinct().orderBy("path")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    return image_files(scan_files(spark, root))


def data_url(path: Column | str, content: Column | str, most: int = 10 * 1024 * 1024) -> Column:
    """Base64 data address of a non-empty image of bounded size, else null."""
    types = {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".gif": "gif", ".bmp": "bmp", ".webp": "webp", ".tiff": "tiff"}
    kind = F.create_map(*[F.lit(x) for p in types.items() for x in p])[extension(path)]
    size = F.octet_length(content)
    return F.when(kind.isNotNull() & (size > 0) & (size <= most), F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content)))


def resolve_images(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted (name)`` against ``known (path)``: the whole path, the base name, then the stem; the first in order."""
    w = wanted.select("name", F.regexp_extract("name", r"([^/]+)$", 1).alias("base"), stem("name").alias("stem")).distinct()
    k = known.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("base"), stem("path").alias("stem")).distinct()
    whole = w.join(k.select("path"), w["name"] == k["path"]).select("name", F.lit(1).alias("priority"), "path")
    base = w.join(k.select("path", "base"), "base").select("name", F.lit(2).alias("priority"), "path")
    by_stem = w.join(k.select("path", "stem"), "stem").select("name", F.lit(3).alias("priority"), "path")
    return whole.union(base).union(by_stem).groupBy("name").agg(F.min(F.struct("priority", "path")).alias("m")).select("name", "m.priority", "m.path")
