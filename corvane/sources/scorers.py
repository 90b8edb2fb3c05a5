"""Model calls behind one interface: a batch of rows in, a batch of results out. The built-in scorers need no model."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score(rows: DataFrame, scorer: Scorer, schema: str, retries: int = 1) -> DataFrame:
    """Applies ``scorer`` to Arrow batches. A failing batch is tried again, then given up: its rows come out with the
    error in ``error`` and nulls elsewhere. ``schema`` must have the column ``error string``."""
    names = [c.split()[0] for c in schema.split(", ")]
    texts = {c.split()[0] for c in schema.split(", ") if c.split()[1] == "string"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for attempt in range(retries + 1):
                try:
                    out = scorer(frame)
                    out["error"] = None
                    break
                except Exception as e:  # noqa: BLE001
                    if attempt == retries:
                        out = frame.reindex(columns=names)
                        out["error"] = type(e).__name__
            out = out.reindex(columns=names)
            yield pd.DataFrame({c: pd.Series([x if isinstance(x, str) else None for x in out[c]], dtype=object) if c in texts else out[c].to_numpy() for c in names})

    return rows.mapInPandas(run, schema)


def hashed_embedding(text: str | None, width: int = 64) -> list[float] | None:
    """Unit vector of signed word hashes; null for a text without words."""
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return None
    v = np.zeros(width)
    for w in words:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % width] += 1 if h >> 63 else -1
    n = float(np.sqrt((v * v).sum()))
    return (v / n).tolist() if n > 1e-10 else v.tolist()


def embed(rows: DataFrame, id_col: str = "id", text_col: str = "text", width: int = 64) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()

    def scorer(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": frame["id"], "embedding": [hashed_embedding(t, width) for t in frame["text"]]})

    return score(rows.selectExpr(f"{id_col} AS id", f"{text_col} AS text"), scorer, f"id {kind}, embedding array<double>, error string")


DEFAULTS = {"primary_language": "ko", "is_rotation_valid": True, "rotation_correction": 0, "is_table": False, "is_diagram": False, "natural_text": ""}


def repaired_page(raw: str | None) -> dict:
    """Fields of a page response: strict JSON, then JSON with broken escapes removed and the end closed, then the text
    field alone, then defaults."""
    text = raw or ""
    closed = re.sub(r"\\u(?![0-9a-fA-F]{4})[0-9a-fA-F]{0,3}", "", text)
    attempts = [text, closed, closed + '"}', closed[: closed.rfind('",') + 1] + "}" if '",' in closed else ""]
    for attempt in attempts:
        try:
            data = json.loads(attempt)
            if isinstance(data, dict):
                return {**DEFAULTS, **{k: v for k, v in data.items() if k in DEFAULTS}}
        except ValueError:
            continue
    m = re.search(r'"natural_text"\s*:\s*"((?:[^"\\]|\\.)*)', text, re.DOTALL)
    return {**DEFAULTS, "natural_text": m.group(1).replace('\\"', '"').replace("\\n", "\n") if m else ""}


def parse_pages(rows: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()

    def scorer(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([repaired_page(t) for t in frame["raw"]], columns=list(DEFAULTS))
        out.insert(0, "id", frame["id"].to_numpy())
        return out

    schema = f"id {kind}, primary_language string, is_rotation_valid boolean, rotation_correction int, is_table boolean, is_diagram boolean, natural_text string, error string"
    return score(rows.selectExpr(f"{id_col} AS id", f"{raw_col} AS raw"), scorer, schema)


def extraction_lines(reply: str) -> list[str]:
    """Entity and relation lines of a model's reply: reasoning and preamble removed, one item a line."""
    text = reply.split("</think>", 1)[-1]
    text = re.sub(r"\s*(?=ENT_\d+\s*(?:\||->))(?<!-> )(?<!->)", "\n", text)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    first = next((i for i, x in enumerate(lines) if re.match(r"ENT_\d+\s*(?:\||->)", x)), 0)
    return lines[first:]


#: Labels whose boxes are not read.
UNREAD = ["image", "chart", "seal", "formula", "table"]


def region_texts(boxes: DataFrame, reader: Scorer, retries: int = 3) -> DataFrame:
    """Texts of the boxes that are to be read (``page, pos, label, x1, y1, x2, y2``) by a pluggable reader of batches."""
    rows = boxes.where(~boxes["label"].isin(*UNREAD))
    return score(rows, reader, "page bigint, pos int, text string, error string", retries)


def rendered_pages(pages: DataFrame, renderer: Scorer) -> DataFrame:
    """Images of pages (``doc, page``) by a pluggable renderer; office files and unwarping are renderers, too."""
    return score(pages, renderer, "doc string, page int, path string, error string")
