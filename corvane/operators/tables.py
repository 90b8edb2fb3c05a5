"""Tables in Markdown and HTML as matrices of cells, and back; Arrow UDFs over whole batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

RESULT = "struct<html:string,error:string>"


class _Cells(HTMLParser):
    """Rows of (text, mark, rowspan, colspan); a mark is one of l, t and lt."""

    def __init__(self):
        super().__init__()
        self.rows, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            spans = dict(attrs)
            self.open = ["", None, int(spans.get("rowspan") or 1), int(spans.get("colspan") or 1)]
            self.rows[-1].append(self.open)
        elif tag in ("l", "t", "lt") and self.open is not None:
            self.open[1] = tag

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open[0] += data


def _rows(html: str) -> list[list[list]]:
    parser = _Cells()
    parser.feed(html)
    if not parser.rows:
        raise ValueError("no table")
    return parser.rows


def spans_of(matrix_html: str) -> str:
    """HTML with spans from a matrix in which <l> continues the cell to the left, <t> the one above, <lt> both."""
    rows = _rows(matrix_html)
    width = len(rows[0])
    if any(len(r) != width for r in rows):
        raise ValueError("rows of different length")
    mark = [[c[1] for c in r] for r in rows]
    used = [[False] * width for _ in rows]
    out = []
    for i, row in enumerate(rows):
        cells = []
        for j, cell in enumerate(row):
            if used[i][j]:
                continue
            if mark[i][j]:
                raise ValueError("a mark continues no cell")
            down = next((k for k in range(i + 1, len(rows)) if mark[k][j] != "t"), len(rows)) - i
            right = next((k for k in range(j + 1, width) if mark[i][k] != "l"), width) - j
            for a in range(i, i + down):
                for b in range(j, j + right):
                    if a > i and b > j and mark[a][b] != "lt":
                        raise ValueError("a span is not a rectangle")
                    used[a][b] = True
            attributes = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{right}"' if right > 1 else "")
            cells.append(f"<td{attributes}>{cell[0].strip()}</td>")
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(out) + "</table>"


def matrix_of(span_html: str) -> str:
    """The matrix of an HTML table with spans."""
    rows = _rows(span_html)
    width = sum(c[3] for c in rows[0])
    grid = [[None] * width for _ in rows]
    for i, row in enumerate(rows):
        for text, _, down, right in row:
            free = [j for j in range(width) if grid[i][j] is None]
            if not free or i + down > len(rows) or free[0] + right > width:
                raise ValueError("a span leaves the table")
            for a in range(down):
                for b in range(right):
                    if grid[i + a][free[0] + b] is not None:
                        raise ValueError("cells overlap")
                    grid[i + a][free[0] + b] = text.strip() if not a and not b else "<l>" if not a else "<t>" if not b else "<lt>"
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c or ''}</td>" for c in r) + "</tr>" for r in grid) + "</table>"


def _batch(convert):
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                out.append((convert(text) if isinstance(text, str) else None, None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["html", "error"])

    return F.pandas_udf(run, RESULT)


def to_spans():
    return _batch(spans_of)


def to_matrix():
    return _batch(matrix_of)


def translate_blocks(convert=spans_of):
    """Converts the blocks of a Markdown text that hold a table; blocks are separated by blank lines."""

    def one(text):
        blocks = re.split(r"\n\s*\n", text)
        return "\n\n".join(convert(b) if "<table" in b.lower() else b for b in blocks)

    return _batch(one)
