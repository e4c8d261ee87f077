"""Elements of web pages: blocks of text and tables as grids, in reading order."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a page consists of: comments and other declarations, elements that hold no text, tags, text.
#: A page may break off in any of them.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z"
    r"|<(?P<raw>script|style|template|noscript)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?>[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
SPAN = re.compile(r"\b(rowspan|colspan)\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE)
#: Tags at which one block of text ends and another begins; at a line break words only part.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: As browsers do, a cell spans so many columns and rows at most.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Between words HTML's white space and the no-break space become one space; at the ends of a text spaces of any kind go.
WHITE, SPACES = "\t\n\f\r\xa0", " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def single(parts: list[str]) -> str:
    text = "".join(parts)
    for c in WHITE:
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(SPACES)


def unescape(text: str, references: Sequence[tuple[str, str]] | None) -> str:
    """``references`` (name, character) are read one after another; None: all of HTML's, as browsers do."""
    if references is None:
        return html.unescape(text)
    for name, character in references if "&" in text else ():
        text = text.replace(name, character)
    return text


class Table:
    """A table whose rows and cells come in order; its place is that of its first tag."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.cell: list[str] | None = None

    def open_row(self) -> None:
        self.cell = None
        self.rows.append([])

    def open_cell(self, attributes: str) -> None:
        if not self.rows:
            self.open_row()
        spans = {name.lower(): int(n[:6]) for name, n in SPAN.findall(attributes)}
        # A row span of 0 reaches to the last row.
        down = spans.get("rowspan", 1) or MOST_ROWS
        self.cell = []
        self.rows[-1].append((self.cell, min(down, MOST_ROWS), max(1, min(spans.get("colspan", 1), MOST_COLUMNS))))

    def grid(self) -> list[list[str]]:
        """Rows of equal width; a cell's text stands in every place that it spans."""
        grid: list[dict[int, str]] = [{} for _ in self.rows]
        for i, row in enumerate(self.rows):
            at = 0
            for parts, down, across in row:
                while at in grid[i]:
                    at += 1
                text = single(parts)
                for line in grid[i : i + down]:
                    for j in range(at, at + across):
                        line.setdefault(j, text)
                at += across
        width = max((max(line, default=-1) + 1 for line in grid), default=0)
        return [[line.get(j, "") for j in range(width)] for line in grid if width]


def elements_of(page: str, references: Sequence[tuple[str, str]] | None = None) -> list[tuple[str, str | None, list[list[str]] | None]]:
    """(kind, text, grid) of a page, its texts by ``unescape``. Tables may stand in cells of others and may never be closed: an
    inner one is an element of its own behind the outer one, whose cell does not have its text."""
    out: list[tuple[str, str | None, Table | None]] = []
    held: list[str] = []
    tables: list[Table] = []

    def flush() -> None:
        text = single(held)
        held.clear()
        if text:
            out.append(("text", text, None))

    for token in TOKEN.finditer(page):
        if token["text"] is not None:
            cell = tables[-1].cell if tables else None
            (held if cell is None else cell).append(unescape(token["text"], references))
            continue
        tag = (token["tag"] or "").lower()
        cell = tables[-1].cell if tables else None
        if cell is None and tag in BLOCKS:
            flush()
        elif tag in BLOCKS or tag == "br":
            (held if cell is None else cell).append(" ")
        if tag == "table" and not token["end"]:
            tables.append(Table())
            out.append(("table", None, tables[-1]))
        elif tables and tag == "table":
            tables.pop()
        elif tables and tag in ("tr", "thead", "tbody", "tfoot"):
            tables[-1].cell = None
            if tag == "tr" and not token["end"]:
                tables[-1].open_row()
        elif tables and tag in ("td", "th"):
            tables[-1].cell = None
            if not token["end"]:
                tables[-1].open_cell(token["attributes"])
    flush()
    return [(kind, text, table.grid() if table else None) for kind, text, table in out if not table or table.grid()]


def html_elements(pages: DataFrame, key: str = "page_id", page: str = "html", references: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(key, element_idx, element_type, content, cells) of all elements of pages, in reading order.

    Text has content, white space between its words made single; a table has cells, rows of equal
    width. Scripts, styles and comments have none. Null and empty pages give no rows. ``references``
    are the character references that are read, in their order; None: all that HTML has.
    """
    kind = dict(pages.dtypes)[key]
    names = ["key", "element_idx", "element_type", "content", "cells"]
    types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                if rows := elements_of(text.as_py(), references):
                    columns = [pa.array(x, t) for x, t in zip((range(len(rows)), *zip(*rows, strict=True)), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(rows)), *columns], names)

    slim = pages.where(F.col(page).isNotNull()).select(F.col(key).alias("key"), F.col(page).alias("html"))
    found = slim.mapInArrow(run, f"key {kind}, element_idx int, element_type string, content string, cells array<array<string>>")
    return found.withColumnRenamed("key", key)


def markdown(cells: Column) -> Column:
    """A table's rows as Markdown: the first is the header."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(cells, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def table_cells(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """(doc_id, table_id, row, value, accuracy) of the tables among elements, for their confidence; a
    grid read from markup has every cell where it belongs."""
    rows = elements.where("element_type = 'table'").select(F.col(key).alias("doc_id"), F.col("element_idx").alias("table_id"), F.posexplode("cells").alias("row", "line"))
    return rows.select("doc_id", "table_id", "row", F.explode("line").alias("value"), F.lit(1.0).alias("accuracy"))


def parse_stats(elements: DataFrame, confidence: DataFrame, *by: str, key: str = "page_id", least: int = 50) -> DataFrame:
    """Pages by how they can be read, and tables by how they were taken, for each ``by``.

    A page with fewer than ``least`` characters of text counts as a scan, as it would go to text
    recognition. Tables (doc_id, table_id, confidence) count by the grade of their confidence.
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    size = F.sum(F.coalesce(F.length("content"), F.lit(0)))
    best = confidence.select(F.col("doc_id").alias(key), F.col("table_id").alias("element_idx"), "confidence")
    marked = elements.join(best, [key, "element_idx"], "left").groupBy(*by, key).agg(
        size.alias("size"), n(F.col("element_type") == "text").alias("texts"), n(F.col("confidence") >= 0.8).alias("lattice"),
        n((F.col("confidence") >= 0.6) & (F.col("confidence") < 0.8)).alias("stream"), n(F.col("confidence") < 0.6).alias("fallback"),
    )
    scanned = F.col("size") < least
    total = lambda c: F.sum(c).alias({"texts": "text_elements"}.get(c, f"tables_{c}"))
    return marked.groupBy(*by).agg(F.count_if(~scanned).alias("text_pages"), F.count_if(scanned).alias("ocr_pages"), *map(total, ("texts", "lattice", "stream", "fallback")))
