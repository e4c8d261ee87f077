"""Components against reachability, and elements of pages against an independent parser."""

import random
from html.parser import HTMLParser

import duckdb
import pytest

from draftlake.operators import network as N
from draftlake.operators import service as V
from draftlake.plans.queries import ORACLES, QUERIES
from draftlake.sources import html as H

EDGES = "graph_key string, src string, dst string"


def reachable(rows):
    ahead = {}
    for g, a, b in rows:
        if None not in (g, a, b):
            ahead.setdefault((g, a), set()).add((g, b))

    def from_(v):
        seen, stack = set(), list(ahead.get(v, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += ahead.get(x, ())
        return seen

    reach = {v: from_(v) for v in {(g, x) for g, a, b in rows for x in (a, b)}}
    out = set()
    for v, there in reach.items():
        mates = [w for w in there if v in reach[w]]
        if mates:
            out.add((*v, min(mates)[1], len(mates)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_as_reachability(spark, seed):
    r, rows = random.Random(seed), []
    for g in "abc":
        n = r.choice([5, 12, 20])
        rows += [(g, f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(r.choice([n - 1, n, 2 * n]))]
    ring = [(f"x{i}", f"x{(i + 1) % 9}") for i in range(9)]
    # A ring alone; one with a way round, a blind end and a node with an edge to itself on it.
    rows += [("r", *e) for e in ring] + [("q", *e) for e in [*ring, ("x3", "y"), ("y", "z"), ("z", "x5"), ("z", "w"), ("y", "y")]]
    rows += [("s", "a", "a"), ("s", "a", "b"), ("s", "c", "c"), ("t", None, "b"), (None, "a", "b")]
    df = spark.createDataFrame([*rows, *rows[:5]], EDGES)
    assert sorted(map(tuple, N.strong_components(df).collect())) == sorted(reachable([x for x in rows if None not in x]))
    assert N.strong_components(df.where("false")).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, keep = [], N._kept
    monkeypatch.setattr(N, "_kept", lambda df: rounds.append(1) or keep(df))
    rows = [("l", f"n{i:05}", f"n{i + 1:05}") for i in range(10_000)]
    rows += [("k", f"n{i:05}", f"n{i + 1:05}") for i in range(1000)] + [("k", "n01000", "n00000"), ("k", "n00500", "m")]
    got = N.strong_components(spark.createDataFrame(rows, EDGES)).groupBy("graph_key", "component", "size").count().collect()
    assert [tuple(r) for r in got] == [("k", "n00000", 1001, 1001)] and len(rounds) < 40


def test_dense_graphs_go_through_a_part_of_their_edges(spark, monkeypatch):
    """Rounds see less than all edges; parties that only the other edges hold together are found too."""
    seen, coloured = [], N._coloured
    monkeypatch.setattr(N, "_coloured", lambda edges, *a: seen.append(edges.count()) or coloured(edges, *a))
    r = random.Random(5)
    rows = [(g, f"n{i:02}", f"n{j:02}") for g in "ab" for i in range(40) for j in range(40) if i != j and r.random() < 0.7]
    # Two dense halves that one edge each way joins, a way in and a way out, and a dense graph without a cycle.
    rows += [("c", f"{h}{i:02}", f"{h}{j:02}") for h in "xy" for i in range(30) for j in range(30) if i != j]
    rows += [("c", "x00", "y00"), ("c", "y07", "x09"), ("c", "in", "x03"), ("c", "y03", "out"), ("c", "x01", "x01"), ("c", "out", "out")]
    rows += [("d", f"n{i:02}", f"n{j:02}") for i in range(40) for j in range(i + 1, 40)] + [(None, "a", "a")]
    df = spark.createDataFrame(rows, EDGES)
    assert sorted(map(tuple, N.strong_components(df).collect())) == sorted(reachable([x for x in rows if None not in x]))
    assert seen and max(seen) < len(rows) / 2
    assert sorted(map(tuple, N.has_cycle(df).collect()), key=str) == [("a", True), ("b", True), ("c", True), ("d", False), (None, False)]


class Reader(HTMLParser):
    """Text blocks and table cells by the standard library's events."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.tables, self.skip = [], [], [], 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(("text", text))

    def target(self):
        return self.tables[-1][-1][-1] if self.tables and self.tables[-1] and self.tables[-1][-1] and self.tables[-1][-1][-1] is not None else None

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        cell = self.target()
        if cell is None and tag in H.BLOCKS:
            self.flush()
        elif tag in H.BLOCKS or tag == "br":
            (self.text if cell is None else cell).append(" ")
        if tag == "table":
            self.tables.append([])
            self.out.append(("table", self.tables[-1]))
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            row = self.tables[-1][-1]
            if row and row[-1] is None:
                row.pop()
            row.append([])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if self.target() is None and tag in H.BLOCKS:
            self.flush()
        elif tag in H.BLOCKS:
            self.target().append(" ")
        if self.tables and tag == "table":
            self.tables.pop()
        elif self.tables and tag in ("td", "th", "tr") and self.target() is not None:
            self.tables[-1][-1].append(None)

    def handle_data(self, data):
        if not self.skip:
            cell = self.target()
            (self.text if cell is None else cell).append(data)


def independent(page):
    r = Reader()
    r.feed(page)
    r.close()
    r.flush()
    text = lambda cell: " ".join("".join(cell).split())
    out = []
    for kind, x in r.out:
        if kind == "text":
            out.append((kind, x))
        else:
            rows = [[text(c) for c in row if c is not None] for row in x]
            width = max(map(len, rows), default=0)
            if width:
                out.append((kind, [row + [""] * (width - len(row)) for row in rows]))
    return out


def test_pages_as_the_standard_parser(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {}
    for r in H.html_elements(spark.read.parquet(f"{sf}/pages.parquet")).orderBy("page_id", "element_idx").collect():
        got.setdefault(r.page_id, []).append((r.element_type, r.content))
    for key, page in pages.items():
        # A tag that is cut off at a page's end is no text here; the other parser gives it as text.
        cut = page[: page.rindex("<")] if "<" in page and ">" not in page[page.rindex("<") :] else page
        assert got[key] == independent(cut)


PAGES = {
    "plain": "<p>one<p>two <b>bold</b>&amp;<br>three<div>four",
    "table": "a<table><tr><th>h1<th>h2<tr><td>1</td><td>2</table>b",
    "unclosed": "<table><tr><td>x<td>y<tr><td>z",
    "nested": "<table><tr><td>out<table><tr><td>in</td></tr></table>er</td><td>next</td></tr></table>after",
    "no rows": "<table></table><table><tr></tr></table>text",
    "cells only": "<table><td>a<td>b</table>",
    "sections": "<table><thead><tr><th>k</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>",
    "script": "x<script>var a = '<p>no</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z",
    "empty": "",
}


def test_tables_as_the_standard_parser(spark):
    for name, page in PAGES.items():
        assert [(k, t if k == "text" else g) for k, t, g in H.elements_of(page)] == independent(page), name


def test_spans_cells_and_markdown(spark):
    page = "<table><tr><td rowspan=2>a<td colspan='2'>b<tr><td>c<td rowspan=\"0\">d<tr><td>e</table><td>stray<p>" + "x" * 60
    rows = [(1, page), (2, "<p>short"), (3, None), (4, "a < b <p"), (5, "<table><tr><td>/<td></table>")]
    found = H.html_elements(spark.createDataFrame(rows, "page_id long, html string"))
    got = {(r.page_id, r.element_idx): r for r in found.withColumn("md", H.markdown(found["cells"])).collect()}
    assert got[1, 0].cells == [["a", "b", "b"], ["a", "c", "d"], ["e", "", "d"]]
    assert got[1, 0].md == "| a | b | b |\n| --- | --- | --- |\n| a | c | d |\n| e |  | d |"
    assert [got[k].content for k in [(1, 1), (1, 2), (2, 0), (4, 0)]] == ["stray", "x" * 60, "short", "a < b"]
    tables = V.table_confidence(H.table_cells(found))
    assert {r.doc_id: r.confidence for r in tables.collect()} == {1: round(1 - 0.5 / 9, 6), 5: 0.6}
    assert {r.doc_id: r.method for r in V.table_choice(tables).collect()} == {1: "lattice", 5: "stream"}
    [stats] = H.parse_stats(found, tables).collect()
    assert stats.asDict() == {"text_pages": 1, "ocr_pages": 3, "text_elements": 4, "tables_lattice": 1, "tables_stream": 1, "tables_fallback": 0}


@pytest.mark.parametrize("name", ["page_elements", "page_parse_stats"])
def test_cut_references_and_odd_spaces_as_the_sql(spark, tmp_path, name):
    """Titles are cut within references; spaces that HTML does not know stay between words."""
    whole = ["&copy;", "&middot;", "&nbsp;", "&lt;", "&gt;", "&quot;", "&amp;", "&amp;lt;", "&eacute;", "&#39;"]
    cut = [x[:n] for x in whole for n in range(1, len(x) + 1)]
    spaces = [*" \t\n\f\r\v\x1c\x85\xa0\u2003\u2028\u3000"]
    pages = [f"<title>token = {x}</title><h1>{x}<br>{x}x</h1><p>{'y' * 36} {x}" for x in cut]
    pages += [f"<title>{x}a{x}b{x}</title><p>{x}</p><p>c {x} d" for x in spaces]
    rows = [(i, f"http://host{i}.example/", page) for i, page in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    said = con.sql(ORACLES[name])
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*said.columns).collect())) == sorted(said.fetchall())
    # All of HTML's references are read where none are named.
    assert H.elements_of("<p>&eacute; &quot &#39;")[0][1] == "é \" '"
