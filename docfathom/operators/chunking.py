"""Chunking and HTML: recursive splitting, parent and child chunks, HTML to text. Pandas UDFs, as the rules walk a text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, base sizes and overlaps by document type, bounds.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
BASE_SIZE = {"pdf": 800, "code": 600, "html": 1000}
OVERLAP = {"pdf": 0.25, "code": 0.19, "html": 0.35}
MIN_SIZE, MAX_SIZE, EMBED_CHARS = 400, 1200, 709
PARENT, CHILD = (1200, 0.15), (400, 0.20)


def split(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that allows it; each begins with the end of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next(s for s in separators if not s or s in text)
    finer = separators[separators.index(sep) + 1 :]
    parts = [text[k : k + size] for k in range(0, len(text), size)] if not sep else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    held = ""
    for part in parts:
        if len(part) > size:
            if held.strip():
                out.append(held)
            out += split(part, size, overlap, finer)
            held = ""
        elif len(held) + len(part) > size:
            if held.strip():
                out.append(held)
            tail = held[-overlap:] if overlap and len(part) + overlap <= size else ""
            held = tail[tail.find(" ") + 1 :] + part if " " in tail else tail + part
        else:
            held += part
    if held.strip():
        out.append(held)
    return [x.strip() for x in out]


def chunk_params(text: Column, doc_type: Column) -> tuple[Column, Column]:
    """Size and overlap: the base of the type, less 200 for many headings, more or less by sentence length; capped for the embedder."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in BASE_SIZE.items() for x in p]), doc_type), F.lit(800))
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in OVERLAP.items() for x in p]), doc_type), F.lit(0.25))
    headings = F.regexp_count(text, F.lit(r"(?m)^#{1,6} ")) / F.greatest(F.lit(1), F.length(text)) * 100
    words = F.size(F.split(text, r"\s+")) / F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    size = base - F.when(headings > 0.15, 200).otherwise(0) + F.when(words > 25, 200).when(words < 10, -100).otherwise(0)
    size = F.least(F.lit(EMBED_CHARS), F.greatest(F.lit(MIN_SIZE), F.least(F.lit(MAX_SIZE), size)))
    return size, F.greatest(F.lit(50), (size * F.least(share, F.lit(0.2))).cast("int"))


CHUNKS = "doc_id long, chunk_index int, chunk_id string, text string"


def chunks(docs: DataFrame, doc_type: str = "html") -> DataFrame:
    """(doc_id, chunk_index, chunk_id, text) with adaptive sizes."""
    size, overlap = chunk_params(F.col("text"), F.lit(doc_type))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, k, f"{d}-chunk-{k}", c) for d, t, s, o in frame.itertuples(index=False) for k, c in enumerate(split(t or "", s, o))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_id", "text"])

    return docs.select("doc_id", "text", size.cast("int").alias("size"), overlap.cast("int").alias("overlap")).mapInPandas(run, CHUNKS.replace("doc_id long", f"doc_id {dict(docs.dtypes)['doc_id']}"))


def parents_and_children(docs: DataFrame) -> DataFrame:
    """(doc_id, parent_id, child_id, parent_index, child_index, text): children of each parent chunk, the parent itself with child_index -1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, t in frame.itertuples(index=False):
                for i, p in enumerate(split(t or "", PARENT[0], int(PARENT[0] * PARENT[1]))):
                    rows.append((d, f"parent_{i}", None, i, -1, p))
                    rows += [(d, f"parent_{i}", f"child_{i}_{j}", i, j, c) for j, c in enumerate(split(p, CHILD[0], int(CHILD[0] * CHILD[1])))]
            yield pd.DataFrame(rows, columns=["doc_id", "parent_id", "child_id", "parent_index", "child_index", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, parent_id string, child_id string, parent_index int, child_index int, text string")


# Elements without content of their own, and words of containers that hold navigation.
DROPPED = ("script", "style", "nav", "header", "footer", "noscript", "svg")
NAVIGATION = ("nav", "header", "footer", "breadcrumb", "toc", "menu", "sidebar")
BREAKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "ul", "ol", "table")
VOID = ("br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track")


class Page(HTMLParser):
    """Text, tables as pipe rows, and links of a page; forgiving of missing end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.hidden: list[str] = []
        self.table: list[list[str]] | None = None
        self.tables = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "a" and named.get("href"):
            self.links.append(named["href"])
        marks = f"{named.get('class') or ''} {named.get('id') or ''}".lower()
        if tag not in VOID and (self.hidden and tag == self.hidden[0] or not self.hidden and (tag in DROPPED or tag in ("div", "ul", "aside", "section") and any(n in marks for n in NAVIGATION))):
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.table[-1].append("")
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag == "table" and self.table is not None:
            self.tables += 1
            rows = [" | ".join(c.strip() for c in row) for row in self.table if row]
            self.out += [f"\n[TABLE {self.tables}]\n", "\n".join(rows), "\n"]
            self.table = None
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.table and self.table[-1]:
            self.table[-1][-1] += data
        elif self.table is None:
            self.out.append(data)

    def text(self) -> str:
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        return "\n".join(line for line in lines if line)


def read_page(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


#: Pages that a task holds as read at once.
PAGES = 64


def read_pages(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    for every in frames:
        for low in range(0, len(every), PAGES):
            frame = every.iloc[low : low + PAGES]
            found = [read_page(h) for h in frame.html]
            yield pd.DataFrame({key: frame[key], "text": [p.text() for p in found], "n_tables": [p.tables for p in found], "links": [p.links for p in found]})


def html_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text, n_tables, links) of rows (key, html)."""
    return pages.select(key, "html").mapInPandas(lambda frames: read_pages(frames, key), f"{key} long, text string, n_tables int, links array<string>")
