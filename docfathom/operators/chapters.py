"""Chapters of long documents: lines of a contents list, headings, and which heading each contents line means.

Contents lists name chapters that were moved, renamed or left out, and their page numbers lie; headings repeat in page headers. Both
come in order, so they are matched by the alignment that keeps the order and is most alike in all, found by dynamic programming
over the lines of one document, which a task holds; a document of more than MOST lines of either kind is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of one kind in a document, at most, and the least likeness of two titles.
MOST, ALIKE = 5_000, 0.5
#: Likeness of a title to one that differs, if both have the same number.
SAME_NUMBER = 0.55
#: Documents whose lines a task holds as objects at once.
DOCUMENTS = 256
CONTENTS = r"^(?:(?i:chapter|section|part)[ \t]+)?([0-9]{1,3}|[IVXLC]{1,7})?[.:)]?[ \t]*(\S.*?)[ \t]*(?:\.{2,}|…|[ \t]{2,}|\t)[ .\t]*([0-9]{1,4})$"
HEADING = r"^(?:(?i:chapter|section|part)[ \t]+([0-9]{1,3}|[IVXLC]{1,7})[.:)]?[ \t]*(.*)|([0-9]{1,3})[.)]?[ \t]+(\p{Lu}.*))$"
LONGEST_HEADING = 120


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, k: F.struct(k.cast("int").alias("line"), F.trim(line).alias("s")))


def contents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, number, title, page) of lines that look like a contents list's; number is empty where there is none."""
    rows = docs.select(key, F.explode(F.filter(_lines(F.col("text")), lambda x: x["s"].rlike(CONTENTS))).alias("x"))
    part = lambda g: F.regexp_extract("x.s", CONTENTS, g)
    return rows.select(key, "x.line", part(1).alias("number"), part(2).alias("title"), part(3).cast("int").alias("page"))


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, number, title) of lines that look like a chapter's heading and not like a contents list's."""
    fits = lambda x: x["s"].rlike(HEADING) & ~x["s"].rlike(CONTENTS) & (F.length(x["s"]) <= LONGEST_HEADING)
    rows = docs.select(key, F.explode(F.filter(_lines(F.col("text")), fits)).alias("x"))
    part = lambda g: F.regexp_extract("x.s", HEADING, g)
    return rows.select(key, "x.line", F.concat(part(1), part(3)).alias("number"), F.concat(part(2), part(4)).alias("title"))


def likeness(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> np.ndarray:
    """How alike (number, title) pairs are: the share of common words of the titles, or SAME_NUMBER; 0 under ALIKE."""
    words = [[frozenset(re.findall(r"\w+", t.lower())) for _, t in side] for side in (a, b)]
    s = np.zeros((len(a), len(b)))
    for i, x in enumerate(words[0]):
        for j, y in enumerate(words[1]):
            share = len(x & y) / len(x | y) if x | y else 0.0
            s[i, j] = max(share, SAME_NUMBER if a[i][0] and a[i][0] == b[j][0] else 0.0)
    return np.where(s >= ALIKE, s, 0.0)


def aligned(s: np.ndarray) -> list[int]:
    """For each row of a table of likenesses its column or -1: pairs in order of both, the largest sum; of equal ones early columns."""
    n, m = s.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n - 1, -1, -1):
        take = np.where(s[i] > 0, s[i] + best[i + 1, 1:], 0.0)
        # the best of what the next row gives and of taking a later column, running from the right
        best[i, :m] = np.maximum(best[i + 1, :m], np.maximum.accumulate(take[::-1])[::-1])
    out, i, j = [-1] * n, 0, 0
    while i < n and j < m:
        if best[i, j] <= best[i + 1, j] + 1e-12:
            i += 1
        elif s[i, j] > 0 and abs(s[i, j] + best[i + 1, j + 1] - best[i, j]) < 1e-12:
            out[i], i, j = j, i + 1, j + 1
        else:
            j += 1
    return out


def located(listed: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, number, title, page, heading_line): the heading of each contents line, or null."""

    # a row a document: many documents come in a batch
    lines = lambda df, name, *fields: df.groupBy(F.col(key).alias(f"_{name}")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    both = lines(listed, "listed", "line", "number", "title", "page").join(lines(found, "found", "line", "number", "title"), F.col("_listed").eqNullSafe(F.col("_found")), "left")
    rows = both.select(F.col("_listed").alias(key), "listed", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(low, DOCUMENTS)
                at, held = [], part.column(1).to_pylist()
                for a, b in zip(held, part.column(2).to_pylist(), strict=True):
                    b = b or []
                    if max(len(a), len(b)) > MOST:
                        raise ValueError("a document with too many lines that look like chapters")
                    named = ([(x["number"], x["title"]) for x in side] for side in (a, b))
                    at += [b[j]["line"] if j >= 0 else None for j in aligned(likeness(*named))] if b else [None] * len(a)
                own = np.repeat(np.arange(part.num_rows), [len(a) for a in held])
                flat = [x for a in held for x in a]
                fields = [("line", pa.int32()), ("number", pa.string()), ("title", pa.string()), ("page", pa.int32())]
                columns = [part.column(0).take(pa.array(own)), *(pa.array([x[c] for x in flat], t) for c, t in fields), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *(c for c, _ in fields), "heading_line"])

    return rows.mapInArrow(run, f"{key} {dict(listed.dtypes)[key]}, line int, number string, title string, page int, heading_line int")


def chapters(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, number, title, line, upto): the chapters that a document's contents list names and its text has, in order, each to the next one's heading
    (upto: the line after its last, null for the last chapter). A document without a contents list has its headings as chapters, of repeated ones the first."""
    from pyspark.sql import Window

    listed, found = contents(docs, key), headings(docs, key)
    known = located(listed, found, key).where("heading_line is not null").select(key, "number", "title", F.col("heading_line").alias("line"))
    plain = found.join(listed.select(key).distinct(), key, "left_anti")
    once = F.row_number().over(Window.partitionBy(key, "number", F.lower("title")).orderBy("line"))
    rows = known.unionByName(plain.withColumn("_n", once).where("_n = 1").select(key, "number", "title", "line"))
    order = Window.partitionBy(key).orderBy("line")
    return rows.select(key, F.row_number().over(order).alias("place"), "number", "title", "line", F.lead("line").over(order).alias("upto"))
