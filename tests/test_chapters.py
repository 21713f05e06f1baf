"""Chapters: contents lists with wrong pages, missing, renamed and repeated headings."""

import itertools

import numpy as np
import pytest

from docfathom.operators import chapters as C

THESIS = """Contents
Chapter 1: Introduction ........ 9
2. Related work on soils\t30
Chapter 3  Methods and data .... 12
IV. Results ... 70
5 Left out entirely ..... 80

Chapter 1: Introduction
text of one, see Chapter 3.
Chapter 2: Related work on dry soils
Chapter 1: Introduction
Chapter 3: Methods and data
12. September was dry, and 3 samples were lost
Chapter IV
Chapter 3: Methods and data
end"""


def test_lines(spark):
    docs = spark.createDataFrame([(1, THESIS), (2, None), (3, "no chapters")], "doc_id long, text string")
    got = [(r.number, r.title, r.page) for r in C.contents(docs).orderBy("line").collect()]
    assert got == [("1", "Introduction", 9), ("2", "Related work on soils", 30), ("3", "Methods and data", 12), ("IV", "Results", 70), ("5", "Left out entirely", 80)]
    found = C.located(C.contents(docs), C.headings(docs)).orderBy("line").collect()
    lines = THESIS.split("\n")
    assert [r.heading_line and lines[r.heading_line] for r in found] == ["Chapter 1: Introduction", "Chapter 2: Related work on dry soils", "Chapter 3: Methods and data", "Chapter IV", None]
    assert found[0].heading_line == 7 and found[2].heading_line == 11
    spans = [(r.place, r.title, r.line, r.upto) for r in C.chapters(docs).collect()]
    assert spans == [(1, "Introduction", 7, 9), (2, "Related work on soils", 9, 11), (3, "Methods and data", 11, 13), (4, "Results", 13, None)]
    plain = spark.createDataFrame([(1, "Chapter 1: A\nx\nChapter 2: B\nChapter 1: A\n")], "doc_id long, text string")
    assert [(r.title, r.line) for r in C.chapters(plain).orderBy("line").collect()] == [("A", 0), ("B", 2)]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_the_best(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(0, 5, 2)
    s = np.where(r.random((n, m)) < 0.5, r.integers(1, 5, (n, m)) / 4, 0.0)
    most = 0.0
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.combinations(range(m), k):
                if all(s[i, j] > 0 for i, j in zip(rows, columns, strict=True)):
                    most = max(most, sum(s[i, j] for i, j in zip(rows, columns, strict=True)))
    got = C.aligned(s)
    pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
    assert [j for _, j in pairs] == sorted({j for _, j in pairs}) and all(s[i, j] > 0 for i, j in pairs)
    assert np.isclose(sum(s[i, j] for i, j in pairs), most)


def test_documents_are_located_many_to_a_batch(spark, capsys):
    docs = spark.createDataFrame([(k, "Chapter 1: One ..... 9\nChapter 1: One\n") for k in (1, 2, None)] + [(3, "Chapter 2: Two ..... 4")], "doc_id long, text string")
    out = C.located(C.contents(docs), C.headings(docs))
    assert sorted((x.doc_id or 0, x.line, x.page, x.heading_line) for x in out.collect()) == [(0, 0, 9, 1), (1, 0, 9, 1), (2, 0, 9, 1), (3, 0, 4, None)]
    out.explain()
    assert "FlatMap" not in capsys.readouterr().out  # no call of Python for each document
