"""The store of streamed documents and dumps of JSON pages."""

import json

import pytest

from docfathom.sources import dumps
from docfathom.streaming.ingest import Library


def batch(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_library(spark, tmp_path):
    library = Library(spark, str(tmp_path / "l"), keep=2)
    long = "A sentence of some words that goes on. " * 60
    library.ingest(batch(spark, (1, "one " + long), (2, "two"), (2, "a lesser two"), (None, "x"), (3, None)), 0)
    state = lambda: {(r.doc_id, r.version): r.text[:5] for r in library.documents().collect()}
    assert state() == {("1", 1): "one A", ("2", 1): "two"}
    library.ingest(batch(spark, (1, "new " + long), (2, "two")), 1)
    library.ingest(batch(spark, (1, "newer " + long)), 2)
    assert state() == {("1", 2): "new A", ("1", 3): "newer", ("2", 1): "two"}
    before = library.log.manifest()
    library.ingest(batch(spark, (1, "a batch that is run again"), (9, "z")), 2)
    assert library.log.manifest() == before
    library.ingest(batch(spark, (2, "two")), 3)  # nothing is new
    assert library.log.marked("ingest") == 3 and state() == {("1", 2): "new A", ("1", 3): "newer", ("2", 1): "two"}
    parts = {}
    for r in library.chunks().collect():
        parts.setdefault((r.doc_id, r.version), []).append(r)
    assert parts.keys() == state().keys() and len(parts[("1", 3)]) > 1 and sorted(r.chunk_index for r in parts[("1", 3)]) == list(range(len(parts[("1", 3)])))


@pytest.fixture
def dump(tmp_path):
    for provider in ("alpha", "beta"):
        (tmp_path / "d" / provider).mkdir(parents=True)
    page = lambda *items: json.dumps({"items": items}) + "\n"
    (tmp_path / "d/alpha/0001.json").write_text(page({"doi": "10.1/a", "title": "A", "year": 2001, "citations": 3}, {"doi": 5, "year": "x", "citations": True}) + "broken\n[1]\n" + page("no object"))
    (tmp_path / "d/beta/0002.json").write_text(page({"doi": "10.1/b", "title": "B", "venue": "V"}) + json.dumps({"items": None}))
    return tmp_path / "d"


def test_pages(spark, dump):
    rows = dumps.pages(spark, str(dump))
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([("alpha", "10.1/a", "A", 2001, 3, None), ("alpha", None, None, None, None, None), ("beta", "10.1/b", "B", None, None, "V")], key=repr)
    one = dumps.pages(spark, str(dump)).where("provider = 'beta' and title is not null")
    assert one.rdd.getNumPartitions() == 1 and [r.doi for r in one.collect()] == ["10.1/b"]
    (dump / "alpha/0001.json").unlink()
    (dump / "beta/0002.json").unlink()
    assert dumps.pages(spark, str(dump)).count() == 0


def test_a_stream_of_pages_resumes(spark, dump, tmp_path):
    def run():
        query = dumps.pages(spark, str(dump), stream=True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
        return sorted(r.doi or "" for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["", "10.1/a", "10.1/b"]
    (dump / "alpha/0003.json").write_text(json.dumps({"items": [{"doi": "10.1/c"}]}))
    assert run() == ["", "10.1/a", "10.1/b", "10.1/c"]
