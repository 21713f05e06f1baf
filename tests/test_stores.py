"""Stores on disk: collections, keyword index, graphs, citations, caches, publication."""

import json
import math
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from docfathom.operators import answers as N
from docfathom.operators import keyword as K
from docfathom.sources import files
from docfathom.sources import stores as S


def rows(spark, items):
    return spark.createDataFrame([(i, t, [float(len(t))], {"doc_id": i, "version": "2", "language": "java" if i == "a" else "", "health": '{"health_score": 5}'}) for i, t in items], S.COLLECTION)


def test_collections(spark, tmp_path):
    c = S.Collections(spark, str(tmp_path / "c"))
    assert c.names() == [] and c.state().count() == 0
    c.create("chunks")
    c.create("chunks")
    c.add("chunks", rows(spark, [("a", "one"), ("b", "two"), ("a", "one")]), batch_rows=1)
    c.add("chunks", rows(spark, [("b", "new"), ("c", "three")]))
    assert {r.id: r.document for r in c.rows("chunks").collect()} == {"a": "one", "b": "new", "c": "three"}
    c.delete("chunks", spark.createDataFrame([("c",), ("z",)], "id string"))
    assert c.count("chunks") == 2 and [tuple(r) for r in c.state().collect()] == [("chunks", 2)]
    docs = {r.id: (r.doc_type, r.version, r.health.health_score) for r in S.versioned_documents(c.rows("chunks")).collect()}
    assert docs == {"a": ("code", 2, 5.0), "b": ("unknown", 2, 5.0)}
    assert c.clear(dry_run=True) == ["chunks"] and c.names() == ["chunks"]
    assert c.clear() == ["chunks"] and c.names() == []


def test_keyword_index_equals_a_search_of_the_texts(spark, tmp_path):
    texts = [(k, " ".join(["spark", "joins", "tables", "streams", "data"][j % 5] for j in range(k, k + 3 + k % 4))) for k in range(30)] + [(30, None), (31, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = K.literal_queries(spark, ["spark tables", "streams streams", "nothing", ""])
    want = {(r.query_id, r.doc_id): r.score for r in K.bm25(docs, queries, 50).collect()}
    index = S.KeywordIndex(spark, str(tmp_path / "i"))
    index.build(docs)
    got = {(r.query_id, r.doc_id): r.score for r in index.search(queries, 50).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    index.delete(spark.createDataFrame([(0,), (1,)], "doc_id long"))
    index.put(spark.createDataFrame([(2, "unique spark"), (99, "unique words")], "doc_id long, text string"))
    assert {r.term: r.df for r in index.term_stats(["unique", "words"]).collect()} == {"unique": 2, "words": 1}
    assert {r.doc_id for r in index.postings().select("doc_id").collect()} & {0, 1} == set() and index.stats()[0] == 31
    after = spark.createDataFrame([(k, t) for k, t in texts if k > 2] + [(2, "unique spark"), (99, "unique words")], "doc_id long, text string")
    want = {(r.query_id, r.doc_id): r.score for r in K.bm25(after, queries, 50).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in index.search(queries, 50).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_graph_store_and_cache(spark, tmp_path):
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "node long, name string")
    edges = spark.createDataFrame([(2, 1, 0.5), (3, 3, 1.0), (0, 4, 0.1)], "a long, b long, severity double")
    root = str(tmp_path / "g")
    S.write_graph(root, nodes, edges, spark.createDataFrame([(0, 7)], "node long, cluster long"), {"built": "now"})
    got = files.published(spark, root, "edges")
    assert {(r.a, r.b) for r in got.collect()} == {(1, 2), (0, 4)}
    assert S.edges_directed(got).count() == 4 and [r.node for r in S.node_page(nodes, 1, 2).collect()] == [2, 3]
    cache = S.GraphCache(spark, str(tmp_path / "cache"))
    assert cache.get({"k": 1}) is None and cache.purge() == 0
    cache.put({"k": 1, "m": 2}, nodes, edges)
    assert cache.get({"m": 2, "k": 1})[0].count() == 5 and cache.get({"k": 2}) is None
    cache.put({"k": 2}, nodes, edges)
    assert cache.purge(keep=1) == 1


def test_citations(spark, tmp_path):
    nodes = spark.createDataFrame([("d", "Doc"), ("r", "Ref"), ("r", "Ref")], "node_id string, title string")
    edges = spark.createDataFrame([("d", "r", "cites"), ("d", "r", "cites"), ("d", "x", "cites")], "source string, target string, relation string")
    assert [tuple(r) for r in S.cited_by(nodes, edges, "d").collect()] == [("r", "Ref")]
    version = S.write_citations(str(tmp_path / "c"), nodes, edges)
    assert spark.read.json(str(tmp_path / "c" / version / "json" / "edges")).count() == 2


def test_readers_always_find_a_version(spark, tmp_path):
    root = str(tmp_path / "p")
    df = spark.range(3)
    files.publish({"t": df}, root)
    missing, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            names = sorted(n for n in os.listdir(root) if n.startswith(files.POINTER))
            try:
                if not open(f"{root}/{names[-1]}").read().startswith("v-"):
                    missing.append(1)
            except (FileNotFoundError, IndexError):
                missing.append(1)
            time.sleep(0.001)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(4):
        files.publish({"t": spark.range(k)}, root)
    stop.set()
    reader.join()
    assert not missing and files.published(spark, root, "t").count() == 3


def test_weights_and_files(spark, tmp_path):
    assert N.weights(3, 1) == {"vector_weight": 0.75, "keyword_weight": 0.25, "combination_strategy": "sum"}
    for bad in ((-1, 1, "sum"), (1, 1, "other")):
        with pytest.raises(ValueError):
            N.weights(*bad)
    N.save_weights(spark, str(tmp_path / "w"), N.weights(1, 1, "top_k"))
    assert N.load_weights(spark, str(tmp_path / "w"))["combination_strategy"] == "top_k"
    (tmp_path / "seeds.json").write_text(json.dumps([{"name": "x", "url": "http://x"}, {"name": "y"}]))
    assert [tuple(r) for r in S.url_seeds(spark, str(tmp_path / "seeds.json")).collect()] == [("x", "http://x")]
    S.results_csv(spark.range(2), str(tmp_path / "out"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "out"))
    pages = spark.createDataFrame([(1, '<meta http-equiv="refresh" content="0">'), (2, "<p>fine</p>"), (3, "x" * 6000 + "window.location")], "page_id long, html string")
    assert [r.page_id for r in pages.where(S.is_redirect_page(pages.html)).collect()] == [1]


def plain(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def test_index_after_random_puts_and_deletes(spark, tmp_path, monkeypatch):
    """A search equals one of an index made anew, before and after compaction; a put writes its rows alone."""
    r, words = random.Random(4), [f"w{k}" for k in range(25)]
    text = lambda: None if r.random() < 0.05 else " ".join(r.choices(words, [1 / (k + 1) for k in range(25)], k=r.randint(0, 30)))
    docs = {k: text() for k in range(300)}
    monkeypatch.setattr(S.KeywordIndex, "PARTS", 3)
    monkeypatch.setattr(S.KeywordIndex, "WINDOW", 8)
    index = S.KeywordIndex(spark, str(tmp_path / "i"))
    index.build(plain(spark, docs))
    queries = K.literal_queries(spark, ["w0 w3", "w9 w9 w20", "w24", "none", "w1 w2 w5 w7"])
    for step in range(3):
        new = {r.randrange(350): text() for _ in range(10)}
        docs |= new
        index.put(plain(spark, new))
        gone = r.sample(range(350), 8)
        for k in gone:
            docs.pop(k, None)
        index.delete(spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        if step == 2:
            live = index.log.segments()
            assert [s["tables"].get("lengths", {}).get("facts", {}).get("rows", 0) for s in live][-2:] == [len(new), 0]
            index.compact()
            assert len(index.log.segments()) == 1
        assert index.stats()[0] == len(docs) and {t.doc_id for t in index.lengths().collect()} == set(docs)
        for floor in (K.EPSILON, None):
            want = [(x.query_id, x["rank"], x.doc_id, round(x.score, 9)) for x in K.bm25(plain(spark, docs), queries, 10, floor).collect()]
            got = [(x.query_id, x["rank"], x.doc_id, round(x.score, 9)) for x in index.search(queries, 10, floor).collect()]
            assert sorted(got) == sorted(want)


def test_search_skips_blocks(spark, tmp_path, monkeypatch):
    """Exact results from well under the postings of the terms."""
    r = random.Random(9)
    docs = {k: " ".join(["rare"] * (r.random() < 0.02) * r.randint(1, 9) + ["often"] * r.randint(0, 3) + [f"x{r.randrange(99)}" for _ in range(r.randint(5, 60))]) for k in range(4000)}
    monkeypatch.setattr(S.KeywordIndex, "PARTS", 4)
    monkeypatch.setattr(S.KeywordIndex, "WINDOW", 16)
    index = S.KeywordIndex(spark, str(tmp_path / "i"))
    index.build(plain(spark, docs))
    queries = K.literal_queries(spark, ["rare often", "often"])
    want = [(x.query_id, x["rank"], x.doc_id, round(x.score, 9)) for x in K.bm25(plain(spark, docs), queries, 5).collect()]
    assert sorted((x.query_id, x["rank"], x.doc_id, round(x.score, 9)) for x in index.search(queries, 5).collect()) == sorted(want)
    work = {x.query_id: (x.postings, x.scored) for x in index.work(queries, 5).collect()}
    assert work[0][1] < 0.3 * work[0][0] and work[1][1] < 0.7 * work[1][0]


def test_index_holds_a_row_a_rare_term(spark, tmp_path, monkeypatch):
    """rows of the index are terms, not terms times windows; a block ends at BLOCK postings; a document's repeated row adds up; postings are shuffled once."""
    monkeypatch.setattr(S.KeywordIndex, "PARTS", 4)
    monkeypatch.setattr(S.KeywordIndex, "WINDOW", 4)
    monkeypatch.setattr(K, "BLOCK", 100)
    docs = {k: " ".join(["often"] * (1 + k % 2) + [f"rare{(k * j) % 97}" for j in range(1, 8)]) for k in range(450)}
    index = S.KeywordIndex(spark, str(tmp_path / "i"))
    rows = plain(spark, docs)
    index.build(rows.unionAll(rows.where("doc_id = 3")))
    held = index.log.raw("postings", index.log.segments())
    counts = {r.term: r.n for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r.term: r.df for r in K.postings(rows).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    assert counts == {t: -(-df // 100) for t, df in want.items()} and counts["often"] == 5
    assert sorted(map(tuple, index.postings().where("doc_id <> 3").collect())) == sorted(map(tuple, K.postings(rows.where("doc_id <> 3")).select("doc_id", "term", "tf", "doc_length").collect()))
    assert index.postings().where("doc_id = 3 and term = 'often'").first().tf == 4
    stats = {r.term: (r.df, r.occurrences) for r in index.term_stats().collect()}
    assert stats["often"] == (450, sum(1 + k % 2 for k in docs) + 2) and {t: s[0] for t, s in stats.items()} == want
    plan = index._tables(rows, "text", "doc_id")["postings"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # texts, then postings


def test_segments(spark, tmp_path, monkeypatch):
    """Compaction by size, freed versions, manifests that aren't whole, writers at one time."""
    from docfathom.sources import segments as G

    monkeypatch.setattr(G, "MOST", 3)
    monkeypatch.setattr(G, "PATIENCE", 0.3)
    rows = lambda *items: spark.createDataFrame(items, "k long, v string")
    at = str(tmp_path / "s")
    log = G.Segments(spark, at, "k", {"t": G.Table()})
    assert log.segments() == [] and log.read("t") is None
    log.build({"t": rows(*[(k, "old") for k in range(100)])})
    for k in range(6):
        log.write({"t": rows((k, f"a{k}"), (k, f"b{k}"))}, rows((k, "")))
        log.delete(rows((50 + k, "")))
    want = sorted([(k, f"{c}{k}") for k in range(6) for c in "ab"] + [(k, "old") for k in range(6, 100) if not 50 <= k < 56])
    assert sorted(map(tuple, log.read("t").collect())) == want
    live = log.segments()
    assert len(live) <= 4 and live[0]["whole"]  # the large first one is left as it is, the small ones were joined
    assert live[0]["tables"]["t"]["facts"]["rows"] == 100
    open(f"{at}/MANIFEST-{log.manifest()['number'] + 1:012}", "w").write('{"segm')  # a writer that is lost
    assert sorted(map(tuple, log.read("t").collect())) == want
    log.delete(rows(*[(k, "") for k in range(6)]))
    log.compact()
    log.write({"t": rows((1, "x"))}, rows((1, "")))
    assert sorted(map(tuple, log.read("t").collect())) == sorted([(1, "x"), *[(k, "old") for k in range(6, 100) if not 50 <= k < 56]])
    folders = {f for f in os.listdir(at) if f.startswith("s-")}
    named = {s["id"] for n in log._numbers() if (t := log._text(n)).endswith("\n") for s in json.loads(t)["segments"]}
    assert folders == named and len(log._numbers()) <= 3
    threads = [threading.Thread(target=lambda k=k: log.write({"t": rows((k, "t"))}, rows((k, "")))) for k in (60, 61)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.k for r in log.read("t").where("v = 't'").collect()} == {60, 61}
