"""Operators on toy tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfathom.operators import academic as A
from docfathom.operators import chunking as H
from docfathom.operators import graph as G
from docfathom.operators.communities import louvain
from docfathom.operators import ingest as I
from docfathom.operators import keyword as K
from docfathom.operators import telemetry as T
from docfathom.operators import vectors as V
from docfathom.plans.registry import ORACLES, QUERIES


def test_counts(spark):
    post = spark.createDataFrame([("doc1", "auth", 2, 100), ("doc2", "auth", 1, 120), ("doc3", "auth", 5, 80), ("doc2", "login", 3, 120)], "doc_id string, term string, tf long, doc_length int")
    meta = spark.createDataFrame([("doc1", "governance"), ("doc2", "Code"), ("doc3", None)], "doc_id string, source_category string")
    stats = {r.term: (r.df, r.occurrences) for r in K.term_stats(post, 3).collect()}
    assert stats == {"auth": (3, 8), "login": (1, 3)}
    assert [r.doc_id for r in K.docs_for_all(post, ["auth", "login"]).collect()] == ["doc2"]
    assert [(r.category, r.docs) for r in K.by_category(post, meta, "auth", 5).collect()] == [("code", 1), ("governance", 1), ("unknown", 1)]
    chunks = spark.createDataFrame([(f"chunk{k}", f"parent{p}") for k, p in ((1, 1), (2, 1), (3, 2), (4, 2), (5, 3))], "chunk_id string, parent_id string")
    post = spark.createDataFrame([(f"chunk{k}", "auth", 1, 9) for k in range(1, 5)] + [("chunk5", "login", 1, 9)], "doc_id string, term string, tf long, doc_length int")
    parents = spark.createDataFrame([(f"parent{k}",) for k in (1, 2, 3)], "doc_id string")
    assert {r.term: r.parents for r in K.parent_counts(post, chunks, parents).collect()} == {"auth": 2, "login": 1}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "spark joins tables"), (2, "spark spark streams"), (3, None), (4, ""), (5, "tables of data")], "doc_id long, text string")
    found = K.bm25(docs, K.literal_queries(spark, ["spark", "spark spark", "nothing", ""]), 5).collect()
    first = {(r.query_id, r.doc_id): r.score for r in found}
    assert set(q for q, _ in first) == {0, 1} and first[0, 2] > first[0, 1]
    assert math.isclose(first[1, 2], 2 * first[0, 2])
    idf = max(0.25, math.log((5 - 2 + 0.5) / 2.5 + 1))
    assert math.isclose(first[0, 1], idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (8 / 5))))
    assert K.bm25(docs.limit(0), K.literal_queries(spark, ["spark"]), 5).count() == 0


def test_nearest_and_fusion(spark):
    rows = spark.createDataFrame([(k, [float(x) for x in np.eye(4)[k % 4] + k / 100]) for k in range(8)] + [(9, [0.0] * 4)], "id long, v array<double>")
    near = {(r.query_id, r.id): r.similarity for r in V.knn_join(rows, 2).collect()}
    assert len(near) == 18 and (0, 4) in near and all(q != i for q, i in near)
    with pytest.raises(Exception, match="dimension"):
        V.nearest(rows, np.array([0]), np.ones((1, 3)), 1).collect()
    a = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5)], "query_id long, id long, score double")
    b = spark.createDataFrame([(0, 2, 7.0), (0, 3, 3.0)], "query_id long, id long, score double")
    rrf = V.fused(a, b, 3, "rrf", (1.0, 1.0)).orderBy("rank").collect()
    assert [(r.id, r.method) for r in rrf] == [(2, "hybrid"), (1, "vector"), (3, "keyword")]
    alone = V.fused(a, b.limit(0), 3, "linear").orderBy("rank").collect()
    assert [(r.id, r.score) for r in alone] == [(1, 0.5), (2, 0.0)]


def test_nearest_of_blocks(monkeypatch):
    """Parts of a block's table give what sorting all of it gives, ties by id; no table of the whole block is held."""
    import pandas as pd

    r = np.random.default_rng(5)
    m = r.integers(-1, 2, (90, 4)).astype(float)  # many ties
    m[3] = 0
    frame = pd.DataFrame({"id": r.permutation(90), "v": list(m)})
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    monkeypatch.setattr(V, "CELLS", 500)
    s, ids = np.round(unit @ unit.T, 12), frame.id.to_numpy()
    s[ids[:, None] == ids[None, :]] = -np.inf
    want = [(q, *x) for q, row in zip(ids, s) for x in [(ids[k],) for k in np.lexsort((ids, -row))[:7]]]
    got = V.nearest_of(frame, frame, 7, True)
    assert list(zip(got.query_id, got.id)) == want and len(V.nearest_of(frame.iloc[:1], frame.iloc[:3], 7, True)) == 2


def test_personas(spark):
    schema = "id long, source_category string, reference_type string, link_status string, quality_score double, citation_count int, domain_relevance_score double, distance double, year int"
    rows = spark.createDataFrame([(1, None, "academic", "available", 0.8, 20, 0.5, 0.2, 2020), (2, "academic_reference", None, None, None, None, None, 0.1, None), (3, None, "academic", "stale_404", 0.8, 20, 0.5, 0.2, 2020), (4, None, "blog", "available", 0.9, 90, 0.9, 0.0, 2024)], schema)
    ids = lambda p: [r.id for r in V.persona_ranked(rows, p, 10, 2024).collect()]
    assert ids("assessor") == [1, 2] and ids("supervisor") == [1, 3, 2]
    assert math.isclose(V.persona_ranked(rows, "assessor", 1, 2024).first().persona_score, 0.5 * 0.8 + 0.2 * 0.8 + 0.15 * 0.5 + 0.1 * 0.2 + 0.05 * 0.6)


def graph(spark, pairs, n):
    return spark.createDataFrame([(k,) for k in range(n)], "node long"), spark.createDataFrame(pairs, "a long, b long")


def test_graph_analytics(spark):
    nodes, path = graph(spark, [(0, 1), (1, 2), (2, 3)], 5)
    assert {r.node: r.component for r in G.components(nodes, path).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert {r.node: round(r.betweenness, 4) for r in G.betweenness(nodes.where("node < 4"), path).collect()} == {0: 0.0, 1: 0.6667, 2: 0.6667, 3: 0.0}
    assert math.isclose(sum(r.rank for r in G.pagerank(nodes, path).collect()), 1)
    assert {r.node: r.hop for r in G.neighbourhood(path, nodes.where("node = 0"), 2).collect()} == {0: 0, 1: 1, 2: 2}
    nodes, two = graph(spark, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)], 6)
    assert {r.node: round(r.clustering, 4) for r in G.clustering(nodes, two).collect()} == {0: 1.0, 1: 1.0, 2: 0.3333, 3: 0.3333, 4: 1.0, 5: 1.0}
    assert {r.node: r.community for r in louvain(nodes, two).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    triangle = graph(spark, [(0, 1), (0, 2), (1, 2)], 3)[1].withColumn("weight", F.lit(0.5))
    assert {(r.jaccard, r.combined) for r in G.strength(triangle).collect()} == {(0.0, 0.5)}
    assert {round(r.jaccard, 4) for r in G.strength(triangle, "true").collect()} == {0.3333}
    row = G.topology(nodes, two).first()
    assert (row.n, row.m, row.components, row.largest) == (6, 7, 1, 6)
    empty_nodes, empty = graph(spark, [], 2)
    assert G.components(empty_nodes, empty).count() == 2 and G.topology(empty_nodes, empty).first().density == 0


def test_edges(spark):
    edges = spark.createDataFrame([(2, 1, 0.3), (1, 2, 0.7), (3, 3, 1.0), (1, 3, 0.2)], "a long, b long, severity double")
    assert {(r.a, r.b, r.severity) for r in G.canonical(edges).collect()} == {(1, 2, 0.7), (1, 3, 0.2)}
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "node long")
    assert {r.node: round(r.conflict, 4) for r in G.conflict_score(nodes, G.canonical(edges)).collect()} == {1: 0.9, 2: 0.7, 3: 0.2, 4: 0.0}
    labels = ["Partial conflicts here", "near duplicate", "aligned", "minor thing", "?", " Contradiction "]
    got = spark.createDataFrame([(x,) for x in labels], "t string").select(G.relationship(F.col("t"))).collect()
    assert [r[0] for r in got] == ["conflict", "duplicate", "consistent", "partial_conflict", "consistent", "conflict"]
    common = spark.createDataFrame([(k, 1) for k in range(50)] + [(1, 2), (2, 2)], "node long, value long")
    assert G.shared_value_edges(common, most=10).count() == 50 and G.shared_value_edges(common, most=100).count() == 50 * 49 // 2


def test_common_values_give_all_pairs(spark):
    held = {1: range(450), 2: range(400, 700), 3: (1, 2, 449, 650), 4: (5,)}
    want = {}
    for nodes in held.values():
        for b in nodes:
            for a in nodes:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    rows = spark.createDataFrame([(k, v) for v, nodes in held.items() for k in nodes] + [(1, 1), (None, 1), (7, None)], "node long, value long")
    assert {(r.a, r.b): r.shared for r in G.shared_value_edges(rows).collect()} == want


def test_layers(spark):
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node long")
    arcs = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 3)], "u long, v long")
    assert {r.node: r.layer for r in G.layers(nodes, arcs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_ingest(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, hash string")
    state = spark.createDataFrame([("a", "0", 1), ("a", "1", 2), ("b", "1", 4)], "doc_id string, hash string, version int")
    assert {r.doc_id: (r.status, r.version) for r in I.check_hash(new, state).collect()} == {"a": ("skip", 2), "b": ("update", 5), "c": ("new", 1)}
    chunks = spark.createDataFrame([(1, k, t) for k, t in enumerate(["tiny", "x" * 120, "small", "[TABLE 1]", "end"])], "doc_id long, chunk_index int, text string")
    got = I.merge_small(chunks).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["tiny", "x" * 120 + "\nsmall", "[TABLE 1]\nend"]
    old = spark.createDataFrame([(1, 0, "h"), (1, 1, "h")], "doc_id long, chunk_index int, hash string")
    more = spark.createDataFrame([(1, k, "h") for k in range(3)] + [(1, 3, "i")], "doc_id long, chunk_index int, hash string")
    assert [r.hash for r in I.new_chunks(more, old).orderBy("hash").collect()] == ["h", "i"]


def test_chunk_quality(spark):
    good = "the people of the city have a good way to think about work and time " * 3
    rows = spark.createDataFrame([(1, "short"), (2, "x" * 2100), (3, "zzzz qqqq " * 15), (4, good), (5, "a" * 150), (6, good + " copyright privacy policy click here"), (7, None)], "doc_id long, text string")
    got = {r.doc_id: r.reason for r in I.chunk_quality(rows).collect()}
    assert got == {1: "too_short", 2: "too_long", 3: "low_stopword_ratio", 4: "heuristic_pass", 5: "too_few_words", 6: "boilerplate_detected", 7: "heuristic_pass"} or got[7] is not None


def test_telemetry(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(100)] + [("b", 1.0)], "g string, v double")
    got = {r.g: (r.p50, r.p99) for r in T.at_percent(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99}, last=True).collect()}
    assert got == {"a": (50.0, 99.0), "b": (1.0, 1.0)}
    calls = spark.sql("select 'k' as k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts from range(5)")
    assert T.token_bucket(calls, ["k"], "ts", 0.5, 2.0).first().passed == 4


def test_chunks(spark):
    text = ("One sentence here. Another one follows it.\n" * 40) + "\n\n" + "y" * 3000
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "word")], "doc_id long, text string")
    rows = H.chunks(docs).collect()
    assert {r.doc_id for r in rows} == {1, 4} and all(len(r.text) <= H.EMBED_CHARS for r in rows)
    family = H.parents_and_children(docs.where("doc_id = 1")).collect()
    assert all(len(r.text) <= H.CHILD[0] for r in family if r.child_index >= 0) and {r.parent_id for r in family if r.child_index < 0} == {r.parent_id for r in family}
    page = H.read_page('<nav><a href="/x">n</a></nav><h1>Title</h1><div class="sidebar">s</div><p>Text &amp; more<br>line<table><tr><th>A<th>B</tr><tr><td>1</td><td>2</td></tr></table><footer>f</footer>')
    assert page.text() == "Title\nText & more\nline\n[TABLE 1]\nA | B\n1 | 2" and page.links == ["/x"]


def test_references(spark):
    docs = spark.createDataFrame([(1, "Intro\nReferences\n[1] Smith (2019) Trees. 10.1234/ab.7\n[2] Doe 2001\nStones\n"), (2, "none"), (3, None)], "doc_id long, text string")
    got = [(r.place, r.raw, r.doi, r.year) for r in A.references(docs).orderBy("place").collect()]
    assert got == [(0, "Smith (2019) Trees. 10.1234/ab.7", "10.1234/ab.7", 2019), (1, "Doe 2001 Stones", None, 2001)]


def test_catalogue():
    assert len(QUERIES) >= 100 and set(ORACLES) <= set(QUERIES)


def test_expansions_give_a_block_of_candidates_no_more_than_k(spark, monkeypatch):
    r = np.random.default_rng(3)
    m = np.concatenate([r.normal(size=(60, 6)), np.zeros((1, 6))])
    m[7], m[8], m[9] = m[3], -m[3], 2 * m[3]
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "id long, v array<double>")
    ratio = lambda a, b: 1 - np.linalg.norm(a - b) / np.linalg.norm(a + b) if np.any(a + b) else np.nan
    want = {}
    for q in range(0, 61, 3):
        s = [(-round(ratio(m[q], m[i]), 12), i) for i in range(61) if i != q and np.isfinite(ratio(m[q], m[i]))]
        want |= {(q, i): -x for x, i in sorted(s)[:4] if -x >= 0.1}
    made, top = [], V.top
    monkeypatch.setattr(V, "BLOCK", 32)
    monkeypatch.setattr(V, "top", lambda df, *a: made.append(df.count()) or top(df, *a))
    got = {(x.term, x.other): x.similarity for x in V.expansions(rows.where("id % 3 = 0"), rows, 4, 0.1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert made[0] <= 21 * 4 * 2


def test_counts_of_shared_values_are_in_parts_by_the_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIRS", 10)
    rows = spark.createDataFrame([(k, v) for v in range(4) for k in range(10)], "node long, value long")
    edges = G.shared_value_edges(rows)
    assert {tuple(x) for x in edges.collect()} == {(a, b, 4) for b in range(10) for a in range(b)}
    assert edges.rdd.getNumPartitions() == 19


def test_budget_adds_up_exactly(spark):
    """Ten times 0.1 is 1, and not a hair less; sums of costs that are no decimals stay those of doubles."""
    rows = spark.createDataFrame([(u, k, v) for u, v in ((1, 0.1), (2, 1e-20), (3, float("inf")), (4, None)) for k in range(10)], "u int, k int, cost double")
    found = {(r.u, r.k): r for r in T.budget(rows, ["u"], ["k"], "cost", 1.0, 1.0, 1.0).collect()}
    assert [found[1, k].warned for k in range(10)] == [False] * 9 + [True] and found[1, 9].allowed
    assert abs(found[2, 9].spent - 1e-19) < 1e-25 and found[3, 0].spent == float("inf") and found[4, 9].spent is None


def test_overlap_counts_pairs_after_the_shuffle(spark, monkeypatch):
    """lists of ends are shuffled, not pairs; common values and ends of many values are dealt into parts; nulls as in SQL."""
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "SHARE", 5)
    r = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in zip(r.integers(0, 40, 500), r.integers(0, 25, 500), strict=True)] + [(k, 99) for k in range(40)] + [(1, None), (None, 3), (None, None), (50, 1), (51, 98)]
    frame = spark.createDataFrame(rows, "node long, value long")
    own = {a: {v for x, v in rows if x == a} for a, _ in rows if a is not None}
    want = {(a, b): round(len(own[a] & own[b] - {None}) / max(len(own[a]), len(own[b])), 9) for a in own for b in own if a < b and own[a] & own[b] - {None}}
    found = G.value_overlap(frame)
    assert {(x.a, x.b): round(x.weight, 9) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [a" not in plan and "hashpartitioning(a" not in plan
    assert G.value_overlap(frame.limit(0)).count() == 0
