"""Stems, entities, tables, questions, concepts, cycles, layouts and terms against known answers or plain versions."""

import re

import numpy as np
from pyspark.sql import functions as F

from docfathom.functions import text as X
from docfathom.functions.stem import porter, preprocessed, stemmed
from docfathom.operators import academic as A
from docfathom.operators import answers as N
from docfathom.operators import drawing as W
from docfathom.operators import graph as G
from docfathom.operators import retrieval as R
from docfathom.operators import tables as B
from docfathom.operators import terms as T
from docfathom.operators import vectors as V


def test_stems(spark):
    # examples of the algorithm's publication
    want = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "vietnamization": "vietnam", "triplicate": "triplic", "formative": "form", "formalize": "formal",
        "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "çà": "çà",
    }
    assert {w: porter(w) for w in want} == want
    df = spark.createDataFrame([("The hopping cats are running", 1), (None, 2), ("", 3)], "text string, id int")
    got = {r.id: r.s for r in df.select("id", preprocessed(F.col("text"), "porter").alias("s")).collect()}
    assert got == {1: ["hop", "cat", "run"], 2: None, 3: []}


def test_entities(spark):
    """Against the same rules in Python, whose word ends know all scripts too."""
    texts = ["Call get_user(x) at /api/v1/users über /a éMAX_SIZE MAX_SIZE OrderService.run order.items snake_case_name ñ_x", "", "pure prose here", "Ünder_score fooBar_baz a.b.c HTTPServer Éa.b"]

    def plain(t):
        out = [e for e in re.findall(r"/(?:api/)?[\w/]+", t) if len(e) > 3] + [e.split("(")[0] for e in re.findall(r"\b[a-z_][a-z0-9_]*\([^)]*\)", t)]
        out += re.findall(r"\b[A-Z][a-zA-Z0-9]*(?:[A-Z][a-z0-9]+)+\b", t) + [e for e in re.findall(r"\b[A-Z][A-Z0-9_]{2,}\b", t) if "_" in e]
        out += re.findall(r"\b[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_.]*\b", t) + [e for e in re.findall(r"\b[a-z][a-z0-9_]*(?:_[a-z0-9]+)+\b", t) if len(e) > 5]
        return sorted(set(out))[:20]

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.entities(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_tables(spark):
    html = """<h2>Sizes</h2><table role="grid"><thead><tr><th colspan="2">Name</th><th>N</th></tr></thead><tbody><tr><td>a</td><td>b &amp; c</td></tr></tbody></table>
      <table><tr><td>x</td><td>y</td></tr></table><p>p</p><table><tr><td>outer <table><tr><td>in</td><td>ner</td></tr></table></td></tr></table><table></table>"""
    first, second, third = B.tables_of(html)
    assert first.text(0) == "[TABLE 0]\nTable-Type: content\nContext: Sizes\n\n| Name | Name | N |\n|---|---|---|\n| a | b & c |  |\n[/TABLE 0]"
    assert (second.kind(), third.kind(), third.nested) == ("layout", "content", 1) and third.rows[0][0][0].startswith("outer [nested: in ner")
    assert B.tables_of(None) == [] and B.tables_of("<table></table>") == []
    long = "[TABLE 3]\n| h |\n|---|\n" + "\n".join(f"| row {k} {'z' * 200} |" for k in range(20)) + "\n[/TABLE 3]"
    parts = B.split_with_tables(f"Before it.\n{long}\nAfter it.", 700, 50)
    assert parts[0] == "Before it." and parts[-1] == "After it." and all(len(p) <= B.MAX_SIZE for p in parts)
    tables = parts[1:-1]
    assert len(tables) > 2 and all(p.startswith(B.OPEN) and "| h |\n|---|" in p and "Context: Before it." in p for p in tables) and f"Table Part: 1/{len(tables)}" in tables[0]
    assert sum(p.count("| row ") for p in tables) == 20
    wide = "| " + " | ".join("c" * 300 for _ in range(6)) + " |"
    assert all(len(p) <= B.WIDE_ROW for p in B.row_parts(wide)) and "".join(B.row_parts(wide)).count("c" * 300) == 6
    got = B.chunks(spark.createDataFrame([(1, f"a\n{long}"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.is_table for r in got) >= 2


def test_research_questions(spark):
    text = "Intro text. RQ1: How do trees grow in dry soils over time? RQ2 short? The research questions are as follows: 1) What makes some forests resilient to frequent fires? Q2. Why do others fail to recover after drought years? and"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "No question. Table 1: variable?"), (4, "- What drives long droughts in soils?\nWhat drives long droughts in soils?\n" + "".join(f"Which species number {k} survive wildfire? " for k in range(20)))], "doc_id long, text string")
    got = {r.doc_id: r.questions for r in A.research_questions(rows).collect()}
    assert got[1] == ["How do trees grow in dry soils over time?", "What makes some forests resilient to frequent fires?", "Why do others fail to recover after drought years?"]
    assert got[2] == got[3] == [] and len(got[4]) == 10 and got[4][1].endswith("number 0 survive wildfire?")
    q = spark.createDataFrame([(["How do forests recover quickly?"], "Forests recover slowly"), ([], "x"), (["Which zebras migrate?"], "none")], "q array<string>, t string")
    assert [(r[0].score, len(r[0].unaddressed)) for r in q.select(A.question_alignment(F.col("q"), F.col("t"))).collect()] == [(1.0, 0), (1.0, 0), (0.0, 1)]


def test_concepts(spark):
    chapters = [(1, 0, "Intro", "forests burning forests"), (1, 1, "Middle", "burned forest soils"), (1, 2, "End", "forests recover, soils too"), (1, 3, "Last", "zebras zebras"), (2, 0, "Only", None)]
    rows = A.concept_progression(spark.createDataFrame(chapters, "doc_id long, place int, name string, text string"), stemmed).collect()
    got = {r.concept: (r.first, r.developed, r.last, r.n) for r in rows}
    assert got["forests"] == ("Intro", 1, "End", 3) and got["soils"] == ("Middle", 0, "End", 2) and got["zebras"] == ("Last", 0, "Last", 1)


def test_cycles_and_layers(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 1), (2, 4), (5, 1), (7, 7), (1, 2)], "u long, v long")
    got = sorted(tuple(r.cycle) for r in R.simple_cycles(arcs).collect())
    assert got == [(1, 2, 3, 4), (1, 2, 4), (2, 3), (7,)]
    assert sorted(len(r.cycle) for r in R.simple_cycles(arcs, 2).collect()) == [1, 2]
    assert R.simple_cycles(arcs.limit(0)).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(8)], "u long, v long")
    nodes = spark.createDataFrame([(k,) for k in range(9)], "node long")
    assert {r.node: r.layer for r in G.layers(nodes, chain).collect()} == {k: k for k in range(9)}


def test_layout_parameters():
    assert W.parameters(49) == {"spring": 2.5, "repulsion": 1.8, "attraction": 0.05, "damping": 0.7, "rounds": 100}
    assert W.parameters(50)["rounds"] == W.parameters(199)["rounds"] == 80 and W.parameters(199)["attraction"] == 0.08
    large = W.parameters(800)
    assert np.isclose(large["spring"], 0.75) and np.isclose(large["attraction"], 0.24) and large["rounds"] == 180 and W.parameters(5000)["rounds"] == 200
    ends, n, p = np.array([[0, 1], [1, 2]]), 3, W.parameters(3) | {"rounds": 4}
    at, speed = np.random.default_rng(42).uniform(-1, 1, (n, 2)).tolist(), [[0.0, 0.0] for _ in range(n)]
    for _ in range(4):  # the same forces, one pair at a time
        force = [[0.0, 0.0] for _ in range(n)]
        for a in range(n):
            for b in range(n):
                d = [at[a][k] - at[b][k] for k in (0, 1)]
                for k in (0, 1):
                    force[a][k] += d[k] * p["repulsion"] * p["spring"] ** 2 / (d[0] ** 2 + d[1] ** 2 + 0.01)
        for a, b in ends:
            d = [at[b][k] - at[a][k] for k in (0, 1)]
            far = (d[0] ** 2 + d[1] ** 2) ** 0.5 + 0.01
            for k in (0, 1):
                force[a][k] += d[k] * p["attraction"] * (far - p["spring"]) / far
                force[b][k] -= d[k] * p["attraction"] * (far - p["spring"]) / far
        for a in range(n):
            for k in (0, 1):
                speed[a][k] = (speed[a][k] + force[a][k]) * p["damping"]
                at[a][k] += speed[a][k]
    assert np.allclose(W.force_positions(n, ends, **p), at)


def test_force_layout(spark):
    at = W.force_positions(4, np.array([[0, 1], [2, 3]]), 200)
    far = lambda a, b: float(np.linalg.norm(at[a] - at[b]))
    assert far(0, 1) < min(far(0, 2), far(0, 3), far(1, 2), far(1, 3))
    nodes = spark.createDataFrame([("d", k) for k in range(5)] + [("e", 1)], "drawing string, node long")
    edges = spark.createDataFrame([("d", 0, 1), ("d", 1, 9), ("f", 0, 1)], "drawing string, a long, b long")
    got = W.force_layout(nodes, edges).collect()
    assert len(got) == 6 and len({(r.x, r.y) for r in got}) >= 5 and got == W.force_layout(nodes, edges).collect()


def test_terms_and_expansion(spark):
    found = {t[0]: t for t in T.scored_terms("machine learning model. The machine learning model of data data data")}
    assert found["machine learning model"][2] == 2 and found["data"][2] == 3 and "of data" not in found and all(0 <= t[4] <= 1 for t in found.values())
    assert T.scored_terms("") == [] and T.scored_terms("xyzzq") == []
    got = {r.term: r.kind for r in T.expanded(spark.createDataFrame([(0, "fiber behaviour vpn")], "query_id long, query string")).collect()}
    assert got["behavior"] == "variant" and "fibre" not in got and got["tunnel"] == "synonym" and got["virtual"] == "synonym" and got["vpn"] == "term"
    assert "fibre" in {r.term for r in T.expanded(spark.createDataFrame([(0, "fiber")], "query_id long, query string"), "Network").collect()}


def test_structure(spark):
    text = "Chapter 1 Start .... 3\nChapter 1 Start\nbody\n1.1 Aims\nmore 1.2 text\nCHAPTER II: End\nlast"
    got = [(r.level, r.number, r.title, text[r.start : r.end].split("\n")[0]) for r in N.structure(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")).orderBy("place").collect()]
    assert got == [(1, "1", "Start", "Chapter 1 Start"), (2, "1.1", "Aims", "1.1 Aims"), (1, "II", "End", "CHAPTER II: End")]


def test_addresses_are_no_sections(spark):
    text = "41.244.73.125 Ineses ererly of in er.\n1.2 Middle\n41.244.73.125 Shop\n10.20.30.40 They went on."
    assert [(r.number, r.title) for r in N.structure(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [("1.2", "Middle")]


def test_blocks_of_vectors(spark, monkeypatch):
    """Many small blocks give what one product gives."""
    r = np.random.default_rng(3)
    m = r.normal(size=(60, 8))
    rows = spark.createDataFrame([(k, [float(x) for x in v], k % 2) for k, v in enumerate(m)], "id long, v array<double>, g long")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    want = {(k, int(i)) for k in range(60) for i in np.argsort(-s[k])[:4]}
    monkeypatch.setattr(V, "BLOCK", 16)
    assert {(x.query_id, x.id) for x in V.knn_join(rows, 4).collect()} == want
    apart = {(x.query_id, x.id) for x in V.knn_join(rows, 3, block_by="g").collect()}
    assert len(apart) == 180 and all(a % 2 == b % 2 for a, b in apart)
    near = {(x.query_id, x.id) for x in V.close_pairs(rows, 0.3).collect()}
    assert near == {(a, b) for a in range(60) for b in range(60) if a != b and s[a, b] >= 0.3}


def test_summaries_parse_a_file_once(spark, tmp_path):
    from docfathom.plans import QUERIES

    spark.createDataFrame([(1,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    plan = QUERIES["code_summaries"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("testImplementation)") == 1


def test_files_of_a_small_table_of_parts_are_shared_out(spark, tmp_path):
    from docfathom.plans.documents import CONFIGS, files

    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert files(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files(spark, str(tmp_path), CONFIGS).where("code like '%#%' or path like '%#%'").isEmpty()


def test_boxes_of_crowded_places_meet_once(spark, monkeypatch):
    monkeypatch.setattr(W, "MEMBERS", 3)
    r = np.random.default_rng(4)
    rows = [(k, float(r.integers(-4, 5)) / 2, 0.5 * (k % 3), 1.5, (0.0, 0.7, 9.0)[k % 3]) for k in range(60)] + [(3, 0.0, 0.5, 1.5, 0.7)]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4])
    got = W.collisions(spark.createDataFrame(rows, "node long, x double, y double, w double, h double"), 1.0)
    assert sorted(map(tuple, got.collect())) == want


def test_few_pages_are_held_as_read():
    import pandas as pd

    from docfathom.operators import chunking as H

    pages = pd.DataFrame({"page_id": range(150), "html": ["<p>one</p>"] * 150})
    parts = list(H.read_pages(iter([pages]), "page_id"))
    assert sum(map(len, parts)) == 150 and max(map(len, parts)) <= H.PAGES


def test_claims_are_whole(spark):
    """all claims of a text."""
    docs = spark.createDataFrame([(1, "".join(f"We find case {k} is so. " for k in range(260)))], "doc_id long, text string")
    assert A.claims(docs).count() == 260


def test_claims_are_as_in_sql(spark, tmp_path):
    """ASCII ends of words, SQL's white space and lower case, and citations by number alone in the query."""
    from docfathom.plans import ORACLES, QUERIES
    from tests.oracle import compare

    texts = ["Señal éno Más", "le noé seul", "a failsß", "one\x0btwo\x0c three", "confİrms it. ΑΣ we show. ας we show. ασ we show.", "We find (Smith, 2019) this. We find (Doe and Roe, 2020a) [3, 4].", None]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, str(tmp_path), QUERIES["sentence_claims"], ORACLES["sentence_claims"]) == ""
