"""Learned search weights against a solver of least squares, and the terms of an expanded query."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfathom.operators import keyword as K
from docfathom.operators import retrieval as R
from docfathom.operators import weights as L
from docfathom.plans.retrieval import rated

DATA, NOW = dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1)
FIELDS = "id long, team string, created_at timestamp, vector_weight double, keyword_weight double, query_type string, query_length int, embedding_similarity double, bm25_score double, relevancy double, samples int"


def plain(rows, current=0.6, least=20):
    """rows: (id, at, vector, keyword, kind, length, similarity, bm25, rating)"""
    rows = [r for r in rows if None not in r[2:4] + r[5:]]
    days = (NOW - DATA).days
    w = np.array([1.0 if r[1] >= DATA else max(0.1, math.exp(-days / 30)) for r in rows])
    if (w > 0).sum() < least:
        return None
    x = np.array([[r[2], r[3], {"technical": 1.0, "natural": 0.5}.get(r[4], 0.0), r[5] / 100, r[6], r[7]] for r in rows])
    y = np.array([r[8] for r in rows])
    mean, high = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    root = np.sqrt(w)
    slope = np.linalg.lstsq((x - mean) * root[:, None], (y - high) * root, rcond=1e-8)[0]
    start = high - mean @ slope
    told = 1 - ((y - start - x @ slope) ** 2).sum() / ((y - y.mean()) ** 2).sum() if y.std() > 1e-6 else 0.0
    last = x[[k for k, _ in sorted(enumerate(rows), key=lambda p: (p[1][1], p[1][0]), reverse=True)[:50]], 2:].mean(axis=0)
    scores = {k / 10: round(start + slope[0] * k / 10 + slope[1] * (1 - k / 10) + last @ slope[2:], 9) for k in range(1, 10)}
    best = min(k for k, v in scores.items() if v == max(scores.values()))
    return best, min(1, max(0, told)), max(0, (slope[0] - slope[1]) * (best - current)), slope


def made(seed, n, good=1.0, noise=0.05):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = float(r.integers(1, 10)) / 10
        kind, length, sim, bm = ("technical", "natural", "mixed", "odd")[int(r.integers(4))], int(r.integers(5, 90)), float(r.uniform()), float(r.uniform())
        at = DATA + dt.timedelta(days=int(r.integers(-40, 20)), seconds=int(r.integers(3)))
        rows.append((k, at, v, round(1 - v, 10), kind, length, sim, bm, float(good * v + 0.3 * sim + 0.1 * length / 100 + r.normal(0, noise))))
    return rows


def test_against_a_solver(spark):
    teams = {"up": made(1, 400), "down": made(2, 80, -0.7), "noise": made(3, 60, 0.0, 3.0), "few": made(4, 19), "flat": [(*r[:8], 0.5) for r in made(5, 30)], "one": [(*r[:2], 0.5, 0.5, *r[4:]) for r in made(6, 40)],
             "nulls": [*made(7, 40), (99, DATA, None, 0.5, "mixed", 5, 0.1, 0.1, 0.1), (98, DATA, 0.5, 0.5, "mixed", 5, 0.1, 0.1, None)], None: made(8, 50), "twice": made(9, 30) * 2}
    rows = [(r[0], team, *r[1:], 7) for team, some in teams.items() for r in some]
    got = {r.team: r for r in L.learned_weights(spark.createDataFrame(rows, FIELDS).repartition(7), "team", DATA, NOW).collect()}
    assert set(got) == set(teams) - {"few"}
    for team, some in teams.items():
        want, r = plain(some), got.get(team)
        if want is None:
            continue
        assert abs(r.confidence - want[1]) < 1e-6 and abs(r.improvement - want[2]) < 1e-6 and np.allclose(r.slopes, want[3], atol=1e-6), team
        assert r.recommended == (r.confidence >= 0.6)
        if abs(want[3][0] - want[3][1]) > 1e-6:
            assert r.vector_weight == want[0] and abs(r.keyword_weight - 1 + want[0]) < 1e-9, team
    assert got["up"].vector_weight == 0.9 and got["down"].vector_weight == 0.1 and not got["noise"].recommended and not got["flat"].recommended and got["one"].vector_weight == 0.1
    assert L.learned_weights(spark.createDataFrame([], FIELDS), "team", DATA, NOW).count() == 0


def test_old_samples(spark):
    at = spark.createDataFrame([(DATA,), (DATA - dt.timedelta(seconds=1),)], "at timestamp")
    weigh = lambda now: [r[0] for r in at.orderBy(F.desc("at")).select(L.sample_weight(F.col("at"), DATA, now)).collect()]
    assert weigh(DATA + dt.timedelta(hours=5)) == [1.0, 1.0] and weigh(DATA + dt.timedelta(days=91)) == [1.0, 0.0] and weigh(DATA + dt.timedelta(days=89)) == [1.0, 0.1]
    assert abs(weigh(DATA + dt.timedelta(days=3))[1] - math.exp(-0.1)) < 1e-12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_whole_table(spark):
    lines = rated(spark, "/root/testdata/sf0.001")
    got = {r.l_linestatus: r for r in L.learned_weights(lines, "l_linestatus", DATA, NOW).collect()}
    held = lines.toPandas()
    for mode, some in held.groupby("l_linestatus"):
        want = plain([(r.id, r.created_at.to_pydatetime(), r.vector_weight, r.keyword_weight, r.query_type, r.query_length, r.embedding_similarity, r.bm25_score, r.relevancy) for r in some.itertuples()])
        assert abs(got[mode].confidence - want[1]) < 1e-6 and got[mode].vector_weight == want[0]
    assert len(got) == held.l_linestatus.nunique()


def test_terms_of_an_expanded_query(spark):
    asked = K.literal_queries(spark, ["la la enten", "", "of the"])
    words = spark.createDataFrame([("Enten", "der", 2.0), ("mentenon kom", "que", 1.5), ("other", "x", 9.0)], "term string, acronym string, weight double")
    got = {(r.query_id, r.term): r.times for r in R.weighted_terms(asked, None, words).collect()}
    assert got == {(0, "la"): 2.0, (0, "enten"): 2.0, (0, "der"): 1.0, (0, "mentenon"): 1.5, (0, "kom"): 1.5, (0, "que"): 1.0}
    docs = spark.createDataFrame([(1, "enten enten x"), (2, "der x y"), (3, "kom z z"), (4, None), (5, "")], "doc_id long, text string")
    found = R.retrieve(docs, "enten", None, expand=True, vocabulary=words).collect()
    assert {r.id for r in found} == {1, 2, 3} and {r.id for r in R.retrieve(docs, "enten", None).collect()} == {1}
