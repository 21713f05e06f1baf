"""Importance resampling against a plain count of features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docfathom.llm import importance
from docfathom.llm.queries import QUERIES
from tests.llm.conftest import ODD, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, longest=2):
    w = words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("deep", [1, 2, 3, 4, 5, 7])
def test_suffix_array(deep):
    r = np.random.default_rng(deep)
    for n in (0, 1, 2, 40, 300):
        seq = r.integers(-1, 3, n)
        order, lcp = importance.suffix_array(seq, deep)

        def head(k):
            part = seq[k : k + deep].tolist()
            return part[: part.index(-1)] if -1 in part else part

        heads = [head(k) for k in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
        for k in range(1, n):
            same = 0
            while same < min(len(heads[k]), len(heads[k - 1])) and heads[k][same] == heads[k - 1][same]:
                same += 1
            assert lcp[k] == same
        assert n == 0 or lcp[0] == 0


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets(longest):
    r = random.Random(longest)
    texts = [importance.words_of(" ".join(r.choice("a b c É dd".split()) for _ in range(r.randint(0, 30)))) for _ in range(40)]
    known = importance.Words()
    seq = known.sequence(texts)
    found = importance.buckets_of(seq, known.words, longest, 10_000)
    start = 0
    for t in texts:
        got = [b for n in found for b in n[start : start + len(t)].tolist() if b >= 0]
        assert got == features(b" ".join(t).decode(), longest)
        start += len(t) + 1
        assert all(n[start - 1] == -1 for n in found)


def test_words():
    text = "Ab_c ÀÉ-9\x7fz q r İ 日本. ퟿\U0001f642"
    assert [w.decode() for w in importance.words_of(text)] == words(text) and importance.words_of(None) == []


def expected(rows, targets):
    source, target = Counter(b for _, t in rows for b in features(t)), Counter(b for t in targets for b in features(t))
    s, t = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for k, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, text) in zip(out, rows, strict=True) if len(words(text)) >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_query(spark, tmp_path, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, prose(k, 15 + k)) for k in range(80)] + [(None, prose(1, 30)), (300, "Word " * 30), (300, "word. " * 30)]
    targets = [prose(1000 + k, 40) for k in range(5)] + [None, ""]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, weight int").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(targets)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = [tuple(r) for r in QUERIES["op12_importance"](spark, folder).collect()]
    assert sorted(got, key=repr) == expected(rows, targets)
    few = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert importance.resample(few, few).count() == 0


def test_batches_of_few_words(monkeypatch):
    """Batches and memories of any size give the same buckets."""
    import pyarrow as pa

    texts = [prose(k, 5 * k) for k in range(12)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    monkeypatch.setattr(importance, "BATCH_WORDS", 30)
    monkeypatch.setattr(importance, "KNOWN", 10)
    known, rows = importance.Words(), []
    for part, held in importance.batches_of(iter([batch, batch]), "text"):
        assert part.num_rows == len(held)
        found = importance.buckets_of(known.sequence(held), known.words, 2, 10_000)
        rows += [b for n in found for b in n.tolist() if b >= 0]
    assert Counter(rows) == Counter(b for t in texts * 2 for b in features(t))


def test_ties_and_large_sorts(spark):
    """Rows of one id and score have ranks of their own."""
    weighed = spark.range(500).selectExpr("id % 7 as doc_id", "30L as n_words", "59L as n_features", "0L as weight").repartition(6)
    got = importance.draw(weighed, 50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 251)) and len(got) == 500
    by_rank = [(-r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank)
