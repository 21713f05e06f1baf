"""Language, quality, rules and the language model: held-out accuracy, brute force, odd rows."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docfathom.llm import anomaly, langid, lm, quality
from tests.llm.conftest import ODD, prose

SYLLABLES = {"aa": "ba be bo ka ke ko".split(), "bb": "thi tha str ing ent".split(), "cc": "ñu ça éx öl ün".split()}


def speech(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language(spark, docs_of):
    rows = [(k, speech(lang, k), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r.lang_pred for r in langid.identify(docs_of(ODD), model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[10] == "und" and odd[3] in SYLLABLES
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_of_unbroken_text(spark):
    run = lambda letters, seed, n: "".join(random.Random(seed).choice(letters) for _ in range(n))
    letters = {"xx": "अआइईउऊऋएऐओऔकखगघङ", "yy": "一丁七丈三上下不与丐丑专且世丘丙"}
    rows = [(k, run(letters[lang], k, 300), lang) for k, lang in enumerate(["xx", "yy"] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = [run(letters["xx"], 100, 410) + run(letters["yy"], 101, 5_000), run(letters["yy"], 102, 410) + run(letters["xx"], 103, 250_000)]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {0: "yy", 1: "xx"}


def test_every_language_is_learned(spark):
    rows = [(k, " ".join([f"{chr(0x4E00 + k // 3)}{chr(0x6E00 + k // 3)}"] * 5), f"l{k // 3:03}") for k in range(690)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 230
    assert all(r.lang_pred == f"l{r.doc_id // 3:03}" for r in langid.identify(docs, model).collect())


def test_quality(spark, docs_of):
    bad = lambda k: " ".join(w + random.Random(k).choice(["###", "$$$", "%%%"]) for w in prose(k, 50).split())
    rows = [(k, bad(k) if k % 4 == 0 else prose(k, 50)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)] + [(None, 1), (1000, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r._df_score for r in quality.score(docs, model, ["doc_id"]).collect()}
    wrong = [k for k in range(300, 400) if (got[k] >= 0.3) != (k % 4 != 0)]
    assert len(wrong) <= 2
    odd = quality.score(docs_of(ODD), model, ["doc_id", "score"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r._df_score <= 1 and r.score == "x" for r in odd)
    nothing = quality.train(docs, labels.limit(0))
    assert quality.score(docs, nothing, ["doc_id"]).first()._df_score == 0.5
    again = quality.train(docs, labels)
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all()


def plain_statistics(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^ \t\n\x0b\x0c\r]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_rules(spark, docs_of):
    texts = [*ODD, "a b c d e f g h i " * 9, "x " * 7 + "\nb\nb\n b", prose(1, 40) + "\n" + prose(1, 40), "é é # $ <"]
    for t in texts:
        assert anomaly.statistics(t)[0] == plain_statistics(t), t
    bad = lambda k: " ".join(w + "###" for w in prose(k, 60).split())
    docs = spark.createDataFrame([(k, bad(k) if k % 10 == 0 else prose(k, 60)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 != 0)) for k in range(200)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in anomaly.judge(docs, anomaly.fit(docs, labels)).collect()}
    assert all(rows[k].kept == (k % 10 != 0) for k in range(400))
    nothing = anomaly.fit(docs, labels.limit(0))
    assert all(r.kept for r in anomaly.judge(docs, nothing).collect())
    odd = anomaly.judge(docs_of(texts), nothing).collect()
    assert all(r.base_failed == anomaly.base_failed(r.n_words, r.n_repeat_words) for r in odd) and len(odd) == len(texts)


def test_language_model(spark):
    texts = [prose(k, 5 + k) for k in range(30)] + ["A b A b a", None, "", " \n"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, width = lm.fit(docs.where("doc_id < 25 or doc_id > 29").select("text"))
    got = {r.doc_id: r for r in lm.score(docs, model, width).collect()}
    split = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", (t or "").lower()) if w] + ["\n"]
    train = [split(t) for k, t in enumerate(texts) if k < 25 or k > 29]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip(["\t", *t], t, strict=False))
    before, context, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(Counter)
    for (a, _), c in pairs.items():
        context[a] += c
        kinds[a][min(c, 3)] += 1
    d, low = (lm.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, before))
    left = sum(low[min(c, 3) - 1] for c in before.values())
    single = lambda w: (before[w] - (low[min(before[w], 3) - 1] if before[w] else 0) + left / (v + 1)) / len(pairs)

    def double(a, w):
        if not context[a]:
            return single(w)
        c = pairs[a, w]
        return (c - (d[min(c, 3) - 1] if c else 0) + sum(d[k - 1] * x for k, x in kinds[a].items()) * single(w)) / context[a]

    for k, t in enumerate(texts):
        words = split(t)
        assert math.isclose(got[k].score, sum(math.log10(double(a, w)) for a, w in zip(["\t", *words], words, strict=False)), abs_tol=1e-9)
        assert math.isclose(got[k].base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), abs_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known) == (len(words), sum(w in count for w in words))
    assert math.isclose(sum(double(train[0][0], w) for w in count) + double(train[0][0], "unseen"), 1, abs_tol=1e-9)
    empty, width = lm.fit(docs.limit(0).select("text"))
    assert {r.n_known for r in lm.score(docs, empty, width).collect()} == {0}
    assert lm.score(docs.limit(0), model, width).count() == 0
    assert lm.perplexity(lm.score(docs.where(F.col("doc_id") < 3), model, width)).count() == 3


def test_threshold_and_telling_against_all_cuts():
    random = np.random.default_rng(11)
    for _ in range(30):
        n = int(random.integers(2, 40))
        paths, good = np.round(random.uniform(0.4, 1.2, n), 1), random.uniform(size=n) < 0.7
        cut = anomaly.threshold(paths, good)
        if good.all() or not good.any():
            assert cut == -1
            continue

        def cost(c, paths=paths, good=good):
            return (paths[~good] >= c).mean() + anomaly.GOOD * (paths[good] < c).mean()

        assert cost(cut) == min(cost(c) for c in (-1.0, *(np.unique(paths) + 0.01)))
        rows = np.round(random.normal(0, 1, (n, 3)), 1)

        def doubt(g):
            return -sum(p * np.log(p) for p in (g.mean(), 1 - g.mean()) if p > 0)

        gained = [max([0.0] + [doubt(good) - sum(m.mean() * doubt(good[m]) for m in (x <= c, x > c)) for c in np.unique(x)[:-1]]) for x in rows.T]
        found = anomaly.telling(rows, good)
        assert np.allclose(found, np.where(np.array(gained) >= anomaly.TELLING * max(gained), np.array(gained) / max(gained), 0) if max(gained) > 0 else 1, atol=1e-8)


def test_paths_of_a_forest_by_hand():
    rows = np.random.default_rng(3).normal(0, 1, (300, 4))
    forest = anomaly.Forest(rows, np.array([1.0, 0.5, 0.0, 2.0]))
    got = forest.paths(rows[:20])
    for row, path in zip(rows[:20], got, strict=True):
        total = 0.0
        for split, value, left, right, length, _ in forest.trees:
            at = 0
            while split[at] >= 0:
                assert split[at] != 2
                at = left[at] if row[split[at]] <= value[at] else right[at]
            total += length[at]
        assert abs(path - total / len(forest.trees) / forest.scale) < 1e-9
    assert forest.paths(np.full((1, 4), 9.0))[0] < got.min()  # far out: short
    assert len(set(forest.paths(np.repeat(rows[:1], 3, axis=0)))) == 1  # rows alike


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_forest_on_rows_held_out():
    """The forest of 300, 1,000 and all labelled rows of a half finds the bad rows of the other half that pass the base rule."""
    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    both = docs.merge(labels[["doc_id", "quality"]].dropna(), on="doc_id").sort_values("doc_id")
    found = [(*anomaly.statistics(t), q == 1) for t, q in zip(both.text, both.quality, strict=True)]
    found = [(odd, good) for base, odd, good in found if not anomaly.base_failed(base[0], base[4])]
    values, good = np.array([odd for odd, _ in found]), np.array([g for _, g in found])
    order = np.random.default_rng(5).permutation(len(values))
    rest = order[len(order) // 2 :]
    for n in (300, 1000, len(order) // 2):
        some = order[:n]
        model = anomaly.grown(values[some], good[some])
        odd = model.forest.paths(values[rest]) < model.cut
        assert odd[~good[rest]].mean() >= 0.95 and odd[good[rest]].mean() <= 0.01, n


def test_rules_learn_from_all_labels(spark):
    """What cuts tell, the trees' rows and the threshold come from more rows than any bounded sample held, and are those of all rows in memory."""
    n = 15_000
    random = np.random.default_rng(17)
    good = random.uniform(size=n) < 0.9
    odd = np.round(random.normal(0, 1, (n, 3)) + np.outer(~good, [2.5, 0, 0.5]), 2)
    stats = spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "base": [[50, 200, 0, 0, 0]] * n, "odd": odd.tolist()})).repartition(7)
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "quality": good.astype(int)}))
    rows = stats.join(labels.withColumnRenamed("quality", "y"), "doc_id")
    assert np.allclose(anomaly.told(rows, n, int((~good).sum())), anomaly.telling(odd, good), atol=1e-9)
    parts = anomaly.drawn(rows, int(good.sum()), int((~good).sum()))
    assert [len(p) for p in parts] == [anomaly.SUBSAMPLE + 6] * anomaly.TREES
    forest, limit = anomaly.fitted(stats, labels)
    assert limit == anomaly.threshold(forest.paths(odd), good)
    assert anomaly.judged(stats, anomaly.Model(forest, limit)).where("not kept").count() == (forest.paths(odd) < limit).sum()
