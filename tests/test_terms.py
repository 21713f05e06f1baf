"""Terms of texts: pruned counts against all runs, related terms against all pairs, plans that don't grow faster than the terms."""

import random

from docfathom.operators import terms as T


def test_rare_words_are_left_out_without_loss():
    for seed in range(60):
        r = random.Random(seed)
        text = " ".join(r.choice(["alpha", "beta", "gamma", "of", "xq", "ab", "delta9", "www", "http", f"w{r.randrange(9)}orda", "strngth"]) for _ in range(r.randrange(80)))
        every, pruned = T.counted_terms(text), T.counted_terms(text, 2)
        common = {t for t, f in every.items() if " " not in t and f >= 3}
        kept = lambda found: {t: f for t, f in found.items() if f >= 2 or " " in t and all(w in common for w in t.split(" "))}
        assert kept(every) == kept(pruned)
    assert len(T.counted_terms(" ".join(f"lone{chr(97 + k)}a" for k in range(20)), 2)) == 0


def test_related_terms_without_pairs(spark):
    names = [f"word t{k:03}" for k in range(200)] + ["other t001", "single"]
    terms = spark.createDataFrame([(d, n) for d in (1, 2) for n in names if d == 1 or n != "word t002"], "d int, term string")
    found = T.related(terms, ["d"], 3)
    got = {(r.d, r.term): r.related for r in found.collect()}
    for d in (1, 2):
        held = [n for n in names if d == 1 or n != "word t002"]
        want = {n: sorted(o for o in held if o != n and set(o.split()) & set(n.split()))[:3] for n in held}
        assert {n: x for (e, n), x in got.items() if e == d} == {n: x for n, x in want.items() if x}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pairs of the terms of a word


def test_store_goes_through_texts_once(spark):
    docs = spark.createDataFrame([(k, "alpha beta alpha beta gamma" * (1 + k % 3)) for k in range(9)], "doc_id long, text string")
    found = T.store(T.extract(docs))
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # the terms are a table by then
    assert {r.term: r.docs for r in found.collect()}["alpha"] == 9
