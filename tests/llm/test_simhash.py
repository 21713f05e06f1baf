"""SimHash groups against brute force."""

import re

import xxhash

from docfathom.llm import simhash
from tests.llm.conftest import ODD, prose


def plain(text, n=3):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    parent = {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    low = {}
    for k in fps:
        low[root(k)] = min(low.get(root(k), k), k)
    return {k: low[root(k)] for k in fps}


def test_against_brute_force(docs_of):
    texts = [prose(k // 4, 200) + (" tail" * (k % 4)) for k in range(60)] + ODD + ["Same Text", "same text"]
    fps = {k: plain(t) for k, t in enumerate(texts)}
    got = simhash.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == groups(fps)


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of(["a"]).limit(0)).count() == 0
    assert simhash.keep_one(docs_of(["a"]).limit(0)).count() == 0


def edited(text, seed, n):
    import random

    words, r = text.split(), random.Random(seed)
    for _ in range(n):
        words[r.randrange(len(words))] = "zq" + str(r.random())[2:6]
    return " ".join(words)


def jaccard(a, b, n=5):
    x, y = (set(zip(*[t.split()[k:] for k in range(n)], strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_finds_similar_texts(docs_of):
    base = [prose(k, 300) for k in range(40)]
    copies = [edited(t, k, 1 + k % 5) for k, t in enumerate(base)]
    kept = {r.doc_id for r in simhash.keep_one(docs_of(base + copies)).collect()}
    assert set(range(40)) <= kept
    similar = {40 + k for k in range(40) if jaccard(base[k], copies[k]) >= 0.8}
    assert len(similar) >= 30
    assert len(similar & kept) <= 1 and not ({40 + k for k in range(40)} - similar) - kept


def test_keep_one_odd_rows(docs_of):
    kept = [r.text for r in simhash.keep_one(docs_of(ODD)).collect()]
    assert sum(not (t or "").strip() for t in kept) == 1  # texts without a word are alike
    assert sorted(t for t in kept if t and t.strip()) == sorted({t for t in ODD if t and t.strip()})
    group = simhash.keep_one(docs_of([prose(1, 60)] * 300 + [prose(2, 60)])).collect()
    assert sorted(r.doc_id for r in group) == [0, 300]


def test_keep_one_finds_contiguous_edits(docs_of):
    """Appended and replaced passages at a similarity just over 0.8: no pair is lost."""
    base = [prose(9000 + k, 200 if k % 3 else 800) for k in range(200)]
    copies = []
    for k, t in enumerate(base):
        words = t.split()
        new = prose(20_000 + k, len(words)).split()
        copies.append(" ".join(words + new[: len(words) * 24 // 100] if k % 2 else new[: len(words) // 10] + words[len(words) // 10 :]))
    similar = {200 + k for k in range(200) if jaccard(base[k], copies[k]) >= 0.8}
    assert len(similar) >= 190
    kept = {r.doc_id for r in simhash.keep_one(docs_of(base + copies)).collect()}
    assert set(range(200)) <= kept
    assert not similar & kept and not ({200 + k for k in range(200)} - similar) - kept


def test_keep_one_links_by_fingerprints(docs_of):
    """Texts of one fingerprint, or of two that are two bits apart, are near copies whatever their sets of shingles have in common."""
    long = prose(5, 9) + " "
    texts = [long * 60 + prose(6, 12), long * 60 + prose(7, 12), prose(8, 200), prose(9, 200)]
    fps = [simhash.majority(simhash.shingle_hashes(simhash.words_of(t), 5)) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and jaccard(texts[0], texts[1]) < 0.5
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(texts)).collect()) == [0, 2, 3]


def test_no_table_of_points_is_broadcast(spark):
    """an explode makes 65 points of a fingerprint, and Spark sizes them as one."""
    fps = {((k % 3) << 40 | 1 << (k % 30)): 0 for k in range(90)} | {1 << 50 | 7: 0}
    want = groups({x: x for x in fps})
    links = simhash.near_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"))
    found, got = [(r.a, r.b) for r in links.collect()], {x: x for x in fps}
    for _ in fps:
        for a, b in found:
            got[a] = got[b] = min(got[a], got[b])
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert got == want and 1 < len(set(want.values())) < len(want) and all((a ^ b).bit_count() <= 2 for a, b in found)
