"""License scans and benchmark decontamination against brute force."""

import random
import re

from docfathom.llm import decontam, licenses
from tests.llm.conftest import ODD, prose


def plain_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        hits = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(docs_of):
    texts = [*ODD, "Released under the MIT License.", "MIT-License mit license", "the GNU General Public License, general public license", "mit K license Klicense", "Licensed under CC BY-NC 4.0.",
             prose(1, 50) + " permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction " + prose(2, 50),
             "licensed\nunder the Apache License, Version 2.0"]
    rows = {r.doc_id: r for r in licenses.scan(docs_of(texts)).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    n = len(ODD)
    assert [rows[n + k].labels for k in (0, 4, 6)] == ["mit", "cc-by-nc", "apache"]
    assert licenses.scan(docs_of(["a"]).limit(0)).count() == 0
    assert len(licenses.scan(docs_of(["under the mit license"] * 2, ids=[4, 4])).collect()) == 2


def best(doc, item):
    wide = min(len(item), len(doc))
    return max((decontam.similarity(decontam.weighted(doc[k : k + wide]), decontam.weighted(item)) for k in range(len(doc) - wide + 1)), default=0) if doc and item else 0


def test_decontam(spark, docs_of):
    r = random.Random(5)
    items = {k: prose(900 + k, r.choice([3, 8, 20, 31, 60])) for k in range(12)}
    bench = spark.createDataFrame([*items.items(), (50, None), (None, "x"), (51, "  ")], "item_id long, text string")
    texts = [*ODD]
    for k in range(60):
        words = items[k % 12].split()
        change = r.random()
        if change < 0.3:
            words = words[r.randint(0, 2) : len(words) - r.randint(0, 2)]
        elif change < 0.6:
            words[r.choice([0, -1])] = "zzz"
        elif change < 0.8:
            words.insert(r.randint(0, len(words)), "qq")
        texts.append(prose(k, r.randint(0, 60)) + " " + ", ".join(words).upper() + ". " + prose(100 + k, r.randint(0, 60)))
    rows = {x.doc_id: x for x in decontam.judge(docs_of(texts), bench).collect()}
    split = lambda t: [w.encode() for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())]
    for k, t in enumerate(texts):
        want = sorted(i for i, x in items.items() if best(split(t), split(x)) >= 0.8)
        assert rows[k].items == ",".join(map(str, want)), t
        assert rows[k].contaminated == bool(want)
    clean = decontam.clean(docs_of(texts), bench)
    assert {x.doc_id for x in clean.collect()} == {k for k in rows if not rows[k].contaminated} and clean.columns[:2] == ["doc_id", "text"]
    assert decontam.clean(docs_of(texts), bench.limit(0)).count() == len(texts)
    assert decontam.judge(docs_of(["a"]).limit(0), bench).count() == 0


def test_blocks_of_items(spark, docs_of, monkeypatch):
    bench = spark.createDataFrame([(k, prose(k, 30)) for k in range(6)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    assert len(list(decontam.item_blocks(bench))) > 2
    rows = decontam.judge(docs_of([prose(1, 30) + " " + prose(4, 30)]), bench).collect()
    assert rows[0].items == "1,4"
