"""The registered queries on small tables with odd rows, against plain versions of what they promise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from docfathom.llm import langid, lines, quality
from docfathom.llm.queries import QUERIES
from tests.llm.conftest import ODD, prose

SPACE = "[ \t\n\x0b\x0c\r]+"
TEXTS = [
    *ODD, prose(1, 40), prose(1, 40), prose(1, 39) + " x", "½ ② Ⅷ 12", "Mail a.b@c.example or +1 (555) 010-9999 now", "0" * 5000 + ".1.1.1 and 10.0.0.256 and 1.2.3.4.5", "4111 1111 1111 1111 1111-1111",
    "Released under the MIT License. the apache\nlicense, GENERAL public license", "line one here\nline two here\nline one here", "a b c d e f g h " * 20, "# $ % symbols & more <x>",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents (odd ones, repeated rows, clashing names), labels and benchmark."""
    at = tmp_path_factory.mktemp("ops")
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, prose(100 + k, 30 + k)) for k in range(60)] + [(3, TEXTS[3]), (12, TEXTS[12])]
    wide = [(k, t, ("aa", "bb", None)[k % 3], "s", len(t or ""), "x", 1, "y") for k, t in rows]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, score string, start int, id string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(100, 160)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, prose(120, 50)), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value double").write.parquet(f"{at}/clicks.parquet")
    empty = at / "empty"
    for name in ("documents", "labels", "benchmark", "clicks"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(at), rows


def found(spark, tables, name):
    """All rows of a query by doc_id; rows that repeat must give equal answers."""
    out = {}
    got = QUERIES[name](spark, tables[0]).collect()
    for r in got:
        assert out.setdefault(r.doc_id, r)[1:] == r[1:] or name == "op7_packing"
    assert len(got) == len(tables[1]) or name == "op7_packing"
    return out


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, f"{tables[0]}/empty").count() == 0


def test_lines(spark, tables):
    got = found(spark, tables, "op1_lines")
    for k, t in tables[1]:
        assert got[k].n_lines == (0 if t is None else t.count("\n") + 1) and got[k].n_dropped == len([x for x in got[k].dropped.split(",") if x])
    assert got[13].n_dropped == 1 and got[12].n_dropped == 0 and got[4].n_dropped == 1 and got[8].dropped == "1,2"


def test_personal_data(spark, tables):
    got = found(spark, tables, "op2_pii")

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    for k, t in tables[1]:
        t, spans = t or "", []
        digits = lambda s: re.sub("[^0-9]", "", s)
        spans += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
        spans += [(m.start(), 1, "ip", m.end()) for m in ips if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        spans += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        spans += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (k, base, got[k].spans)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(s[1] == n for s in spans) for n in range(4))
        assert set(filter(None, base.split(","))) <= set(got[k].spans.split(","))


def test_simhash(spark, tables):
    got = found(spark, tables, "op3_simhash")
    fps = {}
    for k, t in tables[1]:
        w = [x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        shingles = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[k].fingerprint == f"{fps[k]:016x}"
    comp = {k: k for k in fps}
    for _ in fps:
        comp = {k: min(comp[j] for j in fps if (fps[j] ^ fps[k]).bit_count() <= 2) for k in fps}
    assert {k: r.component_id for k, r in got.items()} == comp


def test_language(spark, tables):
    got = found(spark, tables, "op4_language")
    for k, t in tables[1]:
        assert got[k].held_out == (crc(k, 4) == 2) and (got[k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[k].score <= 1
    assert {r.lang_pred for r in got.values()} == {"aa", "bb", "und"}


def test_language_model_is_words_first_then_shorter_ngrams():
    rows = [("aa", 0, "ba", 5), ("bb", 0, "ba", 1), ("bb", 0, "thi", 4), ("aa", 3, "<bo", 2), ("bb", 2, "oz", 3), ("aa", 1, "o", 6), ("bb", 1, "o", 1)]
    totals = {("aa", 0): 5, ("bb", 0): 5, ("aa", 3): 2, ("bb", 2): 3, ("aa", 1): 6, ("bb", 1): 1}
    model = langid.Model(rows, totals)

    def plain(word, lang):
        count = {(k, g, la): n for la, k, g, n in rows}
        for kind in (0, *langid.ORDERS):
            grams = [word] if kind == 0 else [f"<{word}>"[j : j + kind] for j in range(len(word) + 3 - kind)]
            known = {g for _, k, g, _ in rows if k == kind}
            hits = [math.log((count.get((kind, g, lang), 0) + 0.1) / (totals.get((lang, kind), 0) + 0.1 * (len(known) + 1))) for g in grams if g in known]
            if hits:
                return sum(hits) / len(hits)
        return 0.0

    memo = langid.Memo(2)
    for words in (Counter(ba=2), Counter(boz=1), Counter(oz=1, thi=3), Counter(qqq=1), Counter(ba=30, boz=2)):
        mean = [sum(n * plain(w, la) for w, n in words.items()) / sum(words.values()) for la in ("aa", "bb")]
        power = [math.exp((m - max(mean)) * min(sum(words.values()), langid.CERTAIN)) for m in mean]
        lang, score = model.predict(words, memo)
        assert lang == ("aa", "bb")[power.index(max(power))] and math.isclose(score, max(power) / sum(power))
    assert model.predict(Counter(qqq=1), memo) == ("aa", 0.5)  # languages that tie: the first by name


def test_decontamination(spark, tables):
    got = found(spark, tables, "op5_decontam")
    want = {k for k, t in tables[1] if prose(120, 50) in (t or "")}
    assert {k for k, r in got.items() if r.contaminated} == want and all(got[k].items == "7" for k in want)


def test_licenses(spark, tables):
    got = found(spark, tables, "op6_licenses")
    phrases = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
    for k, t in tables[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, label) for p, label in phrases for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(at)) and (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_packing(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op7_packing"](spark, tables[0]).collect()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = Counter()
    for k, t in tables[1]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        while at < len(ids):
            n = 1 << (min(2048, len(ids) - at).bit_length() - 1)
            want[k, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    assert pieces == want and len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}


def test_quality_query(spark, tables):
    got = found(spark, tables, "op8_quality")
    assert all(r.held_out == (crc(k, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for k, r in got.items())


def test_quality_updates_follow_the_regularised_leader():
    """Against the plain algorithm, coordinate by coordinate."""
    r = random.Random(5)
    model, size = quality.Ftrl(9), 8
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        l1 = 0 if i == size else quality.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(200):
        index, label = sorted(r.sample(range(size), 3)), r.randint(0, 1)
        value = [r.random() for _ in index]
        model.learn(np.array(index), np.array(value), label)
        x = dict(zip([*index, size], [*value, 1.0], strict=True))
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            z[i], n[i] = z[i] + g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * weight(i), n[i] + g * g
    assert np.allclose(model.weights(np.arange(9)), [weight(i) for i in range(9)], atol=1e-12)


def test_rules_query(spark, tables):
    got = found(spark, tables, "op9_rules")
    for k, t in tables[1]:
        words = [w for w in re.split(SPACE, t or "") if w]
        windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        repeat = len({p for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for p in range(j, j + 8)})
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search("[^ \t\n\x0b\x0c\r]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, repeat)
        assert r.base_failed == failed and not (failed and r.kept)


def test_language_model_query(spark, tables):
    got = found(spark, tables, "op10_lm")
    split = lambda t: [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]
    train = Counter(w for k, t in tables[1] if crc(k, 7) != 2 for w in split(t))
    total, distinct = sum(train.values()), len(train)
    for k, t in tables[1]:
        w, r = split(t), got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(k, 7) == 2, len(w), sum(x in train for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in w), abs_tol=1e-6) and r.score < 0


def test_shingles_of_pairs():
    r = random.Random(1)
    xs = ["".join(r.choice("abcd é") for _ in range(r.choice([1, 3, 5, 6, 50, 360]))) for _ in range(200)]
    ys = [x[:-1] + r.choice("abc") if r.random() < 0.5 else x[::-1] for x in xs]
    plain = lambda t: {t[k : k + 5] for k in range(len(t) - 4)} or {t}
    for x, y, got in zip(xs, ys, zip(*lines.shingle_counts(xs, ys), strict=True), strict=True):
        assert got == (len(plain(x)), len(plain(y)), len(plain(x) & plain(y)))


def test_signatures_of_lines(monkeypatch):
    r = random.Random(2)
    xs = ["".join(r.choice("abcdefgh éü") for _ in range(r.choice([1, 3, 5, 6, 50, 360]))) for _ in range(60)] + ["".join(r.choice("abc d") for _ in range(3000))]
    want = []
    for x in xs:
        h = lines.hashes(np.array([ord(c) for c in x + lines.FILL * (5 - len(x))], np.uint32))
        least = [min(int(v) ^ int(m) for v in h) & 0xFFFF for m in lines.MASKS]
        want.append([sum(least[4 * b + i] << 16 * i for i in range(4)) for b in range(lines.BANDS)])
    assert [[int(v) % (1 << 64) for v in c] for c in lines.sketched(xs).T] == want
    monkeypatch.setattr(lines, "BLOCK", 700)  # pieces of a long line
    assert [[int(v) % (1 << 64) for v in c] for c in lines.sketched(xs).T] == want
