"""The tokenization automaton against the tokenizers library and against merging by hand."""

import hashlib
import random

import public_tokenizers
import pytest

from docfathom.llm import automaton
from docfathom.llm.queries import QUERIES
from tests.llm.conftest import ODD, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "b", " ", "  ", "the", "ing", "er", "\n", "\r\n", "é", "ß", "1", "22", "½", "'s", "'ll", "'S", ".", "...", "—", "<|endoftext|>", "<|endoftext", "日本", "\t", " ", " ", "\x1c", "-=", "aaaaaaaa", "🙂", "́"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return automaton.encoder_at(PATH)


def test_ids_are_the_library_s(encoder, library):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(4000)] + ["".join(r.choice("abcdest") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += [t or "" for t in ODD] + ["".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)]
    labels = automaton.labels_at(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.ids(text) == want.ids, text
        assert automaton.text_of(want.ids, labels) == text


def test_any_ids_decode_as_the_library_does(library):
    r, labels = random.Random(6), automaton.labels_at(PATH)
    for _ in range(1500):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 9))]
        assert automaton.text_of(ids, labels) == library.decode(ids, skip_special_tokens=False)


def merged(word, merges):
    """Pairs joined in order of the merges, the leftmost first."""
    tokens = list(word)
    for u, v, uv in merges:
        k = 0
        while k + 1 < len(tokens):
            if tokens[k] == u and tokens[k + 1] == v:
                tokens[k : k + 2] = [uv]
            k += 1
    return tokens


@pytest.mark.parametrize("seed", range(30))
def test_random_merges(seed):
    """Automata of made-up merge lists over three bytes, u = v among them, spell all short words as merging does, and forbid all other paths."""
    r = random.Random(seed)
    labels, merges = {b: bytes([b]) for b in range(3)}, []
    for _ in range(12):
        u, v = r.choice(list(labels)), r.choice(list(labels))
        if labels[u] + labels[v] not in labels.values():
            uv = len(labels)
            labels[uv] = labels[u] + labels[v]
            merges.append((u, v, uv))
    built = automaton.compile_merges(labels, merges)
    for n in range(1, 8):
        for code in range(3**n):
            word = bytes(code // 3**k % 3 for k in range(n))
            want = merged(word, merges)
            assert built.path(word) == want
    with pytest.raises(ValueError, match="lacks"):
        built.path(bytes([0, 7, 1]))


def test_merges_out_of_order():
    with pytest.raises(ValueError, match="after"):
        automaton.compile_merges({0: b"a", 1: b"aa", 2: b"aaa"}, [(1, 0, 2), (0, 0, 1)])


def test_memory_and_columns(spark, docs_of, monkeypatch):
    monkeypatch.setattr(automaton, "MEMO", 3)
    own = automaton.Encoder(PATH)
    text = prose(3, 300)
    assert own.ids(text) == automaton.encoder_at(PATH).ids(text) and len(own.memo) <= 3
    docs = docs_of([*ODD, text]).withColumnRenamed("score", "ids").withColumnRenamed("lang", "decoded")
    got = automaton.decode(automaton.encode(docs, PATH), PATH).collect()
    assert len(got) == len(ODD) + 1 and all(r.decoded == (r.text or "") for r in got) and all(r.start == 1 for r in got)
    assert automaton.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == ""


def test_query(spark, tmp_path, library):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, "a <|endoftext|> b", prose(1, 50)])] + [(None, "null id", "x"), (3, "a", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_automaton"](spark, str(tmp_path)).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
