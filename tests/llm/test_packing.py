"""Packing: an exact round trip, and ids equal to the tokenizer's."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docfathom.llm import packing
from tests.llm.conftest import ODD, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(docs_of):
    texts = [*ODD, prose(1, 3000), "Don't stop: café, 12 ÀÉ <|endoftext|> x́ ΑΣ", "İstanbul ﬁ ß"]
    plain = Tokenizer.from_file(PATH)
    want = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    rows = packing.pack(docs_of(texts), PATH).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = got.setdefault(r.doc_id, [])
        assert r.start == len(ids) and r.offset == 0 and r.length == len(r.ids) == 1 << r.bucket
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        ids += r.ids
    assert got == want
    assert all(r.doc_tokens == len(want[r.doc_id]) for r in rows)


@given(st.integers(1, 100_000))
def test_lengths(n):
    pieces = packing.piece_lengths(n)
    assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
    assert len(set(pieces) - {2048}) == len([p for p in pieces if p < 2048])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    plain = Tokenizer.from_file(PATH)
    assert packing.tokenizer_at(PATH).ids(text.encode("utf-8", "ignore").decode()).tolist() == plain.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


def test_empty(docs_of):
    assert packing.pack(docs_of(["a"]).limit(0), PATH).count() == 0
