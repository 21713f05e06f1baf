"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, one piece a sequence.

A document of n tokens gives n // max_len pieces of max_len and one piece for each bit set in n % max_len, largest
first. A piece fills its sequence, so no sequence crosses documents and none needs padding; sequences of one length
make one bucket. The plan is a single map over the documents: no shuffle, nothing kept per corpus.

Defined results: a null text is empty and gives the end token alone; an empty table gives no rows; rows that repeat
are packed each for itself; other columns of the input are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

MAX_LEN = 2048
#: Distinct space-separated strings whose ids a worker remembers; the memory is emptied when full.
MEMO = 800_000
END_ID = 1

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "bucket int, ids array<int>")  # fmt: skip


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


class RankedPieces:
    """The same ids by merge ranks, for byte-level BPE files with a word-end suffix, lower case and one id per merge in order.

    A merge makes the token of its rank, so joining the pair of lowest joint rank is what the merge list asks for.
    The word end is a byte that UTF-8 never has. Only texts below U+0250 come here: there NFC changes nothing and
    lower case is by character.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken

        with open(path) as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        special = {t["content"] for t in spec["added_tokens"]}
        first = min(vocab[a + b] for a, b in merges)
        if steps != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != "</w>" or any(vocab[a + b] != first + k for k, (a, b) in enumerate(merges)):
            raise ValueError("not a file of this kind")
        self.cut = regex.compile(split["pattern"]["Regex"]).findall
        self.special = special
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + self.END * t.endswith("</w>"): i for t, i in vocab.items() if t not in special}
        self.piece = tiktoken._tiktoken.CoreBPE(ranks, {}, r"[\s\S]+").encode_single_piece

    def ids(self, word: str) -> list[int] | None:
        """None: this word needs the tokenizer itself."""
        if max(word) >= "\u0250" or "<|" in word and any(s in word for s in self.special):
            return None
        word = word.lower()
        if word.isalpha():
            return self.piece(word.encode() + self.END)
        if word[-1] in ".," and word[:-1].isalpha():
            return self.piece(word[:-1].encode() + self.END) + self.piece(word[-1].encode() + self.END)
        return [i for p in self.cut(word) for i in self.piece(p.encode() + self.END)]


class WordTokenizer:
    """Ids of whole texts through a memory of the ids of their space-separated strings.

    It holds for tokenizers whose pre-tokenizer drops white space, as no token then reaches over a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        try:
            self.ranked = RankedPieces(path).ids
        except (ValueError, KeyError, TypeError, ImportError):
            self.ranked = lambda word: None

    def word(self, word: bytes) -> bytes:
        ids = self.ranked(text := word.decode())
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> np.ndarray:
        words = text.encode().split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.word(w)
        return np.frombuffer(b"".join([memo[w] for w in words]), dtype="<u4")


@functools.cache
def tokenizer_at(path: str) -> WordTokenizer:
    """A worker's own, kept from task to task."""
    return WordTokenizer(path)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids; sequence_id is unique and offset 0, as a piece is its own sequence."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    names = SCHEMA.split(", ")
    types = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n.split()[0], types[n.split()[1]]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = tokenizer_at(tokenizer_path), (TaskContext.get().partitionId() << 40)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(words.ids(text or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in piece_lengths(len(ids), max_len):
                    piece = ids[start : start + n]
                    row = (doc, start, n, zlib.crc32(piece.tobytes()), len(ids), at, 0, n.bit_length() - 1, piece.astype(np.int32))
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                    start, at, held = start + n, at + 1, held + n
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Training files, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
