"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

compile_merges() builds the deterministic automaton of correct token sequences. It starts from one state in which every
byte may follow every byte; then the merges are applied in order, each by a gadget: where an arc of u leads to a state q
that has an arc of v, an arc of uv is added beside the two, and the arcs of u lead to a copy of q without v. All arcs of
one token lead to one state, so the automaton is a state for each token and, for each state, the tokens that may not
follow. Tokens are numbered in the order of a walk through the tree in which the parent of uv is u, later merges first:
what one merge forbids, v and all later tokens that begin with it, is then one interval, and a row of the table is a
few intervals.

Every prefix of a word has exactly one path. The walk follows the trie of the labels' bytes from a position, takes the
longest arc that the row of the position's state has, and comes back where it leads nowhere.

Defined results: a null text is empty and has no ids; strings of special tokens in a text are those tokens, the earliest and then the
longest first; ids decode to the bytes of their arc labels, read as UTF-8 with U+FFFD for what is none; null ids decode to
an empty text. Rows that repeat are encoded each for itself; other columns are returned as they are, whatever their
names, but for those that encode() and decode() add, which replace columns of the same names.
"""

from __future__ import annotations

import functools
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Strings whose ids a worker remembers; the memory is emptied when full.
MEMO = 400_000
#: Longer strings are not remembered.
MEMO_CHARS = 64
#: How texts of these files are cut into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in these files: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """labels: the bytes of each token; rows: for each token, the bounds of the intervals of places forbidden next.

    trie: nodes of the labels' bytes; a byte leads to (next node, the arc whose label ends there or None). An arc is (token,
    place, row of the state it leads to, length).
    """

    def __init__(self, labels: dict[int, bytes], place: dict[int, int], rows: dict[int, tuple[int, ...]]):
        self.labels, self.rows = labels, rows
        self.whole = {labels[token]: [token] for token in place}  # the start state has an arc of every token
        nodes: dict[bytes, dict] = {b"": {}}
        for token, at in place.items():
            label = labels[token]
            for stop in range(1, len(label) + 1):
                head = label[:stop]
                if head not in nodes:
                    nodes[head] = {}
                    nodes[head[:-1]][head[-1]] = (nodes[head], None)
            nodes[label[:-1]][label[-1]] = (nodes[label], (token, at, rows[token], len(label)))
        self.trie, self.longest = nodes[b""], max(map(len, self.whole), default=0)

    def arcs(self, word: bytes) -> list[tuple[int, int, tuple[int, ...], int]]:
        """The arcs of all labels that a word begins with, short ones first."""
        found, node = [], self.trie
        for byte in word:
            step = node.get(byte)
            if step is None:
                break
            node, arc = step
            if arc:
                found.append(arc)
        return found

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells the word.

        Long arcs are tried first. All paths into one position lead to one state, so a position that turns out
        to have no way on has none on any path, and each position's arcs are gone through once.
        """
        if word in self.whole or not word:
            return self.whole.get(word, [])
        n, longest, dead = len(word), self.longest, set()
        out, rows, stops, left = [], [()], [0], [self.arcs(word[:longest])]
        at = 0
        while at < n:
            arcs, row = left[-1], rows[-1]
            while arcs:
                token, place, to, length = arcs.pop()
                if bisect_right(row, place) & 1 or at + length in dead:
                    continue
                at += length
                out.append(token)
                if at < n:
                    rows.append(to)
                    stops.append(at)
                    left.append(self.arcs(word[at : at + longest]))
                break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this word")
                dead.add(at)
                out.pop(), stops.pop(), left.pop(), rows.pop()
                at = stops[-1]
        return out


def compile_merges(labels: dict[int, bytes], merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton of merges (u, v, uv) in order of rank; labels holds the bytes of all tokens."""
    rank = {uv: r for r, (_, _, uv) in enumerate(merges)}
    children: dict[int, list[int]] = {}
    for r in range(len(merges) - 1, -1, -1):
        u, v, uv = merges[r]
        if rank.get(u, -1) >= r or rank.get(v, -1) >= r or rank[uv] != r:
            raise ValueError("a merge must come after those that make its parts, and each token once")
        children.setdefault(u, []).append(uv)
    made = set(rank)
    place, after = _walk([t for t in labels if t not in made], children)
    ranks = {u: [-rank[c] for c in below] for u, below in children.items()}
    target: dict[int, int] = {t: 0 for t in place if t not in made}  # the state that arcs of a token lead to, as a set of forbidden places
    for r, (u, v, uv) in enumerate(merges):
        state = target.get(u)
        if state is None or v not in target or state >> place[v] & 1:
            continue  # no path holds u and v in a row, so no arc of uv comes to be
        later = bisect_left(ranks.get(v, []), 1 - r if u == v else -r)
        stop = after[children[v][later - 1]] if later else place[v] + 1
        target[uv] = state if u == v else target[v]
        target[u] = state | ((1 << (stop - place[v])) - 1) << place[v]
    known: dict[int, tuple[int, ...]] = {}
    for state in set(target.values()):
        known[state] = _bounds(state)
    return Automaton(labels, {t: place[t] for t in target}, {t: known[state] for t, state in target.items()})


def _walk(roots: list[int], children: dict[int, list[int]]) -> tuple[dict[int, int], dict[int, int]]:
    """For each token its place in the walk, and the place after its last descendant."""
    place: dict[int, int] = {}
    after: dict[int, int] = {}
    stack = [(t, False) for t in reversed(roots)]
    while stack:
        token, done = stack.pop()
        if done:
            after[token] = len(place)
            continue
        place[token] = len(place)
        stack.append((token, True))
        stack.extend((c, False) for c in reversed(children.get(token, [])))
    return place, after


def _bounds(places: int) -> tuple[int, ...]:
    """The bounds of the intervals of set bits: starts at even positions, ends (exclusive) at odd ones."""
    edges = places ^ places << 1
    text = bin(edges)[:1:-1]
    out, at = [], text.find("1")
    while at >= 0:
        out.append(at)
        at = text.find("1", at + 1)
    return tuple(out)


def read_file(path: str) -> tuple[dict, dict[int, bytes]]:
    """What the file states, and the labels of its tokens."""
    with open(path) as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE file")
    byte = byte_of_character()
    return spec, {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items()}


class Encoder:
    """Texts to ids, for byte-level BPE files of the tokenizers library; truncation and padding aren't applied."""

    def __init__(self, path: str):
        spec, labels = read_file(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = compile_merges(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in what is beside them")
        names = sorted(self.special, key=len, reverse=True)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.words = regex.compile(WORDS).findall
        self.white = frozenset(filter(regex.compile(r"\p{White_Space}").match, map(chr, range(0x3100))))
        self.memo: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        """The ids, as 32-bit numbers, of a stretch that no word reaches out of."""
        memo, path, out = self.memo, self.automaton.path, []
        words = self.words(text)
        for word in words:
            found = memo.get(word)
            if found is None:
                found = array("i", path(word.encode())).tobytes()
                self.keep(word, found)
            out.append(found)
        ids = b"".join(out)
        if len(words) > 1:
            self.keep(text, ids)
        return ids

    def keep(self, text: str, ids: bytes) -> None:
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = ids

    def plain(self, text: str, out: list[bytes]) -> None:
        """Words go with the space before them, so a text falls apart before each space that follows another character than white space."""
        parts = text.split(" ")
        memo, white, held = self.memo, self.white, parts[0]
        for p in parts[1:]:
            if not held or held[-1] in white:
                held = f"{held} {p}"
                continue
            out.append(memo.get(held) or self.part(held))
            held = " " + p
        out.append(memo.get(held) or self.part(held))

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        out: list[bytes] = []
        if not self.cut_special or not any(t in text for t in self.special):
            self.plain(text, out)
            return b"".join(out)
        for k, stretch in enumerate(self.cut_special(text)):
            if k % 2:
                out.append(array("i", [self.special[stretch]]).tobytes())
            elif stretch:
                self.plain(stretch, out)
        return b"".join(out)

    def ids(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


@functools.cache
def encoder_at(path: str) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path)


@functools.cache
def labels_at(path: str) -> dict[int, bytes]:
    """The bytes of every token, special ones too."""
    spec, labels = read_file(path)
    return labels | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def text_of(ids: list[int], labels: dict[int, bytes]) -> str:
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text as a column of ints."""
    kept = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(path)
        for batch in batches:
            found = [encoder.packed(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of each row's ids."""
    kept = encoded.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = labels_at(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            ends, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy(zero_copy_only=False)
            found = [text_of(flat[a:b].tolist(), labels) if b > a else "" for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))
