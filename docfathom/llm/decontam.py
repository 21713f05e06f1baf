"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case. The items of the benchmark are read in blocks of a bounded size;
each block gives every worker the items' words, their SimHash over words, and block tables of the fingerprints: a
fingerprint is cut into RADIUS + 1 blocks of bits, so any two within RADIUS agree on a whole block.

A worker slides a window of each item length over a text. As a window without one of an item's shingles has
similarity zero to it, only windows that cover a known shingle are fingerprinted, which loses nothing. Running sums of
the bits make a window's fingerprint cost the same for any length. Block tables give the candidates, whole Hamming
distances thin them, and the Jaccard similarity of word shingles, weighted by how often each is there, decides.

Defined results: null and empty texts hold no item; items without a word are never found; items shorter than a shingle
are one shingle; an empty benchmark finds nothing; rows that repeat get equal answers; texts of any length are whole.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, LEAST = 5, 0.8
#: Differing bits of 64 between the fingerprints of an item and a window like it, at most; see tests for its margin.
RADIUS = 19
#: Characters of benchmark text that workers hold at once.
BLOCK_CHARS = 8_000_000
TABLE_BITS = 20
#: Words of a text whose bit sums are held at once.
STRETCH = 1 << 14
FOUND = "array<struct<item:long,start:long,end:long,similarity:double>>"


class Match(NamedTuple):
    item: int
    start: int
    end: int
    similarity: float


class Words(NamedTuple):
    """The words of some texts: their hashes, bytes from start to end in data, and where each text's words begin."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes
    first: np.ndarray

    def text(self, k: int) -> tuple[np.ndarray, range]:
        return self.ids[self.first[k] : self.first[k + 1]], range(self.first[k], self.first[k + 1])

    def words(self, part: range) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[part.start : part.stop].tolist(), self.end[part.start : part.stop].tolist(), strict=True)]


#: Zero for bytes between words; else a random number for the byte, the same for A and a.
LETTER = np.zeros(256, np.uint64)
_random = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128 or _b >= 128:
        LETTER[_b] = _random[ord(chr(_b).lower()) if _b < 128 else _b]
PRIME = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
CHUNK = 1 << 20


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """PRIME to the power of each place in a chunk, and the inverse."""
    out = []
    for base in (PRIME, pow(PRIME, -1, 1 << 64)):
        x = np.full(CHUNK + 2, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


def words_of(texts: list[str | None]) -> Words:
    """One pass of array operations over the bytes of many texts; a word's hash is a polynomial of its bytes, mixed."""
    raw = [(t or "").lower().encode() for t in texts]
    data = b"\n".join(raw) + b"\n"
    edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
    up, down = powers()
    ids, starts, ends = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        part = np.frombuffer(data, np.uint8, stop - at, at)
        if stop < len(data):  # a chunk ends between words, unless one word fills it
            gaps = np.flatnonzero(LETTER[part[-4096:]] == 0)
            gaps = gaps if len(gaps) else np.flatnonzero(LETTER[part] == 0) - max(0, len(part) - 4096)
            if len(gaps):
                stop = at + max(0, len(part) - 4096) + int(gaps[-1]) + 1
                part = part[: stop - at]
        value = LETTER[part]
        inside = np.concatenate([[False], value > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(value)], dtype=np.uint64)])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ids.append(h ^ (h >> np.uint64(31)))
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    start = np.concatenate(starts)
    return Words(np.concatenate(ids), start, np.concatenate(ends), data, np.searchsorted(start, edges))


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


def weighted(words: list[bytes]) -> Counter:
    """Shingles, each with its count as weight."""
    if len(words) < SHINGLE:
        return Counter({tuple(words): 1}) if words else Counter()
    return Counter(zip(*[words[k:] for k in range(SHINGLE)], strict=False))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def bit_sums(ids: np.ndarray) -> np.ndarray:
    """Running sums, by word, of the 64 bits of the word hashes."""
    bits = np.unpackbits(ids.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def prints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` words from each start."""
    more = 2 * (sums[starts + size] - sums[starts]) > size
    return np.packbits(more, axis=1).view(">u8").astype(np.uint64).ravel()


class Items:
    """A block of the benchmark with its fingerprints and tables."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        every = words_of([text for _, text in rows])
        hashed = {k: every.text(k) for k in range(len(rows))}
        self.weights = {k: weighted(every.words(part)) for k, (x, part) in hashed.items() if len(x)}
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for k in self.weights:
            self.by_size[len(hashed[k][0])].append(k)
        self.prints, self.tables = {}, {}
        #: By number of words, each known shingle and the item sizes it is found in.
        self.sizes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size, items in self.by_size.items():
            ids = [hashed[k][0] for k in items]
            self.prints[size] = np.array([prints(bit_sums(x), np.zeros(1, int), size)[0] for x in ids], np.uint64)
            tables: list[dict] = [defaultdict(list) for _ in range(RADIUS + 1)]
            for at, p in enumerate(self.prints[size].tolist()):
                for table, key in zip(tables, blocks(p), strict=True):
                    table[key].append(at)
            self.tables[size] = tables
            n = min(SHINGLE, size)
            for x in ids:
                for h in rolled(x, n).tolist():
                    self.sizes[n][h].add(size)
        self.shingles = {n: np.array(sorted(x), np.uint64) for n, x in self.sizes.items()}
        self.seen = {}
        for n, x in self.shingles.items():
            self.seen[n] = np.zeros(1 << TABLE_BITS, bool)
            self.seen[n][x & np.uint64((1 << TABLE_BITS) - 1)] = True

    def covered(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the known shingles of n words."""
        r = rolled(ids, n)
        maybe = np.flatnonzero(self.seen[n][r & np.uint64((1 << TABLE_BITS) - 1)])
        known = self.shingles[n]
        place = np.minimum(np.searchsorted(known, r[maybe]), len(known) - 1)
        at = maybe[known[place] == r[maybe]]
        return at, r[at]

    def find(self, texts: list[str | None]) -> dict[int, list[Match]]:
        """By a text's place, of each item its best window there, if similar enough."""
        every = words_of(texts)
        hits: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n in self.shingles:
            at, hashes = self.covered(every.ids, n)
            text = np.searchsorted(every.first, at, "right") - 1
            for k, p, h in zip(text.tolist(), at.tolist(), hashes.tolist(), strict=True):
                if p + n <= every.first[k + 1]:
                    for size in self.sizes[n][h]:
                        hits[k][size].append(p - int(every.first[k]))
        found = {k: self.find_in(every, *every.text(k), hits[k]) for k in sorted(hits)}
        return {k: m for k, m in found.items() if m}

    def find_in(self, texts: Words, ids: np.ndarray, part: range, hits: dict[int, list[int]]) -> list[Match]:
        """hits: by item size, starts of shingles of such items."""
        best: dict[int, Match] = {}
        for size, every in sorted(hits.items()):
            items, n, wide = self.by_size[size], min(SHINGLE, size), min(size, len(ids))  # a text shorter than the item is itself the window
            every = np.array(every)
            while len(every):  # a stretch of the text at a time, with all windows over its known shingles
                at = every[every < every[0] + STRETCH]
                every = every[len(at) :]
                low, high = max(0, int(at[0]) - wide), min(len(ids), int(at[-1]) + n + wide)
                reach = (at[:, None] - np.arange(wide - n + 1)[None, :]).ravel()
                starts = np.unique(reach[(reach >= low) & (reach + wide <= high)])
                for row, near in self.candidates(size, prints(bit_sums(ids[low:high]), starts - low, wide)):
                    start = int(starts[row])
                    window = weighted(texts.words(range(part.start + start, part.start + start + wide)))
                    for c in near:
                        item = items[c]
                        value = similarity(window, self.weights[item])
                        if value >= LEAST and value > best.get(item, (0, 0, 0, 0))[3]:
                            best[item] = Match(self.ids[item], start, start + wide, value)
        return [best[i] for i in sorted(best)]

    def candidates(self, size: int, fps: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Windows with the items that agree on a block and lie within RADIUS bits."""
        distinct, inverse = np.unique(fps, return_inverse=True)
        near = []
        for p in distinct.tolist():
            some = sorted({c for table, key in zip(self.tables[size], blocks(p), strict=True) for c in table.get(key, ())})
            near.append([c for c in some if (p ^ int(self.prints[size][c])).bit_count() <= RADIUS])
        for row, k in enumerate(inverse.tolist()):
            if near[k]:
                yield row, near[k]


def blocks(fp: int) -> list[int]:
    """The fingerprint's RADIUS + 1 blocks of bits."""
    n = RADIUS + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [fp >> a & ((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_CHARS characters (or one item); the driver holds one at a time."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text", F.length("text").alias("n"))
    out: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if out and size + r[2] > BLOCK_CHARS:
            yield out
            out, size = [], 0
        out.append((r[0], r[1]))
        size += r[2]
    if out:
        yield out


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with `_df_found`, the items that each row's text holds: item, start and end word, similarity.

    One map a block of items, one after another over the same rows: nothing is shuffled.
    """
    out = docs.select(F.col("text").alias("_df_text"), F.expr(f"cast(array() as {FOUND})").alias("_df_found"), "*")
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                rows = batch.column(1).to_pylist()
                for k, found in items.find(batch.column(0).to_pylist()).items():
                    rows[k] += [m._asdict() for m in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, batch.schema.field(1).type), *batch.columns[2:]], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out.drop("_df_text")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, best, spans) for each row: items in order, spans as item:start:end in words."""
    found = matched(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("_df_found", lambda m: m["item"])))
    best = F.coalesce(F.array_max(F.transform("_df_found", lambda m: m["similarity"])), F.lit(0.0))
    spans = F.transform("_df_found", lambda m: F.concat_ws(":", m["item"].cast("string"), m["start"].cast("string"), m["end"].cast("string")))
    return found.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"),
                        F.round(best, 6).alias("best"), F.array_join(spans, ",").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    return matched(docs, benchmark).where(F.size("_df_found") == 0).drop("_df_found")
