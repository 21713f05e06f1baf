"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted arrays.

1. Words: tasks count the XXH64 of each token of the training texts; counts are summed by ranges of the hash and each
   range is written as a sorted hash array with its counts. A word's id is its place in the ranges one after another.
2. Bigrams: tasks turn texts into ids and send sorted runs of (id before, id) to the shard of the id before, which
   merges them into a sorted key array with counts and, for each id before, its total and numbers of bigrams seen
   once, twice and more often. Continuation counts (distinct ids before an id) are summed by shards of the id.
3. Scores: workers map the files and look up whole batches of tokens by binary search.

Shards travel as compressed runs, pre-aggregated per task, so a frequent word is one entry a task. Files are written
through pyarrow's file systems to the shared folder (a lost task writes its file again under a name of its own, and
the row that a task returns names the file that counts); where that folder isn't local, a worker fetches the files once.
The driver holds the list of files, the discounts and totals, nothing that grows with the vocabulary.

The order is two: a trigram table of a corpus is larger than the text itself.

Defined results: null text is empty, its only token is the end; without training texts c, N and V are 0 and the model
is uniform; rows that repeat count each time; an empty table gives no rows; texts of any length are whole.
"""

from __future__ import annotations

import functools
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path

#: The hash of the end, a token that no word can be.
END = 0
#: Words or bigrams of a shard that its task merges at once.
SHARD_ROWS = 4_000_000
#: Tokens that a task holds before it sends a run.
RUN = 3_000_000
MEMO = 400_000
#: A bigram is two ids in one key of 64 bits; the last id is the start of a text.
MAX_WORDS = (1 << 32) - 2


class Shard(NamedTuple):
    """One file of arrays: `first` is the id (words) or context id (bigrams) it starts with."""

    path: str
    first: int
    rows: int


class Model(NamedTuple):
    words: list[Shard]
    bigrams: list[Shard]
    follows: list[Shard]
    tokens: int
    distinct: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    #: Distinct bigrams; and of words by their number of predecessors: one, two, more.
    pairs: int
    kinds: tuple[int, int, int]


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Hasher:
    """Token hashes of texts, each closed by the end."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, memo = tokens_of(text), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w) or 1
        out = [memo[w] for w in words]
        out.append(END)
        return np.array(out, np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def exact_sums(at: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Sums of counts by place; bincount() would add them as doubles."""
    out = np.zeros(size, "<u8")
    np.add.at(out, at, counts.astype(np.uint64))
    return out


def present(small: np.ndarray) -> np.ndarray:
    """The distinct values of small integers from 0, in order."""
    return np.flatnonzero(np.bincount(small))


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: differences of the keys and the counts, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    parts = steps.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(parts, codec="zstd", asbytes=True)


def unpacked(blob: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    parts = np.frombuffer(pa.decompress(blob, 16 * rows, codec="zstd", asbytes=True), np.uint8)
    steps, counts = (p.reshape(8, rows).T for p in (parts[: 8 * rows], parts[8 * rows :]))
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(counts).view("<i8").ravel()


RUNS = "shard int, rows long, run binary"
FILES = "shard int, path string, rows long, stats array<double>"


def runs(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each shard among the sorted keys."""
    edges = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1])), len(shards)) if len(shards) else np.zeros(1, int)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array([int(shards[a]) for a, _ in spans], pa.int32()), pa.array([b - a for a, b in spans], pa.int64()),
                                       pa.array([packed(keys[a:b], counts[a:b]) for a, b in spans], pa.binary())], names=["shard", "rows", "run"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards in order, each with its summed keys; the rows come sorted by shard."""
    now, held, size = None, [], 0
    for batch in batches:
        for shard, rows, run in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if now is not None and shard != now:
                yield now, *summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held, size = [], 0
            now = shard
            held.append(unpacked(run, rows))
            size += rows
            if size > 2 * SHARD_ROWS:
                held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                size = len(held[0][0])
    if now is not None:
        yield now, *summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def put(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """Write the arrays one after another; their lengths follow from the row count."""
    where, root = pafs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(f"{root}/{file}") as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    return f"{folder}/{file}"


@functools.cache
def local(path: str) -> str:
    """The file on this machine: itself, or a copy fetched once where the shared folder is a remote store."""
    where, inner = pafs.FileSystem.from_uri(path)
    if isinstance(where, pafs.LocalFileSystem):
        return inner
    copy = os.path.join(tempfile.gettempdir(), f"lm-{xxhash.xxh64_hexdigest(path)}")
    if not os.path.exists(copy):
        part = f"{copy}.{uuid.uuid4().hex}"
        pafs.copy_files(inner, part, source_filesystem=where, destination_filesystem=pafs.LocalFileSystem())
        os.replace(part, copy)
    return copy


def mapped(path: str, dtype: str, rows: int, offset: int = 0) -> np.ndarray:
    return np.memmap(local(path), dtype, "r", offset, (rows,)) if rows else np.empty(0, dtype)


class Words:
    """Ids and counts of token hashes, from the memory-mapped ranges."""

    def __init__(self, shards: list[Shard]):
        self.parts = [(s.first, mapped(s.path, "<u8", s.rows), mapped(s.path, "<u8", s.rows, 8 * s.rows)) for s in shards if s.rows]
        self.low = np.array([p[1][0] for p in self.parts], np.uint64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 unknown) and training counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if self.parts:
            part = np.searchsorted(self.low, hashes, "right") - 1
            for k in present(part + 1) - 1:
                if k >= 0:
                    first, keys, count = self.parts[k]
                    here = np.flatnonzero(part == k)
                    at = np.minimum(np.searchsorted(keys, hashes[here]), len(keys) - 1)
                    hit = keys[at] == hashes[here]
                    ids[here[hit]], counts[here[hit]] = first + at[hit], count[at[hit]]
        return ids, counts


def word_shards(texts: DataFrame, shards: int, folder: str) -> list[Shard]:
    """Count token hashes; ranges of the hash by its top bits, `shards` of them."""
    width = (1 << 64) // shards + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
            return runs((keys // np.uint64(width)).astype(np.int64), keys, counts)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(hasher(text))
                size += len(held[-1])
            if size > RUN:
                yield out()
                held, size = [], 0
        yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in merged(batches):
            yield files(shard, put(folder, f"words-{shard}", [keys.astype("<u8"), counts.astype("<u8")]), len(keys), [float(counts.sum())])

    rows = gathered(texts.select("text").mapInArrow(count, RUNS), shards).mapInArrow(write, FILES)
    found, first = [], 0
    for r in sorted(cut(rows, "lm", large=True).collect()):
        found.append((Shard(r[1], first, r[2]), r[3][0]))
        first += r[2]
    return found


def gathered(rows: DataFrame, shards: int) -> DataFrame:
    """Each shard whole in one task, its runs one after another."""
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


def files(shard: int, path: str, rows: int, stats: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([rows], pa.int64()), pa.array([stats], pa.list_(pa.float64()))], names=["shard", "path", "rows", "stats"])


def of_count(counts: np.ndarray) -> list[float]:
    """How many counts are 1, 2, 3 and 4."""
    return [float((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Chen and Goodman's estimates, kept within their counts; plain values where a count of counts is missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(found, 1))


def ids_of(batch_hashes: list[np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, training counts and, for each token, whether it starts a text, of many texts at once."""
    every = np.concatenate(batch_hashes)
    distinct, inverse = np.unique(every, return_inverse=True)
    ids, counts = words.find(distinct)
    starts = np.zeros(len(every), bool)
    starts[np.cumsum([0, *map(len, batch_hashes[:-1])])] = True
    return ids[inverse], counts[inverse], starts


def bigram_shards(texts: DataFrame, found: list[Shard], distinct: int, shards: int, folder: str) -> tuple[list, list, int]:
    """Files of bigrams by the id before (id `distinct` is the start of a text), and of continuation counts by the id."""
    width = -(-(distinct + 1) // shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words, held, size = Hasher(), Words(found), [], 0

        def out() -> pa.RecordBatch:
            if not held:
                return runs(np.empty(0, int), np.empty(0, np.uint64), np.empty(0, int))
            ids, _, starts = ids_of(held, words)
            before = np.append(distinct, ids[:-1])
            before[starts] = distinct
            keys, counts = np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_counts=True)
            return runs(((keys >> np.uint64(32)) // np.uint64(width)).astype(np.int64), keys, counts)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(hasher(text))
                size += len(held[-1])
            if size > RUN:
                yield out()
                held, size = [], 0
        yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in merged(batches):
            before = (keys >> np.uint64(32)).astype(np.int64) - shard * width
            total = exact_sums(before, counts, width)
            kinds = [np.bincount(before[hit], minlength=width).astype("<u8") for hit in (counts == 1, counts == 2, counts > 2)]
            path = put(folder, f"bigrams-{shard}", [keys.astype("<u8"), total, *kinds, counts.astype("<u8")])
            yield files(shard, path, len(keys), of_count(counts))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct predecessors of each id, partly: those of this task's bigram files."""
        for batch in batches:
            for path, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, counts = np.unique(mapped(path, "<u8", rows) & np.uint64(0xFFFFFFFF), return_counts=True)
                yield runs((ids // np.uint64(width)).astype(np.int64), ids, counts)

    def write_follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, counts in merged(batches):
            dense = np.zeros(width, "<u8")
            dense[ids.astype(np.int64) - shard * width] = counts
            stats = [*of_count(counts), float((counts == 1).sum()), float((counts == 2).sum()), float((counts > 2).sum())]
            yield files(shard, put(folder, f"follows-{shard}", [dense]), width, stats)

    pairs = cut(gathered(texts.select("text").mapInArrow(count, RUNS), shards).mapInArrow(write, FILES), "lm", large=True)
    follows = cut(gathered(pairs.repartition(shards, "path").mapInArrow(follow, RUNS), shards).mapInArrow(write_follow, FILES), "lm")
    return sorted(pairs.collect()), sorted(follows.collect()), width


def fit(docs: DataFrame) -> tuple[Model, int]:
    """The model of rows (text), and the number of context ids in a bigram shard."""
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "model")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = word_shards(docs, shards, folder)  # a shard is as large as a shuffle partition is set to be
    words = [s for s, _ in counted]
    tokens, distinct = int(sum(n for _, n in counted)), sum(s.rows for s in words)
    if distinct >= MAX_WORDS:
        raise ValueError("a bigram's key has 32 bits for a word")
    more = max(shards, math.ceil(tokens / (8 * SHARD_ROWS)))
    pairs, follows, width = bigram_shards(docs, words, distinct, more, folder)
    count = np.sum([r[3] for r in pairs], axis=0) if pairs else np.zeros(4)
    lower = np.sum([r[3] for r in follows], axis=0) if follows else np.zeros(7)
    model = Model(words, [Shard(r[1], r[0], r[2]) for r in pairs], [Shard(r[1], r[0], r[2]) for r in follows], tokens, distinct,
                  discounts(count.tolist()), discounts(lower[:4].tolist()), sum(r[2] for r in pairs), tuple(int(x) for x in lower[4:]))
    return model, width


class Scorer:
    """Probabilities of ids after ids, from the memory-mapped shards."""

    def __init__(self, model: Model, width: int):
        self.model, self.width = model, width
        self.words = Words(model.words)
        self.bigrams = {s.first: (mapped(s.path, "<u8", s.rows), [mapped(s.path, "<u8", width, 8 * (s.rows + width * k)) for k in range(4)],
                                  mapped(s.path, "<u8", s.rows, 8 * (s.rows + 4 * width))) for s in model.bigrams}
        self.follows = {s.first: mapped(s.path, "<u8", width) for s in model.follows}

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """Continuation probability of each id (-1 unknown), down to the uniform one."""
        m = self.model
        uniform = 1 / (m.distinct + 1)
        if not m.pairs:
            return np.full(len(ids), uniform)
        count = np.zeros(len(ids))
        shard = ids // self.width
        for k in present(shard[ids >= 0]):
            if int(k) in self.follows:
                here = (shard == k) & (ids >= 0)
                count[here] = self.follows[int(k)][ids[here] - k * self.width]
        cut_off = np.select([count == 0, count == 1, count == 2], [0, m.lower[0], m.lower[1]], m.lower[2])
        left = sum(d * n for d, n in zip(m.lower, m.kinds, strict=True))
        return (count - cut_off + left * uniform) / m.pairs

    def after(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probabilities."""
        pairs = ((before + 1).astype(np.uint64) << np.uint64(32)) | (ids + 1).astype(np.uint64)
        _, first, inverse = np.unique(pairs, return_index=True, return_inverse=True)
        return np.log10(self.probabilities(before[first], ids[first]))[inverse]

    def probabilities(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        m, low = self.model, self.lower(ids)
        keys = (before.astype(np.uint64) << np.uint64(32)) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = low.copy()
        shard = before // self.width
        d1, d2, d3 = m.discounts
        for k in present(shard[before >= 0]):
            if int(k) not in self.bigrams:
                continue
            sorted_keys, stats, counts = self.bigrams[int(k)]
            here = np.flatnonzero((shard == k) & (before >= 0))
            at = before[here] - k * self.width
            total, n1, n2, n3 = (s[at].astype(float) for s in stats)
            some = total > 0
            here, at, total, n1, n2, n3 = here[some], at[some], total[some], n1[some], n2[some], n3[some]
            place = np.minimum(np.searchsorted(sorted_keys, keys[here]), len(sorted_keys) - 1)
            c = np.where((sorted_keys[place] == keys[here]) & (ids[here] >= 0), counts[place], 0).astype(float)
            c -= np.select([c == 0, c == 1, c == 2], [0, d1, d2], d3)
            out[here] = (c + (d1 * n1 + d2 * n2 + d3 * n3) * low[here]) / total
        return out


def score(docs: DataFrame, model: Model, width: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, width = shared.value
        scorer, hasher = Scorer(model, width), Hasher()
        space = math.log10(model.tokens + model.distinct + 1)
        for batch in batches:
            hashes = [hasher(t) for t in batch.column(1).to_pylist()]
            if not hashes:
                continue
            ids, counts, starts = ids_of(hashes, scorer.words)
            before = np.append(model.distinct, ids[:-1])
            before[starts] = model.distinct
            edges = np.flatnonzero(starts)
            value = scorer.after(before, ids)
            base = np.log10(counts + 1.0) - space
            sums = [np.add.reduceat(x, edges) for x in (np.ones(len(ids), np.int64), (counts > 0).astype(np.int64), base, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
