"""Importance resampling towards a target: documents drawn by the log ratio of hashed n-gram frequencies, with Gumbel noise.

Words become ids within a partition, and a batch of documents one sequence of ids with a separator after each. Its suffix array,
sorted as deep as the longest n-gram, puts equal n-grams side by side; the lengths of common prefixes (LCP) of neighbours bound
their runs. Each run is hashed once, by going on from the hash of the run of the n-gram's head, and its bucket is scattered back to its
occurrences. Counts of buckets are summed within a partition before they are shuffled, and gains are a row a bucket.

Defined results: a null text has no words; a null doc_id counts as an empty one for the noise; rows that repeat count
each for itself, and take ranks in any order among themselves; an empty target or table gives gains and ranks by the same
formula; other columns are returned as they are but for n_words, n_features, weight, score and rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BUCKETS = 10_000
LONGEST = 2
#: Words of a batch; its arrays take some 100 bytes a word.
BATCH_WORDS = 1_000_000
#: Distinct words a task knows; the memory is emptied when full, between batches.
KNOWN = 1_000_000
#: A-Z in lower case, and separators (all ASCII but letters and digits) as spaces; bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


class Words:
    """Ids of words, and each word's hash and the hash that an n-gram beginning with it goes on from."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def sequence(self, texts: list[list[bytes]]) -> np.ndarray:
        """The ids of all texts, -1 after each."""
        if len(self.words) > KNOWN:
            self.ids, self.words = {}, []
        new = {w for words in texts for w in words}.difference(self.ids)
        self.ids.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.words.extend(new)
        get = self.ids.__getitem__
        return np.fromiter((i for words in texts for i in (*map(get, words), -1)), np.int64, sum(map(len, texts)) + len(texts))


def suffix_array(seq: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the first `deep` entries from each on, and the length of the prefix each shares with the one before it.

    Ranks of prefixes double in length until they are deep enough; what lies beyond a separator (-1) is not looked at.
    """
    n = len(seq)
    rank, length = seq + 1, 1
    order = np.argsort(rank, kind="stable")
    while length < deep:
        more = min(length, deep - length)
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - more)] = rank[more:]
        behind[rank == 0] = 0
        width = int(rank.max(initial=0)) + 1
        pair = rank * width + behind
        order = np.argsort(pair, kind="stable")
        length += more
        if length < deep:
            fresh = np.append(False, pair[order][1:] != pair[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) + (pair[order[0]] != 0 if n else 0)
    lcp, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for k in range(deep):
        at = np.minimum(order + k, n - 1)
        word = np.where(order + k < n, seq[at], -1)
        same &= (word[1:] == word[:-1]) & (word[1:] >= 0)
        lcp[1:] += same
    return order, lcp


def buckets_of(seq: np.ndarray, words: list[bytes], longest: int, buckets: int) -> list[np.ndarray]:
    """For n = 1 to longest, the bucket of the n-gram at each position, -1 where none of n words begins."""
    order, lcp = suffix_array(seq, longest)
    n, out = len(seq), []
    head: np.ndarray | None = None  # hash of the (n-1)-gram at each position
    valid = np.ones(n, bool)
    for k in range(longest):
        at = np.arange(n) + k
        valid &= np.where(at < n, seq[np.minimum(at, n - 1)], -1) >= 0
        held = order[valid[order]]
        # neighbours among the n-grams of n words are neighbours in the whole order: shorter ones never share n words
        first = (lcp <= k)[valid[order]]
        starts = held[first]
        last = [words[i] for i in seq[starts + k].tolist()]
        if head is None:
            made = list(map(zlib.crc32, last))
        else:
            made = [zlib.crc32(w, zlib.crc32(b" ", h)) for w, h in zip(last, head[starts].tolist(), strict=True)]
        run = np.cumsum(first) - 1
        hashes = np.zeros(n, np.int64)
        hashes[held] = np.array(made, np.int64)[run] if len(held) else 0
        head = hashes
        out.append(np.where(valid, hashes % buckets, -1))
    return out


def batches_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches of about BATCH_WORDS words each, with the words of their texts."""
    for batch in batches:
        texts, held, start = [], 0, 0
        values = batch.column(batch.schema.get_field_index(column))
        for k in range(batch.num_rows):
            texts.append(words_of(values[k].as_py()))
            held += len(texts[-1])
            if held > BATCH_WORDS:
                yield batch.slice(start, k + 1 - start), texts
                texts, held, start = [], 0, k + 1
        if texts:
            yield batch.slice(start), texts


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(), np.zeros(buckets, np.int64)
        for _, texts in batches_of(batches, text):
            for found in buckets_of(known.sequence(texts), known.words, longest, buckets):
                total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Floored thousandths of the log ratio of smoothed frequencies, by bucket; both tables have at most a row a bucket."""
    held = []
    for counts in (source, target):
        row = [0] * buckets
        for r in counts.collect():
            row[r.bucket] = r.n
        held.append(row)
    (s, t), whole = held, [sum(h) + buckets for h in held]
    return [math.floor(1000 * math.log((b + 1.0) * whole[0] / ((a + 1.0) * whole[1]))) for a, b in zip(s, t, strict=True)]


def weigh(docs: DataFrame, gain: list[int], text: str = "text", longest: int = LONGEST) -> DataFrame:
    """docs without texts, with n_words, n_features and weight: the floored mean gain of a document's features."""
    kept = docs.drop("n_words", "n_features", "weight")
    buckets, others = len(gain), [c for c in kept.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = Words(), np.append(np.array(gain, np.int64), 0)
        for batch, texts in batches_of(batches, text):
            seq = known.sequence(texts)
            summed, counted = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
            for found in buckets_of(seq, known.words, longest, buckets):
                summed += value[found]
                counted += found >= 0
            n_words = np.array([len(words) for words in texts], np.int64)
            starts = np.append(0, np.cumsum(n_words + 1)[:-1])
            total, features = np.add.reduceat(summed, starts), np.add.reduceat(counted, starts)
            weight = total // np.maximum(features, 1)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(features), pa.array(weight)], names=[*others, "n_words", "n_features", "weight"])

    more = [T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    return kept.mapInArrow(run, T.StructType([*(kept.schema[c] for c in others), *more]))


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int, least_words: int = 20, seed: int = 7) -> DataFrame:
    """weighed (doc_id, n_words, n_features, weight) with score, and rank for the drawn: percent of those with least_words words, floored.

    Ranks come from a sort by ranges: each row's place in its part of the sorted table and the sizes of the parts before
    it. No part is larger for ties, as rows of one score and id are told apart by their place in the table.
    """
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    wanted = percent * scored.where(enough).count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_df_row")]
    ordered = scored.where(enough).withColumn("_df_row", F.monotonically_increasing_id()).orderBy(*order).drop("_df_row")
    ordered = cut(ordered.withColumn("_df_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_df_at", 33).alias("_df_part")
    sizes = ordered.groupBy(part).count()  # a row for each task of the sort
    before = F.coalesce(F.sum("count").over(Window.orderBy("_df_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_df_part", before.alias("_df_before"))
    place = F.col("_df_before") + F.col("_df_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn("_df_part", part).join(F.broadcast(starts), "_df_part").withColumn("rank", F.when(place <= wanted, place))
    ranked = ranked.drop("_df_part", "_df_before", "_df_at")
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """docs (without texts) with n_words, n_features, weight, score and rank; target (text) says what is looked for."""
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, "text", longest, buckets), buckets)
    return draw(weigh(docs, gain, "text", longest), percent, least_words, seed)
