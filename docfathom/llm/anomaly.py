"""Quality rules: statistics of each text, and an isolation forest over them.

The forest grows on the statistics as they are, of all labelled documents that pass the base rule: each tree on rows drawn among all of them by
hashes of doc_id, as an isolation forest does, with random splits at random values, so that odd rows end on short paths. A split's statistic is
drawn in proportion to what a single cut of it tells of the labels; one that tells nothing, such as a text's length, would isolate good rows that
are merely rare. A tree sees few bad rows, so that these don't hide one another. What a cut tells, and the path length below which a document is
rejected, come from counts over all labelled rows: the cut at which the share of bad rows kept and the share of good rows lost, GOOD times as
dear, are least together.

Statistics are aggregated by value in Spark and summed up in ranges of values; only the trees' rows, at most TREES * (SUBSAMPLE + 6), and sums
come to the driver.

Defined results: null text has no word and fails the base rule; texts of any length are read whole; rows that repeat
get equal answers and count once in the forest (of texts under one doc_id the one of the least statistics); without labels of both
kinds the forest rejects nothing; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from .common import cut, discard

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
TREES, SUBSAMPLE = 100, 256
#: How many times the share of bad rows kept the share of good rows lost counts.
GOOD = 20
#: Share of a tree's rows that are bad ones: as many as the labels hold would hide one another, as rows that are alike are far from odd.
RARE = 0.02
#: Statistics that tell less than this share of what the best one tells take no part.
TELLING = 0.02
MEMO = 300_000
_memo: dict[bytes, int] = {}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that the text holds twice or more, the first one included."""
    if len(words) <= WINDOW:
        return 0
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh64_intdigest(w)
    ids = np.array([_memo[w] for w in words], np.uint64)
    rolled = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(rolled)]
        rolled ^= rolled >> np.uint64(31)
    _, inverse, count = np.unique(rolled, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the forest's statistics."""
    text = text or ""
    words = text.encode().split()
    n, chars = len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    some = max(1, n)
    distinct = Counter(words)
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, "!?;:"))
    shares = [symbols / some, (max(distinct.values()) if n else 0) / some, len(distinct) / some, upper / max(1, chars), marks / some, dup / max(1, len(lines)),
              repeat / some, chars / some, digits / max(1, chars), math.log1p(n), some / max(1, len(lines))]
    return [n, chars, symbols, dup, repeat], shares


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def telling(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each statistic what its best cut tells of the labels (information gained), relative to the best statistic's."""
    n, bad = len(rows), (~good).sum()
    if not bad or bad == n:
        return np.ones(rows.shape[1])

    def doubt(p: np.ndarray | float) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return -(p * np.log(p) + (1 - p) * np.log(1 - p))

    gained = np.zeros(rows.shape[1])
    below = np.arange(1, n)
    for k, values in enumerate(rows.T):
        order = np.argsort(values, kind="stable")
        held = np.cumsum(~good[order])[:-1]
        rest = (below * doubt(held / below) + (n - below) * doubt((bad - held) / (n - below))) / n
        gained[k] = np.max(doubt(bad / n) - rest, where=values[order][1:] > values[order][:-1], initial=0.0)
    return relative(gained)


def relative(gained: np.ndarray) -> np.ndarray:
    return np.where(gained >= TELLING * gained.max(), gained / gained.max(), 0.0) if gained.max() > 0 else np.ones(len(gained))


def rare_rows(usual: int, rare: int) -> int:
    """Bad rows of a tree with so many good ones."""
    return min(rare, math.ceil(RARE * usual))


class Forest:
    """Trees as flat arrays; a leaf adds the mean path of an unbuilt tree over its rows. A split's statistic is drawn by the weights."""

    def __init__(self, rows: np.ndarray, weights: np.ndarray | None = None, good: np.ndarray | None = None, seed: int = 7):
        random = np.random.default_rng(seed)
        usual, rare = np.flatnonzero(np.ones(len(rows), bool) if good is None else good), np.flatnonzero(np.zeros(len(rows), bool) if good is None else ~good)

        def picked() -> np.ndarray:
            some = random.choice(usual, min(SUBSAMPLE, len(usual)), replace=False)
            return rows[np.append(some, random.choice(rare, rare_rows(len(some), len(rare)), replace=False))]

        self.plant((picked() for _ in range(TREES if len(rows) else 0)), np.ones(rows.shape[1]) if weights is None else weights, len(rows), random)

    @classmethod
    def of(cls, parts: Iterable[np.ndarray], weights: np.ndarray, n: int, seed: int = 7) -> Forest:
        """A tree for each part, rows drawn among n."""
        out = cls.__new__(cls)
        out.plant(parts, weights, n, np.random.default_rng(seed))
        return out

    def plant(self, parts: Iterable[np.ndarray], weights: np.ndarray, n: int, random) -> None:
        self.weights = weights
        self.trees = [self.grow(part, random, int(np.ceil(np.log2(max(2, len(part)))))) for part in parts]
        self.scale = self.mean_path(min(SUBSAMPLE, max(2, n)))

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(self, rows: np.ndarray, random, limit: int) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []  # statistic, value, left, right, path

        def add(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0, at, at, depth + self.mean_path(len(part))])
            spread = np.flatnonzero((part.max(axis=0) > part.min(axis=0)) & (self.weights > 0)) if len(part) > 1 and depth < limit else []
            if len(spread):
                f = int(random.choice(spread, p=self.weights[spread] / self.weights[spread].sum()))
                value = random.uniform(part[:, f].min(), part[:, f].max())
                low = part[:, f] <= value
                nodes[at][:2] = [f, value]
                nodes[at][2], nodes[at][3] = add(part[low], depth + 1), add(part[~low], depth + 1)
            return at

        add(rows, 0)
        flat = np.array(nodes)
        return flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], limit

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row, relative to that of random rows: small is odd."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for split, value, left, right, path, depth in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(depth):
                f = split[at]
                at = np.where(f < 0, at, np.where(rows[every, np.maximum(f, 0)] <= value[at], left[at], right[at]))
            total += path[at]
        return total / max(1, len(self.trees)) / self.scale


def threshold(paths: np.ndarray, good: np.ndarray, dear: float = GOOD) -> float:
    """The cut with the least of (share of bad rows kept) + dear * (share of good rows lost), halfway between the paths next to it; of cuts as
    good the lowest; -1, which rejects nothing, without rows of both kinds or if no cut is better than none."""
    if not good.any() or good.all():
        return -1.0
    values, place = np.unique(paths, return_inverse=True)
    lost, caught = np.cumsum(np.bincount(place, good)), np.cumsum(np.bincount(place, ~good))
    cost = 1 - caught / (~good).sum() + dear * lost / good.sum()
    best = int(cost.argmin())
    return float((values[best] + values[min(best + 1, len(values) - 1)]) / 2) if cost[best] < 1 else -1.0


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc_id, keep..., base array<long>, odd array<double>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([b for b, _ in found], pa.list_(pa.int64())), pa.array([o for _, o in found], pa.list_(pa.float64()))],
                                             names=["doc_id", *keep, "base", "odd"])

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *keep)
    return rows.mapInArrow(run, rows.drop("text").schema.add("base", ArrayType(LongType())).add("odd", ArrayType(DoubleType())))


class Model(NamedTuple):
    forest: Forest
    cut: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The forest and its threshold, from all labelled documents, as far as they pass the base rule."""
    return fitted(measured(docs, []), labels, label)


def fitted(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """fit() of what measured() gives."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    passed = f"base[0] >= {MIN_WORDS} and 100 * base[4] <= {MAX_REPEAT_PERCENT} * base[0]"
    once = stats.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("base", "odd")).alias("s")).select("doc_id", "y", "s.*")  # rows may repeat
    rows = cut(once.where(passed).select("doc_id", "y", "odd"), "labelled", large=True)
    n, good = (x or 0 for x in rows.agg(F.count(F.lit(1)), F.sum("y")).first())
    if good in (0, n):
        discard(rows)
        return Model(Forest(np.empty((0, 1))), -1.0)
    forest = Forest.of(drawn(rows, good, n - good), told(rows, n, n - good), n)
    limit = best_cut(rows, forest, good, n - good)
    discard(rows)
    return Model(forest, limit)


def up_to(counts: DataFrame) -> DataFrame:
    """counts (k, value, n, bad), a row for each value of k, with the sums `below` and `held` of n and bad over the values up to its own.

    Values are parted by ranges: sums of whole ranges, then of the values in each, so that no k goes through one task.
    """
    placed = cut(counts.repartitionByRange("k", "value").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("k", "range").agg(F.sum("n").alias("n0"), F.sum("bad").alias("bad0"))
    sums = sums.select("k", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", "bad0")])
    own = Window.partitionBy("k", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(sums), ["k", "range"]).select("k", "value", (F.col("n0") + F.sum("n").over(own)).alias("below"), (F.col("bad0") + F.sum("bad").over(own)).alias("held"))


def told(rows: DataFrame, n: int, bad: int) -> np.ndarray:
    """telling() of rows (y, odd) in Spark."""

    def doubt(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return -(p * F.ln(p) + (1 - p) * F.ln(1 - p))

    values = rows.select(F.posexplode("odd").alias("k", "value"), (1 - F.col("y")).alias("bad"))
    sums = up_to(values.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))).where(F.col("below") < n)
    rest = (F.col("below") * doubt(F.col("held") / F.col("below")) + (n - F.col("below")) * doubt((bad - F.col("held")) / (n - F.col("below")))) / n
    gained = np.zeros(rows.select(F.size("odd")).first()[0])
    for k, most in sums.groupBy("k").agg(F.max(doubt(F.lit(bad / n)) - rest)).collect():
        gained[k] = max(0.0, most)
    return relative(gained)


def drawn(rows: DataFrame, good: int, bad: int) -> list[np.ndarray]:
    """The rows of each tree: of all good rows and of all bad ones those of the smallest hashes of doc_id and the tree's number."""
    sizes = {1: (min(SUBSAMPLE, good), good), 0: (rare_rows(min(SUBSAMPLE, good), bad), bad)}
    # little more than a tree's rows are under the bound, whatever the table's size
    bound = {y: min((1 << 63) - 1, int((2 * min(1.0, (size + 10 * size**0.5) / n) - 1) * (1 << 63))) for y, (size, n) in sizes.items()}
    by_label = lambda of: F.when(F.col("y") == 1, of[1]).otherwise(of[0])
    hashes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("doc_id", t).alias("h")))
    near = rows.select("doc_id", "y", "odd", F.explode(F.filter(hashes, lambda x: x["h"] <= by_label(bound))).alias("x")).select("x.*", "doc_id", "y", "odd")
    place = F.row_number().over(Window.partitionBy("tree", "y").orderBy("h", "doc_id"))
    found = near.withColumn("place", place).where(F.col("place") <= by_label({y: size for y, (size, _) in sizes.items()})).select("tree", "odd").toPandas()
    return [np.array(part.tolist(), float) for _, part in found.groupby("tree")["odd"]]


def best_cut(rows: DataFrame, forest: Forest, good: int, bad: int, dear: float = GOOD) -> float:
    """threshold() of the paths of rows (y, odd), with rows of both kinds, in Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.paths(table_of(batch.column(1))))], names=["bad", "value"])

    paths = rows.select((1 - F.col("y")).alias("bad"), "odd").mapInArrow(run, "bad int, value double")
    sums = cut(up_to(paths.groupBy(F.lit(0).alias("k"), "value").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))), "paths")
    cost = 1 - F.col("held") / bad + dear * (F.col("below") - F.col("held")) / good
    least, value = sums.agg(F.min(F.struct(cost.alias("cost"), "value")).alias("x")).select("x.*").first()
    after = sums.where(F.col("value") > value).agg(F.min("value")).first()[0]
    discard(sums)
    return (value + (value if after is None else after)) / 2 if least < 1 else -1.0


def table_of(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def grown(values: np.ndarray, good: np.ndarray) -> Model:
    """The model of labelled rows; without rows of both kinds it rejects nothing."""
    if not good.any() or good.all():
        return Model(Forest(np.empty((0, 1))), -1.0)
    forest = Forest(values, telling(values, good), good)
    return Model(forest, threshold(forest.paths(values), good))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, path)."""
    return judged(measured(docs, []), model)


def judged(stats: DataFrame, model: Model) -> DataFrame:
    """judge() of what measured() gives."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, limit = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            base = table_of(batch.column(1))
            paths = forest.paths(table_of(batch.column(2))) if forest.trees else np.ones(len(base))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(base[:, k])) for k in range(5)), pa.array(failed), pa.array(~failed & (paths >= limit)), pa.array(paths)], names=names)

    fields = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, path double"
    return stats.select("doc_id", "base", "odd").mapInArrow(run, fields)
