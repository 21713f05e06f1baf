"""Weights of vector and keyword search learned from rated queries, by least squares on six features.

One aggregation gives each group's sums of products; a group is then one small row, whatever its samples, and is solved as such. A group's
newest samples, over which weights are compared, come from a ranking that Spark cuts before the shuffle.

Defined results: samples with a null in a feature or the rating are left out; groups of fewer than `least` samples of some weight give no
row; features that don't vary, or that others determine, get the solution of least norm; of weights alike the lowest is taken; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword import top

# What a kind of query counts as, the scale of lengths, the weights that are tried, the newest samples they are compared over, the least
# weight and the days of decay and of staleness of samples older than the data, and the least samples and fit of a recommendation.
KINDS = {"technical": 1.0, "natural": 0.5, "mixed": 0.0}
LENGTH_SCALE, TRIED, NEWEST = 100.0, tuple(k / 10 for k in range(1, 10)), 50
LEAST_WEIGHT, DECAY_DAYS, STALE_DAYS, LEAST_SAMPLES, LEAST_FIT = 0.1, 30.0, 90, 20, 0.6
FEATURES = ("vector_weight", "keyword_weight", "_kind", "_length", "embedding_similarity", "bm25_score")
N = len(FEATURES)
PAIRS = [(i, j) for i in range(N) for j in range(i, N)]


def sample_weight(at: Column, data_at, now) -> Column:
    """1 for samples no older than the data; else less by the days since the data came, and 0 once these are over STALE_DAYS."""
    days = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.lit(data_at))) / 86400)
    old = F.when(days > STALE_DAYS, 0.0).when(days > 0, F.greatest(F.lit(LEAST_WEIGHT), F.exp(-days / DECAY_DAYS))).otherwise(1.0)
    return F.when(at < F.lit(data_at), old).otherwise(1.0)


def solved(weighted: np.ndarray, plain: np.ndarray, recent: np.ndarray, current: float) -> dict[str, float]:
    """The fit of sums (of weights, features, ratings and their products), its R² over all samples, and the best of the tried weights."""

    def parts(s: np.ndarray):
        square = np.zeros((N, N))
        for value, (i, j) in zip(s[2 * N + 3 :], PAIRS, strict=True):
            square[i, j] = square[j, i] = value
        return s[0], s[1 : N + 1], s[N + 1], s[N + 2], s[N + 3 : 2 * N + 3], square

    w, x, y, _, xy, xx = parts(weighted)
    mean = x / w
    slope = np.linalg.pinv(xx - w * np.outer(mean, mean), rcond=1e-10, hermitian=True) @ (xy - mean * y)
    start = y / w - slope @ mean
    n, x, y, yy, xy, xx = parts(plain)
    lost = yy - 2 * (start * y + slope @ xy) + n * start**2 + 2 * start * slope @ x + slope @ xx @ slope
    spread = yy - y * y / n
    fit = float(1 - lost / spread) if spread > 1e-12 else 0.0
    scores = [start + slope[0] * v + slope[1] * (1 - v) + slope[2:] @ recent for v in TRIED]
    best = TRIED[int(np.argmax(np.round(scores, 12)))]
    better = (slope[0] - slope[1]) * (best - current)
    return {"vector_weight": best, "keyword_weight": round(1 - best, 10), "confidence": min(1.0, max(0.0, fit)), "improvement": max(0.0, float(better)), "slopes": [float(c) for c in slope], "intercept": float(start)}


def learned_weights(samples: DataFrame, by: str, data_at, now, current: float = 0.6, least: int = LEAST_SAMPLES, least_fit: float = LEAST_FIT) -> DataFrame:
    """(by, samples, vector_weight, keyword_weight, confidence, improvement, recommended, slopes, intercept) of samples (id, by, created_at,
    vector_weight, keyword_weight, query_type, query_length, embedding_similarity, bm25_score, relevancy): recommended where the fit is
    good enough, improvement over the current weight of vectors."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in KINDS.items() for v in p]), "query_type"), F.lit(0.0))
    rows = samples.select(F.col(by).alias("_by"), "id", "created_at", sample_weight(F.col("created_at"), data_at, now).alias("_w"), F.col("relevancy").cast("double").alias("_y"),
                          *[(kind if f == "_kind" else F.col("query_length") / LENGTH_SCALE if f == "_length" else F.col(f)).cast("double").alias(f) for f in FEATURES]).dropna(subset=["_y", "_w", *FEATURES])

    def sums(w: Column) -> Column:
        y, x = F.col("_y"), [F.col(f) for f in FEATURES]
        return F.array(*[F.sum(w * t) for t in (F.lit(1.0), *x, y, y * y, *(a * y for a in x), *(x[i] * x[j] for i, j in PAIRS))])

    totals = rows.groupBy("_by").agg(F.count_if(F.col("_w") > 0).alias("samples"), sums(F.col("_w")).alias("weighted"), sums(F.lit(1.0)).alias("plain")).where(F.col("samples") >= least)
    newest = top(rows, ["_by"], [F.desc("created_at"), F.desc("id")], NEWEST).groupBy("_by").agg(F.array(*[F.avg(f) for f in FEATURES[2:]]).alias("recent"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [solved(np.array(r.weighted, float), np.array(r.plain, float), np.array(r.recent, float), current) for r in b.itertuples()]
            yield pd.concat([b[["_by", "samples"]].reset_index(drop=True), pd.DataFrame(found, columns=["vector_weight", "keyword_weight", "confidence", "improvement", "slopes", "intercept"])], axis=1)

    # nulls of a group's name are a group too
    both = totals.join(newest.withColumnRenamed("_by", "_b"), F.col("_by").eqNullSafe(F.col("_b"))).drop("_b")
    fields = f"_by {dict(rows.dtypes)['_by']}, samples long, vector_weight double, keyword_weight double, confidence double, improvement double, slopes array<double>, intercept double"
    return both.mapInPandas(solve, fields).withColumnRenamed("_by", by).withColumn("recommended", F.col("confidence") >= least_fit)
