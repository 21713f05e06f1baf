"""Vector search, rank fusion, reranking and persona rules.

Cosine over a collection is a matrix product: queries are a bounded block, given to every worker, and each Arrow batch
of the collection is multiplied with it; a worker keeps the k best of each query, so a few rows a query and task are
shuffled. knn_join() takes a table of queries, or all rows, and compares blocks with blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyword import top

#: Query vectors that a worker holds at once.
BLOCK = 4096
#: Rows of a block of a join that finds the nearest, and cells of the table of similarities that are held at once.
JOIN_BLOCK, CELLS = 16_384, 4_000_000
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def norm_ratio(a: Column, b: Column) -> Column:
    """1 - |a - b| / |a + b|, which is no cosine."""
    length = lambda op: F.sqrt(F.aggregate(F.zip_with(a, b, op), F.lit(0.0), lambda s, x: s + x * x))
    return 1 - F.try_divide(length(lambda x, y: x.cast("double") - y), length(lambda x, y: x.cast("double") + y))


def resized(v: Column, d: int) -> Column:
    """Padded with zeros or cut to d dimensions."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), d)), 1, d)


def mean_vector(rows: DataFrame, by: list[str], v: str) -> DataFrame:
    """The mean of the vectors of each group."""
    at = rows.select(*by, F.posexplode(v).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return at.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def nearest(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, same: bool = False) -> DataFrame:
    """(query_id, id, similarity): the k nearest of rows (id, v) to each query vector by cosine, ties by id.

    Vectors of another dimension raise an error; same: ids name the same things, and a row isn't its own neighbour.
    """
    if len(ids) > BLOCK:
        raise ValueError("a block of queries is bounded")
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_s, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
        for frame in frames:
            if not len(frame):
                continue
            m = np.stack(frame.v.to_numpy()).astype(float)
            if m.shape[1] != unit.shape[1]:
                raise ValueError(f"dimension {m.shape[1]} meets {unit.shape[1]}")
            s = unit @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
            i = np.broadcast_to(frame.id.to_numpy()[None, :], s.shape)
            if same:
                s = np.where(i == ids[:, None], -np.inf, s)
            s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, i], axis=1)
            order = np.lexsort((i, -s), axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        q, at = np.nonzero(np.isfinite(best_s))
        yield pd.DataFrame({"query_id": ids[q], "id": best_i[q, at], "similarity": best_s[q, at]})

    part = rows.select("id", "v").mapInPandas(run, "query_id long, id long, similarity double")
    return top(part, ["query_id"], [F.desc(F.round("similarity", 12)), F.asc("id")], k).drop("rank")


def nearest_of(q: pd.DataFrame, r: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """(query_id, id, similarity): the k rows of the block r (id, v) nearest to each of the block q, ties by id. Only what reaches the k-th largest is sorted."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(q) and len(r):
        mine, theirs, qid, rid = _unit(q.v), _unit(r.v).T, q.id.to_numpy(), r.id.to_numpy()
        if mine.shape[1] != theirs.shape[0]:
            raise ValueError(f"dimension {theirs.shape[0]} meets {mine.shape[1]}")
        step = max(1, CELLS // len(r))
        for low in range(0, len(q), step):
            s = mine[low : low + step] @ theirs
            if same:
                s[rid[None, :] == qid[low : low + step, None]] = -np.inf
            row, col, value = _largest(s, rid, k)
            found.append((qid[low + row], rid[col], value))
    return pd.DataFrame(dict(zip(("query_id", "id", "similarity"), map(np.concatenate, zip(*found)))))


def _largest(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest finite values of each row, ties by the column's id. Only what reaches the k-th largest is sorted."""
    # similarities are compared by 12 digits: some below the k-th may be equal to it
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2e-12 if s.shape[1] > k else np.full(len(s), -np.inf)
    row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    value = s[row, col]
    order = np.lexsort((ids[col], -np.round(value, 12), row))
    row, col, value = row[order], col[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], value[kept]


def knn_join(rows: DataFrame, k: int, block_by: str | None = None, queries: DataFrame | None = None, same: bool = True) -> DataFrame:
    """(query_id, id, similarity): the k nearest of rows (id, v) to each of the queries (id, v), or to each of the rows.

    Both sides are dealt into blocks by the hash of the id, and each pair of blocks meets in a task of its own as a matrix
    product, a part of it at a time, so a task holds two blocks whatever the tables' sizes. Exact, and all rows as queries cost
    what that costs; block_by compares within the groups of a column only.
    """
    queries = rows if queries is None else queries
    group = F.col(block_by) if block_by else F.lit(0)
    sides = []
    for side, other in ((queries, rows), (rows, queries)):
        own, across = (max(1, -(-x.count() // JOIN_BLOCK)) for x in (side, other))
        sides.append((side.select(F.col("id").alias("id"), F.col("v").alias("v"), group.cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(own)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("other"))))
    # aliases: a cogroup loses columns that both sides have from one table
    left = sides[0].select("id", "v", "g", F.col("own").alias("qb"), F.col("other").alias("rb"))
    right = sides[1].select("id", "v", "g", F.col("other").alias("qb"), F.col("own").alias("rb"))

    by = ["g", "qb", "rb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda q, r: nearest_of(q, r, k, same), "query_id long, id long, similarity double")
    return top(found, ["query_id"], [F.desc(F.round("similarity", 12)), F.asc("id")], k).drop("rank")


def blocked(left: DataFrame, right: DataFrame, score, keep, most: int | None = None, schema: str = "query_id long, id long, similarity double") -> DataFrame:
    """Rows of score(q, r), a matrix for two blocks of vectors, that keep(matrix) marks, over all pairs of blocks of left and right (id, v).
    most: of these a pair of blocks gives as many of the largest scores to each row of its left block, ties by id, CELLS of the matrix at a time."""
    sides = []
    for k, (side, other) in enumerate(((left, right), (right, left))):
        own, across = (max(1, -(-x.count() // BLOCK)) for x in (side, other))
        mine, theirs = ("qb", "rb") if k == 0 else ("rb", "qb")
        sides.append(side.select(F.col("id").alias("id"), F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(own)).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias(theirs)))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "similarity": np.empty(0)})
        if most is not None:
            theirs, mine, rid, qid = np.stack(r.v.to_numpy()).astype(float), np.stack(q.v.to_numpy()).astype(float), r.id.to_numpy(), q.id.to_numpy()
            found, step = [], max(1, CELLS // len(r))
            for low in range(0, len(q), step):
                s = score(mine[low : low + step], theirs)
                row, col, value = _largest(np.where(keep(s) & (qid[low : low + step, None] != rid[None, :]), s, -np.inf), rid, most)
                found.append((qid[low + row], rid[col], value))
            return pd.DataFrame(dict(zip(("query_id", "id", "similarity"), map(np.concatenate, zip(*found)))))
        s = score(np.stack(q.v.to_numpy()).astype(float), np.stack(r.v.to_numpy()).astype(float))
        row, col = np.nonzero(keep(s) & (q.id.to_numpy()[:, None] != r.id.to_numpy()[None, :]))
        return pd.DataFrame({"query_id": q.id.to_numpy()[row], "id": r.id.to_numpy()[col], "similarity": s[row, col]})

    return sides[0].groupBy("qb", "rb").cogroup(sides[1].groupBy("qb", "rb")).applyInPandas(lambda q, r: meet(q, r), schema)


def close_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(query_id, id, similarity) of all ordered pairs of rows (id, v) with at least this cosine."""

    def cosines(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) @ (r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)).T

    return blocked(rows, rows, cosines, lambda s: np.round(s, 12) >= least)


def expansions(terms: DataFrame, candidates: DataFrame, k: int, least: float) -> DataFrame:
    """(term, other, similarity): of the k candidates (id, v) nearest to each term (id, v) by norm ratio those over a threshold."""

    def ratio(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        # products tell which may be among the k nearest, one's own row beside them; differences and sums of these, and of opposites, give the ratio itself
        square, twice = (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :], 2 * (q @ r.T)
        near = np.where(square + twice > 1e-9 * square, 1 - np.sqrt(np.maximum(square - twice, 0) / np.maximum(square + twice, 1e-300)), np.inf)
        row, col = np.nonzero(near >= np.partition(near, -k - 1, axis=1)[:, [-k - 1]] - 1e-6 if near.shape[1] > k + 1 else np.full(near.shape, True))
        for low in range(0, len(row), BLOCK):
            x, y = q[row[low : low + BLOCK]], r[col[low : low + BLOCK]]
            apart, together = (np.sqrt(((x + sign * y) ** 2).sum(axis=1)) for sign in (-1, 1))
            near[row[low : low + BLOCK], col[low : low + BLOCK]] = 1 - apart / np.where(together == 0, np.nan, together)
        return near

    found = blocked(terms, candidates, ratio, np.isfinite, k)
    best = top(found, ["query_id"], [F.desc(F.round("similarity", 12)), F.asc("id")], k)
    return best.where(F.col("similarity") >= least).select(F.col("query_id").alias("term"), F.col("id").alias("other"), "similarity")


def _unit(vectors: pd.Series) -> np.ndarray:
    sizes = {len(v) for v in vectors}
    if len(sizes) > 1:
        raise ValueError(f"dimension {min(sizes)} meets {max(sizes)}")
    m = np.stack(vectors.to_numpy()).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def min_max(score: Column, by: list[str]) -> Column:
    """Scores from 0 to 1 within a group; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def fused(semantic: DataFrame, keyword: DataFrame, k: int, strategy: str = "rrf", weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(query_id, id, score, method) of two ranked lists (query_id, id, score), the k best; a single source falls through.

    rrf: sum of weight / (60 + rank), with weights of 1 for the plain form; linear: weighted min-max scores; sum: weighted
    scores; top_k: the first max(1, k * weight) of each list, semantic first.
    """
    a, b = ranked(semantic), ranked(keyword)
    if strategy == "linear":
        a, b = (x.withColumn("s", min_max(F.col("score"), ["query_id"])) for x in (a, b))
    elif strategy == "rrf":
        a, b = (x.withColumn("s", 1 / (RRF_K + F.col("r"))) for x in (a, b))
    else:
        a, b = (x.withColumn("s", F.col("score")) for x in (a, b))
    if strategy == "top_k":
        a, b = (x.where(F.col("r") <= max(1, int(k * w))) for x, w in zip((a, b), weights, strict=True))
    both = a.select("query_id", "id", F.col("s").alias("sa"), F.col("r").alias("ra")).join(b.select("query_id", "id", F.col("s").alias("sb"), F.col("r").alias("rb")), ["query_id", "id"], "full")
    method = F.when(F.col("sb").isNull(), "vector").when(F.col("sa").isNull(), "keyword").otherwise("hybrid")
    score = weights[0] * F.coalesce("sa", F.lit(0.0)) + weights[1] * F.coalesce("sb", F.lit(0.0))
    order = [F.desc("score"), F.asc("id")]
    if strategy == "top_k":
        score, order = F.coalesce("sa", "sb"), [F.asc(F.coalesce("ra", F.lit(1 << 30) + F.col("rb")))]
    return top(both.select("query_id", "id", F.round(score, 12).alias("score"), method.alias("method"), "ra", "rb"), ["query_id"], order, k).drop("ra", "rb")


def rerank_score(text: Column, distance: Column, query: str, depth: Column, is_api: Column, is_config: Column, has_code: Column) -> Column:
    """Similarity from distance, term overlap, metadata and length."""
    low, terms = query.lower(), sorted(set(query.lower().split()))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    overlap = F.size(F.array_intersect(F.array(*map(F.lit, terms)), words)) / len(terms) if terms else F.lit(0.0)
    n = F.size(words)
    out = F.greatest(F.lit(0.0), 1 - distance / 2) + overlap * 0.2 + F.when(depth == 1, 0.1).otherwise(0.0)
    for key, flag, bonus in (("api", is_api, 0.15), ("config", is_config, 0.15), ("code", has_code, 0.1)):
        if key in low:
            out = out + F.when(flag, bonus).otherwise(0.0)
    return out + F.when(n.between(300, 600), 0.05).when(n < 100, -0.05).otherwise(0.0)


def cross_encoded(rows: DataFrame, scorer, k: int, cache: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, query, id, text) reranked by an injected pandas UDF scorer(query, text); cache: (key, score)."""
    rows = rows.where("id is not null and text is not null").withColumn("key", F.sha2(F.concat_ws("\u0001", "query", "text"), 256))
    if cache is not None:
        rows = rows.join(cache.select("key", F.col("score").alias("had")), "key", "left")
        known = rows.where("had is not null").withColumn("score", F.col("had"))
        rows = known.unionByName(rows.where("had is null").withColumn("score", scorer("query", "text"))).drop("had")
    else:
        rows = rows.withColumn("score", scorer("query", "text"))
    return top(rows.drop("key"), ["query_id"], [F.desc("score"), F.asc("id")], k)


# Persona, least quality, least citations, types, stale links, verifiable only, stale penalty, recency.
PERSONAS = (
    ("supervisor", 0.6, 10, ["academic", "report", "preprint"], True, False, 0.2, 0.1),
    ("assessor", 0.7, 5, ["academic", "report"], False, True, 0.5, 0.0),
    ("researcher", 0.4, 0, ["preprint", "academic", "report"], True, False, 0.3, 0.4),
)


def persona_scored(rows: DataFrame, persona: str, as_of_year: int) -> DataFrame:
    """Rows (id, source_category, reference_type, link_status, quality_score, citation_count, domain_relevance_score,
    distance, year) that the persona's rules let through, with persona_score. Academic references skip the rules."""
    name, quality, citations, types, stale, verifiable, penalty, recency_bias = next(p for p in PERSONAS if p[0] == persona)
    academic = F.lower(F.coalesce("source_category", F.lit(""))) == "academic_reference"
    kind, link = F.lower(F.coalesce("reference_type", F.lit(""))), F.lower(F.coalesce("link_status", F.lit("available")))
    q, c = F.coalesce("quality_score", F.lit(0.0)), F.coalesce("citation_count", F.lit(0))
    allowed = ((kind == "") | kind.isin(*types)) & ((link == "available") | F.lit(stale and not verifiable)) & (q >= quality) & (c >= citations)
    recency = F.when(F.col("year").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), as_of_year - F.col("year")) / 10))
    score = (0.5 * F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("distance")), F.lit(0.0)) + 0.2 * q + 0.15 * F.coalesce("domain_relevance_score", F.lit(0.0))
             + 0.1 * F.least(F.lit(1.0), c / 100) + (0.05 + recency_bias) * recency - F.when(link != "available", penalty).otherwise(0.0))
    return rows.where(academic | allowed).withColumn("persona_score", score)


def persona_ranked(rows: DataFrame, persona: str, k: int, as_of_year: int) -> DataFrame:
    """The k best rows of persona_scored()."""
    return persona_scored(rows, persona, as_of_year).orderBy(F.desc("persona_score"), "id").limit(k)
