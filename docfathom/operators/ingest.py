"""Ingest: versions, idempotency, chunk merging, chunk quality, health and validation, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def check_hash(new: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, hash, status, version) of new (doc_id, hash) against state (doc_id, hash, version): new, update or skip."""
    last = state.groupBy("doc_id").agg(F.max_by("hash", "version").alias("old"), F.max("version").alias("v"))
    both = new.select("doc_id", "hash").join(last, "doc_id", "left")
    status = F.when(F.col("v").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("old")), "skip").otherwise("update")
    return both.select("doc_id", "hash", status.alias("status"), F.when(status == "skip", F.col("v")).otherwise(F.coalesce("v", F.lit(0)) + 1).alias("version"))


def prune(rows: DataFrame, keep: int) -> DataFrame:
    """The last `keep` versions of each document."""
    return rows.withColumn("_last", F.max("version").over(Window.partitionBy("doc_id"))).where(F.col("version") > F.col("_last") - keep).drop("_last")


def new_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks (doc_id, hash) of new that old doesn't hold, each old one used once."""
    w = Window.partitionBy("doc_id", "hash").orderBy("chunk_index")
    numbered = lambda df: df.withColumn("_n", F.row_number().over(w))
    return numbered(new).join(numbered(old).select("doc_id", "hash", "_n"), ["doc_id", "hash", "_n"], "left_anti").drop("_n")


def merge_small(chunks: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, chunk_index, text, parts): chunks under `least` characters join the one before, by line; tables and firsts stay."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    keep = (F.length("text") >= least) | F.col("text").contains("[TABLE") | (F.row_number().over(w) == 1)
    marked = chunks.withColumn("_island", F.sum(F.when(keep, 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return (marked.groupBy("doc_id", "_island").agg(F.min("chunk_index").alias("chunk_index"), parts.alias("p"))
            .select("doc_id", "chunk_index", F.array_join(F.transform("p", lambda s: s["text"]), "\n").alias("text"), F.size("p").alias("parts")))


def entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy) of the characters of each text in lower case, in bits."""
    chars = rows.select(key, F.length(text).alias("n"), F.explode(F.split(F.lower(text), "")).alias("c")).where("c <> ''")
    count = chars.groupBy(key, "n", "c").agg(F.count(F.lit(1)).alias("k"))
    return count.groupBy(key).agg((-F.sum(F.col("k") / F.col("n") * F.log2(F.col("k") / F.col("n")))).alias("entropy"))


def chunk_quality(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, clean, confidence, reason): the first rule that a chunk breaks, else a confidence."""
    t = F.col(text)
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    ratio = F.size(F.filter(words, lambda w: w.isin(*X.FREQUENT_WORDS))) / F.size(words)
    hits = sum(F.lower(t).contains(p).cast("int") for p in X.BOILERPLATE)
    base = rows.select(key, F.length(t).alias("len"), F.size(words).alias("n"), ratio.alias("ratio"), hits.alias("hits"), t.alias("_t"))
    both = base.join(entropy(base.where(F.col("len").between(X.MIN_CHUNK, X.MAX_CHUNK)), key, "_t"), key, "left")
    c = F.col
    reason = (F.when(c("len") < X.MIN_CHUNK, "too_short").when(c("len") > X.MAX_CHUNK, "too_long").when(c("n") < X.MIN_CHUNK_WORDS, "too_few_words")
              .when(c("ratio") < X.MIN_FREQUENT, "low_stopword_ratio").when(c("hits") >= X.MAX_BOILERPLATE, "boilerplate_detected")
              .when(c("entropy") < X.MIN_ENTROPY, "low_entropy").otherwise("heuristic_pass"))
    fixed = {"too_short": 0.2, "too_long": 0.3, "too_few_words": 0.3, "low_stopword_ratio": 0.4, "boilerplate_detected": 0.3, "low_entropy": 0.5}
    confidence = F.least(F.lit(0.95), 0.5 + 0.5 * c("ratio") + (c("entropy") - 3) / 10)
    for name, value in fixed.items():
        confidence = F.when(reason == name, value).otherwise(confidence)
    return both.select(key, (reason == "heuristic_pass").alias("clean"), confidence.alias("confidence"), reason.alias("reason"))


def health(summary: Column, total: Column, valid: Column, repaired: Column, failed: Column, truncated: Column, loss: Column) -> Column:
    """0.4 summary + 30 valid + 20 (1 - failed) + 10 (1 - repaired) - 10 truncated * loss, at least 0; shares of total."""
    share = lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))
    return F.greatest(F.lit(0.0), 0.4 * summary + 30 * share(valid) + 20 * (1 - share(failed)) + 10 * (1 - share(repaired)) - 10 * share(truncated) * loss)


def validated(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `errors`: the names of the rules that a row breaks, a null counting as a break."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def category(path: Column, override: Column) -> Column:
    """The override, else the parent directory unless that says nothing."""
    parent = F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)
    return F.coalesce(override, F.when(~parent.isin("", "downloads", "data_raw"), parent))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows, and old ones without a new one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of (path, hash) at two dates: added, removed or modified."""
    both = before.select("path", F.col("hash").alias("a")).join(after.select("path", F.col("hash").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")
