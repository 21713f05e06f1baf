"""Shared parts: scratch tables, MinHash buckets, distributed components, deterministic samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: MinHash signatures: columns of four hashes, and hashes in all.
BANDS = 12
LANES = 4 * BANDS
#: Hashes in which two signatures agree, at least: at a similarity of 0.8 all but 2 in 100,000 pairs do.
AGREE = 26
#: Pairs of large buckets that are compared in the end, for each row of the table, once buckets are dealt anew.
LEFT = 32
#: Keys that are shuffled at once, as far as one band's are not more: what lies on disk at a time is a part of all keys.
KEYS = 8_000_000
#: Buckets of one row more are compared whole: at first, and once they are dealt anew.
NEAR, LATER = 4, 16
#: Rows of a bucket that are sorted together.
PART = 10_000
#: Rows in one Arrow batch; a batch of long texts must fit beside the worker.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be very long, so Python workers get small Arrow batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a local master gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or _checkpoint_dir(sc)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docfathom-"))
        found = _checkpoint_dir(sc)
    return found.rstrip("/")


def _checkpoint_dir(sc) -> str | None:
    where = sc._jsc.sc().getCheckpointDir()
    return where.get() if where.isDefined() else None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/docfathom-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str, bucket_by: str | None = None, large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs nothing.

    bucket_by: the table keeps its rows by that column in as many buckets as a shuffle has partitions, so that it joins and
    aggregates by the column without a shuffle. large: the shuffles before it are worth letting go of at once.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if bucket_by:
        table = f"docfathom_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.option("path", path).bucketBy(buckets, bucket_by).format("parquet").saveAsTable(table)
        out = spark.table(table)
    else:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._docfathom_path, out._docfathom_table = path, table if bucket_by else None
    del df, writer
    if bucket_by or large:
        free(spark)
    return out


def free(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan reads any more; Spark removes them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table made by cut() that no later plan reads."""
    path, table = getattr(df, "_docfathom_path", None), getattr(df, "_docfathom_table", None)
    if path:
        spark = df.sparkSession
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: numpy's own way hashes them, which takes far longer."""
    values = np.sort(values, kind="stable")
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values that two sorted arrays of distinct values have in common."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[:-1][both[1:] == both[:-1]]


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones at every run: those with the smallest hash of the key (then the key).

    A bound on the hash leaves little more than `rows` rows before they are ordered, whatever the table's size.
    """
    n = df.count()
    if n > rows:
        share = min(1.0, (rows + 10 * rows**0.5) / n)
        df = df.where(F.xxhash64(key) <= F.lit(int((2 * share - 1) * ((1 << 63) - 1))))
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def lane(at: int) -> Column:
    """One of the LANES 16-bit parts of the columns s0, s1, ... of a signature."""
    return F.shiftrightunsigned(F.col(f"s{at // 4}"), 16 * (at % 4)).bitwiseAND(F.lit(0xFFFF))


def at_once(rows: int) -> list[range]:
    """The bands in parts of about KEYS keys of so many rows, or one band."""
    some = max(1, min(BANDS, KEYS // max(1, rows)))
    return [range(b, min(BANDS, b + some)) for b in range(0, BANDS, some)]


def band_rows(sigs: DataFrame, bands: range) -> DataFrame:
    """(key, id) for some of the bands of each signature."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.col(f"s{b}")) for b in bands])
    return sigs.select(F.explode(keys).alias("key"), "id")


def finer_rows(rows: DataFrame, sigs: DataFrame, some: range) -> DataFrame:
    """The rows of buckets that are too large, dealt anew: by the key and some of the groups of four further lanes, of as many bands, each group after the last one used."""
    groups = []
    for j in some:
        value = reduce(lambda x, y: F.shiftleft(x, 16).bitwiseOR(y), [lane(j + BANDS * k) for k in range(4)])
        groups.append(F.when(F.col("last") < j, F.struct(F.xxhash64("key", F.lit(j), value).alias("key"), F.lit(j).cast("byte").alias("last"))))
    found = rows.join(sigs, "id").select("id", "comp", F.explode(F.array_compact(F.array(*groups))).alias("at"))
    return found.select("at.key", "id", "comp", "at.last")


def deal(rows: DataFrame, near: int, met: int) -> DataFrame:
    """rows (key, id) or (key, id, comp, last) in buckets that hold two components or more (without comp, each row is one), with the bucket's
    size n and the rows they meet there (id, comp): in a bucket of up to near + 1 rows all before them, in a larger one its first row
    and the `met` before them.

    Sizes are aggregated before the shuffle and joined back, and rows of a large bucket are sorted in parts of about PART
    rows, each with a first row of its own: no bucket, however large, needs one task.
    """
    if "comp" in rows.columns:
        several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "n")
    else:
        several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = cut(several, "buckets", large=True)
    joined = rows.join(several, "key")
    if "comp" not in rows.columns:
        joined = joined.withColumn("comp", F.col("id")).withColumn("last", F.lit(-1).cast("byte"))
    part = F.when(F.col("n") > PART, F.pmod("id", F.ceil(F.col("n") / PART))).otherwise(F.lit(0))
    by_id, own = Window.partitionBy("key", "part").orderBy("id"), F.struct("id", "comp")
    before = lambda k: F.collect_list(own).over(by_id.rowsBetween(-k, -1))
    head = F.array(F.first(own).over(by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    others = F.when(F.col("n") <= near + 1, before(near)).otherwise(F.concat(head, before(met)))
    found = cut(joined.withColumn("part", part).select("key", "id", "comp", "last", "n", others.alias("others")), "dealt", large=True)
    discard(several)
    return found


def bucket_pairs(dealt: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, across components that meet in a bucket."""
    pairs = dealt.select(F.explode("others").alias("x"), F.col("id").alias("b"), "comp")
    return pairs.where("x.id < b and x.comp <> comp").select(F.col("x.id").alias("a"), "b").distinct()


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree on AGREE of LANES lanes."""
    parts = [f"s{k}" for k in range(BANDS)]
    both = pairs.join(sigs.select(F.col("id").alias("a"), *[F.col(p).alias(f"a{p}") for p in parts]), "a")
    both = both.join(sigs.select(F.col("id").alias("b"), *[F.col(p).alias(f"b{p}") for p in parts]), "b")
    both = both.select("a", "b", *[F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}")).alias(p) for p in parts])
    return both.where(sum((lane(k) == 0).cast("int") for k in range(LANES)) >= AGREE).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over edges (a, b), for nodes that have an edge.

    Alternates large-star and small-star steps until the edges are stars; each step's table is cut, and the loop
    ends when two steps give the same edges. Only counts and checksums come to the driver.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        new = cut(small.unionAll(low.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        was, mark = mark, _mark(new)
        discard(now)
        now = new
        if was == mark:
            break
    out = cut(now.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()), "components")
    discard(now)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) once links (a, b) are added to found: only components that a link joins are gone through."""
    label = lambda side: found.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    edges = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(edges).select(F.col("node").alias("was"), F.col("comp").alias("now"))
    known = found.join(more, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    new = more.select(F.col("was").alias("node"), F.col("now").alias("comp")).join(found.select("node"), "node", "left_anti")
    out = cut(known.unionAll(new), "components")
    discard(found)
    discard(more)
    return out


def linked_components(sigs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, comp): comp is the smallest id reachable over verified pairs of MinHash candidates.

    sigs (id, s0, ...) hold MinHashes of 16 bits, four to a column; each column is a band. Rows of one band key are a
    bucket. Small buckets are compared whole; in a larger one each row meets the first one and some before it. While such
    buckets hold several components, their rows are dealt anew by four further lanes at a time;
    once the pairs left in them are at most LEFT times as many as the rows of sigs, these are compared too. A pair of
    similarity 0.8 that meets in large buckets only is lost by one dealing with a chance of 8 in 10,000, by two with one
    of 9 in 1,000. Pairs whose signatures agree on too few lanes are dropped before verify(pairs), which returns those
    of the pairs (a, b) that hold. Work is in proportion to the rows.
    """
    rows_in_all, near = sigs.count(), NEAR
    parts = [deal(band_rows(sigs, some), near, 1) for some in at_once(rows_in_all)]
    dealt = reduce(DataFrame.unionAll, parts)
    links = cut(verify(agreeing(bucket_pairs(dealt), sigs)), "links", large=True)
    found = components(links)
    discard(links)
    while True:
        large = dealt.where(F.col("n") > near + 1).select("key", "id", "last")
        large = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = cut(large.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n"), "mixed")
        size, left = (x or 0 for x in mixed.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first())
        rows = cut(large.join(mixed.select("key"), "key"), "rows")
        for part in parts:
            discard(part)
        discard(mixed)
        last = left <= rows_in_all * (0.25 if near == NEAR else LEFT)
        if not last:
            near, parts = LATER, []
            for some in at_once(size):
                finer = cut(finer_rows(rows, sigs, some), "finer", large=True)
                parts.append(deal(finer, near, near))
                discard(finer)
            dealt = reduce(DataFrame.unionAll, parts)
            pairs = bucket_pairs(dealt)
        else:
            other = rows.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
            pairs = rows.select("key", F.col("id").alias("a"), "comp").join(other, "key").where("a < b and comp <> cb").select("a", "b").distinct()
        links = cut(verify(agreeing(pairs, sigs)), "links")
        found = found if links.isEmpty() else merged(found, links)
        discard(links)
        discard(rows)
        if last:
            return found
