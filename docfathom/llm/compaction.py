"""Executed compaction of a table of many files: small files of a part are packed into groups, each rewritten as one file.

write_files() writes a table as one file a key, in order. plan() packs the small files of each part first-fit decreasing: a
Fenwick tree over compressed residuals keeps the open groups, and the least index over a suffix is the earliest group that
has room. compact() rewrites each group of several files as one, moves it in and takes the sources away; all other files stay as they are.

Spark writes files aside, a folder a key. Then a journal of moves and removals is written, and carried out; finish() carries out
again what a lost driver left, and moves or removals that are done already change nothing. A file is written by one task, as it must be
whole; its rows come sorted through a shuffle, so a task holds a batch at a time and what it sorts can spill. Files, not rows, go through the driver.

Defined results: an empty table gives no file; null keys are a key of their own; rows that repeat are all kept, those of equal
order in any order; nulls come first; the files have the table's columns alone, whatever their names, as long as none begins with _df_.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

UNIT = r"([^/]+)\.parquet$"


class Groups:
    """Open groups by room left; fit(size) gives the earliest one with room for size, or opens one.

    Room is compressed to the number of distinct sizes that fit in it: a group takes a size if it counts at least as far. A
    node of the tree covers the places (k - lowest bit of k, k], counted from the roomiest, with a heap of group indices. A
    group that has moved on stays in the heaps of nodes where it was, and is dropped when it comes up there.
    """

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity, self.sizes = capacity, sorted(set(sizes))
        self.heaps: list[list[int]] = [[] for _ in range(len(self.sizes) + 1)]
        self.room: list[int] = []
        self.place: list[int] = []

    def _place(self, room: int) -> int:
        """1 for groups that take every size, one more for each size that they don't; beyond the tree: they take none."""
        return len(self.sizes) + 1 - bisect_right(self.sizes, room)

    def _add(self, group: int) -> None:
        k = self.place[group] = self._place(self.room[group])
        while k <= len(self.sizes):
            heappush(self.heaps[k], group)
            k += k & -k

    def _earliest(self, last: int) -> int | None:
        """The least group among places 1 to last."""
        best, k = None, last
        while k:
            heap, least = self.heaps[k], k - (k & -k)
            while heap and not least < self.place[heap[0]] <= k:
                heappop(heap)
            if heap and (best is None or heap[0] < best):
                best = heap[0]
            k = least
        return best

    def fit(self, size: int) -> int:
        group = self._earliest(len(self.sizes) - bisect_left(self.sizes, size))
        if group is None:
            group = len(self.room)
            self.room.append(self.capacity)
            self.place.append(0)
        self.room[group] -= size
        self._add(group)
        return group


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The group of each size, in the order given: the earliest-opened one that then holds at most capacity, else a new one."""
    groups = Groups(sizes, capacity)
    return [groups.fit(size) for size in sizes]


def write_files(df: DataFrame, path: str, staging: str, unit: str, order: list[str], removals: list[str] | None = None) -> None:
    """One file path/<unit>.parquet for each value of the column `unit`, which it doesn't hold, with its rows in order.

    Columns of `order` that begin with _df_ aren't written either. removals: files that go once the new ones are there.
    """
    spark = df.sparkSession
    # the journal publishes files, so tasks may put them in place aside as they end: no second round of moves
    ordered = df.repartition(unit).sortWithinPartitions(unit, *[F.col(f"`{c}`") for c in order])
    ordered.drop(*[c for c in order if c.startswith("_df_")]).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(unit).parquet(staging)
    name = lambda f: f.rsplit("/", 2)[1].removeprefix(f"{unit}=")
    moves = [[f, f"{path}/{name(f)}.parquet"] for f in data_files(spark, staging)]
    _write(spark, f"{staging}.journal", json.dumps({"into": path, "moves": moves, "removals": removals or []}))
    finish(spark, staging)


def finish(spark: SparkSession, staging: str) -> None:
    """Carry out a journal: moves, then removals; each is done once, however often this is called."""
    fs, at = _fs(spark, staging)
    journal = json.loads(_read(spark, f"{staging}.journal"))
    fs.mkdirs(at(journal["into"]))
    for old, new in journal["moves"]:
        if fs.exists(at(old)):
            if not fs.rename(at(old), at(new)):
                raise OSError(f"can't move {old}")
        elif not fs.exists(at(new)):
            raise OSError(f"{new} is lost")
    for old in journal["removals"]:
        fs.delete(at(old), False)


def rows_of(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """The rows of files, with _df_file, their file's place, and _df_row, their number in it."""
    df = spark.read.schema(schema).parquet(*paths)
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias("_df_file"), F.col("_metadata.row_index").alias("_df_row"))


def unit_of(place: Column) -> Column:
    return F.regexp_extract(place, UNIT, 1)


def plan(files: DataFrame, part: str, order: list[str], small: int, capacity: int) -> DataFrame:
    """files (with n_rows) and grp and at: the group of a file of under `small` rows within its part and its place there, else null.

    The files of a part are taken by descending rows, then by `order`; one task packs a part.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("grp", T.LongType()), T.StructField("at", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        few = sorted((r for r in held if r["n_rows"] < small), key=lambda r: (-r["n_rows"], *(r[c] for c in order)))
        taken: dict[int, int] = {}
        for r, group in zip(few, pack([r["n_rows"] for r in few], capacity), strict=True):
            r["grp"], r["at"] = group, taken.get(group, 0)
            taken[group] = r["at"] + 1
        more = [pa.array([r.get(c) for r in held], pa.int64()) for c in ("grp", "at")]
        return pa.Table.from_arrays([*table.columns, *more], names=[*table.schema.names, "grp", "at"])

    return files.groupBy(part).applyInArrow(run, schema)


def compact(spark: SparkSession, schema: T.StructType, path: str, planned: DataFrame, staging: str) -> None:
    """Rewrite groups of several files in the folder `path`: planned has _df_unit (a file's name), _df_to (its group's) and at for each."""
    several = planned.groupBy("_df_to").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = planned.join(several, "_df_to").select("_df_unit", "_df_to", F.col("at").alias("_df_place"))
    wanted = {r[0] for r in members.select("_df_unit").collect()}  # names of files
    sources = [f for f in data_files(spark, path) if f.rsplit("/", 1)[1].removesuffix(".parquet") in wanted]
    if sources:
        rows = rows_of(spark, schema, sources).withColumn("_df_unit", unit_of(F.col("_df_file"))).drop("_df_file")
        joined = rows.join(F.broadcast(members), "_df_unit").drop("_df_unit")  # a row a file
        write_files(joined, path, staging, "_df_to", ["_df_place", "_df_row"], sources)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Files in a folder or its folders; none if there is no such folder."""
    fs, at = _fs(spark, path)
    found, folders = [], [at(path)] if fs.exists(at(path)) else []
    while folders:
        for status in fs.listStatus(folders.pop()):
            name = status.getPath().toString()
            if status.isDirectory():
                folders.append(status.getPath())
            elif name.endswith(".parquet"):
                found.append(name)
    return sorted(found)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    stream = fs.create(at(path), True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at(path))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def digests(rows: DataFrame, key: str, cents: Column) -> DataFrame:
    """By file (_df_file): rows, least and largest key, sum of cents, and the hash of its keys in file order.

    rows has _df_file and _df_row, as rows_of() gives them. Files come sorted to a task, which holds one hash at a time.
    """
    held = rows.select("_df_file", "_df_row", F.col(key).cast("long").alias("id"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"))
    held = held.repartition("_df_file").sortWithinPartitions("_df_file", "_df_row").select("_df_file", "id", "cents")
    schema = pa.schema([("_df_file", pa.string()), *((c, pa.int64()) for c in ("n_rows", "min_id", "max_id", "cents")), ("ids_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, low, high, total, sha = None, 0, None, None, 0, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, (now, n, low, high, total, sha.hexdigest()), strict=True))], schema)
        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, cents = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            start = 0
            while start < len(names):
                stop = bisect_right(names, names[start], start)
                if names[start] != now:
                    if n:
                        yield row()
                    now, n, low, high, total, sha = names[start], 0, None, None, 0, hashlib.sha256()
                part = ids[start:stop]
                there = [i for i in part if i is not None]
                if there:
                    low, high = min(there if low is None else [low, *there]), max(there if high is None else [high, *there])
                sha.update(("," * (n > 0) + ",".join("" if i is None else str(i) for i in part)).encode())
                n, total, start = n + len(part), total + sum(cents[start:stop]), stop
        if n:
            yield row()

    return held.mapInArrow(run, "_df_file string, n_rows long, min_id long, max_id long, cents long, ids_sha256 string")


def clicks_units(clicks: DataFrame, share: int) -> DataFrame:
    """clicks with the name of each row's starting file: its day, lot and piece; a day of r rows has 1 + r // share lots."""
    day = F.unix_date(F.col("arrived_at").cast("date"))
    days = clicks.groupBy(day.alias("_df_day")).agg(F.count(F.lit(1)).alias("_df_in_day"))  # a row a day
    held = clicks.join(F.broadcast(days), day.eqNullSafe(F.col("_df_day")))
    h = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary"))
    lot, piece = F.floor(h / 16) % (1 + F.floor(F.col("_df_in_day") / share)), F.least(h % 4, F.floor(h / 4) % 4)
    unit = F.concat_ws("_", F.coalesce(F.col("_df_day").cast("string"), F.lit("null")), lot, piece)
    return held.select(*[F.col(f"`{c}`") for c in clicks.columns], unit.alias("_df_unit"))


def compact_clicks(clicks: DataFrame, folder: str) -> DataFrame:
    """Write clicks into folder/clicks, one file a day, lot and piece, compact each day's small files, and return a row for each file there is in the end."""
    spark, schema, n = clicks.sparkSession, clicks.schema, clicks.count()
    share = lambda x: 1 + n // x
    path = f"{folder}/clicks"
    write_files(clicks_units(clicks, share(200)), path, f"{folder}/first", "_df_unit", ["arrived_at", "click_id"])
    files = rows_of(spark, schema, [path]).groupBy("_df_file").agg(F.count(F.lit(1)).alias("n_rows"))
    parts = F.split("_df_unit", "_")
    files = files.withColumn("_df_unit", unit_of(F.col("_df_file")))
    files = files.select("_df_unit", parts[0].alias("_df_day"), parts[1].cast("long").alias("lot"), parts[2].cast("long").alias("piece"), "n_rows")
    to = F.when(F.col("grp").isNull(), F.col("_df_unit")).otherwise(F.concat_ws("_", "_df_day", F.concat(F.lit("g"), "grp")))
    planned = plan(files, "_df_day", ["lot", "piece"], share(750), share(300)).withColumn("_df_to", to).withColumn("at", F.coalesce("at", F.lit(0)))
    planned = cut(planned, "plan")
    compact(spark, schema, path, planned, f"{folder}/second")
    joined = F.array_sort(F.collect_list(F.struct("at", F.concat_ws("-", "lot", "piece").alias("name"))))
    final = planned.groupBy("_df_to").agg(
        F.first("_df_day").try_cast("long").alias("day"), F.min_by("lot", "at").alias("lot"), F.min_by("piece", "at").alias("piece"),
        F.array_join(F.transform(joined, lambda x: x["name"]), ",").alias("sources"), (F.count(F.lit(1)) > 1).alias("rewritten"), F.first("_df_unit").alias("_df_unit"),
    )
    final = final.withColumn("_df_to", F.when(F.col("rewritten"), F.col("_df_to")).otherwise(F.col("_df_unit"))).drop("_df_unit")
    found = digests(rows_of(spark, schema, [path]), "click_id", F.floor(100 * F.col("value") + 0.5))
    whole = found.withColumn("_df_to", unit_of(F.col("_df_file"))).join(F.broadcast(final), "_df_to")  # a row a file
    where = F.regexp_replace("_df_file", "^file:/+", "/")
    return whole.select("day", "lot", "piece", "n_rows", F.col("min_id").alias("min_click_id"), F.col("max_id").alias("max_click_id"), "cents", "sources", "ids_sha256",
                        F.lit(",".join(schema.names)).alias("columns"), where.alias("path"), "rewritten")
