"""Tables kept as a log of segments: a put writes its rows alone, a delete its keys, and readers merge.

A store is a folder of segments and numbered manifests. A manifest names the live segments from old to new; the highest whole one
counts, so a reader sees a write whole or not at all. A segment holds some named tables and `keys`, the keys that it puts or deletes: they
hide all rows of those keys in older segments. compact() rewrites the newer segments, or all, as one, drops what is hidden and
frees segments that no manifest names any more; the last manifest but one, and its segments, stay for readers that have just looked.

Writers agree by creating the manifest of the next number, which one of them can; the others read it, take over what it says and try
the number after. Only names and counts of segments go through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "MANIFEST-"
#: Newer segments that a store may have before write() compacts them; and how many times the rows of all newer ones an older one must have to be left out.
MOST, RATIO = 8, 4
#: Seconds that a manifest which isn't whole is waited for before its writer counts as lost.
PATIENCE = 10.0


class Table:
    """How a table is kept: `encode` lays rows out for writing, `decode` reads them back, `folders` are columns of the laid-out rows that make
    folders, and `facts` are sums over the rows that the manifest holds for each segment."""

    def __init__(self, encode: Callable[[DataFrame], DataFrame] = lambda df: df, decode: Callable[[DataFrame], DataFrame] = lambda df: df, folders: tuple[str, ...] = (), facts: dict[str, Column] | None = None):
        self.encode, self.decode, self.folders, self.facts = encode, decode, folders, facts or {}


class Segments:
    """A store of tables that have the column `key`."""

    def __init__(self, spark: SparkSession, root: str, key: str, tables: dict[str, Table]):
        self.spark, self.root, self.key, self.tables = spark, root.rstrip("/"), key, tables

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))] if fs.exists(path(self.root)) else []
        return sorted(int(n[len(MANIFEST) :]) for n in names if n.startswith(MANIFEST))

    def _text(self, number: int) -> str:
        fs, path = self._fs()
        try:
            stream = fs.open(path(f"{self.root}/{MANIFEST}{number:012}"))
        except Exception as e:  # noqa: BLE001  the JVM's exception for a file that is gone
            if "FileNotFound" in str(e):
                return ""
            raise
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def manifest(self, wait: bool = False) -> dict:
        """The newest whole manifest; wait: a newer one that isn't whole yet is waited for."""
        until = time.time() + PATIENCE
        while True:
            numbers = self._numbers()
            for number in reversed(numbers):
                text = self._text(number)
                if text.endswith("\n"):
                    return {"number": number} | json.loads(text)
                if wait and time.time() < until:
                    break
            else:
                return {"number": 0, "segments": [], "marks": {}}
            if not wait:
                return {"number": 0, "segments": [], "marks": {}}
            time.sleep(0.05)

    def _commit(self, change: Callable[[list[dict]], list[dict]], mark: tuple[str, int] | None = None) -> dict | None:
        """Publish the live segments with a change made to them; None, and nothing is published, if a mark of the same name is as high already."""
        fs, path = self._fs()
        while True:
            now = self.manifest(wait=True)
            marks = now["marks"] | (dict([mark]) if mark else {})
            if mark and now["marks"].get(mark[0], -1) >= mark[1]:
                return None
            segments = change(now["segments"])
            number = max([now["number"], *self._numbers()]) + 1
            try:
                out = fs.create(path(f"{self.root}/{MANIFEST}{number:012}"), False)
            except Exception as e:  # noqa: BLE001  another writer has taken the number
                if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                    continue
                raise
            out.write(bytearray((json.dumps({"segments": segments, "marks": marks}) + "\n").encode()))
            out.close()
            self._free(segments)
            return {"number": number, "segments": segments}

    def _free(self, segments: list[dict]) -> None:
        """Delete manifests but the last two, and segments that only those named."""
        fs, path = self._fs()
        old = {n: self._text(n) for n in self._numbers()[:-2]}
        kept = {s["id"] for n in self._numbers()[-2:] if (text := self._text(n)).endswith("\n") for s in json.loads(text)["segments"]} | {s["id"] for s in segments}
        for number, text in old.items():
            for s in json.loads(text)["segments"] if text.endswith("\n") else []:
                if s["id"] not in kept:
                    fs.delete(path(f"{self.root}/{s['id']}"), True)
            fs.delete(path(f"{self.root}/{MANIFEST}{number:012}"), False)

    def _written(self, rows: dict[str, DataFrame], keys: DataFrame | None, rows_per_file: int = 0) -> dict:
        """A new segment, not yet published."""
        name, tables = f"s-{uuid.uuid4().hex}", {}
        for table, df in rows.items():
            kept, at = self.tables[table], f"{self.root}/{name}/{table}"
            laid = kept.encode(df)
            writer = laid.write.option("maxRecordsPerFile", rows_per_file)
            (writer.partitionBy(*kept.folders) if kept.folders else writer).parquet(at)
            sums = self.spark.read.schema(laid.schema).parquet(at).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in kept.facts.items()]).first()
            tables[table] = {"schema": laid.schema.jsonValue(), "facts": sums.asDict()}
        count = 0
        if keys is not None:
            keys.select(self.key).distinct().write.parquet(f"{self.root}/{name}/keys")
            count = self.spark.read.parquet(f"{self.root}/{name}/keys").count()
        return {"id": name, "tables": tables, "keys": count, "whole": keys is None}

    def build(self, rows: dict[str, DataFrame], rows_per_file: int = 0) -> None:
        """Put rows in place of all that there is."""
        new = self._written(rows, None, rows_per_file)
        self._commit(lambda _: [new])

    def marked(self, name: str) -> int:
        """The highest mark of a name that a write has left, -1 without one."""
        return self.manifest()["marks"].get(name, -1)

    def write(self, rows: dict[str, DataFrame], keys: DataFrame, rows_per_file: int = 0, mark: tuple[str, int] | None = None) -> None:
        """Put rows; all older rows of the keys, which hold those of the rows, go. mark: a name and a number that rises from write to write; one
        that was left before, as by a batch that is run again, writes nothing."""
        if mark and self.marked(mark[0]) >= mark[1]:
            return
        new = self._written(rows, keys, rows_per_file)
        now = self._commit(lambda live: [*live, new], mark)
        if now is None:
            fs, path = self._fs()
            fs.delete(path(f"{self.root}/{new['id']}"), True)
        elif len(now["segments"]) > MOST:
            self.compact(whole=False)

    def delete(self, keys: DataFrame) -> None:
        self.write({}, keys)

    def segments(self) -> list[dict]:
        return self.manifest()["segments"]

    def hidden(self, live: list[dict]) -> DataFrame | None:
        """(key, _at): the newest segment, by its place, that puts or deletes a key; none if no newer segment does."""
        held = [self.spark.read.parquet(f"{self.root}/{s['id']}/keys").select(self.key, F.lit(at).alias("_at")) for at, s in enumerate(live) if at and not s["whole"]]
        return reduce(DataFrame.unionAll, held).groupBy(self.key).agg(F.max("_at").alias("_at")) if held else None

    def raw(self, table: str, live: list[dict], prune: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
        """Rows as they are laid out in all segments, with _seg, their segment's place; prune is applied before they are joined to anything."""
        parts = []
        for at, s in enumerate(live):
            if table in s["tables"]:
                df = self.spark.read.schema(T.StructType.fromJson(s["tables"][table]["schema"])).parquet(f"{self.root}/{s['id']}/{table}")
                parts.append((prune(df) if prune else df).withColumn("_seg", F.lit(at)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def visible(self, rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
        """Rows (with _seg) that no newer segment hides."""
        if hidden is None:
            return rows
        return rows.join(hidden, self.key, "left").where("_at is null or _at <= _seg").drop("_at")

    def read(self, table: str, prune: Callable[[DataFrame], DataFrame] | None = None, live: list[dict] | None = None) -> DataFrame | None:
        """The live rows of a table; None if nothing was ever put."""
        live = self.segments() if live is None else live
        rows = self.raw(table, live, prune)
        return None if rows is None else self.visible(self.tables[table].decode(rows), self.hidden(live)).drop("_seg")

    def compact(self, whole: bool = True) -> None:
        """Rewrite all segments as one, or only the newer ones: from the first that is not RATIO times as large as all after it."""
        live = self.segments()
        first = 0
        if not whole:
            size = lambda s: s["keys"] + sum(t["facts"]["rows"] for t in s["tables"].values())
            while first < len(live) - 1 and size(live[first]) >= RATIO * sum(map(size, live[first + 1 :])):
                first += 1
        run = live[first:]
        if len(run) < 2:
            return
        rows = {t: df for t in self.tables if (df := self.read(t, live=run)) is not None}
        keys = reduce(DataFrame.unionAll, [self.spark.read.parquet(f"{self.root}/{s['id']}/keys") for s in run]) if first else None
        new, ids = self._written(rows, keys), [s["id"] for s in run]

        def change(now: list[dict]) -> list[dict]:
            places = [k for k, s in enumerate(now) if s["id"] in ids]
            if len(places) != len(ids) or places[-1] - places[0] != len(ids) - 1:
                raise RuntimeError("another writer has compacted these segments")
            return [*now[: places[0]], new, *now[places[-1] + 1 :]]

        self._commit(change)
