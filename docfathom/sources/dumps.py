"""Dumps of providers and repositories as tables: folders of JSON pages, read by Python data sources in batch and as streams.

A dump is root/<provider>/<name>.json (or root/provider=<provider>/..., as Spark writes it): a page a line, {"items": [{...}, ...]}, as their interfaces answer and a crawler keeps
them; providers of papers and hosts of code alike. Each file is a partition. A filter on `provider` prunes folders before any file is opened; as a
stream, files are taken in order of name, and the name of the last one is the place that a restarted query resumes from.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition


def _where(root: str):
    """The file system of a folder and its path there; file:/x and file:///x are both local."""
    from pyarrow import fs

    if root.startswith("file:") or ":/" not in root:
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    return fs.FileSystem.from_uri(root)


def _files(root: str, providers: set[str] | None = None) -> list[tuple[str, str]]:
    """(provider, path) of the files of a dump, in order."""
    from pyarrow import fs

    where, base = _where(root)
    found = []
    for info in where.get_file_info(fs.FileSelector(base, recursive=True)):
        provider = info.path.rsplit("/", 2)[-2].removeprefix("provider=")
        if info.type == fs.FileType.File and info.path.endswith(".json") and (providers is None or provider in providers):
            found.append((provider, info.path))
    return sorted(found, key=lambda f: (f[1].rsplit("/", 1)[-1], f[0]))


def _items(root: str, provider: str, path: str, schema: T.StructType) -> Iterator[tuple]:
    """Items of a file's pages as rows; a line that is no page, and an item that is no object, are left out, and a value of another type is null."""
    where = _where(root)[0]
    kinds = {T.LongType: int, T.StringType: str, T.DoubleType: (int, float), T.BooleanType: bool}
    fields = [(f.name, kinds[type(f.dataType)], type(f.dataType) is T.DoubleType) for f in schema.fields if f.name != "provider"]
    with where.open_input_stream(path) as stream:
        rest = b""
        while True:
            block = stream.read(1 << 20)
            *lines, rest = (rest + block).split(b"\n") if block else (rest, b"")
            for line in lines:
                try:
                    page = json.loads(line)
                except ValueError:
                    continue
                for item in page.get("items") or [] if isinstance(page, dict) else []:
                    if isinstance(item, dict):
                        values = [v if isinstance(v := item.get(n), k) and (k is bool or not isinstance(v, bool)) else None for n, k, _ in fields]
                        yield (provider, *(float(v) if real and v is not None else v for v, (_, _, real) in zip(values, fields, strict=True)))
            if not block:
                return


class _File(InputPartition):
    def __init__(self, provider: str, path: str):
        super().__init__(path)
        self.provider, self.path = provider, path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, root: str):
        self.schema, self.root, self.providers = schema, root, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the provider; the others are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("provider",):
                self.providers = values if self.providers is None else self.providers & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(*f) for f in _files(self.root, self.providers)] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _items(self.root, partition.provider, partition.path, self.schema) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """An offset is the place of a file: its name, then its provider."""

    def __init__(self, schema: T.StructType, root: str):
        self.schema, self.root = schema, root

    @staticmethod
    def _place(provider: str, path: str) -> list[str]:
        return [path.rsplit("/", 1)[-1], provider]

    def initialOffset(self) -> dict:
        return {"last": ["", ""]}

    def latestOffset(self) -> dict:
        found = _files(self.root)
        return {"last": self._place(*found[-1]) if found else ["", ""]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(*f) for f in _files(self.root) if start["last"] < self._place(*f) <= end["last"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _items(self.root, partition.provider, partition.path, self.schema)


class JsonPages(DataSource):
    """spark.read.format("json_pages").schema("provider string, ...").load(root), and readStream alike; the first column is the folder that a file lies in."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        raise ValueError("give the schema of the items, with provider as its first column")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(_checked(schema), self.options["path"])

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(_checked(schema), self.options["path"])


def _checked(schema: T.StructType) -> T.StructType:
    if schema.names[:1] != ["provider"]:
        raise ValueError("the first column is provider")
    return schema


#: What providers of papers, and hosts of repositories, answer with.
PAPERS = "provider string, doi string, title string, year long, citations long, venue string"
CHANGES = "provider string, id long, repository string, title string, author string, state string, merged boolean"


def pages(spark: SparkSession, root: str, schema: str = PAPERS, stream: bool = False) -> DataFrame:
    """A dump as a table, or as a stream."""
    spark.dataSource.register(JsonPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.readStream if stream else spark.read).format("json_pages").schema(schema).load(root)
