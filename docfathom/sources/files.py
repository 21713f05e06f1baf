"""Files in and out: documents, code trees, vocabularies, audit logs, graph tables and their publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = "*.{py,java,groovy,js,ts,cs,go,sql,xml,gradle,properties,yml,yaml,md,html}"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole files."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def tree(spark: SparkSession, path: str, names: str = CODE, before: str | None = None, after: str | None = None) -> DataFrame:
    """(path, modified, size, code) of a source tree; binary files are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names)
    for key, value in (("modifiedBefore", before), ("modifiedAfter", after)):
        if value:
            read = read.option(key, value)
    rows = read.load(path).where(~F.contains(F.substring(F.col("content"), 1, 1024), F.lit(b"\x00")))
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), decoded(F.col("content")).alias("code"))


def decoded(content):
    """UTF-8 where the bytes are such, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def vocabulary_csv(spark: SparkSession, path: str, term: str = "term", acronym: str = "acronym", category: str = "category", weight: str = "weight") -> DataFrame:
    """(term, acronym, category, weight), columns by name; weight 1 where there is none."""
    rows = spark.read.option("header", True).csv(path)
    column = lambda name: F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
    return rows.select(F.trim(column(term)).alias("term"), column(acronym).alias("acronym"), column(category).alias("category"), F.coalesce(F.try_to_number(column(weight), F.lit("999D999")).cast("double"), F.lit(1.0)).alias("weight")).where("term <> ''")


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "terms array<struct<term:string,acronym:string,category:string,weight:double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("terms").alias("t"))
    return rows.select("t.term", "t.acronym", "t.category", F.coalesce("t.weight", F.lit(1.0)).alias("weight"))


def audit_log(spark: SparkSession, path: str, schema: str = "timestamp string, event string, operation string, attempt int, error_type string") -> DataFrame:
    """JSON lines; broken ones are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[len(POINTER) :]) for n in names if n.startswith(POINTER) and n[len(POINTER) :].isdecimal())


#: Small files, numbered, each naming a version; the highest number counts.
POINTER = "CURRENT-"


def publish(tables: dict[str, DataFrame], root: str, rows_per_file: int = 0, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write the tables to a folder of their own and then name it in a small file of the next number, which appears whole: readers see all
    or nothing new, whenever they look. The last pointer but one stays for readers that have just listed it."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write.option("maxRecordsPerFile", rows_per_file)
        columns = (partition_by or {}).get(name)
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{root}/{version}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path(f"{root}/.{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    known = _pointers(spark, root)
    if not fs.rename(path(f"{root}/.{version}"), path(f"{root}/{POINTER}{(known or [0])[-1] + 1:012}")):
        raise OSError("another writer published")
    for old in known[:-1]:
        fs.delete(path(f"{root}/{POINTER}{old:012}"), False)
    return version


def current(spark: SparkSession, root: str) -> str | None:
    """The version that is published, if any."""
    known = _pointers(spark, root)
    return spark.read.text(f"{root}/{POINTER}{known[-1]:012}").first()[0] if known else None


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{version}/{name}")


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has done."""
    return rows.join(done.select(key), key, "left_anti")


def conversation_markdown(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown) of rows (conv_id, turn, role, text)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("**"), F.initcap(t["role"]), F.lit(":** "), t["text"]))
    return turns.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("markdown"))
