"""A local session for tests, benchmarks and trials; on a cluster the caller brings its own."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import SparkSession


def session(name: str = "docfathom", cores: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in more.items()}
    os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_checkpoints(spark) -> None:
    """Set a checkpoint folder on a local master where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docfathom-"))


def new_folder(spark, name: str) -> str:
    """A folder that isn't there yet in the shared checkpoint folder."""
    with_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df):
    """df as a table in the shared checkpoint folder. Unlike checkpoint() it computes df once, and keeps nothing of the plan that made it: the
    constraints that a checkpoint carries along double with each round of an iterative operator."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark) -> None:
    """Let go of shuffle files that no plan reads any more; Spark removes them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
