"""Streams of events: sliding metrics with late data, rate control per key, running conversation counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream; ts is taken as UTC."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_metrics(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts, errors and mean value of each window and type; events later than `late` are dropped and state is freed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "errors", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


# Targets of the rate control and its steps.
TARGET_P95, TARGET_ERRORS, UP, DOWN, BACKOFF = 0.5, 0.01, 1.1, 0.8, 0.5


def next_rate(rate: float, p95: float, errors: float, limited: bool, low: float, high: float) -> float:
    """Half after a refusal, less under strain, a little more when both targets are met."""
    factor = BACKOFF if limited else DOWN if p95 > TARGET_P95 or errors > TARGET_ERRORS else UP
    return min(high, max(low, rate * factor))


def adaptive_rate(requests: DataFrame, low: float = 0.1, high: float = 100.0, window: int = 100) -> DataFrame:
    """(key, rate, n) after each batch of requests (key, latency, status): state is the rate and the last `window` requests."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, n, kept = state.get if state.exists else (1.0, 0, [])
        kept = list(kept)
        for frame in frames:
            kept = (kept + [f"{a}:{b}" for a, b in zip(frame.latency, frame.status, strict=True)])[-window:]
            n += len(frame)
        pairs = [(float(x.split(":")[0]), int(x.split(":")[1])) for x in kept]
        ordered = sorted(a for a, _ in pairs)
        p95 = ordered[min(int(len(ordered) * 0.95), len(ordered) - 1)]
        rate = next_rate(rate, p95, sum(s >= 500 for _, s in pairs) / len(pairs), any(s == 429 for _, s in pairs), low, high)
        state.update((rate, n, kept))
        yield pd.DataFrame({"key": [key[0]], "rate": [rate], "n": [n]})

    grouped = requests.groupBy("key")
    return grouped.applyInPandasWithState(step, "key string, rate double, n long", "rate double, n long, kept array<string>", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything there is, into a table in memory: for tests and replays."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return df.sparkSession.table(name)
