"""Telemetry rollups, time buckets, exact percentiles, cache advice, budgets and retention over event rows.

Aggregations are partial before they shuffle. Exact percentiles take the row at an index of the sorted group; that is a
window over the group and not a collected array, so a group may be larger than a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Gaps before the last so many weigh nothing in a double.
LAST = 128


def rate(hit: Column) -> Column:
    return F.avg(hit.cast("double"))


def bucket(ts: Column, minutes: int) -> Column:
    """The start of the bucket within the hour."""
    return F.date_trunc("hour", ts) + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.minute(ts) / minutes) * minutes).cast("int"))


def at_percent(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], last: bool = False) -> DataFrame:
    """For each group the value at index int(n * share) of its sorted values; last: an index past the end is the last one."""
    w = Window.partitionBy(*by)
    placed = rows.select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    place = lambda s: F.least(F.floor(F.col("n") * s), F.col("n") - 1) if last else F.floor(F.col("n") * s)
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("at") == place(s), F.col(value))).alias(name) for name, s in shares.items()])


def rollup(rows: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    return rows.groupBy(*by).agg(*[c.alias(name) for name, c in aggregates.items()])


def since(rows: DataFrame, ts: str, as_of, hours: float) -> DataFrame:
    """Rows of the last hours before as_of; the clock is a parameter."""
    return rows.where((F.col(ts) > F.lit(as_of) - F.expr(f"make_interval(0,0,0,0,0,0,{hours * 3600})")) & (F.col(ts) <= F.lit(as_of)))


def ema_gaps(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Accesses and the running mean 0.7 * old + 0.3 * gap of the seconds between them, in time order; score min(100, n / (ema / 3600 + 1))."""
    w = Window.partitionBy(*by).orderBy(ts, "event_id")
    gaps = rows.select(*by, ts, "event_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) / 1e6).alias("gap"))
    late = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc("event_id"))
    last = gaps.where("gap is not null").withColumn("j", F.row_number().over(late)).where(F.col("j") <= LAST)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("j") == F.col("n") - 1, F.pow(F.lit(0.7), F.col("j") - 1)).otherwise(0.3 * F.pow(F.lit(0.7), F.col("j") - 1))
    means = last.join(sizes, by).groupBy(*by).agg(F.sum(F.col("gap") * weight).alias("ema"))
    out = sizes.join(means, by, "left").select(*by, "n", F.coalesce("ema", F.lit(0.0)).alias("ema"))
    return out.withColumn("score", F.least(F.lit(100.0), F.col("n") / (F.col("ema") / 3600 + 1)))


def eviction_policy(accesses: DataFrame, by: list[str], count: str) -> DataFrame:
    """LRU, HYBRID or LFU by the variation of the access counts; LRU under ten items."""
    cv = F.try_divide(F.stddev_pop(count), F.avg(count))
    policy = F.when(F.count(F.lit(1)) < 10, "lru").when(cv > 0.8, "lfu").when(cv > 0.5, "hybrid").otherwise("lru")
    return accesses.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.coalesce(cv, F.lit(0.0)).alias("cv"), policy.alias("policy"))


def ttl(hit_rate: Column, now: Column, low: int, high: int) -> Column:
    """A recent hit rate of 0.8, 0.6, 0.4 or less makes the lifetime 1.5, 1, 0.75 or 0.5 times as long, within bounds."""
    factor = F.when(hit_rate >= 0.8, 1.5).when(hit_rate >= 0.6, 1.0).when(hit_rate >= 0.4, 0.75).otherwise(0.5)
    return F.greatest(F.lit(low), F.least(F.lit(high), (now * factor).cast("int")))


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


#: Costs of up to twelve decimals add up exactly.
EXACT = "decimal(28,12)"


def budget(rows: DataFrame, by: list[str], order: list[str], cost: str, total: float, per_call: float, warn: float) -> DataFrame:
    """Running cost of each call and whether it may go: within per_call and total; warned from that share of the total.

    Costs add up as the decimals they are written as, so that a sum of exactly a limit is on its right side; a group's sums from a
    cost on that no decimal of EXACT holds are those of doubles.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    exact = F.col(cost).try_cast(EXACT)
    held = F.col(cost).isNull() | F.coalesce(exact.cast("double") == F.col(cost).cast("double"), F.lit(False))
    spent = F.when(F.min(held).over(w), F.sum(exact).over(w).cast("double")).otherwise(F.sum(cost).over(w))
    rows = rows.withColumn("spent", spent)
    return rows.withColumn("allowed", (F.col(cost) <= per_call) & (F.col("spent") <= total)).withColumn("warned", F.col("spent") >= warn * total)


def token_bucket(rows: DataFrame, by: list[str], ts: str, rate_per_s: float, capacity: float, cost: float = 1.0) -> DataFrame:
    """(by..., requests, passed): each group's requests in time order against a bucket that fills at rate_per_s.

    Rows come sorted and are gone through once, a state at a time: no group is held as a whole.
    """
    kinds = [f"{c} {dict(rows.dtypes)[c]}" for c in by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, [0, 0, 0.0, 0.0]  # requests, passed, tokens, time
        done: list[tuple] = []
        for frame in frames:
            for *this, t in frame.itertuples(index=False):
                if this != key:
                    if key is not None:
                        done.append((*key, *state[:2]))
                    key, state = this, [0, 0, float(capacity), t]
                state[2] = min(float(capacity), state[2] + (t - state[3]) * rate_per_s)
                state[3] = t
                state[0] += 1
                if state[2] >= cost:
                    state[1], state[2] = state[1] + 1, state[2] - cost
            yield pd.DataFrame(done, columns=[*by, "requests", "passed"])
            done = []
        if key is not None:
            yield pd.DataFrame([(*key, *state[:2])], columns=[*by, "requests", "passed"])

    timed = rows.select(*by, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return timed.repartition(*by).sortWithinPartitions(*by, "t").mapInPandas(run, ", ".join([*kinds, "requests long", "passed long"]))


# Errors that pass by themselves.
TRANSIENT = r"(?i)timeout|timed out|temporar|unavailable|connection|rate limit|429|502|503|504"


def is_transient(error: Column) -> Column:
    return error.rlike(TRANSIENT)
