"""Caches over a stream of accesses, with state and timers: which accesses hit, what is evicted, what a cache should be told.

A cache of a capacity is kept in shards by the hash of the key, each with its part of the capacity, so a busy cache is no one task's; the state of a
shard holds at most that many keys. Keys live for a time after their last access, by the time of the events: a timer at the first
expiry removes what nobody asks for any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ACCESSES = "cache string, shard int, key string, ts timestamp, hit boolean, evicted string"


def _ms(ts: datetime) -> int:
    return int(ts.timestamp() * 1000)


class _Shard(StatefulProcessor):
    """Least recently used keys of a shard go when it is full; keys whose time is over go by a timer."""

    def __init__(self, capacity: int, ttl_ms: int | None):
        self.capacity, self.ttl = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "key string", "at long, seq long")
        self.seq = handle.getValueState("seq", "n long")

    def _expired(self, at: int, now: int) -> bool:
        return self.ttl is not None and at + self.ttl <= now

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq = (self.seq.get() or (0,))[0]
        held = {k[0]: (v[0], v[1]) for k, v in self.last.iterator()}
        before, touched = set(held), set()
        for r in sorted(rows, key=lambda r: (r.ts, r.key)):
            now, seq = _ms(r.ts), seq + 1
            hit = r.key in held and not self._expired(held[r.key][0], now)
            evicted = None
            if r.key not in held and len(held) >= self.capacity:
                evicted = min(held, key=lambda k: (*held[k], k))
                del held[evicted]
            held[r.key] = (max(now, held.get(r.key, (0, 0))[0]), seq)
            touched.add(r.key)
            yield Row(cache=key[0], shard=key[1], key=r.key, ts=r.ts, hit=hit, evicted=evicted)
        for k in before - set(held):
            self.last.removeKey((k,))
        for k in touched & set(held):
            self.last.updateValue((k,), held[k])
        self.seq.update((seq,))
        if self.ttl is not None and held:
            self._timer(min(at for at, _ in held.values()) + self.ttl)

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for k, v in list(self.last.iterator()):
            if self._expired(v[0], now):
                self.last.removeKey(k)
            else:
                left.append(v[0])
        if left:
            self.handle.registerTimer(min(left) + self.ttl)
        return iter(())

    def close(self) -> None:
        pass


def cached(accesses: DataFrame, capacity: int, ttl_seconds: int | None = None, shards: int = 16, late: str = "10 minutes") -> DataFrame:
    """(cache, shard, key, ts, hit, evicted) of a stream of accesses (cache, key, ts): whether the key was there and in time, and which key went for it.

    Accesses later than `late` are dropped; those of a batch are taken in order of time. Rows without a cache, key or time are left out.
    """
    spark = accesses.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = accesses.where("cache is not null and key is not null and ts is not null").select("cache", "key", "ts").withWatermark("ts", late)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    processor = _Shard(max(1, capacity // shards), ttl_seconds * 1000 if ttl_seconds is not None else None)
    return rows.groupBy("cache", "shard").transformWithState(processor, ACCESSES, "append", "eventTime")


def recommendation(hits: DataFrame) -> DataFrame:
    """(cache, accesses, hit_rate, evictions, advice) of what cached() gives: a larger cache where keys are evicted under a target rate of 0.8, a longer time to live where none is."""
    rows = hits.groupBy("cache").agg(F.count(F.lit(1)).alias("accesses"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("evicted").alias("evictions"))
    advice = F.when(F.col("hit_rate") >= 0.8, "keep").when(F.col("evictions") > 0, "enlarge").otherwise("live longer")
    return rows.withColumn("advice", advice)
