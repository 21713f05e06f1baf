"""Caches as streams against plain replays, over batches, late and expired rows."""

from collections import OrderedDict
from datetime import datetime, timedelta

import pytest

from docfathom.streaming import caches as C

AT = datetime(2024, 1, 1)


def replay(rows, capacity, ttl):
    held, out = OrderedDict(), []
    for k, s in rows:
        hit = k in held and (ttl is None or s - held[k] < ttl)
        evicted = None
        if k not in held and len(held) >= capacity:
            evicted, _ = held.popitem(last=False)
        held[k] = s
        held.move_to_end(k)
        out.append((k, s, hit, evicted))
    return out


def feed(spark, tmp_path, batches, name, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame([("c", k, AT + timedelta(seconds=s)) for k, s in rows], "cache string, key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema("cache string, key string, ts timestamp").parquet(f"{tmp_path}/{name}/in")
        query = C.cached(stream, shards=1, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/c").trigger(availableNow=True).start(f"{tmp_path}/{name}/out")
        query.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/{name}/out").orderBy("ts").collect()
    return [(r.key, int((r.ts - AT).total_seconds()), r.hit, r.evicted) for r in found]


@pytest.mark.parametrize("ttl", [None, 300])
def test_cache(spark, tmp_path, ttl):
    rows = [("abcab"[k % 5] if k % 7 else f"k{k}", 40 * k) for k in range(30)]
    got = feed(spark, tmp_path, [rows[:9], rows[9:20], rows[20:]], f"t{ttl}", capacity=3, ttl_seconds=ttl, late="1 hour")
    assert got == replay(rows, 3, ttl)


def test_late_and_expired(spark, tmp_path):
    got = feed(spark, tmp_path, [[("a", 0), ("b", 10)], [("x", 5000)], [("a", 20), ("y", 5100)], [("a", 5200)]], "late", capacity=9, ttl_seconds=600, late="1 minute")
    assert [(k, s, h) for k, s, h, _ in got] == [("a", 0, False), ("b", 10, False), ("x", 5000, False), ("y", 5100, False), ("a", 5200, False)]
    advice = C.recommendation(spark.createDataFrame([("c", True, None)] * 9 + [("d", False, "k"), ("e", False, None)], "cache string, hit boolean, evicted string")).collect()
    assert {r.cache: r.advice for r in advice} == {"c": "keep", "d": "enlarge", "e": "live longer"}
