"""Queries of telemetry, caches, conversations and ratings."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import telemetry as T
from .registry import query, table

AS_OF = datetime.datetime(2024, 1, 20)
HIT = "(event_id % 3 <> 0)"


def events(spark, sf):
    return table(spark, sf, "events")


@query("events_rollup", f"""SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(avg({HIT}::INT), 6) AS hit_rate, count(*) FILTER (value > 400) AS slow, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def events_rollup(spark, sf):
    """G10, G11, G15"""
    return T.rollup(events(spark, sf), ["event_type"], n=F.count(F.lit(1)), avg_value=F.round(F.avg("value"), 6), hit_rate=F.round(T.rate(F.expr(HIT)), 6),
                    slow=F.count_if(F.col("value") > 400), total=F.round(F.sum("value"), 4))


@query("benchmark_rollup", f"""SELECT user_id % 4 AS model, count(*) AS n, round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_time, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(sum(value) * 0.002, 6) AS cost,
  CASE WHEN avg((event_type = 'error')::INT) > 0.1 THEN 'unhealthy' WHEN avg((event_type = 'error')::INT) > 0.05 THEN 'degraded' ELSE 'healthy' END AS health FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 168 HOURS AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def benchmark_rollup(spark, sf):
    """G11, G15, G16, with the clock a parameter"""
    rows = T.since(events(spark, sf), "ts", AS_OF, 168)
    error = T.rate(F.col("event_type") == "error")
    return T.rollup(rows.withColumn("model", F.col("user_id") % 4), ["model"], n=F.count(F.lit(1)), avg_time=F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 6),
                    success_rate=F.round(T.rate(F.col("event_type") != "error"), 6), cost=F.round(F.sum("value") * 0.002, 6),
                    health=F.when(error > 0.1, "unhealthy").when(error > 0.05, "degraded").otherwise("healthy"))


@query("events_time_bucket", "SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS bucket, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def time_bucket(spark, sf):
    """G13"""
    return T.rollup(events(spark, sf).withColumn("bucket", T.bucket(F.col("ts"), 15).cast("timestamp_ntz")), ["bucket"], n=F.count(F.lit(1)), avg_value=F.round(F.avg("value"), 6))


@query("window_metrics_p99", """WITH r AS (SELECT event_type, date_trunc('day', ts) AS day, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY event_type, date_trunc('day', ts)) AS n FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('day', ts) ORDER BY value))
  SELECT event_type, day, max(value) FILTER (pos = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (pos = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (pos = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY 1, 2""")
def p99(spark, sf):
    """Exact percentiles by index, a day at a time"""
    rows = events(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return T.at_percent(rows, ["event_type", "day"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, last=True)


@query("sliding_window_metrics", """WITH h AS (SELECT unnest([0, 1, 2]) AS k), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, value, event_type FROM events, h)
  SELECT start, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (event_type = 'error') AS errors FROM w GROUP BY 1""")
def sliding(spark, sf):
    """Windows of three hours that start every hour"""
    w = events(spark, sf).groupBy(F.window(F.col("ts").cast("timestamp"), "3 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total", "errors")


@query("request_window_stats", """SELECT user_id, count(*) AS requests, round(avg((event_type = 'error')::INT), 6) AS error_rate, count(*) FILTER ((props->>'k')::INT = 42) AS limited, count(*) FILTER ((props->>'k')::INT >= 95) AS server_errors FROM events GROUP BY 1""")
def request_window(spark, sf):
    """JSON fields"""
    rows = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return T.rollup(rows, ["user_id"], requests=F.count(F.lit(1)), error_rate=F.round(T.rate(F.col("event_type") == "error"), 6), limited=F.count_if(F.col("k") == 42), server_errors=F.count_if(F.col("k") >= 95))


@query("cache_window_stats", f"""SELECT event_type AS cache_type, round(avg({HIT}::INT), 6) AS hit_rate, round(avg(value) FILTER ({HIT}), 6) AS hit_ms, round(avg(value) FILTER (NOT {HIT}), 6) AS miss_ms, round(sum(value * 10), 4) AS bytes, max(value) AS most FROM events GROUP BY 1""")
def cache_window(spark, sf):
    """G18, G36, M04"""
    hit = F.expr(HIT)
    return T.rollup(events(spark, sf).withColumnRenamed("event_type", "cache_type"), ["cache_type"], hit_rate=F.round(T.rate(hit), 6), hit_ms=F.round(F.avg(F.when(hit, F.col("value"))), 6),
                    miss_ms=F.round(F.avg(F.when(~hit, F.col("value"))), 6), bytes=F.round(F.sum(F.col("value") * 10), 4), most=F.max("value"))


@query("access_ema_prefetch", """WITH RECURSIVE g AS (SELECT user_id, row_number() OVER w AS i, (epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT user_id, i, NULL::DOUBLE AS ema FROM g WHERE i = 1 UNION ALL SELECT g.user_id, g.i, CASE WHEN r.ema IS NULL THEN gap ELSE 0.7 * r.ema + 0.3 * gap END FROM r JOIN g ON g.user_id = r.user_id AND g.i = r.i + 1),
  f AS (SELECT user_id, max(i) AS n, max_by(coalesce(ema, 0), i) AS ema FROM r GROUP BY 1) SELECT user_id, n, round(ema, 2) AS ema, round(least(100, n / (ema / 3600 + 1)), 4) AS score FROM f WHERE least(100, n / (ema / 3600 + 1)) > 1 ORDER BY score DESC, user_id LIMIT 20""")
def access_ema(spark, sf):
    """W18, W07"""
    found = T.ema_gaps(events(spark, sf), ["user_id"], "ts").where("score > 1")
    return found.select("user_id", "n", F.round("ema", 2).alias("ema"), F.round("score", 4).alias("score")).orderBy(F.desc("score"), "user_id").limit(20)


@query("eviction_policy", """WITH a AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS items, round(coalesce(stddev_pop(n) / nullif(avg(n), 0), 0), 6) AS cv,
  CASE WHEN count(*) < 10 THEN 'lru' WHEN stddev_pop(n) / nullif(avg(n), 0) > 0.8 THEN 'lfu' WHEN stddev_pop(n) / nullif(avg(n), 0) > 0.5 THEN 'hybrid' ELSE 'lru' END AS policy FROM a GROUP BY 1""")
def eviction_policy(spark, sf):
    """G19"""
    accesses = events(spark, sf).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return T.eviction_policy(accesses, ["event_type"], "n").withColumn("cv", F.round("cv", 6))


@query("ttl_recommendation", f"""WITH h AS (SELECT user_id, avg({HIT}::INT) AS r FROM events GROUP BY 1) SELECT user_id, greatest(600, least(5000, trunc(3600 * CASE WHEN r >= 0.8 THEN 1.5 WHEN r >= 0.6 THEN 1.0 WHEN r >= 0.4 THEN 0.75 ELSE 0.5 END)::INT)) AS ttl FROM h""")
def ttl_recommendation(spark, sf):
    """G20"""
    rates = events(spark, sf).groupBy("user_id").agg(T.rate(F.expr(HIT)).alias("r"))
    return rates.select("user_id", T.ttl(F.col("r"), F.lit(3600), 600, 5000).alias("ttl"))


@query("lru_keep", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 25")
def lru_keep(spark, sf):
    """W08, M05"""
    return T.keep_newest(events(spark, sf), ["event_type"], [F.desc("ts"), F.asc("event_id")], 25).select("event_type", "event_id")


@query("token_budget_running", """WITH s AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)
  SELECT user_id, event_id, round(spent, 4) AS spent, value <= 450 AND spent <= 5000 AS allowed, spent >= 4000 AS warned FROM s""")
def token_budget(spark, sf):
    """M09"""
    found = T.budget(events(spark, sf), ["user_id"], ["ts", "event_id"], "value", 5000, 450, 0.8)
    return found.select("user_id", "event_id", F.round("spent", 4).alias("spent"), "allowed", "warned")


@query("token_bucket_replay", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
  r AS (SELECT user_id, i, t, 2.0::DOUBLE AS tokens, 1 AS passed FROM e WHERE i = 1 UNION ALL SELECT user_id, i, t, have - (have >= 1)::INT, passed + (have >= 1)::INT FROM
    (SELECT e.user_id, e.i, e.t, passed, least(3.0::DOUBLE, tokens + (e.t - r.t) * (1 / 7200.0::DOUBLE)) AS have FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
  SELECT user_id, max(i)::BIGINT AS requests, max(passed)::BIGINT AS passed FROM r GROUP BY 1""")
def token_bucket(spark, sf):
    """Replay of each user's requests"""
    return T.token_bucket(events(spark, sf), ["user_id"], "ts", 1 / 7200, 3.0)


@query("retention", "SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS")
def retention(spark, sf):
    """M11, F19"""
    return events(spark, sf).where(F.col("ts") >= F.lit(AS_OF - datetime.timedelta(days=10))).agg(F.count(F.lit(1)).alias("kept"))


@query("retry_counts", "SELECT coalesce(event_type, 'all') AS operation, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND value > 300 GROUP BY ROLLUP (event_type)")
def retry_counts(spark, sf):
    """By operation and overall, in one pass"""
    rows = events(spark, sf).where(F.col("ts").between(F.lit(datetime.datetime(2024, 1, 5)), F.lit(AS_OF)) & (F.col("value") > 300))
    return rows.rollup("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("operation"), "n")


@query("phase_times", """WITH p AS (SELECT user_id, 'parse' AS phase, sum(value * 0.2) AS s FROM events GROUP BY 1 UNION ALL SELECT user_id, 'embed', sum(value * 0.5) FROM events GROUP BY 1 UNION ALL SELECT user_id, 'store', sum(value * 0.3) FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT phase, round(sum(s), 3) AS total, round(avg(s), 3) AS average, max_by(user_id, round(s, 6) - user_id / 1e9) AS slowest FROM p GROUP BY 1""")
def phase_times(spark, sf):
    """G33, G39"""
    e = events(spark, sf).groupBy("user_id").agg(F.sum(F.col("value") * 0.2).alias("parse"), F.sum(F.col("value") * 0.5).alias("embed"), F.sum(F.when(F.col("event_type") != "view", F.col("value") * 0.3)).alias("store"))
    long = e.unpivot("user_id", ["parse", "embed", "store"], "phase", "s").where("s is not null")
    return long.groupBy("phase").agg(F.round(F.sum("s"), 3).alias("total"), F.round(F.avg("s"), 3).alias("average"), F.max_by("user_id", F.round("s", 6) - F.col("user_id") / 1e9).alias("slowest"))


@query("resource_summary", """SELECT event_type AS activity, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, round(sum(value) / count(*), 6) AS per_op, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1""")
def resource_summary(spark, sf):
    """G34, M10"""
    return T.rollup(events(spark, sf).withColumnRenamed("event_type", "activity"), ["activity"], n=F.count(F.lit(1)), mean=F.round(F.avg("value"), 6), most=F.max("value"),
                    per_op=F.round(F.try_divide(F.sum("value"), F.count(F.lit(1))), 6), p90=F.round(F.percentile("value", 0.9), 6))


@query("slowest_queries", "SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 72 HOURS AND ts <= TIMESTAMP '2024-01-20' ORDER BY value DESC, event_id LIMIT 10")
def slowest(spark, sf):
    """W04"""
    return T.since(events(spark, sf), "ts", AS_OF, 72).orderBy(F.desc("value"), "event_id").select("event_id", "value").limit(10)


@query("recent_queries", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent(spark, sf):
    """W05"""
    return events(spark, sf).orderBy(F.desc("ts"), "event_id").select("event_id", "ts").limit(10)


@query("rating_distribution", "SELECT quality * 4 + toxic + 1 AS rating, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM labels GROUP BY 1")
def ratings(spark, sf):
    """G12"""
    labels = table(spark, sf, "labels")
    n = labels.agg(F.count(F.lit(1)).alias("all"))
    return labels.groupBy((F.col("quality") * 4 + F.col("toxic") + 1).alias("rating")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("rating", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("relevancy_range", "SELECT doc_id, quality * 4 + toxic + 1 AS rating FROM labels WHERE quality * 4 + toxic + 1 BETWEEN 2 AND 5 ORDER BY doc_id DESC LIMIT 15")
def relevancy_range(spark, sf):
    """F18"""
    rated = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 4 + F.col("toxic") + 1).alias("rating"))
    return rated.where(F.col("rating").between(2, 5)).orderBy(F.desc("doc_id")).limit(15)


@query("conversation_summary", """SELECT conv_id, max(turn) AS turn_count, count(*) AS turns, sum(length(text) // 4)::BIGINT AS tokens, count(*) FILTER (role = 'user') AS questions FROM conversations GROUP BY 1""")
def conversation_summary(spark, sf):
    """M07"""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn_count"), F.count(F.lit(1)).alias("turns"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"), F.count_if(F.col("role") == "user").alias("questions"))


@query("conversation_running", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations")
def conversation_running(spark, sf):
    """Running counts"""
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("so_far"))


@query("conversation_neighbours", """WITH w AS (SELECT conv_id, turn, lag(turn) OVER o AS p, lead(turn) OVER o AS n FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT * FROM w WHERE turn % 3 = 1)
  SELECT conv_id, turn AS main, 0::BIGINT AS place, p AS turn FROM m WHERE p IS NOT NULL UNION ALL SELECT conv_id, turn, 1, turn FROM m UNION ALL SELECT conv_id, turn, 2, n FROM m WHERE n IS NOT NULL""")
def conversation_neighbours(spark, sf):
    """The one before, the hit, the one after"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("p"), F.lead("turn").over(w).alias("n")).where("turn % 3 = 1")
    out = rows.select("conv_id", F.col("turn").alias("main"), F.posexplode(F.array("p", "turn", "n")).alias("place", "turn")).where("turn is not null")
    return out.withColumn("place", F.col("place").cast("long"))


@query("conversation_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'license') OR lower(text) LIKE '%la de%' ORDER BY conv_id, turn LIMIT 20")
def conversation_search(spark, sf):
    """F16, F17, W05"""
    low = F.lower("text")
    return table(spark, sf, "conversations").where(low.contains("license") | low.like("%la de%")).select("conv_id", "turn").orderBy("conv_id", "turn").limit(20)


@query("category_enrichment", """SELECT coalesce(d.source, 'Unknown') AS category, count(*) AS n FROM events e LEFT JOIN documents d ON e.event_id % 2000 = d.doc_id GROUP BY 1""")
def category_enrichment(spark, sf):
    """J20"""
    e = events(spark, sf).select((F.col("event_id") % 2000).alias("doc_id"))
    return e.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "left").groupBy(F.coalesce("source", F.lit("Unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("hot_entities", "SELECT user_id, count(*) AS accesses FROM events GROUP BY 1 ORDER BY accesses DESC, user_id LIMIT 10")
def hot_entities(spark, sf):
    """W20"""
    return events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses")).orderBy(F.desc("accesses"), "user_id").limit(10)


@query("date_confidence_filter", """SELECT event_id FROM events WHERE (try_cast(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE ts::VARCHAR END AS TIMESTAMP) IS NULL OR ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06') AND value / 250.0 <= 2 * (1 - 60 / 100.0)""")
def date_confidence(spark, sf):
    """rows without a readable date stay"""
    when = F.try_to_timestamp(F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("ts").cast("string")))
    inside = F.col("ts").between(F.lit(datetime.datetime(2024, 1, 3)), F.lit(datetime.datetime(2024, 1, 6)))
    return events(spark, sf).where((when.isNull() | inside) & (F.col("value") / 250 <= 2 * (1 - 60 / 100))).select("event_id")


@query("transient_errors", "SELECT doc_id, regexp_matches(text, '(?i)timeout|timed out|temporar|unavailable|connection|rate limit|429|502|503|504') AS transient FROM documents")
def transient_errors(spark, sf):
    """Classification of error texts"""
    return table(spark, sf, "documents").select("doc_id", T.is_transient(F.col("text")).alias("transient"))


@query("cache_stream", """WITH a AS (SELECT event_type AS cache, ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) < INTERVAL 6 HOURS AS again FROM events)
  SELECT cache, count(*) AS accesses, round(avg(coalesce(again, false)::INT), 6) AS hit_rate, 0::BIGINT AS evictions, CASE WHEN avg(coalesce(again, false)::INT) >= 0.8 THEN 'keep' ELSE 'live longer' END AS advice FROM a GROUP BY 1""", writes=True)
def cache_stream(spark, sf):
    """A cache of the users of each event type, of six hours and room for all, over the stream of events; tests hold caches that are full, late rows and timers"""
    from ..session import new_folder
    from ..streaming import caches as C
    from ..streaming import windows as W

    at = new_folder(spark, "caches")
    table(spark, sf, "events").write.parquet(f"{at}/events")  # a stream reads folders
    accesses = W.read_events(spark, f"{at}/events", 1000).select(F.col("event_type").alias("cache"), F.col("user_id").cast("string").alias("key"), "ts")
    hits = C.cached(accesses, 1 << 20, 6 * 3600, shards=4, late="60 days")
    hits.writeStream.format("parquet").option("checkpointLocation", f"{at}/marks").trigger(availableNow=True).start(f"{at}/hits").awaitTermination()
    return C.recommendation(spark.read.schema(C.ACCESSES).parquet(f"{at}/hits")).withColumn("hit_rate", F.round("hit_rate", 6))
