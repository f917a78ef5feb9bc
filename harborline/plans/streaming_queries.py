"""Registered queries for rate limits, sessions, feeds and user transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators.transforms import apply_transform, jaro_similarity, json_fields
from harborline.plans.registry import query, table
from harborline.plans.registry_queries import _batch
from harborline.session import scratch_path
from harborline.streaming import limits
from harborline.streaming import state as X
from harborline.streaming import streams as L

_DAY = 86_400
_RATE = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT user_id, rn, event_id, t, [t] AS q, true AS accepted, 0::BIGINT AS retry FROM e WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, t, CASE WHEN len(f) < 2 THEN list_append(f, t) ELSE f END, len(f) < 2, CASE WHEN len(f) < 2 THEN 0::BIGINT ELSE greatest(1, (f[1] + {_DAY * 1000000} - t) // 1000000) END
    FROM (SELECT e.user_id, e.rn, e.event_id, e.t, list_filter(r.q, lambda x: x >= e.t - {_DAY * 1000000}) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
  SELECT user_id, event_id, accepted, retry AS retry_after_seconds FROM r"""
_RATE_ALL = """WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT rn, event_id, t, [t] AS q, true AS accepted, 0::BIGINT AS retry FROM e WHERE rn = 1
    UNION ALL SELECT rn, event_id, t, CASE WHEN len(f) < 5 THEN list_append(f, t) ELSE f END, len(f) < 5, CASE WHEN len(f) < 5 THEN 0::BIGINT ELSE greatest(1, (f[1] + 600000000 - t) // 1000000) END
    FROM (SELECT e.rn, e.event_id, e.t, list_filter(r.q, lambda x: x >= e.t - 600000000) AS f FROM r JOIN e ON e.rn = r.rn + 1))
  SELECT 'all' AS everyone, event_id, accepted, retry AS retry_after_seconds FROM r"""
_SESSION = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT user_id, rn, event_id, t, t AS s, NULL::BIGINT AS l FROM e WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, t, CASE WHEN l0 IS NOT NULL AND t >= l0 THEN t ELSE s0 END, CASE WHEN l0 IS NOT NULL AND t < l0 THEN l0 WHEN l0 IS NOT NULL THEN NULL WHEN t > s0 + 3600000000 THEN t + 86400000000 END
    FROM (SELECT e.user_id, e.rn, e.event_id, e.t, r.s AS s0, r.l AS l0 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
  SELECT user_id, event_id, CASE WHEN l IS NULL THEN 'active' ELSE 'locked' END AS state, s AS session_start, coalesce(l, s + 3600000000) AS until FROM r"""


@query("X1_rate_check", _RATE)
def x1(spark, d):
    return limits.rate_check(table(spark, d, "events"), "user_id", "ts", "event_id", 2, _DAY)


@query("X1_rate_check_in_blocks", _RATE)
def x1b(spark, d):
    """As if no user's events fitted one task: blocks hand their last accepted times on."""
    return limits.rate_check(table(spark, d, "events"), "user_id", "ts", "event_id", 2, _DAY, group_rows=25)


@query("X1_rate_check_one_key", _RATE_ALL)
def x1k(spark, d):
    """All events under one key: every task has blocks of it."""
    ev = table(spark, d, "events").withColumn("everyone", F.lit("all"))
    return limits.rate_check(ev, "everyone", "ts", "event_id", 5, 600, group_rows=500)


@query("X1_rate_stream", _RATE)
def x1s(spark, d):
    """The limiter on a stream of the event files."""
    table(spark, d, "events")
    return L.run_to_table(X.rate_stream(L.file_feed(spark, d, "events.parquet"), "user_id", "ts", "event_id", 2, _DAY), "rate")


@query("X2_sessions", _SESSION)
def x2(spark, d):
    return X.sessions(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("X2_sessions_in_blocks", _SESSION)
def x2b(spark, d):
    """As if no user's accesses fitted one task: sessions by linked starts, in blocks."""
    return X.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", group_rows=40)


@query("X2_session_stream", _SESSION)
def x2s(spark, d):
    table(spark, d, "events")
    return L.run_to_table(X.session_stream(L.file_feed(spark, d, "events.parquet"), "user_id", "ts", "event_id"), "sessions")


_GAPS = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
  s AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR us - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e)
  SELECT user_id, event_id, session, min(us) OVER (PARTITION BY user_id, session) AS session_start FROM s"""


@query("X2_gap_sessions", _GAPS)
def x2g(spark, d):
    return X.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("X2_gap_sessions_in_blocks", _GAPS)
def x2gb(spark, d):
    return X.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", group_rows=40)


@query("X3_hourly_epoch_counts", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS epoch, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def x3(spark, d):
    return X.hourly_epoch_counts(table(spark, d, "events"), "ts")


@query(
    "X3_hourly_window_stream",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, CAST(count(*) AS BIGINT) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events) GROUP BY 1""",
)
def x3s(spark, d):
    """Hours that the watermark has closed, each written once; late rows have been set aside before."""
    table(spark, d, "events")
    feed = L.file_feed(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    on_time, _ = L.split_late(feed, "ts", scratch_path(spark, "sorted-out"))
    path = scratch_path(spark, "on-time")
    on_time.write.parquet(path)
    hours = L.run_to_table(X.windowed_counts(spark.readStream.schema(on_time.schema).parquet(path), "ts"), "hours")
    return hours.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("X4_tail_events", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 250")
def x4(spark, d):
    table(spark, d, "events")
    feed = L.file_feed(spark, d, "events.parquet").select("event_id", "user_id", "event_type")
    return L.run_to_table(L.tail_events(feed, "event_id", 250), "tail")


@query(
    "X5_stream_upsert",
    """SELECT p_brand AS canonical_column, upper(p_type) AS alias, 'candidate' AS status, round(max(round(l_quantity / 55, 4)), 6) AS confidence, CAST(count(*) AS BIGINT) AS hit_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def x5(spark, d):
    """Alias sightings written as files, then merged into an empty registry micro-batch by micro-batch."""
    path = scratch_path(spark, "sightings")
    files = max(4, -(-table(spark, d, "lineitem").count() // 1_000_000))
    _batch(spark, d).repartition(files, "seq").write.parquet(f"{path}/in")
    feed = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{path}/in")
    _, rows = L.stream_upsert(feed, f"{path}/registry").latest()
    return rows.select("canonical_column", "alias", "status", F.round("confidence", 6).alias("confidence"), "hit_count")


@query(
    "X6_state_progress",
    "SELECT user_id, arg_max(event_type, event_id) AS state, arg_max(least(1.0, greatest(0.0, value / 50)), event_id) AS progress, max(event_id) AS seq FROM events GROUP BY user_id",
)
def x6(spark, d):
    ev = table(spark, d, "events").withColumn("progress", F.col("value") / 50)
    return X.state_progress(ev, "user_id", "event_id", "event_type", "progress")


@query(
    "X7_expire_keys",
    """WITH s AS (SELECT user_id, epoch_us(max(ts)) + 3600000000 AS expires, CASE WHEN count(*) FILTER (event_type = 'error') > 10 THEN epoch_us(max(ts)) + 90000000000 END AS locked FROM events GROUP BY 1), n AS (SELECT epoch_us(max(ts)) + 93600000000 - 7200000000 AS now FROM events)
       SELECT user_id, expires FROM s, n WHERE NOT (coalesce(now > locked, false) OR now > expires + 90000000000)""",
)
def x7(spark, d):
    ev = table(spark, d, "events")
    us = F.unix_micros(F.max("ts").cast("timestamp"))
    held = ev.groupBy("user_id").agg((us + 3_600_000_000).alias("expires"), F.when(F.count_if(F.col("event_type") == "error") > 10, us + 90_000_000_000).alias("locked"))
    now = ev.agg((us + 93_600_000_000 - 7_200_000_000).alias("now")).first()[0]
    return X.expire_keys(held, "expires", "locked", F.lit(now)).select("user_id", "expires")


@query("X_late_rows", "SELECT 'late' AS kind, CAST(count(*) FILTER (l_orderkey % 2 = 1) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'on_time', count(*) FILTER (l_orderkey % 2 = 0) FROM lineitem")
def x_late(spark, d):
    """Rows a year behind arrive after the newest ones: all are late and kept aside, across a restart."""
    path, log = scratch_path(spark, "late"), scratch_path(spark, "late-log")
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ts"))
    newest = li.agg(F.max("ts")).first()[0]
    ahead = li.filter("l_orderkey % 2 = 0").withColumn("ts", F.lit(newest).cast("timestamp_ntz"))
    behind = li.filter("l_orderkey % 2 = 1").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 YEAR"))
    on_time = late = None
    for part in (ahead, behind):
        part.write.mode("append").parquet(f"{path}/in")
        feed = spark.readStream.schema(li.schema).parquet(f"{path}/in")
        on_time, late = L.split_late(feed, "ts", path, checkpoint=log)
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(on_time, "on_time").unionByName(count(late, "late"))


@query("D2_user_transform", "SELECT o_orderkey, o_totalprice * 1.5::DOUBLE AS lifted FROM orders")
def d2(spark, d):
    """An author's own transform; one that returns nothing falls back to its input."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    lifted = apply_transform(o, lambda df, context: df.withColumn("lifted", F.col("o_totalprice") * context["lift"]), {"lift": 1.5})
    kept = apply_transform(lifted, lambda df: df.filter("o_orderkey < 0"))
    return kept.select("o_orderkey", "lifted")


@query("D1_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def d1(spark, d):
    """A table function in Python whose columns follow from its arguments."""
    table(spark, d, "events").createOrReplaceTempView("_d1_events")
    spark.udtf.register("json_fields", json_fields)
    return spark.sql("SELECT event_id, f.k, f.absent FROM _d1_events, LATERAL json_fields(props, 'k bigint, absent string') AS f")


@query("D4_batch_similarity", "SELECT p_partkey, round(jaro_similarity(lower(p_name), lower(p_type)), 6) AS similarity FROM part")
def d4(spark, d):
    """A measure that has no built-in form, worked out in Arrow batches."""
    return table(spark, d, "part").select("p_partkey", F.round(jaro_similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("similarity"))
