"""Registered queries for windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.operators import sampling as T
from harborline.operators import sets as U
from harborline.operators import windows as W
from harborline.plans.registry import query, table


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


_LAGS = """SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7, lag(value, 30) OVER w AS value_lag_30 FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
# So small that every user spans several blocks: the path of groups too large for one task.
_BLOCK_ROWS = 40


@query("W1_lag_features", _LAGS)
def w1(spark, d):
    return W.lag_features(_events(spark, d), "value", ["ts", "event_id"], ["user_id"]).drop("user_id", "ts", "value")


@query("W1_lag_features_in_blocks", _LAGS)
def w1b(spark, d):
    return W.lag_features(_events(spark, d), "value", ["ts", "event_id"], ["user_id"], group_rows=_BLOCK_ROWS).drop("user_id", "ts", "value")


_ROLLING = """SELECT event_id, CASE WHEN count(value) OVER w7 = 7 THEN round(avg(value) OVER w7, 6) END AS value_rolling_mean_7, CASE WHEN count(value) OVER w7 = 7 THEN round(stddev_samp(value) OVER w7, 6) END AS value_rolling_std_7,
         CASE WHEN count(value) OVER w30 = 30 THEN round(avg(value) OVER w30, 6) END AS value_rolling_mean_30, CASE WHEN count(value) OVER w30 = 30 THEN round(stddev_samp(value) OVER w30, 6) END AS value_rolling_std_30 FROM events
       WINDOW w7 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


@query("W2_rolling_features", _ROLLING)
def w2(spark, d):
    return _rolled(W.rolling_features(_events(spark, d), "value", ["ts", "event_id"], ["user_id"]))


@query("W2_rolling_features_in_blocks", _ROLLING)
def w2b(spark, d):
    return _rolled(W.rolling_features(_events(spark, d), "value", ["ts", "event_id"], ["user_id"], group_rows=_BLOCK_ROWS))


def _rolled(r):
    return r.select("event_id", *[F.round(c, 6).alias(c) for c in r.columns if "rolling" in c])


@query(
    "W3_adjacent_pairs",
    """SELECT conv_id, turn, text, reply FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) WHERE role = 'user' AND nr = 'assistant'""",
)
def w3(spark, d):
    return W.adjacent_pairs(table(spark, d, "conversations"), ["conv_id"], ["turn", "role"], "role", "text").select("conv_id", "turn", "text", "reply")


@query(
    "W5_chunk_means",
    """SELECT CAST(c - 1 AS INTEGER) AS chunk, round(avg(value), 6) AS y, CAST(count(*) AS BIGINT) AS n FROM (SELECT value, ntile(12) OVER (ORDER BY ts, event_id) AS c FROM events) GROUP BY c""",
)
def w5(spark, d):
    ev = _events(spark, d)
    return W.chunk_means(ev, "value", 12, ["ts", "event_id"]).withColumn("y", F.round("y", 6))


@query("W6_chunk_counts", "SELECT CAST(c - 1 AS INTEGER) AS chunk, CAST(count(*) AS BIGINT) AS n FROM (SELECT ntile(24) OVER (ORDER BY ts, event_id) AS c FROM events) GROUP BY c")
def w6(spark, d):
    return W.chunk_counts(_events(spark, d), ["ts", "event_id"], points=24)


_TURNS = """WITH m AS (SELECT date_trunc('month', o_orderdate) AS t, round(sum(o_totalprice), 2) / count(*) AS y FROM orders GROUP BY 1), s AS (SELECT t, y, y - lag(y) OVER (ORDER BY t) AS d FROM m),
       z AS (SELECT t, sign(round(d, 6)) AS g FROM s WHERE round(d, 6) <> 0), p AS (SELECT g, lag(g) OVER (ORDER BY t) AS pg FROM z)
       SELECT CAST((SELECT count(*) FILTER (g <> pg) FROM p) AS BIGINT) AS turning_points, CAST(count(*) AS BIGINT) AS n, coalesce(bool_and(d >= 0), true) OR coalesce(bool_and(d <= 0), true) AS monotone,
         count(DISTINCT round(d, 6)) / greatest(count(d), 1) AS unique_diff_ratio FROM s"""


@query("W8_turning_points", _TURNS)
def w8(spark, d):
    return _turns(spark, d)


@query("W8_turning_points_in_blocks", _TURNS)
def w8b(spark, d):
    return _turns(spark, d, group_rows=10)


def _turns(spark, d, **bound):
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("t")).agg((F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("y"))
    return W.turning_points(m, "y", ["t"], **bound).select("turning_points", "n", "monotone", "unique_diff_ratio")


@query(
    "W9_ema",
    """WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
       SELECT a.event_id, round(sum(CASE WHEN b.i = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3 END * pow(1 - 1.0::DOUBLE / 3, a.i - b.i) * b.value), 6) AS value_ema FROM e a JOIN e b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id""",
)
def w9(spark, d):
    return W.ema(_events(spark, d), "value", ["ts", "event_id"], ["user_id"], alpha=1 / 3).select("event_id", F.round("value_ema", 6).alias("value_ema"))


@query(
    "W11_best_by_priority",
    """WITH b AS (SELECT p_brand, p_name, max(p_size) AS score FROM part GROUP BY 1, 2)
       SELECT p_brand, p_name, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name) AS INTEGER) AS rank, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name) = 1 AS is_primary FROM b QUALIFY rank <= 3""",
)
def w11(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_name", F.col("p_size").alias("score"))
    return W.best_by_priority(p, ["p_brand"], "p_name", "score")


@query(
    "W12_changelog_tail",
    """SELECT event_id, user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)) WHERE r <= 20 AND seq > 500""",
)
def w12(spark, d):
    tail = W.changelog_tail(_events(spark, d), ["user_id"], ["ts", "event_id"], 20)
    return W.since(tail, 500).select("event_id", "user_id", "seq")


@query(
    "W13_conv_last_turn_split",
    """WITH e AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1), u AS (SELECT c.conv_id, c.turn AS t FROM conversations c JOIN e ON c.conv_id = e.conv_id AND c.turn = e.t AND c.role = 'assistant' WHERE trim(c.text) <> '')
       SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn = u.t THEN 'expected' ELSE 'prompt' END AS part FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn <= u.t""",
)
def w13(spark, d):
    return W.last_turn_split(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text").select("conv_id", "turn", "role", "part")


@query(
    "W13_prompt_text",
    """WITH e AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1), u AS (SELECT c.conv_id, c.turn AS t FROM conversations c JOIN e ON c.conv_id = e.conv_id AND c.turn = e.t AND c.role = 'assistant' WHERE trim(c.text) <> '')
       SELECT c.conv_id, 0 AS piece, string_agg(upper(role) || ': ' || trim(text, ' '), chr(10) ORDER BY turn) AS prompt FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn < u.t GROUP BY c.conv_id""",
)
def w13_prompt(spark, d):
    split = W.last_turn_split(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")
    return W.prompt_text(split, ["conv_id"], "turn", "role", "text")


# ---- sampling ----------------------------------------------------------------------------------


@query("T1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def t1(spark, d):
    return T.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 30)


@query(
    "T2_quota_select",
    "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE (c_nationkey = 1 AND r <= 4) OR (c_nationkey = 2 AND r <= 6) OR (c_nationkey = 7 AND r <= 2)",
)
def t2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return T.quota_select(c, "c_nationkey", {1: 4, 2: 6, 7: 2}, [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "c_nationkey")


@query(
    "T4_batch_sample",
    """WITH p AS (SELECT o_orderkey, o_totalprice, sha256('42:' || o_orderkey) AS tok, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 4000 AS b FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY tok, o_orderkey) AS k FROM p), n AS (SELECT greatest(1, 2001 // CAST(ceil(count(*) / 4000.0) AS BIGINT)) AS s FROM orders)
       SELECT o_orderkey, o_totalprice FROM r, n ORDER BY k > s, tok, o_orderkey LIMIT 2001""",
)
def t4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return T.batch_sample(o, ["o_orderkey"], ["o_orderdate", "o_orderkey"], 2001, 4000).drop("o_orderdate")


@query("T5_hash_sample", "SELECT doc_id, n_chars FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 300")
def t5(spark, d):
    return T.hash_sample(table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"], 300, 7)


@query(
    "T6_stratified_sample",
    """WITH n AS (SELECT quality AS q, greatest(1, CAST(round_even(count(*) * (100.0::DOUBLE / (SELECT count(*) FROM labels)), 0) AS BIGINT)) AS quota FROM labels GROUP BY 1),
       r AS (SELECT l.*, sha256('42:' || doc_id) AS tok, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM labels l)
       SELECT doc_id, quality, toxic FROM r JOIN n ON r.quality = n.q WHERE k <= quota ORDER BY tok LIMIT 100""",
)
def t6(spark, d):
    return T.stratified_sample(table(spark, d, "labels"), "quality", ["doc_id"], 100)


@query("T7_cap_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY sha256('42:' || concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) LIMIT 25000")
def t7(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return T.cap_rows(table(spark, d, "lineitem").select(*key), key, 25_000)


@query(
    "T8_split_assign",
    """SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split
       FROM (SELECT doc_id, CAST(CAST('0x' || substr(sha256('42:' || doc_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710655.0::DOUBLE AS u FROM documents)""",
)
def t8(spark, d):
    return T.split_assign(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    "T9_pick_resources",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS package, CASE WHEN contains(url, '?') THEN 'JSON' WHEN contains(url, '#') THEN 'xml' ELSE 'csv' END AS fmt,
         CASE WHEN contains(url, '/en/') THEN 'English ' WHEN contains(url, '/fr/') THEN 'Traditional Chinese ' ELSE 'API ' END AS name FROM pages),
       s AS (SELECT *, CASE WHEN fmt = 'JSON' THEN 4 ELSE 0 END + CASE WHEN name = 'English ' THEN 3 WHEN name = 'Traditional Chinese ' THEN -3 ELSE -1 END AS score FROM p WHERE fmt IN ('JSON', 'csv'))
       SELECT package, page_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY package ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 2""",
)
def t9(spark, d):
    url = F.col("url")
    p = table(spark, d, "pages").select(
        "page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("package"),
        F.when(url.contains("?"), "JSON").when(url.contains("#"), "xml").otherwise("csv").alias("fmt"),
        F.when(url.contains("/en/"), "English ").when(url.contains("/fr/"), "Traditional Chinese ").otherwise("API ").alias("name"),
    )
    return T.pick_resources(p, "package", 2, "fmt", "name", "url", ["page_id"]).select("package", "page_id", "score", "rank")


# ---- sets ------------------------------------------------------------------------------------------


@query("U1_content_dedupe", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def u1(spark, d):
    return U.content_dedupe(table(spark, d, "documents"), ["text", "lang"], ["doc_id"]).select("doc_id")


@query(
    "U2_fingerprint_groups",
    """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, concat_ws('|', 'parquet', c_nationkey, 5, 0, array_to_string(list_sort([c_mktsegment, 'id']), ',')) AS s FROM customer)
       SELECT dataset_id, sha256(s) AS fingerprint, min(dataset_id) OVER (PARTITION BY s) AS canonical_id, CASE WHEN dataset_id <> min(dataset_id) OVER (PARTITION BY s) THEN min(dataset_id) OVER (PARTITION BY s) END AS duplicate_of FROM c""",
)
def u2(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.lit("parquet").alias("suffix"), F.col("c_nationkey").alias("n_rows"), F.lit(5).alias("n_cols"), F.lit(0).alias("size"),
        F.array(F.col("c_mktsegment"), F.lit("id")).alias("columns"),
    )
    return U.fingerprint_groups(c).select("dataset_id", "fingerprint", "canonical_id", "duplicate_of")


@query("U3_concat", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'copy' FROM orders WHERE o_orderstatus = 'F'")
def u3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return U.concat_frames([o, o.filter(F.col("o_orderstatus") == "F").withColumn("o_orderstatus", F.lit("copy"))])


_WORDS = "unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    "U4_column_sets",
    f"""WITH p AS (SELECT DISTINCT {_WORDS} AS token FROM benchmark), k AS (SELECT DISTINCT {_WORDS} AS token FROM conversations)
        SELECT coalesce(p.token, k.token) AS token, CASE WHEN p.token IS NOT NULL AND k.token IS NOT NULL THEN 'matched' WHEN k.token IS NOT NULL THEN 'missing' ELSE 'extra' END AS state FROM p FULL JOIN k ON p.token = k.token""",
)
def u4(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")).alias("token"))
    return U.column_sets(words("benchmark"), words("conversations"))


@query(
    "U5_ordered_unique_merge",
    """SELECT p_partkey, array_to_string(list_slice(m, -2, -1), ',') AS merged FROM (SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN string_split(p_name, ' ') ELSE list_concat(string_split(p_name, ' '), [p_type]) END AS m FROM part)""",
)
def u5(spark, d):
    p = table(spark, d, "part")
    merged = U.ordered_unique_merge(F.split("p_name", " "), F.array(F.upper(F.substring_index("p_name", " ", 1)), F.col("p_type")), 2)
    return p.select("p_partkey", F.array_join(merged, ",").alias("merged"))
