"""Registered queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.plans.registry import query, table


@query(
    "F1_parse_number",
    """
    WITH t AS (
      SELECT o_orderkey, CAST(CAST(o_orderkey AS BIGINT) AS VARCHAR) || ',5' AS comma_text,
             '$' || CAST(o_totalprice AS VARCHAR) AS dollar_text, o_orderpriority AS label_text FROM orders)
    SELECT o_orderkey, CAST(replace(comma_text, ',', '.') AS DOUBLE) AS comma_value,
           CAST(substr(dollar_text, 2) AS DOUBLE) AS dollar_value,
           TRY_CAST(regexp_replace(label_text, '[^0-9.-]', '', 'g') AS DOUBLE) AS label_value FROM t""",
)
def f1(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        S.parse_number(F.concat(F.col("o_orderkey").cast("string"), F.lit(",5"))).alias("comma_value"),
        S.parse_number(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("dollar_value"),
        S.parse_number(F.col("o_orderpriority")).alias("label_value"),
    )


@query(
    "F2_normalize_token",
    """SELECT p_partkey, regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '', 'g') AS brand_token,
       regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name_slug,
       lower(regexp_replace(trim(p_type), '[^\\p{L}\\p{N}]+', '', 'g')) AS type_token FROM part""",
)
def f2(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        S.normalize_token(F.col("p_brand")).alias("brand_token"),
        S.slug(F.col("p_name")).alias("name_slug"),
        S.unicode_token(F.col("p_type")).alias("type_token"),
    )


@query(
    "F3_split_tokens",
    """SELECT c_custkey, array_to_string(list_filter(string_split_regex(lower(
         regexp_replace(trim(c_name || 'Of' || c_mktsegment), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens
       FROM customer""",
)
def f3(spark, d):
    c = table(spark, d, "customer")
    text = F.concat("c_name", F.lit("Of"), "c_mktsegment")
    return c.select("c_custkey", F.concat_ws(" ", S.split_tokens(text)).alias("tokens"))


@query(
    "F4_combine_str",
    """SELECT d.doc_id, coalesce(d.lang, '') || '|' || coalesce(CAST(l.quality AS VARCHAR), '') || '|' || coalesce(d.source, '') AS combined
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def f4(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", S.combine_str([F.col("lang"), F.col("quality"), F.col("source")], "|").alias("combined"))


@query(
    "F5_hhmm_split",
    """SELECT d.doc_id, CAST(least(greatest(floor(coalesce(v, 0) / 100.0), 0), 23) AS INTEGER) AS hh,
         CAST(least(greatest(coalesce(v, 0) % 100, 0), 59) AS INTEGER) AS mm
       FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars END AS v FROM documents d LEFT JOIN labels l USING (doc_id)) d""",
)
def f5(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    df = table(spark, d, "documents").join(labelled, "doc_id", "left")
    hh, mm = S.hhmm_split(F.when(F.col("has") == 1, F.col("n_chars")))
    return df.select("doc_id", hh.alias("hh"), mm.alias("mm"))


@query(
    "F6_cyclic",
    """SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12.0), 6) + 0.0 AS month_sin,
       round(cos(2 * pi() * month(o_orderdate) / 12.0), 6) + 0.0 AS month_cos FROM orders""",
)
def f6(spark, d):
    s, c = S.cyclic(F.month("o_orderdate"), 12)
    return table(spark, d, "orders").select("o_orderkey", (F.round(s, 6) + 0.0).alias("month_sin"), (F.round(c, 6) + 0.0).alias("month_cos"))


@query(
    "F7_haversine_km",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS la1, l_tax * 1000 AS lo1, l_discount * 500 AS la2, l_quantity * 2 AS lo2 FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0,
         pow(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2))))), 4) AS km FROM t""",
)
def f7(spark, d):
    li = table(spark, d, "lineitem")
    km = S.haversine_km(F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_discount") * 500, F.col("l_quantity") * 2)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(km, 4).alias("km"))


@query(
    "F8_binary_flag",
    """SELECT d.doc_id, CASE WHEN CAST(l.quality AS VARCHAR) IN ('1', 'yes') THEN 1 ELSE 0 END AS is_good
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def f8(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", S.binary_flag(F.col("quality"), ["1", "yes"]).alias("is_good"))


@query(
    "F9_ratio_safe_div_interaction",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / (CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END), 4) AS price_per_discount,
       round(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END, 6) AS tax_share,
       round(l_quantity * l_discount, 6) AS quantity_x_discount FROM lineitem""",
)
def f9(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(S.ratio(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("price_per_discount"),
        F.round(S.safe_div(F.col("l_tax"), F.col("l_discount")), 6).alias("tax_share"),
        F.round(F.col("l_quantity") * F.col("l_discount"), 6).alias("quantity_x_discount"),
    )


@query(
    "F10_date_parts",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day,
       CAST(isodow(ts) AS INTEGER) AS ts_weekday, CAST(hour(ts) AS INTEGER) AS ts_hour,
       CAST(isodow(ts) >= 6 AS INTEGER) AS ts_is_weekend, CAST(month(ts) IN (12, 1, 2) AS INTEGER) AS ts_is_winter,
       CAST(month(ts) IN (6, 7, 8) AS INTEGER) AS ts_is_summer, CAST(hour(ts) // 6 AS INTEGER) AS ts_time_of_day FROM events""",
)
def f10(spark, d):
    parts = S.date_parts("ts")
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "F11_parse_datetime",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_iso,
         strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS from_us, CAST(NULL AS VARCHAR) AS from_words FROM events""",
)
def f11(spark, d):
    ev = table(spark, d, "events")
    shown = "yyyy-MM-dd HH:mm:ss"
    return ev.select(
        "event_id",
        F.date_format(S.parse_datetime(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), shown).alias("from_iso"),
        F.date_format(S.parse_datetime(F.date_format("ts", "MM/dd/yyyy")), shown).alias("from_us"),
        F.date_format(S.parse_datetime(F.col("event_type")), shown).alias("from_words"),
    )


@query(
    "F12_date_dim",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(month(o_orderdate) AS INTEGER) AS date_month,
       CAST(isodow(o_orderdate) AS INTEGER) AS date_day_of_week, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend FROM orders""",
)
def f12(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", *[c.alias(n) for n, c in S.date_dim(F.col("day")).items()])


@query(
    "F13_delay_flags",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, delay, CAST(delay > 0 AS INTEGER) AS is_delayed, CAST(delay > 15 AS INTEGER) AS is_late_15,
       CAST(delay > 60 AS INTEGER) AS is_late_60 FROM (SELECT l.*, CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS INTEGER) AS delay
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
)
def f13(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    df = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("delay", F.date_diff("l_shipdate", "o_orderdate"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "delay", *[c.alias(n) for n, c in S.delay_flags(F.col("delay")).items()])


@query(
    "F14_hub_flags_route",
    """SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS origin,
       CAST(upper(substr(c_mktsegment, 1, 3)) IN ('AUT', 'BUI', 'ATL', 'DEN') AS INTEGER) AS origin_is_hub,
       upper(substr(c_mktsegment, 1, 3)) || '_' || n_name AS route FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def f14(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    df = c.join(n, c.c_nationkey == n.n_nationkey, "left").withColumn("origin", F.upper(F.substring("c_mktsegment", 1, 3)))
    return df.select(
        "c_custkey", "origin",
        S.hub_flag(F.col("origin"), ["AUT", "BUI", "ATL", "DEN"]).alias("origin_is_hub"),
        S.route(F.col("origin"), F.col("n_name")).alias("route"),
    )


@query(
    "F15_label_or_null_flag",
    """SELECT d.doc_id, CAST(l.quality IS NOT NULL AS INTEGER) AS has_label FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def f15(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", F.col("quality").isNotNull().cast("int").alias("has_label"))


@query(
    "F28_format_usd",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 10000 THEN '$' || format('{:,}', CAST(round_even(o_totalprice / 1000.0, 0) AS BIGINT)) || 'k USD'
       ELSE '$' || format('{:,.2f}', o_totalprice) || ' USD' END AS shown FROM orders""",
)
def f28(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.format_usd(F.col("o_totalprice")).alias("shown"))


@query(
    "F31_hash_bucket",
    """SELECT p_partkey, CAST(CAST('0x' || substr(sha256(p_name), 1, 8) AS BIGINT) % 256 AS DOUBLE) AS bucket FROM part""",
)
def f31(spark, d):
    return table(spark, d, "part").select("p_partkey", S.hash_bucket(F.col("p_name")).alias("bucket"))


@query(
    "F32_canonical_hash",
    """SELECT c_custkey, sha256('c_mktsegment=' || coalesce(length(c_mktsegment) || ':' || c_mktsegment, '-') || ';' ||
       'c_name=' || coalesce(length(c_name) || ':' || c_name, '-') || ';') AS row_hash FROM customer""",
)
def f32(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.canonical_hash(["c_name", "c_mktsegment"]).alias("row_hash"))


def _hmac_sql(message: str) -> str:
    key = b"harbor".ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(
    "F33_identities",
    f"""WITH t AS (SELECT event_id, CAST(user_id AS VARCHAR) AS ip, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS ep,
          CASE WHEN event_type = 'view' THEN 'chrome' WHEN event_type = 'click' THEN 'edge' ELSE 'other' END AS bucket FROM events)
        SELECT event_id, bucket, {_hmac_sql("ip || '|' || bucket || '|stable'")} AS stable_id,
          {_hmac_sql("ip || '|' || bucket || '|' || CAST(ep AS VARCHAR)")} AS epoch_id FROM t""",
)
def f33(spark, d):
    ev = table(spark, d, "events")
    agent = F.when(F.col("event_type") == "view", "Chrome Edge").when(F.col("event_type") == "click", "edge").otherwise("x")
    ip = F.col("user_id").cast("string")
    return ev.select(
        "event_id",
        S.agent_bucket(agent).alias("bucket"),
        S.stable_identity("harbor", ip, agent).alias("stable_id"),
        S.epoch_identity("harbor", ip, agent, F.col("ts")).alias("epoch_id"),
    )


@query(
    "F36_finite_or_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS finite_share,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS shipped_at FROM lineitem""",
)
def f36(spark, d):
    li = table(spark, d, "lineitem")
    raw = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(S.finite_or_null(raw), 6).alias("finite_share"),
        S.iso_utc(F.col("l_shipdate")).alias("shipped_at"),
    )


@query(
    "F38_calibrate",
    """SELECT event_id, round(0.80 + least(1.0, greatest(0.0, value / 100.0)) * 0.05, 4) AS confidence FROM events""",
)
def f38(spark, d):
    return table(spark, d, "events").select("event_id", S.calibrate(F.col("value") / 100.0).alias("confidence"))


@query(
    "F42_truncate",
    """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 397) || '...' END AS short_text FROM documents""",
)
def f42(spark, d):
    return table(spark, d, "documents").select("doc_id", S.truncate_text(F.col("text"), 400).alias("short_text"))
