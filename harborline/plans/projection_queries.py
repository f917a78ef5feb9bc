"""Registered queries for projections, filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import profile as A
from harborline.operators import projections as P
from harborline.plans.registry import query, table


@query("P1_rename_aliases", "SELECT o_orderkey AS order_id, o_custkey, o_totalprice AS amount, o_orderstatus AS status FROM orders")
def p1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("status"))
    return P.rename_aliases(o, {"o_orderkey": "order_id", "o_totalprice": "amount", "o_custkey": "status", "missing": "x"})


@query("P2_ensure_columns", "SELECT o_orderkey, o_totalprice, CAST(NULL AS DOUBLE) AS demand, CAST(NULL AS VARCHAR) AS note FROM orders")
def p2(spark, d):
    return P.ensure_columns(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": "double", "demand": "double", "note": "string"})


@query("P3_align_columns", "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS orderstatuses, CAST(NULL AS BIGINT) AS visits FROM orders")
def p3(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("OrderKey"), F.col("o_totalprice").alias("total price"), F.col("o_orderstatus").alias("order_status"))
    return P.align_columns(o, {"order_key": "long", "total_price": "double", "orderstatuses": "string", "visits": "long"})


@query(
    "P4_filter_in",
    """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag
       UNION ALL SELECT 'kept', 1, NULL""",
)
def p4(spark, d):
    li = table(spark, d, "lineitem")
    kept = P.filter_in(li, "l_returnflag", ["A", "R"], never_empty=True).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    guard = P.filter_in(li, "l_returnflag", ["none"], never_empty=True).agg(F.lit("kept").alias("l_returnflag"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("quantity"))
    return kept.unionByName(guard)


@query(
    "P5_clean_target",
    """SELECT doc_id AS row_id, CAST(quality AS DOUBLE) AS target, 'regression' AS task FROM documents JOIN labels USING (doc_id)
       UNION ALL SELECT doc_id, NULL, 'classification:' || trim(lang) FROM documents WHERE trim(lang) <> ''""",
)
def p5(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reg = P.clean_target(docs.select("doc_id", F.col("quality").alias("target")), "target", "regression")
    cls = P.clean_target(docs.select("doc_id", F.col("lang").alias("target")), "target", "classification")
    return reg.select(F.col("doc_id").alias("row_id"), "target", F.lit("regression").alias("task")).unionByName(
        cls.select(F.col("doc_id").alias("row_id"), F.lit(None).cast("double").alias("target"), F.concat(F.lit("classification:"), "target").alias("task"))
    )


@query("P6_select_features", "SELECT l_quantity, l_extendedprice, l_tax FROM lineitem")
def p6(spark, d):
    return P.select_features(table(spark, d, "lineitem"), "l_discount", include=["l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_partkey"], exclude=["l_partkey"])


@query(
    "P7_drop_leaky",
    """SELECT unnest(['cust_id', 'nation_id', 'c_acctbal', 'c_mktsegment', 'next_balance']) AS feature,
         unnest([(SELECT count(DISTINCT c_custkey) * 1.0 / count(*) < 0.95 FROM customer), (SELECT count(DISTINCT c_nationkey) * 1.0 / count(*) < 0.95 FROM customer), true, false, false]) AS kept""",
)
def p7(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_nationkey").alias("nation_id"), "c_acctbal", "c_mktsegment", F.col("c_acctbal").alias("next_balance")
    )
    kept, dropped = P.drop_leaky(c, c.columns, "c_mktsegment", forbidden_patterns=[".*next_.*"])
    return spark.createDataFrame([(f, True) for f in kept] + [(f, False) for f in dropped], "feature string, kept boolean")


def _names(spark, d):
    """Column names as data: distinct slugs of part names, and stock identifiers made from brands."""
    p = table(spark, d, "part")
    return p.select(F.regexp_replace("p_name", " ", "_").alias("name"), "p_size").unionByName(
        p.select(F.concat(F.lower(F.col("p_type")), F.when(F.col("p_size") > 25, "_id").otherwise("code")).alias("name"), "p_size")
    )


_NAMES_SQL = """(SELECT replace(p_name, ' ', '_') AS name, p_size FROM part UNION ALL
    SELECT lower(p_type) || CASE WHEN p_size > 25 THEN '_id' ELSE 'code' END, p_size FROM part)"""


@query(
    "P8_is_id_like",
    f"""SELECT DISTINCT name, (name IN ('id', 'row_id', 'record_id', 'uuid', 'uid', 'index') OR name LIKE '%\\_id' ESCAPE '\\' OR regexp_full_match(name, '.*id\\d*')
        OR contains(name, 'fips') OR name LIKE '%code' OR name LIKE 'code\\_%' ESCAPE '\\') AS id_like FROM {_NAMES_SQL}""",
)
def p8(spark, d):
    return _names(spark, d).select("name").distinct().withColumn("id_like", P.is_id_like(F.col("name")))


@query(
    "P9_low_value_target",
    """WITH g AS (SELECT CASE WHEN p_size > 40 THEN 'Rank' WHEN p_size > 30 THEN 'row_' || p_brand WHEN p_size > 20 THEN p_brand || '_labels' ELSE p_brand || '_cost' END AS name,
         p_brand, CAST(count(DISTINCT p_size) AS BIGINT) AS n_distinct FROM part GROUP BY 1, 2)
       SELECT name, p_brand, n_distinct, CASE WHEN name = 'Rank' THEN 'low_value_exact:rank' WHEN name LIKE 'row\\_%' ESCAPE '\\' THEN 'low_value_pattern:^row_.*'
         WHEN name LIKE '%\\_labels' ESCAPE '\\' THEN 'low_value_pattern:.*_label(s)?$' WHEN n_distinct <= 2 THEN 'regression_low_unique_target' END AS reason FROM g""",
)
def p9(spark, d):
    p = table(spark, d, "part")
    name = (
        F.when(F.col("p_size") > 40, F.lit("Rank"))
        .when(F.col("p_size") > 30, F.concat(F.lit("row_"), "p_brand"))
        .when(F.col("p_size") > 20, F.concat("p_brand", F.lit("_labels")))
        .otherwise(F.concat("p_brand", F.lit("_cost")))
    )
    g = p.groupBy(name.alias("name"), "p_brand").agg(F.count_distinct("p_size").alias("n_distinct"))
    return g.withColumn("reason", P.low_value_target(F.col("name"), F.lit("regression"), F.col("n_distinct")))


@query(
    "P10_eligibility",
    """WITH g AS (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT CAST(s_acctbal AS BIGINT) // 1000) AS BIGINT) AS n_cols FROM supplier GROUP BY s_nationkey)
       SELECT s_nationkey, n_rows, n_cols, CASE WHEN s_nationkey = 3 THEN 'worker_disabled_spec' WHEN s_nationkey = 5 THEN 'no_target_spec'
         WHEN n_rows < 3 THEN 'rows_below_min:' || n_rows || '<3' WHEN n_cols < 2 THEN 'cols_below_min:' || n_cols || '<2' WHEN n_cols <= 2 THEN 'lookup_table_shape'
         WHEN n_cols - 1 < 3 THEN 'feature_count_below_min:' || (n_cols - 1) || '<3' ELSE 'eligible' END AS reason FROM g""",
)
def p10(spark, d):
    s = table(spark, d, "supplier")
    g = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.floor(F.round("s_acctbal") / 1000)).alias("n_cols"))
    key = F.col("s_nationkey")
    return g.withColumn(
        "reason",
        P.eligibility(key != 3, F.when(key != 5, F.lit("t")), F.col("n_rows"), F.col("n_cols"), F.col("n_cols") - 1, min_rows=3, min_cols=2, min_features=3),
    )


_INCLUDE, _EXCLUDE = ["token", r"\bthe\b", "copyright"], ["license", r"\bque\b"]


@query(
    "P11_keyword_gate",
    r"""SELECT doc_id, (source = 'src3' OR (regexp_matches(lower(text), 'token|copyright|(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') AND NOT regexp_matches(lower(text), 'license|(^|[^\p{L}\p{N}_])que([^\p{L}\p{N}_]|$)'))) AS kept FROM documents""",
)
def p11(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", P.keyword_gate(F.col("text"), _INCLUDE, _EXCLUDE, F.col("source"), ["src3"]).alias("kept"))


@query(
    "P12_guardrail_classify",
    r"""WITH w AS (SELECT conv_id, turn, role, text, lower(trim(text)) AS low,
           list_distinct(list_filter(string_split_regex(lower(trim(text)), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS words FROM conversations)
        SELECT conv_id, turn, role, CASE WHEN low = '' THEN 'empty_message' WHEN regexp_matches(low, '\bignore (all|previous|prior) instructions\b|\bsystem prompt\b') THEN 'identity_or_prompt_injection'
          WHEN NOT (len(list_intersect(words, ['the', 'and', 'with'])) >= 1 AND len(list_intersect(words, ['the', 'and', 'with'])) * 1.0 / greatest(1, len(words)) >= 0.05)
            AND regexp_matches(low, '(^|[^\p{L}\p{N}_])(are|les)([^\p{L}\p{N}_]|$)') THEN 'off_scope' END AS reason FROM w""",
)
def p12(spark, d):
    conv = table(spark, d, "conversations")
    reason = P.guardrail_classify(F.col("text"), ["the", "and", "with"], [r"\bare\b", r"\bles\b"])
    return conv.select("conv_id", "turn", "role", reason.alias("reason"))


@query(
    "P13_quality_gate",
    """WITH d AS (SELECT d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT count(*) AS n,
         sum((lang IS NULL)::INT) AS a, sum((source IS NULL)::INT) AS b, sum((quality IS NULL)::INT) AS c FROM d), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM d)),
       g AS (SELECT 'null_ratio:lang' AS gate, a * 1.0 / n AS value, 0.3 AS threshold FROM s UNION ALL SELECT 'null_ratio:source', b * 1.0 / n, 0.3 FROM s
         UNION ALL SELECT 'null_ratio:quality', c * 1.0 / n, 0.3 FROM s UNION ALL SELECT 'duplicate_row_ratio', 1.0 - k * 1.0 / n, 0.05 FROM s, u
         UNION ALL SELECT 'timestamp_field:order_date', 1.0, 0.0 UNION ALL SELECT 'key_hint:source', 0.0, 0.0)
       SELECT gate, round(CAST(value AS DOUBLE), 6) AS value, CAST(threshold AS DOUBLE) AS threshold, value <= threshold AS passed FROM g""",
)
def p13(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("lang", "source", "quality")
    return P.quality_gate(docs, 0.30, 0.05, ["order_date"], ["source"]).withColumn("value", F.round("value", 6))


@query("F24_auto_detect_columns",
    """WITH s AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_totalprice) AS c FROM orders)
       SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
         unnest([CASE WHEN a <= 20 AND a < n * .05 THEN 'categorical' ELSE 'numeric' END, CASE WHEN b <= 20 AND b < n * .05 THEN 'categorical' ELSE 'numeric' END, 'categorical',
         CASE WHEN c <= 20 AND c < n * .05 THEN 'categorical' ELSE 'numeric' END, 'temporal', 'categorical']) AS kind FROM s""")
def f24(spark, d):
    kinds = A.auto_detect_columns(table(spark, d, "orders"))
    return spark.createDataFrame([(c, k) for k, cols in kinds.items() for c in cols], "column_name string, kind string")
