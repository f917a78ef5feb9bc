"""Registered queries for table profiles and KPI tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import profile as A
from harborline.operators.states import column_states, merged_states, read_states
from harborline.plans.registry import query, table
from harborline.plans.reports import dashboard_bundle
from harborline.session import materialize


def _docs_labels(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").drop("text")


_DL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_DL_TYPES = [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]
_SUMMARY = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS dtype, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS null_count, "
    f"round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_ratio, CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_cols FROM {_DL}"
    for i, (c, t) in enumerate(_DL_TYPES)
)


@query("A1_schema_summary", _SUMMARY)
def a1(spark, d):
    return A.schema_summary(_docs_labels(spark, d))


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "A2_numeric_profile",
    " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) + 0.0 AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
        for i, c in enumerate(_LI_NUM)
    ),
)
def a2(spark, d):
    p = A.numeric_profile(table(spark, d, "lineitem"))
    return p.select("ordinal", "column_name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), (F.col("min") + 0.0).alias("min"), "max")


@query(
    "A2_profile_from_states",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS nulls, CAST(min({c}) + 0.0 AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, TRUE AS distinct_holds, TRUE AS median_holds FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def a2s(spark, d):
    """Each month's states are written once and merged on reading; the sketches are held against all rows."""
    li, columns = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]
    monthly = materialize(column_states(li.withColumn("month", F.date_trunc("month", "l_shipdate")), columns, ["month"]))
    told = materialize(read_states(merged_states(monthly), [0.5]))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))
    seen = li.select(cells.alias("c")).select("c.*").join(F.broadcast(told.select("column_name", "q50")), "column_name")
    exact = seen.groupBy("column_name").agg(F.countDistinct("v").alias("all"), F.avg((F.col("v") <= F.col("q50")).cast("double")).alias("upto"), F.avg((F.col("v") < F.col("q50")).cast("double")).alias("below"))
    return told.join(exact, "column_name").select(
        "column_name", "n", "nulls", (F.col("min") + 0.0).alias("min"), "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        (F.abs(F.col("n_distinct") - F.col("all")) <= 0.06 * F.col("all")).alias("distinct_holds"), ((F.col("upto") >= 0.48) & (F.col("below") <= 0.52)).alias("median_holds"),
    )


@query(
    "A3_top_values",
    """WITH v AS (SELECT 'p_name' AS column_name, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part),
       c AS (SELECT column_name, value, CAST(count(*) AS BIGINT) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
       SELECT column_name, value, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""",
)
def a3(spark, d):
    return A.top_values(table(spark, d, "part"))


@query(
    "A4_quality",
    """WITH s AS (SELECT (count(*) FILTER (quality IS NULL)) / count(*) AS q, (count(*) FILTER (toxic IS NULL)) / count(*) AS t, count(*) FILTER (lang IS NULL) / count(*) AS g,
         count(*) FILTER (source IS NULL) / count(*) AS o, count(*) FILTER (n_chars IS NULL) / count(*) AS c FROM """ + _DL + """),
       m AS (SELECT 1 - (round(q, 6) + round(t, 6) + g + o + c) / 6 AS comp, q, t FROM s)
       SELECT round(comp, 4) AS completeness, round(1 - comp, 4) AS data_gap_ratio, array_to_string(list_filter([CASE WHEN q > .35 THEN 'quality' END, CASE WHEN t > .35 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS missing_fields,
         CASE WHEN comp >= 0.8 THEN 'high' WHEN comp >= 0.55 THEN 'medium' ELSE 'low' END AS band FROM m""",
)
def a4(spark, d):
    return A.quality(_docs_labels(spark, d))


@query(
    "A13_kpis",
    """WITH e AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
       m AS (SELECT avg(value) FILTER (i < greatest(1, floor(n * 0.2))) AS b, avg(value) FILTER (i >= n - greatest(1, floor(n * 0.2))) AS c, stddev_pop(value) AS s, avg(value) AS a FROM e)
       SELECT round(b, 6) AS baseline, round(c, 6) AS current, round((c - b) / b, 6) AS delta, round(greatest(0.01, least(0.99, s / (abs(a) + 1e-9))), 6) AS risk FROM m""",
)
def a13(spark, d):
    k = A.kpis(table(spark, d, "events").select("value", "ts", "event_id"), "value", ["ts", "event_id"])
    return k.select([F.round(c, 6).alias(c) for c in k.columns])


@query(
    "A14_kpi_targets",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
       k AS (SELECT 'o_orderkey' AS kpi, avg(o_orderkey) FILTER (i < greatest(1, n // 5)) AS b, avg(o_orderkey) FILTER (i >= n - greatest(1, n // 5)) AS c FROM o
       UNION ALL SELECT 'o_custkey', avg(o_custkey) FILTER (i < greatest(1, n // 5)), avg(o_custkey) FILTER (i >= n - greatest(1, n // 5)) FROM o
       UNION ALL SELECT 'o_totalprice', avg(o_totalprice) FILTER (i < greatest(1, n // 5)), avg(o_totalprice) FILTER (i >= n - greatest(1, n // 5)) FROM o)
       SELECT kpi, round(b, 4) AS baseline, round(c, 4) AS current, round(c * 1.08, 4) AS target_30d, round(c * 1.08 - c, 4) AS gap FROM k""",
)
def a14(spark, d):
    k = A.kpi_targets(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"])
    return k.select("kpi", *[F.round(c, 4).alias(c) for c in k.columns if c != "kpi"])


@query(
    "A15_default_tables",
    """SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, CAST(event_id AS DOUBLE) AS metric,
       event_type AS category, CAST(event_id AS VARCHAR) AS id FROM (SELECT ts, event_id, event_type, value FROM events)""",
)
def a15(spark, d):
    ev = table(spark, d, "events").select("ts", "event_id", "event_type", "value")
    picked = ev.select(F.col("ts").alias("event_date"), "event_id", "event_type", "value")
    return A.default_main(picked, ["event_date", "event_id"])


@query(
    "A28_histogram",
    """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT unnest(range(30)) AS bin),
       c AS (SELECT least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1)
       SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 30), 4) AS low, round(lo + (b.bin + 1) * ((hi - lo) / 30), 4) AS high, CAST(coalesce(n, 0) AS BIGINT) AS n
       FROM b CROSS JOIN r LEFT JOIN c ON b.bin = c.bin""",
)
def a28(spark, d):
    h = A.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30)
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query(
    "A29_missingness_top",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_ratio FROM {_DL}" for c, _ in _DL_TYPES),
)
def a29(spark, d):
    return A.missingness_top(_docs_labels(spark, d))


@query(
    "A30_distribution_hints",
    """SELECT 'l_extendedprice' AS target, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
         CASE WHEN max(l_extendedprice) > 100000 THEN 'high_magnitude_target,' ELSE '' END || 'non_negative_target' AS hints FROM lineitem
       UNION ALL SELECT 'l_tax', CAST(count(*) AS BIGINT), round(avg(l_tax), 4), round(stddev_samp(l_tax), 4), min(l_tax) + 0.0, max(l_tax), 'bounded_ratio_target,non_negative_target' FROM lineitem""",
)
def a30(spark, d):
    li = table(spark, d, "lineitem")

    def hints(c):
        h = A.distribution_hints(li, c)
        return h.select(F.lit(c).alias("target"), "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), (F.col("min") + 0.0).alias("min"), "max", "hints")

    return hints("l_extendedprice").unionByName(hints("l_tax"))


@query(
    "A31_max_pair_correlation",
    """WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_quantity, l_discount)) AS b, abs(corr(l_extendedprice, l_discount)) AS e FROM lineitem)
       SELECT round(greatest(a, b, e), 6) AS max_corr, greatest(a, b, e) >= 0.995 AS too_correlated FROM c""",
)
def a31(spark, d):
    m = A.max_pair_correlation(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return m.select(F.round("max_corr", 6).alias("max_corr"), "too_correlated")


@query(
    "F25_select_target",
    """SELECT 'retail_price' AS column_name, CASE WHEN count(DISTINCT p_retailprice) > 20 THEN 'regression' ELSE 'classification' END AS task_type, CAST(2.5 AS DOUBLE) AS score FROM part""",
)
def f25(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("label_text"), "p_size", F.col("p_retailprice").alias("retail_price"))
    return A.select_target(p.drop("label_text")).select("column_name", "task_type", "score")


@query(
    "F37_field_type",
    """SELECT k.column_name, k.kind, (SELECT CAST(count(*) AS BIGINT) FROM events) AS n_rows FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name,
       unnest(['integer', 'datetime', 'integer', 'string', 'number', 'string']) AS kind) k""",
)
def f37(spark, d):
    ev = table(spark, d, "events")
    kinds = spark.createDataFrame(list(A.field_types(ev).items()), "column_name string, kind string")
    return kinds.withColumn("n_rows", F.lit(ev.count()).cast("long"))


@query(
    "W7_uniform_downsample",
    """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), k AS (SELECT unnest(range(1000)) AS j)
       SELECT DISTINCT event_id FROM e JOIN k ON e.i = CAST(round_even(k.j * ((e.n - 1) / 999.0::DOUBLE), 0) AS BIGINT)""",
)
def w7(spark, d):
    return A.uniform_downsample(table(spark, d, "events").select("event_id", "ts"), 1000, ["ts", "event_id"]).select("event_id")


@query(
    "A13_dashboard_kpis",
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS m FROM events),
       q AS (SELECT avg(value) FILTER (p < greatest(1, floor(m * 0.2))) AS b, avg(value) FILTER (p >= m - greatest(1, floor(m * 0.2))) AS c, stddev_pop(value) AS s, avg(value) AS a FROM s)
       SELECT round(b, 6) AS baseline, round(c, 6) AS current, round((c - b) / b, 6) AS delta, round(greatest(0.01, least(0.99, s / (abs(a) + 1e-9))), 6) AS risk FROM q""",
)
def a13_dashboard(spark, d):
    """KPIs of the dashboard, over all rows; only what a chart draws is thinned."""
    ev = table(spark, d, "events").select(F.col("ts").alias("event_date"), "event_id", "value")
    k = dashboard_bundle(ev.withColumnRenamed("value", "demand"), ["event_date", "event_id"])["kpis"]
    return k.select([F.round(c, 6).alias(c) for c in k.columns])


@query(
    "F25_pick_of_a_sample",
    """SELECT 'no id' AS pick, 'order_price' AS column_name, CAST(count(DISTINCT o_totalprice) > 20 AS BOOLEAN) AS many FROM orders UNION ALL SELECT 'tie by name', 'avalue', count(DISTINCT o_totalprice) > 20 FROM orders""",
)
def f25s(spark, d):
    """An identifier is never the metric; of metrics alike in all else the first by name is taken."""
    from harborline.operators import targets as G

    o = table(spark, d, "orders")
    ids = A.column_stats(o.select(F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("order_price")))
    alike = A.column_stats(o.select(F.col("o_totalprice").alias("zvalue"), F.col("o_totalprice").alias("avalue")))
    many = F.lit(o.select("o_totalprice").distinct().count() > 20)
    tagged = lambda df, name: df.select(F.lit(name).alias("pick"), "column_name", many.alias("many"))
    return tagged(G.pick_metric(ids, ["price"], "sample"), "no id").unionByName(tagged(G.fallback_target(alike), "tie by name"))


@query(
    "F25_target_picks",
    """WITH s AS (SELECT count(DISTINCT l_quantity) AS q, count(DISTINCT l_discount) AS d, count(DISTINCT l_extendedprice) AS p FROM lineitem)
       SELECT 'fallback' AS pick, 'l_extendedprice' AS column_name, 'regression' AS task_type FROM s UNION ALL SELECT 'scored', CASE WHEN q > 20 THEN 'l_quantity' ELSE 'l_extendedprice' END, 'regression' FROM s
       UNION ALL SELECT 'metric', 'l_discount', 'regression' FROM s UNION ALL SELECT 'sample', 'l_discount', CASE WHEN d <= 20 THEN 'classification' ELSE 'regression' END FROM s
       UNION ALL SELECT 'recommended', 'l_returnflag', 'classification' FROM s UNION ALL SELECT 'rule', 'l_tax', 'regression' FROM s UNION ALL SELECT 'rule', 'l_linestatus', 'classification' FROM s UNION ALL SELECT 'rule', 'l_extendedprice', 'regression' FROM s""",
)
def f25p(spark, d):
    from harborline.operators import targets as G

    stats = A.column_stats(table(spark, d, "lineitem")).cache()
    tagged = lambda df, name: df.select(F.lit(name).alias("pick"), "column_name", "task_type")
    out = tagged(G.fallback_target(stats), "fallback")
    out = out.unionByName(tagged(G.scored_targets(stats).filter("rank = 1"), "scored"))
    out = out.unionByName(tagged(G.pick_metric(stats, ["discount"]), "metric")).unionByName(tagged(G.pick_metric(stats, ["discount"], "sample"), "sample"))
    out = out.unionByName(tagged(G.recommend_target(stats, "absent", "L_RETURNFLAG"), "recommended"))
    rules = G.rule_targets(stats, [("status$", 90, "regression"), ("price", 80, "regression")], [("l_tax", "regression")])
    return out.unionByName(tagged(rules, "rule"))
