"""Registered queries for aggregates, series, ensembles, metrics and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import aggregates as A
from harborline.plans.registry import query, table


@query(
    "A5_profile_by",
    """SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, round(coalesce(sum(l_quantity), 0), 2) AS target_quantity, round(avg(l_extendedprice), 4) AS avg_price,
       round(coalesce(stddev_samp(l_discount), 0), 6) AS discount_std, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def a5(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    p = A.profile_by(
        li, ["l_returnflag", "l_linestatus", "year"], ("target_quantity", "sum:l_quantity"),
        {"avg_price": ("mean", "l_extendedprice"), "discount_std": ("std", "l_discount"), "n": ("len", "l_tax")},
    )
    return p.withColumns({"target_quantity": F.round("target_quantity", 2), "avg_price": F.round("avg_price", 4), "discount_std": F.round("discount_std", 6)})


_MONTHLY = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, avg(o_totalprice) AS y FROM orders GROUP BY 1), k AS (SELECT * FROM m)"""


@query("A9_monthly_trend", f"WITH {_MONTHLY} SELECT t, round(y, 4) AS y FROM k")
def a9(spark, d):
    return A.monthly_trend(table(spark, d, "orders"), "o_orderdate", "o_totalprice").withColumn("y", F.round("y", 4))


@query("A10_resample_mean_weekly", "SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS t, round(avg(value), 6) AS value FROM events GROUP BY 1")
def a10(spark, d):
    return A.resample_mean(table(spark, d, "events"), "ts", ["value"], "week").withColumn("value", F.round("value", 6))


@query("A10_resample_mean_monthly", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def a10m(spark, d):
    return A.resample_mean(table(spark, d, "orders"), "o_orderdate", ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "A11_seasonality",
    """SELECT 'month' AS grain, CAST(month(o_orderdate) AS INTEGER) AS period, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1, 2
       UNION ALL SELECT 'quarter', CAST(quarter(o_orderdate) AS INTEGER), round(avg(o_totalprice), 4) FROM orders GROUP BY 1, 2""",
)
def a11(spark, d):
    return A.seasonality(table(spark, d, "orders"), "o_orderdate", "o_totalprice").withColumn("y", F.round("y", 4))


@query(
    "A12_linear_forecast",
    f"""WITH {_MONTHLY}, i AS (SELECT t, y, row_number() OVER (ORDER BY t) - 1 AS x FROM k), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS b, max(t) AS last, max(x) AS xl FROM i)
        SELECT CAST(last + CAST(g AS INTEGER) AS DATE) AS t, CAST(g AS INTEGER) AS step, round(b + s * (xl + g), 4) AS y_hat FROM f, range(1, 91) r(g)""",
)
def a12(spark, d):
    trend = A.monthly_trend(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return A.linear_forecast(trend).withColumn("y_hat", F.round("y_hat", 4))


@query(
    "A12_forecast_by_date",
    f"""WITH {_MONTHLY}, i AS (SELECT t, y, date_diff('day', (SELECT min(t) FROM k), t) AS x FROM k), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS b, max(t) AS last, max(x) AS xl FROM i)
        SELECT CAST(last + CAST(g AS INTEGER) AS DATE) AS t, CAST(g AS INTEGER) AS step, round(b + s * (xl + g), 4) AS y_hat FROM f, range(1, 31) r(g)""",
)
def a12d(spark, d):
    trend = A.monthly_trend(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return A.linear_forecast(trend, horizon=30, step="date").withColumn("y_hat", F.round("y_hat", 4))


_PREDS = """p AS (SELECT l_orderkey AS row_id, CAST(l_suppkey % 3 AS INTEGER) AS worker, (l_extendedprice - 50000) / 10000 AS y_hat, l_discount / 7 + l_tax / 13 AS conf FROM lineitem),
  n AS (SELECT 0 AS worker, 50000.0::DOUBLE AS mean, 10000.0::DOUBLE AS std UNION ALL SELECT 1, 40000, 0)"""


@query(
    "A16_ensemble_regression",
    f"""WITH {_PREDS} SELECT row_id, round(sum((y_hat * CASE WHEN abs(coalesce(std, 1)) < 1e-8 THEN 1 ELSE coalesce(std, 1) END + coalesce(mean, 0)) * conf) / CASE WHEN sum(conf) <= 1e-8 THEN 1 ELSE sum(conf) END, 4) + 0.0 AS prediction
        FROM p LEFT JOIN n USING (worker) GROUP BY row_id""",
)
def a16(spark, d):
    li = table(spark, d, "lineitem")
    preds = li.select(F.col("l_orderkey").alias("row_id"), (F.col("l_suppkey") % 3).cast("int").alias("worker"), ((F.col("l_extendedprice") - 50000) / 10000).alias("y_hat"), (F.col("l_discount") / 7 + F.col("l_tax") / 13).alias("conf"))
    norm = spark.createDataFrame([(0, 50000.0, 10000.0), (1, 40000.0, 0.0)], "worker int, mean double, std double")
    return A.ensemble_regression(preds, norm).withColumn("prediction", F.round("prediction", 4) + 0.0)


@query(
    "A17_ensemble_classification",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings), p AS (SELECT vec_id, c, abs(x) AS prob, 0.7::DOUBLE AS conf FROM e UNION ALL SELECT vec_id, c, 1 - abs(x), 0.2::DOUBLE FROM e),
       s AS (SELECT vec_id, c, sum(CAST(prob AS DOUBLE) * conf) / sum(conf) AS q FROM p GROUP BY 1, 2)
       SELECT vec_id AS row_id, CAST(arg_max(c, (q, -c)) AS INTEGER) AS class, round(max(q), 6) AS probability FROM s GROUP BY 1""",
)
def a17(spark, d):
    """Two scorers read class weights off the vectors, one of them inverted."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("class", "x"))
    p = F.abs("x")
    one = e.select("row_id", "class", p.cast("double").alias("prob"), F.lit(0.7).alias("conf"))
    two = e.select("row_id", "class", (F.lit(1.0).cast("float") - p).cast("double").alias("prob"), F.lit(0.2).alias("conf"))
    return A.ensemble_classification(one.unionByName(two)).withColumn("probability", F.round("probability", 6))


@query(
    "A18_prediction_summary",
    """SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(l_extendedprice), 4) AS prediction_mean, round(stddev_pop(l_extendedprice), 4) AS prediction_std, min(l_extendedprice) AS prediction_min, max(l_extendedprice) AS prediction_max,
       round(quantile_cont(l_extendedprice, 0.05), 4) AS prediction_p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS prediction_p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS prediction_p95 FROM lineitem""",
)
def a18(spark, d):
    s = A.regression_summary(table(spark, d, "lineitem"), "l_extendedprice")
    return s.select("n_rows", "prediction_min", "prediction_max", *[F.round(c, 4).alias(c) for c in s.columns if c not in ("n_rows", "prediction_min", "prediction_max")])


@query("A18_class_summary", "SELECT label AS class, CAST(count(*) AS BIGINT) AS n, round(avg(abs(CAST(embedding[1] AS DOUBLE))), 6) AS mean_confidence FROM embeddings GROUP BY label")
def a18c(spark, d):
    e = table(spark, d, "embeddings").select("label", F.abs(F.element_at("embedding", 1).cast("double")).alias("prob"))
    return A.class_summary(e, "label", "prob").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "A18_worker_summary",
    "SELECT l_suppkey AS worker, round(sum(l_extendedprice), 2) / count(*) AS prediction_mean, round(stddev_pop(l_extendedprice), 4) AS prediction_std, round(avg(l_tax), 6) AS confidence_mean, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY 1",
)
def a18w(spark, d):
    s = A.worker_summary(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_tax")
    exact = F.round(F.col("prediction_mean") * F.col("n_rows"), 2) / F.col("n_rows")
    return s.withColumns({"prediction_mean": exact, "prediction_std": F.round("prediction_std", 4), "confidence_mean": F.round("confidence_mean", 6)})


_CLS = "c AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))"


def _classes(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return docs.select(F.col("quality").alias("y"), (F.col("n_chars") > 500).cast("int").alias("p"), F.col("n_chars").cast("double").alias("s"))


@query(
    "A19_classification_report",
    f"""WITH {_CLS}, k AS (SELECT u.v, count(*) FILTER (y = u.v) AS t, count(*) FILTER (p = u.v) AS q, count(*) FILTER (y = u.v AND p = u.v) AS h FROM c, (SELECT DISTINCT y AS v FROM c UNION SELECT DISTINCT p FROM c) u GROUP BY 1),
        a AS (SELECT sum(t)::DOUBLE AS n, sum(h)::DOUBLE AS h, avg(2.0 * h / (t + q)) AS f1, sum(t * q)::DOUBLE AS tp, sum(t * t)::DOUBLE AS tt, sum(q * q)::DOUBLE AS pp FROM k),
        r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM c), u AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)) AS auc FROM r)
        SELECT round(h / n, 6) AS accuracy, round(f1, 6) AS f1_score, round((h * n - tp) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc, round(auc, 6) AS roc_auc FROM a, u""",
)
def a19(spark, d):
    r = A.classification_report(_classes(spark, d), "y", "p", "s")
    return r.select([F.round(c, 6).alias(c) for c in r.columns])


_REG = "c AS (SELECT l_extendedprice AS y, l_quantity * 2100.0::DOUBLE AS p FROM lineitem)"
_REG_METRICS = "m AS (SELECT 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, sqrt(sum((y - p) * (y - p)) / count(*)) / (max(y) - min(y)) AS rmse_normalized, avg(abs(y - p)) / (max(y) - min(y)) AS mae_normalized, avg(y - p) AS mean_residual, max(abs(y - p)) AS max_abs_residual FROM c)"


def _regression(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100.0).alias("p"))
    return A.regression_report(df, "y", "p")


@query("A20_regression_report", f"WITH {_REG}, {_REG_METRICS} SELECT round(r2, 6) AS r2, round(rmse_normalized, 6) AS rmse_normalized, round(mae_normalized, 6) AS mae_normalized, round(mean_residual, 4) AS mean_residual, round(max_abs_residual, 4) AS max_abs_residual FROM m")
def a20(spark, d):
    r = _regression(spark, d)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns[:3]], *[F.round(c, 4).alias(c) for c in r.columns[3:]])


@query(
    "A21_benchmark_gate",
    f"""WITH {_REG}, {_REG_METRICS}, v AS (SELECT 'r2' AS metric, r2 AS value, 0.90 AS threshold, r2 >= 0.90 AS passed FROM m UNION ALL SELECT 'rmse_normalized', rmse_normalized, 0.12, rmse_normalized <= 0.12 FROM m UNION ALL SELECT 'mae_normalized', mae_normalized, 0.10, mae_normalized <= 0.10 FROM m)
        SELECT 'price_by_quantity' AS model, 'regression' AS task_type, metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold, passed, (SELECT bool_and(passed) FROM v) AS verdict FROM v""",
)
def a21(spark, d):
    wide = _regression(spark, d).withColumn("model", F.lit("price_by_quantity")).withColumn("task_type", F.lit("regression"))
    metrics = wide.unpivot(["model", "task_type"], ["r2", "rmse_normalized", "mae_normalized"], "metric", "value")
    gate = A.benchmark_gate(metrics, A.thresholds(metrics, "minimum"))
    verdict = A.gate_verdict(gate).select("model", "task_type", F.col("passed").alias("verdict"))
    return gate.join(verdict, ["model", "task_type"]).select("model", "task_type", "metric", F.round("value", 6).alias("value"), "threshold", "passed", "verdict")


@query(
    "A21_domain_gate",
    f"""WITH {_REG}, v AS (SELECT avg(abs(y - p) / y) AS mape FROM c) SELECT 'price_by_quantity' AS model, 'eta' AS domain, 'mape' AS metric, round(mape, 6) AS value, 0.12::DOUBLE AS threshold, mape <= 0.12 AS passed FROM v""",
)
def a21d(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100.0).alias("p"))
    value = li.agg(F.avg(F.abs(F.col("y") - F.col("p")) / F.col("y")).alias("value"))
    metrics = value.select(F.lit("price_by_quantity").alias("model"), F.lit("eta").alias("domain"), F.lit("mape").alias("metric"), "value")
    return A.domain_gate(metrics, "shipping_freight").withColumn("value", F.round("value", 6))


@query(
    "A21_gate_of_an_industry",
    f"""WITH {_REG}, {_REG_METRICS} SELECT 'r2' AS metric, 0.90::DOUBLE AS threshold, r2 >= 0.90 AS passed FROM m UNION ALL SELECT 'rmse_normalized', 0.12, rmse_normalized <= 0.12 FROM m UNION ALL SELECT 'mae_normalized', 0.10, mae_normalized <= 0.10 FROM m""",
)
def a21i(spark, d):
    wide = _regression(spark, d).withColumn("model", F.lit("m")).withColumn("task_type", F.lit("regression"))
    metrics = wide.unpivot(["model", "task_type"], ["r2", "rmse_normalized", "mae_normalized"], "metric", "value")
    return A.benchmark_gate(metrics, A.thresholds(metrics, "good", "shipping_freight")).select("metric", "threshold", "passed")


@query(
    "A19_roc_points",
    f"""WITH {_CLS}, s AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM c GROUP BY s)
        SELECT s AS score, round(sum(n) OVER w / sum(n) OVER (), 8) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr FROM s WINDOW w AS (ORDER BY s DESC)""",
)
def a19r(spark, d):
    r = A.roc_points(_classes(spark, d), "y", "s")
    return r.select("score", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


@query("A19_confusion_table", f"WITH {_CLS} SELECT y AS truth, p AS predicted, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 8) AS share FROM c GROUP BY 1, 2")
def a19c(spark, d):
    return A.confusion_table(_classes(spark, d), "y", "p").withColumn("share", F.round("share", 8))


_RES = "r AS (SELECT n_name AS category, s_suppkey AS dataset_id, s_acctbal > 0 AS trained, s_acctbal > 3000 AS passed FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _results(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("category"), F.col("s_suppkey").alias("dataset_id"), (F.col("s_acctbal") > 0).alias("trained"), (F.col("s_acctbal") > 3000).alias("passed"))


@query("A22_category_coverage", f"WITH {_RES} SELECT category, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (trained) AS BIGINT) AS trained, CAST(count(*) FILTER (trained AND passed) AS BIGINT) AS passed, count(*) FILTER (trained AND passed) >= 3 AS gate_ok FROM r GROUP BY 1")
def a22(spark, d):
    return A.category_coverage(_results(spark, d), 3)


@query(
    "A22_run_summary",
    f"""WITH {_RES}, c AS (SELECT category, count(*) AS e, count(*) FILTER (trained) AS t, count(*) FILTER (trained AND passed) AS p FROM r GROUP BY 1)
        SELECT CAST(sum(e) AS BIGINT) AS expected, CAST(sum(t) AS BIGINT) AS trained, CAST(sum(p) AS BIGINT) AS passed, CAST(count(*) FILTER (p >= 3) AS BIGINT) AS categories_ok, sum(t) >= 30 AND count(*) FILTER (p >= 3) >= 5 AS done FROM c""",
)
def a22s(spark, d):
    return A.run_summary(A.category_coverage(_results(spark, d), 3), 30, 5)


@query(
    "A23_dominant_family",
    """WITH w AS (SELECT p_type AS category, CASE WHEN p_size > 25 THEN 'regression' ELSE 'classification' END AS task, p_brand AS family FROM part), t AS (SELECT category, task, count(*) AS n FROM w GROUP BY 1, 2), f AS (SELECT category, family, count(*) AS n FROM w GROUP BY 1, 2)
       SELECT category, (SELECT arg_min(task, (-n, task)) FROM t WHERE t.category = f.category) AS dominant_task_type, arg_min(family, (-n, family)) AS dominant_family, CAST(max(n) AS BIGINT) AS n_selected, CAST(count(*) AS BIGINT) AS n_families,
         CAST(sum(n) AS BIGINT) AS n_workers, max(n) >= 25 AS semantic_ok, CASE WHEN max(n) < 25 THEN 'insufficient_same_family_workers' END AS blocking_reason FROM f GROUP BY category""",
)
def a23(spark, d):
    w = table(spark, d, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") > 25, "regression").otherwise("classification").alias("task_type"), F.col("p_brand").alias("family"))
    return A.dominant_family(w, 25)


@query(
    "A24_history_stats",
    """WITH e AS (SELECT date_trunc('hour', ts) AS rid, ts, CAST(user_id AS VARCHAR) AS worker, value, event_type FROM events), r AS (SELECT * FROM e),
       c AS (SELECT worker, event_type, count(*) AS n FROM r GROUP BY 1, 2)
       SELECT r.worker, CAST(count(*) AS BIGINT) AS runs, round(round(sum(value), 2) / count(*), 4) AS prediction_mean_avg, (SELECT arg_min(event_type, (-n, event_type)) FROM c WHERE c.worker = r.worker) AS dominant_task_type FROM r GROUP BY r.worker""",
)
def a24(spark, d):
    """An hour of events is one report; its users are the workers."""
    runs = table(spark, d, "events").select(
        F.date_trunc("hour", "ts").alias("report_id"), F.col("ts").alias("report_time"), F.col("user_id").cast("string").alias("worker"),
        F.col("value").alias("prediction_mean"), F.lit(0.9).alias("confidence_mean"), F.col("event_type").alias("task_type"),
    )
    h = A.history_stats(runs)
    exact = F.round(F.round(F.col("prediction_mean_avg") * F.col("runs"), 2) / F.col("runs"), 4)
    return h.select("worker", "runs", exact.alias("prediction_mean_avg"), "dominant_task_type")


@query(
    "A25_corpus_stats",
    """SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 1, 2
       UNION ALL SELECT 'quality', coalesce(CAST(quality AS VARCHAR), 'unknown'), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def a25(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return A.corpus_stats(docs, ["lang", "source", "quality"])


@query(
    "A25_coverage_ratio",
    """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (l.doc_id IS NOT NULL) AS BIGINT) AS covered, round(count(*) FILTER (l.doc_id IS NOT NULL) / count(*), 4) AS ratio FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def a25c(spark, d):
    return A.coverage_ratio(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query(
    "A26_status_counts",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'candidate' END AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""",
)
def a26(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("pending review").alias("status"))
    return A.status_counts(o)


@query(
    "A27_qa_rollup",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (value > 20) AS BIGINT) AS n_success, round(coalesce(avg(CASE WHEN value > 5 THEN value / 100 END), 0), 6) AS avg_match, round(avg(value / 200), 6) AS avg_risk,
       round(avg(user_id % 7), 6) AS avg_missing, CAST(count(*) FILTER (user_id % 2 = 0) AS BIGINT) AS n_forecast FROM events GROUP BY 1""",
)
def a27(spark, d):
    v, u = F.col("value"), F.col("user_id")
    runs = table(spark, d, "events").select("event_type", (v > 20).alias("success"), F.when(v > 5, v / 100).alias("match_score"), (v / 200).alias("risk_score"), (u % 7).alias("missing_fields"), (u % 2 == 0).alias("has_forecast"))
    r = A.qa_rollup(runs, "event_type")
    return r.select("event_type", "n", "n_success", "n_forecast", *[F.round(c, 6).alias(c) for c in ("avg_match", "avg_risk", "avg_missing")])


@query(
    "A32_eval_scorecard",
    """WITH s AS (SELECT role AS task_type, CASE WHEN length(text) > 100 THEN 1.0 ELSE 0.0 END AS exact_match, CASE WHEN turn > 2 THEN (length(text) % 10) / 9.0::DOUBLE END AS json_valid, length(text) AS ms FROM conversations)
       SELECT task_type, CAST(count(*) AS BIGINT) AS samples, round(CAST(avg(exact_match) AS DOUBLE), 4) AS exact_match, round(avg(json_valid), 4) AS json_valid, round(avg(ms), 2) AS latency_ms_avg FROM s GROUP BY ROLLUP (task_type)""",
)
def a32(spark, d):
    n = F.length("text")
    s = table(spark, d, "conversations").select(F.col("role").alias("task_type"), F.when(n > 100, 1.0).otherwise(0.0).alias("exact_match"), F.when(F.col("turn") > 2, (n % 10) / 9.0).alias("json_valid"), n.alias("ms"))
    return A.eval_scorecard(s, ["exact_match", "json_valid"], "ms")


@query(
    "A33_chart_aggregate",
    """WITH b AS (SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE AS month, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 10),
       a AS (SELECT l_returnflag, month, round(sum(net), 2) AS sales, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1, 2)
       SELECT l_returnflag, month, sales, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY month) AS BIGINT) AS running, CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total FROM a""",
)
def a33(spark, d):
    out = A.chart_transform(
        table(spark, d, "lineitem"),
        [
            {"filter": {"field": "l_quantity", "gte": 10}},
            {"timeUnit": "month", "field": "l_shipdate", "as": "month"},
            {"calculate": {"op": "-", "left": 1, "right": {"field": "l_discount"}}, "as": "keep"},
            {"calculate": {"op": "*", "left": {"field": "l_extendedprice"}, "right": {"field": "keep"}}, "as": "net"},
            {"aggregate": [{"op": "sum", "field": "net", "as": "sales"}, {"op": "count", "as": "n"}], "groupby": ["l_returnflag", "month"]},
            {"window": [{"op": "sum", "field": "n", "as": "running"}], "groupby": ["l_returnflag"], "sort": [{"field": "month"}]},
            {"joinaggregate": [{"op": "sum", "field": "n", "as": "total"}], "groupby": ["l_returnflag"]},
        ],
    )
    return out.select("l_returnflag", "month", F.round("sales", 2).alias("sales"), "n", "running", "total")


@query(
    "A33_chart_pivot_fold",
    """WITH p AS (SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1),
       f AS (SELECT o_orderpriority, 'F' AS status, F AS amount FROM p UNION ALL SELECT o_orderpriority, 'O', O FROM p UNION ALL SELECT o_orderpriority, 'P', P FROM p)
       SELECT o_orderpriority, status, amount, round(sum(amount) OVER (PARTITION BY o_orderpriority ORDER BY status), 2) AS high, round(sum(amount) OVER (PARTITION BY o_orderpriority ORDER BY status) - amount, 2) AS low FROM f""",
)
def a33p(spark, d):
    out = A.chart_transform(
        table(spark, d, "orders"),
        [
            {"pivot": "o_orderstatus", "value": "o_totalprice", "op": "sum", "groupby": ["o_orderpriority"], "values": ["F", "O", "P"]},
            {"fold": ["F", "O", "P"], "as": ["status", "amount"]},
            {"stack": "amount", "groupby": ["o_orderpriority"], "sort": [{"field": "status"}], "as": ["low", "high"]},
        ],
    )
    return out.select("o_orderpriority", "status", *[F.round(c, 2).alias(c) for c in ("amount", "low", "high")])


@query(
    "A33_chart_bin",
    """WITH r AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem)
       SELECT round(lo + least(floor((l_quantity - lo) / w), 6) * w, 6) AS bin_start, CAST(count(*) AS BIGINT) AS n FROM lineitem, r GROUP BY 1""",
)
def a33b(spark, d):
    out = A.chart_transform(
        table(spark, d, "lineitem"),
        [{"bin": {"maxbins": 7}, "field": "l_quantity", "as": "bin_start"}, {"aggregate": [{"op": "count", "as": "n"}], "groupby": ["bin_start"]}],
    )
    return out.select(F.round("bin_start", 6).alias("bin_start"), "n")


@query("A33_chart_hour", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def a33h(spark, d):
    return A.chart_transform(table(spark, d, "events"), [{"timeUnit": "hour", "field": "ts", "as": "hour"}, {"aggregate": [{"op": "count", "as": "n"}], "groupby": ["hour"]}])


@query(
    "A33_chart_windows",
    """SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, lag(o_totalprice) OVER k AS before, lead(o_totalprice, 2) OVER k AS after, round(avg(o_totalprice) OVER f + 0.0001, 2) AS mean,
         min(o_totalprice) OVER f AS low, max(o_totalprice) OVER f AS high, first_value(o_totalprice) OVER f AS first, last_value(o_totalprice) OVER f AS last FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus), k AS (PARTITION BY o_custkey ORDER BY o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
)
def a33w(spark, d):
    price = "o_totalprice"
    by_key = [("lag", "before", 1), ("lead", "after", 2), ("mean", "mean", None), ("min", "low", None), ("max", "high", None), ("first_value", "first", None), ("last_value", "last", None)]
    ops = [{"op": op, "field": price, "as": name, **({"param": n} if n else {})} for op, name, n in by_key]
    steps = [
        {"window": [{"op": "rank", "as": "rank"}, {"op": "dense_rank", "as": "dense_rank"}], "sort": [{"field": "o_orderstatus"}], "groupby": ["o_custkey"]},
        {"window": ops, "sort": [{"field": "o_orderkey"}], "groupby": ["o_custkey"]},
    ]
    out = A.chart_transform(table(spark, d, "orders"), steps)
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"), "before", "after", F.round(F.col("mean") + 0.0001, 2).alias("mean"), "low", "high", "first", "last")


@query(
    "A34_conversation_summary",
    """SELECT conv_id, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS total_questions, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS answered,
       CAST(count(*) FILTER (role = 'user' AND length(text) > 80) AS BIGINT) AS user_provided, CAST(count(*) FILTER (role = 'user' AND length(text) <= 80) AS BIGINT) AS benchmark_default,
       CAST(greatest(0, count(*) FILTER (role = 'assistant') - count(*) FILTER (role = 'user')) AS BIGINT) AS unresolved FROM conversations GROUP BY conv_id""",
)
def a34(spark, d):
    c = table(spark, d, "conversations").withColumn("source", F.when(F.length("text") > 80, "user_provided").otherwise("benchmark_default"))
    return A.conversation_summary(c, "conv_id", "role", "source")
