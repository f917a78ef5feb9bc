"""Grouped tables: profiles, series, forecasts, model metrics, gates and report roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.operators.ordering import exact_quantiles, over_ordered, running_max, running_sum
from harborline.operators.profile import per_column

# ---- derived profiles -------------------------------------------------------------------------


def profile_by(
    df: DataFrame, keys: Sequence[str], target: tuple[str, str], extra: dict[str, tuple[str, str]]
) -> DataFrame:
    """Per key set: a target statistic and more, as name -> (sum | mean | std | len, column).

    A sum of nulls is 0 and so its row stays; groups without a target value are dropped; a null
    deviation is 0.
    """

    def stat(kind: str, c: str) -> Column:
        v = F.col(c).cast("double")
        return {"sum": S.sum0(v), "mean": F.avg(v), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "len": F.count(F.lit(1))}[kind]

    name, kind_col = target[0], target[1]
    kind, column = kind_col.split(":")
    out = df.groupBy(*keys).agg(stat(kind, column).alias(name), *[stat(k, c).alias(n) for n, (k, c) in extra.items()])
    return out.filter(F.col(name).isNotNull() & ~F.isnan(name))


# ---- series -----------------------------------------------------------------------------------


def monthly_trend(df: DataFrame, time: str, value: str, keep: int | None = None, min_points: int = 1) -> DataFrame:
    """Monthly means (t, y), of the last `keep` months if given; empty below `min_points` rows or months."""
    v = F.col(value).try_cast("double")
    monthly = (
        df.filter(F.col(time).isNotNull() & v.isNotNull())
        .groupBy(F.date_trunc("month", time).cast("date").alias("t"))
        .agg(F.avg(v).alias("y"), F.count(F.lit(1)).alias("_n"))
    )
    # One row per calendar month, so windows over it stay small at any scale.
    every = Window.partitionBy(F.lit(0))
    ranked = monthly.select(
        "t", "y",
        F.row_number().over(every.orderBy(F.desc("t"))).alias("_back"),
        F.sum("_n").over(every).alias("_rows"),
        F.count(F.lit(1)).over(every).alias("_months"),
    )
    months = F.col("_months") if keep is None else F.least("_months", F.lit(keep))
    enough = (F.col("_rows") >= min_points) & (months >= min_points)
    return ranked.filter(enough if keep is None else (F.col("_back") <= keep) & enough).select("t", "y")


def resample_mean(df: DataFrame, time: str, columns: Sequence[str], grain: str = "month") -> DataFrame:
    """Period means: `grain` "week" (labelled by its Sunday) or "month" (by its first day)."""
    values = df.filter(F.col(time).isNotNull())
    if grain not in ("week", "month"):
        raise ValueError(f"unknown grain: {grain}")
    start = F.date_trunc(grain, time).cast("date")
    period = F.date_add(start, 6) if grain == "week" else start
    return values.groupBy(period.alias("t")).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def seasonality(df: DataFrame, time: str, value: str) -> DataFrame:
    """Mean by month of year and by quarter: (grain, period, y)."""
    grains = F.explode(
        F.array(
            F.struct(F.lit("month").alias("grain"), F.month(time).alias("period")),
            F.struct(F.lit("quarter").alias("grain"), F.quarter(time).alias("period")),
        )
    )
    return df.select(grains.alias("g"), F.col(value).alias("_v")).groupBy("g.grain", "g.period").agg(F.avg("_v").alias("y"))


def linear_forecast(series: DataFrame, horizon: int = 90, step: str = "index", min_points: int = 2) -> DataFrame:
    """(t, y_hat, step) for `horizon` days after the last point of a small (t, y) series.

    Least squares over the point index; with fewer than `min_points` points, or a single one, the mean. With step="index" each
    future day advances one index step although points are months apart (the documented quirk);
    step="date" fits and extends over dates instead.
    """
    every = Window.partitionBy(F.lit(0))
    at = F.row_number().over(every.orderBy("t")) - 1
    x = at if step == "index" else F.date_diff("t", F.min("t").over(every))
    indexed = series.select("t", "y", x.cast("double").alias("x"))
    fit = indexed.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("y").alias("mean"),
        F.count(F.lit(1)).alias("n"), F.max("t").alias("last"), F.max("x").alias("x_last"),
    ).filter(F.col("n") > 0)
    future = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    line = F.col("intercept") + F.col("slope") * (F.col("x_last") + F.col("step"))
    return future.select(
        F.date_add("last", F.col("step")).alias("t"), "step", F.when(F.col("n") >= min_points, F.coalesce(line, F.col("mean"))).otherwise(F.col("mean")).alias("y_hat")
    )


# ---- ensembles and predictions ------------------------------------------------------------------------


def ensemble_regression(preds: DataFrame, norm: DataFrame) -> DataFrame:
    """preds(row_id, worker, y_hat, conf), norm(worker, mean, std): confidence-weighted value per row."""
    joined = preds.join(norm, "worker", "left")
    std = F.coalesce("std", F.lit(1.0))
    std = F.when(F.abs(std) < 1e-8, 1.0).otherwise(std)
    value = F.col("y_hat") * std + F.coalesce("mean", F.lit(0.0))
    total = F.sum("conf")
    return joined.groupBy("row_id").agg((F.sum(value * F.col("conf")) / F.when(total <= 1e-8, 1.0).otherwise(total)).alias("prediction"))


def ensemble_classification(probs: DataFrame) -> DataFrame:
    """probs(row_id, class, prob, conf) -> (row_id, class, probability): best class, the lowest on a tie."""
    total = F.sum("conf")
    per_class = probs.groupBy("row_id", "class").agg(
        (F.sum(F.col("prob") * F.col("conf")) / F.when(total <= 1e-8, 1.0).otherwise(total)).alias("p")
    )
    best = per_class.groupBy("row_id").agg(F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("b"))
    return best.select("row_id", (-F.col("b.c")).alias("class"), F.col("b.p").alias("probability"))


def regression_summary(df: DataFrame, prediction: str) -> DataFrame:
    quantiles = exact_quantiles(df, [prediction], [0.05, 0.50, 0.95])[prediction]
    v = F.col(prediction)
    return df.agg(
        F.count(v).alias("n_rows"), F.avg(v).alias("prediction_mean"), F.stddev_pop(v).alias("prediction_std"), F.min(v).alias("prediction_min"), F.max(v).alias("prediction_max")
    ).withColumns({f"prediction_p{p}": F.lit(q).cast("double") for p, q in zip(("05", "50", "95"), quantiles)})


def class_summary(df: DataFrame, label: str, probability: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_confidence"))


def worker_summary(df: DataFrame, worker: str, prediction: str, conf: str) -> DataFrame:
    return df.groupBy(F.col(worker).alias("worker")).agg(
        F.avg(prediction).alias("prediction_mean"), F.stddev_pop(prediction).alias("prediction_std"), F.avg(conf).alias("confidence_mean"), F.count(F.lit(1)).alias("n_rows")
    )


# ---- metrics and gates -----------------------------------------------------------------------------------


def classification_report(df: DataFrame, y: str, y_hat: str, score: str | None = None) -> DataFrame:
    """accuracy, macro f1, mcc and, for 0/1 labels with a score, roc_auc.

    The confusion table has a row per pair of classes; AUC sums ranks over distinct scores. Neither
    sorts the data rows themselves.
    """
    pairs = df.filter(F.col(y).isNotNull() & F.col(y_hat).isNotNull()).groupBy(F.col(y).alias("t"), F.col(y_hat).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("c"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("pred"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("c").agg(F.sum("truth").alias("truth"), F.sum("pred").alias("pred"), F.sum("hit").alias("hit"))
    f1 = F.when(F.col("truth") + F.col("pred") > 0, 2.0 * F.col("hit") / (F.col("truth") + F.col("pred"))).otherwise(0.0)
    d = lambda c: F.sum(c.cast("double"))
    one = per_class.agg(
        F.sum("truth").cast("double").alias("n"), F.sum("hit").cast("double").alias("hits"), F.avg(f1).alias("f1_score"),
        d(F.col("truth").cast("double") * F.col("pred")).alias("tp"), d(F.col("truth").cast("double") * F.col("truth")).alias("tt"), d(F.col("pred").cast("double") * F.col("pred")).alias("pp"),
    )
    n2 = F.col("n") * F.col("n")
    spread = F.sqrt((n2 - F.col("pp")) * (n2 - F.col("tt")))
    report = one.select(
        F.try_divide("hits", "n").alias("accuracy"), "f1_score",
        F.when(spread > 0, (F.col("hits") * F.col("n") - F.col("tp")) / spread).otherwise(0.0).alias("mcc"),
    )
    if score is None:
        return report.withColumn("roc_auc", F.lit(None).cast("double"))
    auc = roc_auc(df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()), y, score)
    return report.withColumn("roc_auc", F.lit(auc).cast("double"))


def roc_auc(df: DataFrame, y: str, score: str) -> float | None:
    """Share of (positive, negative) pairs ranked right, ties counting half."""
    by_score = df.groupBy(F.col(score).alias("_s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) != 1).cast("long")).alias("_n"))
    ranked = running_sum(by_score, [], ["_s"], {"_upto": F.col("_n")})
    wins = F.col("_p").cast("double") * ((F.col("_upto") - F.col("_n")) + F.col("_n") / 2.0)
    row = ranked.agg(F.sum(wins).alias("w"), F.sum("_p").alias("p"), F.sum("_n").alias("n")).first()
    return row["w"] / (row["p"] * row["n"]) if row["p"] and row["n"] else None


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, fpr, tpr): rates when that score and all above count as positive, one row per distinct score."""
    by_score = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) != 1).cast("long")).alias("_n")
    )
    totals = by_score.agg(F.sum("_p"), F.sum("_n")).first()
    ranked = running_sum(by_score.withColumn("_order", -F.col("score")), [], ["_order"], {"_tp": F.col("_p"), "_fp": F.col("_n")})
    rate = lambda c, total: F.try_divide(F.col(c).cast("double"), F.lit(float(total or 0)))
    return ranked.select("score", rate("_fp", totals[1]).alias("fpr"), rate("_tp", totals[0]).alias("tpr"))


def confusion_table(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """(truth, predicted, n, share): counts per pair of classes, and their share of the true class."""
    pairs = df.filter(F.col(y).isNotNull() & F.col(y_hat).isNotNull()).groupBy(F.col(y).alias("truth"), F.col(y_hat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    # A class has as many rows as there are classes.
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def regression_report(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """r2, and rmse and mae over the target's range (the normaliser chosen here), and residual extremes."""
    t, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(y_hat).cast("double")
    one = df.filter(F.col(y).isNotNull() & F.col(y_hat).isNotNull()).agg(
        F.sum(e * e).alias("sse"), F.var_pop(t).alias("var"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
        (F.max(t) - F.min(t)).alias("range"), F.avg(e).alias("mean_residual"), F.max(F.abs(e)).alias("max_abs_residual"),
    )
    spread = F.when(F.col("range") > 0, F.col("range")).otherwise(1.0)
    return one.select(
        F.when(F.col("var") > 0, 1.0 - F.col("sse") / (F.col("var") * F.col("n"))).otherwise(0.0).alias("r2"),
        (F.sqrt(F.col("sse") / F.col("n")) / spread).alias("rmse_normalized"),
        (F.col("mae") / spread).alias("mae_normalized"), "mean_residual", "max_abs_residual",
    )


# Gate levels (minimum, good, excellent) per industry, task and metric.
_EASIER = [
    ("classification", "accuracy", 0.85, 0.90, 0.94), ("classification", "f1_score", 0.85, 0.90, 0.94), ("classification", "mcc", 0.65, 0.75, 0.84),
    ("classification", "roc_auc", 0.85, 0.90, 0.95), ("regression", "r2", 0.85, 0.90, 0.94), ("regression", "rmse_normalized", 0.16, 0.12, 0.08),
    ("regression", "mae_normalized", 0.13, 0.10, 0.06),
]
THRESHOLDS = {
    "ecommerce": [
        ("classification", "accuracy", 0.90, 0.92, 0.95), ("classification", "f1_score", 0.90, 0.91, 0.94), ("classification", "mcc", 0.75, 0.78, 0.86),
        ("classification", "roc_auc", 0.90, 0.93, 0.97), ("regression", "r2", 0.90, 0.92, 0.95), ("regression", "rmse_normalized", 0.12, 0.10, 0.07),
        ("regression", "mae_normalized", 0.10, 0.08, 0.05),
    ],
    "aviation": [
        ("classification", "accuracy", 0.90, 0.90, 0.95), ("classification", "f1_score", 0.90, 0.88, 0.93), ("classification", "mcc", 0.75, 0.75, 0.85),
        ("classification", "roc_auc", 0.90, 0.92, 0.97), ("regression", "r2", 0.90, 0.85, 0.92), ("regression", "rmse_normalized", 0.12, 0.12, 0.08),
        ("regression", "mae_normalized", 0.10, 0.10, 0.06),
    ],
    "shipping_freight": _EASIER,
    "trucking_delivery": _EASIER,
}
# Limits of an industry's own metrics, by domain.
_ROADS = {"eta": {"mape": 0.12}, "safety": {"incident_recall_min": 0.88}, "cold_chain": {"excursion_recall_min": 0.90}}
DOMAIN_THRESHOLDS = {
    "ecommerce": {"conversion": {"uplift_min": 0.05}, "inventory": {"stockout_precision_min": 0.90}, "fraud": {"fraud_recall_min": 0.90}},
    "aviation": {"predictive_maintenance": {"rul_accuracy": 0.95, "rul_rmse_cycles": 15.0}, "sentiment": {"f1_multiclass": 0.85}, "demand_forecasting": {"mape": 0.10}},
    "shipping_freight": _ROADS,
    "trucking_delivery": _ROADS,
}
# The deciding metric, and metrics where less is better.
TIERS = ["minimum", "good", "excellent"]
PRIMARY_METRIC = {"classification": "f1_score"}
LOWER_IS_BETTER = ["rmse_normalized", "mae_normalized", "mape", "rmse", "mae", "rul_rmse_cycles"]


def thresholds(df: DataFrame, tier: str, industry: str = "ecommerce") -> DataFrame:
    """(task_type, metric, threshold, is_primary) of an industry's tier."""
    i = TIERS.index(tier)
    rows = [(task, metric, levels[i], PRIMARY_METRIC.get(task) == metric) for task, metric, *levels in THRESHOLDS[industry]]
    return df.sparkSession.createDataFrame(rows, "task_type string, metric string, threshold double, is_primary boolean")


def benchmark_gate(metrics: DataFrame, limits: DataFrame, model: str = "model") -> DataFrame:
    """metrics(model, task_type, metric, value) against limits(task_type, metric, threshold, is_primary)."""
    held = metrics.filter(F.col("value").isNotNull()).join(limits, ["task_type", "metric"])
    passed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return held.withColumn("passed", passed).select(model, "task_type", "metric", "value", "threshold", "is_primary", "passed")


def domain_gate(metrics: DataFrame, industry: str, model: str = "model") -> DataFrame:
    """metrics(model, domain, metric, value) against the industry's domain limits; other metrics are passed over."""
    rows = [(domain, metric, float(limit)) for domain, limits in DOMAIN_THRESHOLDS[industry].items() for metric, limit in limits.items()]
    limits = metrics.sparkSession.createDataFrame(rows, "domain string, metric string, threshold double")
    held = metrics.filter(F.col("value").isNotNull()).join(limits, ["domain", "metric"])
    passed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return held.withColumn("passed", passed).select(model, "domain", "metric", "value", "threshold", "passed")


def gate_verdict(gate: DataFrame, model: str = "model") -> DataFrame:
    """The primary metric decides; where none is, all must pass."""
    return gate.groupBy(model, "task_type").agg(
        F.coalesce(F.bool_and(F.when(F.col("is_primary"), F.col("passed"))), F.bool_and("passed")).alias("passed"),
        F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_checks"),
    )


def category_coverage(results: DataFrame, min_workers: int) -> DataFrame:
    """results(category, dataset_id, trained, passed): counts, and whether enough workers passed."""
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("trained").alias("trained"), F.count_if(F.col("trained") & F.col("passed")).alias("passed"),
        (F.count_if(F.col("trained") & F.col("passed")) >= min_workers).alias("gate_ok"),
    )


def run_summary(coverage: DataFrame, min_datasets: int, min_categories: int) -> DataFrame:
    return coverage.agg(
        F.sum("expected").alias("expected"), F.sum("trained").alias("trained"), F.sum("passed").alias("passed"), F.count_if("gate_ok").alias("categories_ok"),
        ((F.sum("trained") >= min_datasets) & (F.count_if("gate_ok") >= min_categories)).alias("done"),
    )


def dominant_family(workers: DataFrame, min_workers: int) -> DataFrame:
    """workers(category, task_type, family): leading task and family (most, then by name) and whether enough share it."""
    lead = lambda c, n: F.max_by(c, F.struct(n, F.lit(1)))  # noqa: E731,F841
    tasks = workers.groupBy("category", "task_type").agg(F.count(F.lit(1)).alias("n"))
    families = workers.groupBy("category", "family").agg(F.count(F.lit(1)).alias("n"))
    task = tasks.groupBy("category").agg(F.min_by("task_type", F.struct(-F.col("n"), "task_type")).alias("dominant_task_type"))
    family = families.groupBy("category").agg(
        F.min_by("family", F.struct(-F.col("n"), "family")).alias("dominant_family"), F.max("n").alias("n_selected"), F.count(F.lit(1)).alias("n_families"), F.sum("n").alias("n_workers")
    )
    ok = F.col("n_selected") >= min_workers
    return task.join(family, "category").withColumns({"semantic_ok": ok, "blocking_reason": F.when(~ok, "insufficient_same_family_workers")})


def history_stats(runs: DataFrame, newest: int | None = None) -> DataFrame:
    """runs(report_id, report_time, worker, prediction_mean, confidence_mean, task_type): per worker, over all reports or the newest."""
    recent = runs.filter(F.trim("worker") != "")
    if newest is not None:
        reports = runs.groupBy("report_id").agg(F.max("report_time").alias("_t")).orderBy(F.desc("_t"), F.desc("report_id")).limit(newest)
        recent = recent.join(reports.select("report_id"), "report_id", "left_semi")
    m = F.coalesce("prediction_mean", F.lit(0.0))
    stats = recent.groupBy("worker").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(m), 6).alias("prediction_mean_avg"), F.round(F.avg(F.abs(m)), 6).alias("prediction_mean_abs_avg"),
        F.round(F.avg(F.coalesce("confidence_mean", F.lit(0.0))), 6).alias("confidence_avg"),
    )
    tasks = recent.filter(F.col("task_type") != "").groupBy("worker", F.lower("task_type").alias("task_type")).agg(F.count(F.lit(1)).alias("n"))
    top = tasks.groupBy("worker").agg(F.min_by("task_type", F.struct(-F.col("n"), "task_type")).alias("dominant_task_type"))
    return stats.join(top, "worker", "left")


def corpus_stats(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value, n): counts by each dimension from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in dims]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def coverage_ratio(known: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """(total, covered, ratio): distinct known keys that occur."""
    keys = known.select(*on).distinct()
    covered = seen.select(*on).distinct().withColumn("_c", F.lit(1))
    joined = keys.join(covered, list(on), "left")
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count("_c").alias("covered")).withColumn(
        "ratio", F.round(F.col("covered") / F.greatest("total", F.lit(1)), 4)
    )


STATUSES = ["candidate", "approved", "rejected"]


def status_counts(registry: DataFrame, status: str = "status") -> DataFrame:
    low = F.lower(F.coalesce(F.col(status), F.lit("candidate")))
    return registry.groupBy(F.when(low.isin(*STATUSES), low).otherwise("candidate").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def qa_rollup(runs: DataFrame, by: str) -> DataFrame:
    """runs(success, match_score, risk_score, missing_fields, has_forecast) per industry."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), zero("match_score").alias("avg_match"), zero("risk_score").alias("avg_risk"),
        zero("missing_fields").alias("avg_missing"), F.count_if("has_forecast").alias("n_forecast"),
    )


def eval_scorecard(scored: DataFrame, metrics: Sequence[str], latency: str) -> DataFrame:
    """Mean of each metric overall (task_type null) and per task type, nulls skipped."""
    return scored.rollup("task_type").agg(
        F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], F.round(F.avg(latency), 2).alias("latency_ms_avg")
    )


def conversation_summary(turns: DataFrame, conv: str, role: str, source: str) -> DataFrame:
    """Per conversation: questions asked, answers by source, and what is left open."""
    asked = F.count_if(F.col(role) == "assistant")
    answered = F.count_if(F.col(role) == "user")
    return turns.groupBy(conv).agg(
        asked.alias("total_questions"), answered.alias("answered"),
        F.count_if((F.col(role) == "user") & (F.col(source) == "user_provided")).alias("user_provided"),
        F.count_if((F.col(role) == "user") & (F.col(source) == "benchmark_default")).alias("benchmark_default"),
        F.greatest(F.lit(0), asked - answered).alias("unresolved"),
    )


# ---- chart transforms ----------------------------------------------------------------------------------------

AGGREGATES = {
    "sum": lambda c: F.sum(c), "mean": lambda c: F.avg(c), "average": lambda c: F.avg(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c),
    "count": lambda c: F.count(F.lit(1)), "distinct": lambda c: F.count_distinct(c), "stdev": lambda c: F.stddev_samp(c), "stdevp": lambda c: F.stddev_pop(c),
}
COMPARISONS = {
    "equal": lambda a, b: a == b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "oneOf": lambda a, b: a.isin(*b), "range": lambda a, b: a.between(*b),
}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}
TIME_UNITS = {"year": "year", "quarter": "quarter", "month": "month", "week": "week", "day": "day", "hour": "hour"}


def _window_op(df: DataFrame, group: list[str], keys: list[str], op: dict) -> DataFrame:
    """One window column, over all rows up to the current one; every form also works in blocks when a group is large."""
    kind, name, field = op["op"], op["as"], op.get("field")
    if kind in ("sum", "count", "row_number"):
        return running_sum(df, group, keys, {name: F.col(field) if kind == "sum" else F.lit(1)})
    if kind == "mean":
        known = F.col(field).isNotNull().cast("long")
        both = running_sum(df, group, keys, {"_total": F.col(field), "_known": known})
        return both.withColumn(name, F.try_divide(F.col("_total"), F.col("_known"))).drop("_total", "_known")
    if kind == "max":
        return running_max(df, group, keys, {name: F.col(field)})
    if kind == "min":
        return running_max(df, group, keys, {name: -F.col(field)}).withColumn(name, -F.col(name))
    if kind in ("lag", "lead"):
        n = int(op.get("param", 1))
        step = F.lag if kind == "lag" else F.lead
        return over_ordered(df, group, keys, lambda w: {name: step(field, n).over(w)}, before=n if kind == "lag" else 0, after=n if kind == "lead" else 0)
    if kind == "last_value":  # the frame ends at the row itself
        return df.withColumn(name, F.col(field))
    if kind == "first_value":
        first = df.groupBy(*group).agg(F.min_by(field, F.struct(*keys)).alias(name))
        return df.join(first, group, "left") if group else df.crossJoin(F.broadcast(first))
    if kind in ("rank", "dense_rank"):
        same = lambda w: F.coalesce(F.lag(F.struct(*keys)).over(w) == F.struct(*keys), F.lit(False))
        marked = over_ordered(df, group, keys, lambda w: {"_new": (~same(w)).cast("long")}, before=1)
        if kind == "dense_rank":
            return running_sum(marked, group, keys, {name: F.col("_new")}).drop("_new")
        numbered = running_sum(marked, group, keys, {"_row": F.lit(1)})
        return running_max(numbered, group, keys, {name: F.when(F.col("_new") == 1, F.col("_row"))}).drop("_new", "_row")
    raise ValueError(f"unknown window operator: {kind}")


def _operand(v) -> Column:
    return F.col(v["field"]) if isinstance(v, dict) else F.lit(v)


def chart_transform(df: DataFrame, steps: Sequence[dict], order_by: Sequence[str] = ()) -> DataFrame:
    """Apply declarative chart steps. Only the operators tabled above are known; no text is evaluated."""
    for step in steps:
        df = _chart_step(df, step, list(order_by))
    return df


def _chart_step(df: DataFrame, step: dict, order: list[str]) -> DataFrame:
    group = list(step.get("groupby", []))
    if "filter" in step:
        f = step["filter"]
        op = next(k for k in f if k in COMPARISONS)
        return df.filter(COMPARISONS[op](F.col(f["field"]), f[op]))
    if "aggregate" in step:
        return df.groupBy(*group).agg(*[AGGREGATES[a["op"]](a.get("field")).alias(a["as"]) for a in step["aggregate"]])
    if "joinaggregate" in step:
        stats = df.groupBy(*group).agg(*[AGGREGATES[a["op"]](a.get("field")).alias(a["as"]) for a in step["joinaggregate"]])
        return df.join(stats, group, "left") if group else df.withColumns({k: F.lit(v) for k, v in stats.first().asDict().items()})
    if "window" in step:
        keys = [s["field"] for s in step.get("sort", [])] or order
        for w in step["window"]:
            df = _window_op(df, group, keys, w)
        return df
    if "calculate" in step:
        c = step["calculate"]
        return df.withColumn(step["as"], ARITHMETIC[c["op"]](_operand(c["left"]), _operand(c["right"])))
    if "timeUnit" in step:
        start = F.date_trunc(TIME_UNITS[step["timeUnit"]], step["field"])
        return df.withColumn(step["as"], start.cast("timestamp_ntz") if step["timeUnit"] == "hour" else start.cast("date"))
    if "bin" in step:
        v, n = F.col(step["field"]).cast("double"), int(step["bin"].get("maxbins", 10))
        ends = df.agg(F.min(v), F.max(v)).first()
        if ends[0] is None:
            return df.withColumn(step["as"], F.lit(None).cast("double"))
        width = (ends[1] - ends[0]) / n or 1.0
        at = F.least(F.floor((v - ends[0]) / width), F.lit(n - 1))
        return df.withColumn(step["as"], F.lit(ends[0]) + at * F.lit(width))
    if "fold" in step:
        key, value = step.get("as", ["key", "value"])
        return df.unpivot([c for c in df.columns if c not in step["fold"]], step["fold"], key, value)
    if "pivot" in step:
        agg = AGGREGATES[step.get("op", "sum")](step["value"])
        return df.groupBy(*group).pivot(step["pivot"], step.get("values")).agg(agg)
    if "stack" in step:
        low, high = step["as"]
        keys = [s["field"] for s in step.get("sort", [])] or order
        stacked = running_sum(df, group, keys, {high: F.col(step["stack"])})
        return stacked.withColumn(low, F.col(high) - F.coalesce(F.col(step["stack"]), F.lit(0)))
    raise ValueError(f"unknown chart step: {sorted(step)}")
