"""Further ways to pick a target, each over a column catalogue (see profile.column_stats).

A catalogue has one row per column, so ranking it is small work at any table size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.text import hits
from harborline.operators.projections import LOW_VALUE_EXACT, LOW_VALUE_PATTERNS, any_pattern, is_id_like

# Name parts tried in order, with the task they stand for.
PRIORITY_PARTS = [
    ("converted", "classification"), ("conversion", "classification"), ("purchase", "classification"), ("fraud", "classification"),
    ("chargeback", "classification"), ("risk", "classification"), ("late", "classification"), ("sla_breach", "classification"),
    ("quality", "classification"), ("revenue", "regression"), ("sales", "regression"), ("amount", "regression"), ("price", "regression"),
    ("gmv", "regression"), ("margin", "regression"), ("profit", "regression"),
]
# Name parts of metrics, of class labels and of measured outcomes.
METRIC_PARTS = [
    "value", "volume", "count", "rate", "ratio", "ton", "teu", "weight", "time", "delay", "dwell", "revenue", "cost", "price",
    "amount", "shipment", "passenger", "freight", "index", "capacity",
]
CLASS_PARTS = [
    "label", "target", "class", "fraud", "risk", "converted", "conversion", "delay", "abandon", "status", "sentiment", "review",
    "rating", "score", "flag", "reorder", "reordered",
]
MEASURE_PARTS = ["price", "amount", "sales", "revenue", "cost", "quantity", "time", "duration", "billing", "margin", "gmv", "units"]
# Fixed values of the metric picks: exact names, patterns that speak for and against a column, with their points.
PICKS = {
    "metric": {
        "exact": (["obs_value", "value", "figure", "count", "hours", "hour"], 3.0),
        "for": ("delay|dwell|wait|volume|ton|teu|value|cost|yield|margin|capacity|util|incident|injury|claim|temp", 1.5),
        "against": ("latitude|longitude|^lat$|^lon$|easting|northing|postcode|zip|fips|code$", -4.0),
        "year": (r"^(19|20)\d{2}$", -4.0),
        "lookup": (["price_base", "decimal", "decimals", "unit_mult", "series_no"], -5.0),
    },
    "sample": {
        "exact": (["obs_value", "value", "figure", "count", "hours", "delay", "cost", "revenue", "capacity", "ton"], 2.0),
        "for": ("delay|dwell|wait|volume|ton|value|cost|yield|margin|capacity|util|incident|injury|claim|temp|fuel|speed|flow", 1.0),
        "against": ("lat|lon|longitude|latitude|postcode|zip|fips|code$", -3.0),
        "year": (r"^$", 0.0),
        "lookup": ([], 0.0),
    },
}



def _low() -> Column:
    return F.lower(F.col("column_name"))


def _low_value() -> Column:
    return _low().isin(*LOW_VALUE_EXACT) | any_pattern(_low(), [f"^(?:{p})" for p in LOW_VALUE_PATTERNS])


def _task() -> Column:
    return F.when(F.col("is_numeric") & (F.col("n_distinct") > 20), "regression").otherwise("classification")


def _best(stats: DataFrame, *order: Column, tie: str = "ordinal") -> DataFrame:
    return stats.withColumn("_r", F.row_number().over(Window.orderBy(*order, tie))).filter(F.col("_r") == 1).drop("_r")


def fallback_target(stats: DataFrame) -> DataFrame:
    """(column_name, task_type): the first listed name part present, else the best metric-like number."""
    usable = stats.filter(~is_id_like(F.col("column_name")))
    place, task = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (part, kind) in reversed(list(enumerate(PRIORITY_PARTS))):
        hit = _low().contains(part) & (F.lit(kind == "regression") | (F.col("n_distinct") <= 100))
        place, task = F.when(hit, i).otherwise(place), F.when(hit, kind).otherwise(task)
    named = usable.withColumns({"_place": place, "task_type": task}).filter(F.col("_place").isNotNull())
    present = F.round(F.col("n_rows") * (1 - F.col("null_ratio")))
    numbers = usable.filter(F.col("is_numeric") & (F.col("n_distinct") >= 5) & (present >= F.greatest(F.lit(20), F.floor(F.col("n_rows") * 0.2))))
    metric = numbers.withColumns({"_place": F.lit(len(PRIORITY_PARTS)) + F.when(hits(_low(), METRIC_PARTS) > 0, 0).otherwise(1), "task_type": _task()})
    return _best(named.unionByName(metric), F.col("_place"), F.when(F.col("_place") >= len(PRIORITY_PARTS), -F.col("n_distinct")).otherwise(0), tie="column_name").select("column_name", "task_type")


def scored_targets(stats: DataFrame) -> DataFrame:
    """Candidates with a score from class-like and measure-like name parts and gaps, best first."""
    cls, reg = hits(_low(), CLASS_PARTS), hits(_low(), MEASURE_PARTS)
    usable = stats.filter(~is_id_like(F.col("column_name"))).withColumn("task_type", _task())
    is_class = F.col("task_type") == "classification"
    fits = F.when(is_class, (F.col("n_distinct") >= 2) & (F.col("n_distinct") <= 100)).otherwise(F.col("n_distinct") >= 10)
    own, other = F.when(is_class, cls).otherwise(reg), F.when(is_class, reg).otherwise(cls)
    score = 0.4 + 0.2 * own - 0.1 * F.col("null_ratio") - 0.05 * other
    kept = usable.filter(fits).withColumn("score", score)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")))


def recommend_target(stats: DataFrame, metadata_default: str | None = None, current: str | None = None) -> DataFrame:
    """One row: the source's own default, else the configured target, else the best scored candidate."""
    named = lambda n, conf, why: stats.filter(_low() == n.lower()).select("column_name", _task().alias("task_type"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))
    for name, conf, why in ((metadata_default, "high", "source metadata default target"), (current, "medium", "existing target present")):
        if name:
            found = named(name, conf, why)
            if not found.isEmpty():
                return found
    return scored_targets(stats).filter(F.col("rank") == 1).select("column_name", "task_type", F.lit("medium").alias("confidence"), F.lit("sample heuristic").alias("reason"))


def pick_metric(stats: DataFrame, tokens: Sequence[str], kind: str = "metric") -> DataFrame:
    """(column_name, task_type, score): the numeric column whose name speaks most for a metric, from 1.0 up."""
    p = PICKS[kind]
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    score = (
        points(F.col("is_numeric"), 2.0)
        + points(_low().isin(*p["exact"][0]), p["exact"][1])
        + (points(hits(_low(), tokens) > 0, 1.5) if tokens else F.lit(0.0))
        + points(_low().rlike(p["for"][0]), p["for"][1])
        + points(_low().rlike(p["against"][0]), p["against"][1])
        + points(_low().rlike(p["year"][0]), p["year"][1])
        + (points(_low().isin(*p["lookup"][0]), p["lookup"][1]) if p["lookup"][0] else F.lit(0.0))
    )
    usable = stats.filter(~_low_value()).withColumn("score", score)
    usable = usable.filter(~is_id_like(F.col("column_name")))
    if kind != "metric":
        usable = usable.filter(F.col("is_numeric") & (F.col("n_distinct") >= 4))
    best = _best(usable, F.desc("score")).filter((F.col("score") >= 1.0) & F.col("is_numeric"))
    return best.select("column_name", (F.lit("regression") if kind == "metric" else _task()).alias("task_type"), "score")


def rule_targets(columns: DataFrame, rules: Sequence[tuple[str, int, str]], current: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(column_name, task_type, score) of every column a rule (pattern, priority, task) finds; configured ones score 110.

    Feed to best_by_priority for the three best names. Flag-like names and text columns are classes.
    """
    flagged = hits(_low(), ["flag", "band", "class", "status", "risk_tier", "bucket", "label"]) > 0
    found = []
    for pattern, priority, task in rules:
        kind = F.when(flagged | ~F.col("is_numeric"), "classification").otherwise(task)
        found.append(F.when(_low().rlike(pattern) & ~is_id_like(F.col("column_name")), F.struct(F.lit(priority).alias("score"), kind.alias("task_type"))))
    for name, task in current:
        found.append(F.when(_low() == name.lower(), F.struct(F.lit(110).alias("score"), F.lit(task).alias("task_type"))))
    rows = columns.select("column_name", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("column_name", "f.task_type", "f.score")
