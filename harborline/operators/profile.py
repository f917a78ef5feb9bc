"""Table profiles. Each block is one aggregation over the table, unpivoted afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions import scalars as S
from harborline.operators.ordering import POS, positions

MISSING_FIELD_RATIO = 0.35


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def per_column(df: DataFrame, columns: Sequence[str], stats: dict[str, callable], shared: dict[str, Column] | None = None) -> DataFrame:
    """One row per column with the named statistics, from a single pass.

    `stats` maps an output name to a function of a column name; `shared` adds table-wide values.
    """
    shared = shared or {}
    one = df.agg(
        *[fn(c).alias(f"{i}_{s}") for i, c in enumerate(columns) for s, fn in stats.items()],
        *[v.alias(f"t_{s}") for s, v in shared.items()],
    )
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column_name"),
            *[F.col(f"{i}_{s}").alias(s) for s in stats],
            *[F.col(f"t_{s}").alias(s) for s in shared],
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schema_summary(df: DataFrame) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = per_column(df, df.columns, {"null_count": lambda c: F.count_if(F.col(c).isNull())}, {"n_rows": F.count(F.lit(1))})
    named = F.create_map(*[F.lit(v) for kv in types.items() for v in kv])
    return nulls.select(
        "ordinal",
        "column_name",
        F.element_at(named, F.col("column_name")).alias("dtype"),
        "null_count",
        F.round(F.when(F.col("n_rows") > 0, F.col("null_count") / F.col("n_rows")).otherwise(0.0), 6).alias("null_ratio"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
    )


def numeric_profile(df: DataFrame, limit: int | None = None) -> DataFrame:
    """mean, sample deviation, min, max of all numeric columns, or of the first `limit`."""
    cols = numeric_columns(df)[:limit]
    return per_column(
        df,
        cols,
        {
            "mean": lambda c: F.avg(c),
            "std": lambda c: F.stddev_samp(c),
            "min": lambda c: F.min(F.col(c).cast("double")),
            "max": lambda c: F.max(F.col(c).cast("double")),
        },
    )


def top_values(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """The k most frequent values of each text column; ties by value."""
    cols = list(columns or text_columns(df))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = (
        df.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quality(df: DataFrame) -> DataFrame:
    """completeness, gap ratio, fields missing too often and a band."""
    one = schema_summary(df).agg(
        F.avg("null_ratio").alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("null_ratio") > MISSING_FIELD_RATIO, F.struct("ordinal", "column_name")))).alias("f"),
    )
    completeness = S.clamp(1.0 - F.coalesce("m", F.lit(1.0)), 0.0, 1.0)
    return one.select(
        F.round(completeness, 4).alias("completeness"),
        F.round(S.clamp(1.0 - completeness, 0.0, 1.0), 4).alias("data_gap_ratio"),
        F.concat_ws(",", F.transform("f", lambda x: x["column_name"])).alias("missing_fields"),
        F.when(completeness >= 0.80, "high").when(completeness >= 0.55, "medium").otherwise("low").alias("band"),
    )


def missingness_top(df: DataFrame, k: int | None = None) -> DataFrame:
    """Null ratio of every column, highest first, or of the k highest."""
    ranked = schema_summary(df).orderBy(F.desc("null_ratio"), F.desc("ordinal")).select("column_name", "null_ratio")
    return ranked.limit(k) if k else ranked


def distribution_hints(df: DataFrame, target: str) -> DataFrame:
    c = F.col(target)
    if is_numeric(df.schema[target].dataType):
        v = c.cast("double")
        one = df.filter(c.isNotNull()).agg(
            F.count(c).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std")
        )
        hints = F.array(
            F.when((F.col("min") >= 0) & (F.col("max") <= 1), "bounded_ratio_target"),
            F.when(F.col("max") > 100_000, "high_magnitude_target"),
            F.when(F.col("min") >= 0, "non_negative_target"),
        )
        return one.select(
            "n",
            *[F.round(F.coalesce(F.col(s), F.lit(0.0)), 6).alias(s) for s in ("mean", "min", "max", "std")],
            F.concat_ws(",", hints).alias("hints"),
        )
    one = df.filter(c.isNotNull()).agg(F.count(c).alias("n"), F.count_distinct(c).alias("n_unique"))
    return one.withColumn("hints", F.when(F.col("n") > 0, "categorical_or_text_target").otherwise(""))


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def max_pair_correlation(df: DataFrame, columns: Sequence[str], limit: float = 0.995) -> DataFrame:
    return pair_correlations(df, columns).agg(F.max(F.abs("corr")).alias("max_corr")).select(
        "max_corr", F.coalesce(F.col("max_corr") >= limit, F.lit(False)).alias("too_correlated")
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the column's range; the top value falls in the last bin; empty bins show 0."""
    v = F.col(column).cast("double")
    values = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = values.agg(F.min("v"), F.max("v")).first()
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, hi = float(ends[0]), float(ends[1])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col("v") - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# Name parts that mark a time column, and the limits for a number to be a category.
TEMPORAL_PARTS = ["date", "time", "year", "month", "day", "hour", "timestamp"]
CATEGORY_MAX_DISTINCT = 20
CATEGORY_MAX_SHARE = 0.05


SKETCH_ERROR = 0.02


def distinct_against(df: DataFrame, columns: Sequence[str], limits: callable, value: callable = F.col, nulls: bool = True) -> tuple[int, dict[str, int]]:
    """Rows, and distinct values of each column, exact wherever a limit is near and sketched elsewhere.

    One pass sketches all columns. Only a column whose sketch lies within ten of its standard errors of one of
    `limits(rows)` is counted exactly, on its own, so values are not shuffled for the rest. A null is a value if `nulls`.
    """
    if not columns:
        return df.count(), {}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(value(c), SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(columns)],
        *[F.bool_or(value(c).isNull()).alias(f"z{i}") for i, c in enumerate(columns)],
    ).first()
    n, out = row["n"], {}
    for i, c in enumerate(columns):
        about, null = row[f"d{i}"], int(bool(nulls and row[f"z{i}"]))
        if any(abs(about + null - m) <= 10 * SKETCH_ERROR * max(about, m) + 1 for m in limits(n)):
            about = df.select(value(c).alias("v")).filter(F.col("v").isNotNull()).distinct().count()
        out[c] = about + null
    return n, out


def auto_detect_columns(df: DataFrame) -> dict[str, list[str]]:
    """categorical / numeric / temporal column names; distinct values are counted only as closely as the rules need."""
    out: dict[str, list[str]] = {"categorical": [], "numeric": [], "temporal": []}
    kinds: dict[str, str] = {}
    for f in df.schema.fields:
        if any(p in f.name.lower() for p in TEMPORAL_PARTS):
            kinds[f.name] = "temporal"
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "categorical"
        elif is_numeric(f.dataType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "temporal"
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    if numbers:
        n, found = distinct_against(df, numbers, lambda n: [CATEGORY_MAX_DISTINCT, n * CATEGORY_MAX_SHARE])
        for c in numbers:
            if found[c] <= CATEGORY_MAX_DISTINCT and found[c] < n * CATEGORY_MAX_SHARE:
                kinds[c] = "categorical"
    for c, k in kinds.items():
        out[k].append(c)
    return out


# Name parts and what they add to a target's score.
TARGET_NAME_SCORES = [
    (["target", "label"], 2.0),
    (["price", "fare", "revenue"], 1.5),
    (["delay", "rul", "failure"], 1.5),
]
MAX_CLASSES = 50


def column_stats(df: DataFrame) -> DataFrame:
    """Catalogue of a table's columns: ordinal, name, numeric or not, null ratio, distinct values."""
    numeric = numeric_columns(df)
    stats = per_column(
        df, df.columns,
        {"null_count": lambda c: F.count_if(F.col(c).isNull()), "n_distinct": lambda c: S.distinct_with_null(c)},
        {"n_rows": F.count(F.lit(1))},
    )
    return stats.select(
        "ordinal", "column_name", F.col("column_name").isin(*numeric).alias("is_numeric") if numeric else F.lit(False).alias("is_numeric"),
        (F.col("null_count") / F.greatest("n_rows", F.lit(1))).alias("null_ratio"), "n_distinct", "n_rows",
    )


def score_targets(stats: DataFrame) -> DataFrame:
    """Candidates of a column catalogue with score, task and rank (earlier column wins a tie)."""
    from harborline.operators.projections import is_id_like

    name = F.col("column_name")
    score = F.lit(0.0)
    for parts, add in TARGET_NAME_SCORES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        score = score + F.when(hit, add).otherwise(0.0)
    score = score + F.when(F.col("null_ratio") < 0.2, 0.5).otherwise(0.0) + F.when(F.col("n_distinct") > 1, 0.5).otherwise(0.0)
    score = score - F.when(~F.col("is_numeric") & (F.col("n_distinct") > MAX_CLASSES), 5.0).otherwise(0.0)
    task = (
        F.when(F.col("is_numeric") & (F.col("n_distinct") > 20), "regression")
        .when(~F.col("is_numeric") & (F.col("n_distinct") > MAX_CLASSES), "high_cardinality_target")
        .otherwise("classification")
    )
    kept = stats.filter(~is_id_like(name) & (F.col("n_distinct") >= 2)).withColumns({"score": score, "task_type": task})
    # A catalogue of one table: as many rows as the table has columns.
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")))


def select_target(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """The best scored column, of the candidates if any are named."""
    stats = column_stats(df)
    if candidates:
        stats = stats.filter(F.col("column_name").isin(*candidates))
    return score_targets(stats).filter(F.col("rank") == 1)


DATETIME_NAME_PARTS = ["date", "time", "timestamp", "ts", "datetime"]


def field_types(df: DataFrame) -> dict[str, str]:
    """Bundle type of each column, from its schema type and, for text, its name."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            out[f.name] = "boolean"
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[f.name] = "integer"
        elif is_numeric(t):
            out[f.name] = "number"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "datetime"
        else:
            out[f.name] = "datetime" if any(p in f.name.lower() for p in DATETIME_NAME_PARTS) else "string"
    return out


def parse_ratio(df: DataFrame, columns: Sequence[str], parse: callable) -> dict[str, float]:
    """Share of rows each column parses on, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(parse(F.col(c))).alias(c) for c in columns]).first()
    return {c: row[c] / max(1, row["_n"]) for c in columns}


# Name priorities of the dashboard's columns.
TIME_PARTS = ["date", "time", "timestamp", "datetime", "event"]
METRIC_PARTS = ["demand", "volume", "orders", "revenue", "sales", "count", "qty", "churn", "risk", "rate", "score"]
CATEGORY_PARTS = ["category", "segment", "channel", "region", "type", "group"]


def _pick(df: DataFrame) -> dict[str, str | None]:
    fields = df.schema.fields
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)

    def first(test) -> str | None:
        return next((f.name for f in fields if test(f)), None)

    numbers = numeric_columns(df)
    metric = next((c for p in METRIC_PARTS for c in numbers if p in c.lower()), numbers[0] if numbers else None)
    time = first(lambda f: any(p in f.name.lower() for p in TIME_PARTS) or isinstance(f.dataType, dates))
    if time is None:
        texts = text_columns(df)
        ratios = parse_ratio(df, texts, S.parse_datetime) if texts else {}
        time = next((c for c in texts if ratios[c] >= 0.6), None)
    return {
        "time": time,
        "metric": metric,
        "category": first(lambda f: any(p in f.name.lower() for p in CATEGORY_PARTS) or isinstance(f.dataType, T.StringType)),
        "id": first(lambda f: f.name.lower() == "id" or f.name.lower().endswith("_id") or "identifier" in f.name.lower()),
    }


def default_main(df: DataFrame, order_by: Sequence[str], as_of: str = "2024-12-31") -> DataFrame:
    """main(t, metric, category, id) plus the row's position.

    Without a time column rows get consecutive days ending `as_of`; without a metric, their row
    number; unreadable times become `as_of`.
    """
    pick = _pick(df)
    placed = positions(df, order_by)
    if pick["time"] is None:
        n = df.count()
        t = F.date_add(F.lit(as_of).cast("date"), (F.col(POS) - F.lit(n - 1)).cast("int")).cast("timestamp")
    else:
        kind = df.schema[pick["time"]].dataType
        c = F.col(pick["time"])
        parsed = c.cast("timestamp") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else S.parse_datetime(c)
        t = parsed if not isinstance(kind, T.StringType) else F.coalesce(parsed, F.lit(as_of).cast("timestamp"))
    metric = (F.col(POS) + 1).cast("double") if pick["metric"] is None else F.coalesce(S.finite_or_null(F.col(pick["metric"])), F.lit(0.0))
    category = F.lit("All") if pick["category"] is None else F.coalesce(F.col(pick["category"]).cast("string"), F.lit("Unknown"))
    ident = F.concat(F.lit("row_"), (F.col(POS) + 1).cast("string"))
    if pick["id"] is not None:
        ident = F.coalesce(F.col(pick["id"]).cast("string"), ident)
    return placed.select(
        F.col(POS).alias("pos"), S.iso_utc(t).alias("t"), metric.alias("metric"), category.alias("category"), ident.alias("id")
    )


def downsample_positions(n_rows: int, max_rows: int) -> Column:
    """Whether a 0-based position is one of round-half-even(i * (n-1)/(max-1)), i = 0..max-1."""
    if n_rows <= max_rows:
        return F.lit(True)
    if max_rows <= 1:
        return F.col(POS) == 0
    step = (n_rows - 1) / float(max_rows - 1)
    # Only the two indices around pos / step can round to pos.
    low = F.floor(F.col(POS) / F.lit(step))
    hit = F.lit(False)
    for k in (-1, 0, 1, 2):
        i = low + k
        hit = hit | ((i >= 0) & (i <= max_rows - 1) & (F.bround(i.cast("double") * F.lit(step)).cast("long") == F.col(POS)))
    return hit


def uniform_downsample(df: DataFrame, max_rows: int, order_by: Sequence[str]) -> DataFrame:
    """At most `max_rows` rows spread evenly over the order, both ends included."""
    n = df.count()
    return positions(df, order_by).filter(downsample_positions(n, max_rows)).drop(POS)


def kpis(df: DataFrame, metric: str, order_by: Sequence[str], share: float = 0.2) -> DataFrame:
    """baseline (first fifth), current (last fifth), relative delta and a clamped variation ratio."""
    n = df.count()
    split = max(1, int(n * share))
    v = F.col(metric).cast("double")
    one = positions(df, order_by).agg(
        F.avg(F.when(F.col(POS) < split, v)).alias("b"),
        F.avg(F.when(F.col(POS) >= n - split, v)).alias("c"),
        F.stddev_pop(v).alias("s"),
        F.avg(v).alias("m"),
    )
    baseline, current = F.coalesce("b", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    risk = F.coalesce(F.col("s") / (F.abs("m") + 1e-9), F.lit(0.0))
    return one.select(
        baseline.alias("baseline"),
        current.alias("current"),
        S.safe_div(current - baseline, baseline).alias("delta"),
        S.clamp(risk, 0.01, 0.99).alias("risk"),
    )


def kpi_targets(df: DataFrame, order_by: Sequence[str], first: int | None = None, lift: float = 1.08) -> DataFrame:
    """Head and tail fifth means, target and gap for all numeric columns, or for the first few."""
    cols = numeric_columns(df)[:first]
    n = df.count()
    part = max(1, n // 5)
    placed = positions(df, order_by)
    head = lambda c: F.coalesce(F.avg(F.when(F.col(POS) < part, F.col(c).cast("double"))), F.lit(0.0))
    tail = lambda c: F.coalesce(F.avg(F.when(F.col(POS) >= n - part, F.col(c).cast("double"))), F.lit(0.0))
    return per_column(placed, cols, {"baseline": head, "current": tail}).select(
        F.col("column_name").alias("kpi"),
        "baseline",
        "current",
        (F.col("current") * lift).alias("target_30d"),
        (F.col("current") * lift - F.col("current")).alias("gap"),
    )
