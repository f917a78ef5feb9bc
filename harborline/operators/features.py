"""Feature fitting: each encoder or scaler fits parameters on one table and applies them to any."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions import scalars as S
from harborline.operators.aggregates import classification_report, regression_report, resample_mean
from harborline.operators.ordering import POS, exact_quantiles, positions
from harborline.operators.profile import auto_detect_columns, distinct_against, is_numeric, pair_correlations, parse_ratio
from harborline.operators.projections import clean_target, ensure_columns, filter_in, rename_aliases
from harborline.operators.windows import turning_points
from harborline.session import materialize

# ---- encoders ---------------------------------------------------------------------------------
# Fitted codes are written once. Their size is then known, so Spark sends a small table to every
# task and shuffles only for one too big for that.


def fit_codes(df: DataFrame, column: str, null_as: str | None = None, first: int = 0) -> DataFrame:
    """(value, code): sorted distinct values numbered from `first`."""
    v = F.col(column).cast("string")
    if null_as is not None:
        v = F.coalesce(v, F.lit(null_as))
    values = df.select(v.alias("value")).filter(F.col("value").isNotNull()).distinct()
    return materialize(positions(values, ["value"]).select("value", (F.col(POS) + first).cast("int").alias("code")))


def fit_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, share of rows), null read as "unknown"."""
    n = max(1, df.count())
    shares = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg((F.count(F.lit(1)) / F.lit(n)).alias("code"))
    return materialize(shares)


def apply_codes(df: DataFrame, column: str, params: DataFrame, name: str, unseen: Column | None = None, null_as: str | None = None) -> DataFrame:
    v = F.col(column).cast("string")
    if null_as is not None:
        v = F.coalesce(v, F.lit(null_as))
    keyed = df.withColumn("_value", v)
    code = F.col("code") if unseen is None else F.coalesce("code", unseen)
    joined = keyed.join(params.select(F.col("value").alias("_value"), "code"), "_value", "left")
    return joined.withColumn(name, code).drop("_value", "code")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    return apply_codes(df, column, fit_codes(df, column), f"{column}_encoded")


def ordinal_encode(df: DataFrame, column: str, params: DataFrame | None = None) -> DataFrame:
    """Codes 1..k of the sorted values, null as "unknown", unseen 0."""
    fitted = params if params is not None else fit_codes(df, column, null_as="unknown", first=1)
    return apply_codes(df, column, fitted, f"{column}_ordinal", F.lit(0), null_as="unknown")


def frequency_encode(df: DataFrame, column: str, params: DataFrame | None = None) -> DataFrame:
    fitted = params if params is not None else fit_frequencies(df, column)
    return apply_codes(df, column, fitted, f"{column}_freq", F.lit(0.0), null_as="unknown")


def _flag_name(column: str, value: str) -> str:
    return f"{column}_{value}".replace(" ", "_").lower()


# Flags one call may add: each is a column of the plan. More is an error, never a cut.
MOST_FLAGS = 2_000


def onehot_values(df: DataFrame, column: str, max_categories: int | None = None) -> list[str]:
    """All values, most frequent first, or the `max_categories` most frequent; too many for columns is an error."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(max_categories or MOST_FLAGS + 1).collect()]
    if len(found) > MOST_FLAGS:
        raise ValueError(f"{column} has over {MOST_FLAGS} values: name those wanted, or use another encoder")
    return found


def _one_name_each(names: Sequence[str], taken: Sequence[str]) -> None:
    seen = [n.lower() for n in (*taken, *names)]
    twice = sorted({n for n in seen if seen.count(n) > 1})
    if twice:
        raise ValueError(f"flags would share a name: {twice[:5]}")


def onehot(df: DataFrame, column: str, max_categories: int | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per value; a null value gives null flags. Values whose flags would share a name are an error."""
    found = list(values) if values is not None else onehot_values(df, column, max_categories)
    _one_name_each([_flag_name(column, v) for v in found], df.columns)
    return df.withColumns({_flag_name(column, v): (F.col(column).cast("string") == v).cast("int") for v in found})


def dummies(df: DataFrame, columns: Sequence[str], max_unique: int | None = None, force: Sequence[str] = ()) -> DataFrame:
    """One-hot of every value of the columns, null as "unknown". With `max_unique`, columns of more values stay unless forced."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    most = MOST_FLAGS if max_unique is None else max_unique
    counts = distinct_against(df, list(columns), lambda n: [most, MOST_FLAGS], unknown, nulls=False)[1]
    out = df
    for c in columns:
        if max_unique is not None and c not in force and counts[c] > max_unique:
            continue
        values = [r[0] for r in df.select(unknown(c)).distinct().limit(MOST_FLAGS + 1).collect()]
        if len(values) > MOST_FLAGS:
            raise ValueError(f"{c} has over {MOST_FLAGS} values: use another encoder")
        _one_name_each([f"{c}_{v}" for v in values], [x for x in out.columns if x != c])
        out = out.withColumns({f"{c}_{v}": (unknown(c) == v).cast("int") for v in sorted(values)}).drop(c)
    return out


# Column names taken as free text, and name parts that hint at numbers.
TEXT_NAMES = ["name", "keywords", "summary", "content", "description", "title", "review", "text", "comments", "metar"]
NUMBER_PARTS = [
    "price", "amount", "cost", "rate", "score", "rating", "qty", "quantity", "count", "revenue", "sales",
    "weight", "distance", "time", "duration", "age", "latitude", "longitude", "lat", "lon",
]


def text_like(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns by name, by many distinct values, or by mean length."""
    limit = lambda n: max(1000, int(0.5 * n))
    n, distinct = distinct_against(df, list(columns), lambda n: [limit(n)])
    lengths = df.agg(*[F.avg(F.length(c)).alias(c) for c in columns]).first() if columns else {}
    return [c for c in columns if c.lower() in TEXT_NAMES or distinct[c] > limit(n) or (lengths[c] or 0) > 30]


def text_hash(df: DataFrame, column: str, n: int = 64, name: str | None = None) -> DataFrame:
    """Token counts in n hash buckets as a sparse vector (words of two or more characters)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    keyed = df.withColumn("_words", words)
    out = name or f"{column}_hashed"
    return HashingTF(numFeatures=n, inputCol="_words", outputCol=out).transform(keyed).drop("_words")


def numeric_coercion(df: DataFrame, columns: Sequence[str], min_ratio: float = 0.80, min_parsed: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """Text columns that are mostly numbers become doubles; one pass decides for all."""
    row = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns], *[F.count(S.parse_number(F.col(c))).alias(f"p_{c}") for c in columns]
    ).first()
    chosen = {}
    for c in columns:
        share = row[f"p_{c}"] / max(1, row[f"n_{c}"])
        hinted = any(p in c.lower() for p in NUMBER_PARTS)
        if share >= min_ratio and (hinted or row[f"p_{c}"] >= min_parsed):
            chosen[c] = share
    return df.withColumns({c: S.parse_number(F.col(c)) for c in chosen}), chosen


NOT_IMPUTED = ["id", "name", "label", "region", "segment", "category", "channel"]


def impute_mean_numeric(df: DataFrame, columns: Sequence[str], min_ratio: float = 0.7) -> DataFrame:
    """Columns at least 70 % numeric are parsed, their gaps filled with the mean."""
    cols = [c for c in columns if not any(p in c.lower() for p in NOT_IMPUTED)]
    if not cols:
        return df
    shares = parse_ratio(df, cols, S.safe_double)
    chosen = [c for c in cols if shares[c] >= min_ratio]
    if not chosen:
        return df
    means = df.agg(*[F.avg(S.safe_double(F.col(c))).alias(c) for c in chosen]).first()
    return df.withColumns({c: F.coalesce(S.safe_double(F.col(c)), F.lit(means[c] or 0.0)) for c in chosen})


# ---- scalers -----------------------------------------------------------------------------------


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_samp(c).alias(f"b_{c}") for c in columns]).first()
    return {c: (row[f"a_{c}"] or 0.0, row[f"b_{c}"] or 1.0) for c in columns}


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"a_{c}") for c in columns], *[F.max(F.col(c).cast("double")).alias(f"b_{c}") for c in columns]).first()
    return {c: (row[f"a_{c}"] or 0.0, ((row[f"b_{c}"] or 0.0) - (row[f"a_{c}"] or 0.0)) or 1.0) for c in columns}


def fit_robust(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and inter-quartile range by linear interpolation."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return {c: (q[c][1] or 0.0, ((q[c][2] or 0.0) - (q[c][0] or 0.0)) or 1.0) for c in columns}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_scaled": (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in params.items()})


# ---- target features ---------------------------------------------------------------------------


def oof_target_encode(
    df: DataFrame, columns: Sequence[str], y: str, key: Sequence[str], folds: int = 5, smoothing: float = 20.0, min_count: int = 1,
    positive: str | None = None, seed: int | str = 42,
) -> DataFrame:
    """Adds <column>_te: smoothed mean of a two-class target over the other folds.

    Folds come from the key's hash. Sums per (value, fold) are taken from sums per value, so each
    column costs one aggregation and one join on (value, fold).
    """
    k = max(2, min(folds, 10))
    labels = [r[0] for r in df.select(F.col(y).cast("string")).distinct().limit(3).collect()]
    if len(labels) != 2:
        raise ValueError(f"{y} must have two classes")
    known = sorted(v if v is not None else "None" for v in labels)
    wanted = positive if positive in known else known[-1]
    text = F.coalesce(F.col(y).cast("string"), F.lit("None"))
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[F.col(c).cast("string") for c in key])), 256)
    fold = F.pmod(F.conv(F.substring(token, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
    out = df.withColumns({"_y": (text == wanted).cast("double"), "_fold": fold})
    mu = out.agg(F.avg("_y")).first()[0]
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
        part = out.groupBy(value.alias("_v"), F.col("_fold").alias("_f")).agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"))
        whole = part.groupBy("_v").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
        cnt, total = F.col("n_all") - F.col("n"), F.col("s_all") - F.col("s")
        rates = part.join(whole, "_v").select(
            "_v", "_f", F.when(cnt < min_count, F.lit(mu)).otherwise((total + smoothing * mu) / (cnt + smoothing)).alias(f"{c}_te")
        )
        rates = materialize(rates)
        out = out.join(rates, (value == rates["_v"]) & (F.col("_fold") == rates["_f"]), "left").drop("_v", "_f")
    return out.drop("_y", "_fold")


def derive_target(df: DataFrame, kind: str, source: str, name: str, **spec) -> DataFrame:
    """New target column: median_split, threshold_split, length_median, categorical_map or keyword_polarity."""
    if kind in ("median_split", "threshold_split"):
        df = df.withColumn(source, S.parse_number(F.col(source))).filter(F.col(source).isNotNull())
        cut = spec.get("threshold") if kind == "threshold_split" else None
        if cut is None:
            cut = exact_quantiles(df, [source], [0.5])[source][0]
        return df.withColumn(name, F.when(F.col(source) >= F.lit(cut), spec.get("high_label", "high")).otherwise(spec.get("low_label", "low")))
    if kind == "length_median":
        df = df.withColumn(source, F.col(source).cast("string")).filter(F.col(source).isNotNull()).withColumn("_len", F.length(source))
        cut = exact_quantiles(df, ["_len"], [0.5])["_len"][0]
        return df.withColumn(name, F.when(F.col("_len") >= F.lit(cut), "long").otherwise("short")).drop("_len")
    if kind == "categorical_map":
        pairs = [F.lit(x) for kv in spec["map"].items() for x in kv]
        out = df.withColumn(name, F.element_at(F.create_map(*pairs), F.col(source).cast("string")))
        return out.filter(F.col(name).isNotNull()) if spec.get("drop_nulls", True) else out
    if kind == "keyword_polarity":
        low = F.lower(F.coalesce(F.col(source).cast("string"), F.lit("")))
        hits = lambda words: sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
        pos, neg = hits(spec.get("positive", [])), hits(spec.get("negative", []))
        neutral = spec.get("neutral_label", "neutral")
        out = df.withColumn(name, F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise(neutral))
        return out.filter(F.col(name) != neutral) if spec.get("drop_neutral", True) else out
    raise ValueError(f"unknown derived target: {kind}")


def norm_calendar(df: DataFrame, month: str, weekday: str, flags: dict[str, str]) -> DataFrame:
    """month/12, weekday/7 and flags for values at or above their column's median (name -> column)."""
    medians = exact_quantiles(df, list(flags.values()), [0.5])
    return df.withColumns(
        {
            "month_norm": F.coalesce(F.col(month), F.lit(0)).cast("double") / 12.0,
            "weekday_norm": F.coalesce(F.col(weekday), F.lit(0)).cast("double") / 7.0,
            **{n: (F.col(c) >= F.lit(medians[c][0] or 0.0)).cast("int") for n, c in flags.items()},
        }
    )


ZONES = ["a", "b", "c", "d", "e"]


def shipment_charge(df: DataFrame, weight: str, zone: str, billed: str, card: dict[str, tuple[float, float]]) -> DataFrame:
    """Expected charge in half-kilogram slabs from a rate card (zone -> fixed, additional); unknown zones are d."""
    z = F.lower(F.coalesce(F.col(zone).cast("string"), F.lit("d")))
    z = F.when(z.isin(*ZONES), z).otherwise("d")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    slab = F.greatest(F.lit(0.5), F.ceil(w / 0.5) * F.lit(0.5))
    steps = F.greatest(F.lit(0), F.bround((slab - 0.5) / 0.5).cast("int"))
    at = lambda i: F.element_at(F.create_map(*[F.lit(x) for k in ZONES for x in (k, float(card.get(k, (0.0, 0.0))[i]))]), z)
    expected = at(0) + steps * at(1)
    delta = F.col(billed) - expected
    return df.withColumns(
        {
            "weight_slab_kg": slab, "rate_key": F.concat(F.lit("fwd_"), z), "expected_charge": expected,
            "charge_delta": delta, "charge_delta_abs": F.abs(delta), "overbilled_flag": (delta > 1.0).cast("int"),
        }
    )


# ---- composed jobs --------------------------------------------------------------------------------


def engineer(df: DataFrame, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Label-encode categories, standard-scale numbers, expand dates; returns the new feature names."""
    kinds = auto_detect_columns(df)
    made: list[str] = []
    out = df
    for c in kinds["categorical"]:
        if c != target:
            out = label_encode(out, c)
            made.append(f"{c}_encoded")
    numbers = [c for c in kinds["numeric"] if c != target]
    if numbers:
        out = scale(out, fit_standard(df, numbers))
        made += [f"{c}_scaled" for c in numbers]
    for c in kinds["temporal"]:
        if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            parts = S.date_parts(c)
            out = out.withColumns(parts)
            made += list(parts)
    return out, made


def prepare_matrix(df: DataFrame, columns: Sequence[str], width: int | None = None, name: str = "features") -> DataFrame:
    """One vector per row: doubles, gaps 0, padded to the expected width; more columns than that is an error."""
    cols = list(columns)
    if width and len(cols) > width:
        raise ValueError(f"{len(cols)} columns for a width of {width}")
    filled = df.withColumns({f"_x{i}": F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for i, c in enumerate(cols)})
    inputs = [f"_x{i}" for i in range(len(cols))]
    for i in range(len(cols), width or 0):
        filled = filled.withColumn(f"_x{i}", F.lit(0.0))
        inputs.append(f"_x{i}")
    return VectorAssembler(inputCols=inputs, outputCol=name, handleInvalid="keep").transform(filled).drop(*inputs)


@dataclass
class FeatureMeta:
    """What a fit learned, for replay on new rows."""

    aliases: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    filter: tuple[str, list] | None = None
    ordinal: dict[str, DataFrame] = field(default_factory=dict)
    frequency: dict[str, DataFrame] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)


def replay_features(df: DataFrame, meta: FeatureMeta) -> DataFrame:
    """alias, fill, filter, encode, coerce: always in that order."""
    out = ensure_columns(rename_aliases(df, meta.aliases), meta.columns)
    if meta.filter:
        out = filter_in(out, meta.filter[0], meta.filter[1], never_empty=True)
    for c, params in meta.ordinal.items():
        out = ordinal_encode(out, c, params)
    for c, params in meta.frequency.items():
        out = frequency_encode(out, c, params)
    return out.withColumns({c: S.parse_number(F.col(c)) for c in meta.numeric if not is_numeric(out.schema[c].dataType)})


def train_dataset_model(df: DataFrame, features: Sequence[str], targets: Sequence[tuple[str, str]], key: Sequence[str], trees: int = 20, seed: int = 42, max_classes: int | None = None):
    """Random forest for the first target (name, task) that can be trained; (report, status log).

    The report holds the metrics the gates take, on a fifth of the rows chosen by key hash.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import RandomForestRegressor

    log: list[tuple[str, str]] = []
    for target, task in targets:
        if target not in df.columns:
            log.append((target, "missing_target"))
            continue
        clean = clean_target(df, target, task)
        held = S.unit_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in key]), seed) >= 0.8
        inputs = [c for c in features if c != target]
        # Fitting and scoring read the rows several times; they are cleaned and encoded for all of them at once.
        rows = materialize(clean.select(target, *dict.fromkeys(inputs), held.alias("_held")))
        n_classes = rows.select(target).distinct().limit(2 if max_classes is None else max_classes + 1).count()
        if n_classes < 2 or (task == "classification" and max_classes is not None and n_classes > max_classes):
            log.append((target, "untrainable_target"))
            continue
        data = prepare_matrix(rows, inputs)
        if task == "classification":
            index = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(data)
            data = index.transform(data)
            model = RandomForestClassifier(labelCol="_label", featuresCol="features", numTrees=trees, seed=seed).fit(data.filter(~F.col("_held")))
            report = classification_report(model.transform(data.filter("_held")), "_label", "prediction")
        else:
            model = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees, seed=seed).fit(data.filter(~F.col("_held")))
            report = regression_report(model.transform(data.filter("_held")), target, "prediction")
        log.append((target, "trained"))
        return report.withColumn("target", F.lit(target)).withColumn("task_type", F.lit(task)), log
    return None, log


# Name parts of the columns whose course is checked, in priority order.
REALISM_PARTS = ["revenue", "sales", "margin", "cost", "profit", "customer", "order", "demand", "transaction", "lead_time", "on_time", "stockout"]
REALISM_SKIP = ["date", "time", "timestamp", "id", "name", "label", "region", "segment", "category", "channel"]


def realism_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    numbers = [c for c in df.columns if is_numeric(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.StringType)]
    shares = parse_ratio(df, numbers, S.safe_double) if numbers else {}
    picked: list[str] = []
    for part in REALISM_PARTS:
        picked += [c for c in numbers if part in c.lower() and c not in picked and shares[c] >= 0.75]
    for c in numbers:
        if c not in picked and not any(p in c.lower() for p in REALISM_SKIP) and shares[c] >= 0.85:
            picked.append(c)
    return picked[:limit]


def realism_checks(df: DataFrame, time: str, grain: str = "month") -> DataFrame:
    """One row: why the table's series look made up, or null.

    Checked on period means: too smooth or monotone, no reversals anywhere, all moving one way,
    or nearly identical series.
    """
    cols = realism_columns(df)
    verdict = None
    if cols:
        numeric = df.select(time, *[S.safe_double(F.col(c)).alias(c) for c in cols])
        series = resample_mean(numeric, time, cols, grain).cache()
        shapes = []
        for c in cols:
            r = turning_points(series, c, ["t"]).first()
            if r["n"] >= 6 and (r["std"] or 0) > 0:
                shapes.append((c, r))
        smooth = [
            c for c, r in shapes
            if (r["monotone"] and abs(r["change"]) / max(1.0, abs(r["mean"])) >= 0.08) or (r["unique_diff_ratio"] <= 0.25 and r["n"] >= 8)
        ]
        ways = [math.copysign(1, r["change"]) for _, r in shapes if r["change"] != 0]
        if smooth:
            verdict = f"series too smooth/monotonic: {', '.join(smooth)}"
        elif len(shapes) >= 2 and sum(r["turning_points"] for _, r in shapes) == 0:
            verdict = "no reversals across key metrics"
        elif len(shapes) >= 3 and len(ways) >= 3 and len(set(ways)) == 1:
            verdict = "all key metrics move in the same direction"
        elif len(shapes) >= 3 and shapes[0][1]["n"] >= 6:
            top = pair_correlations(series.dropna(), [c for c, _ in shapes]).agg(F.max(F.abs("corr"))).first()[0]
            if top is not None and top >= 0.995:
                verdict = "key metrics are unrealistically correlated"
        series.unpersist()
    return df.sparkSession.createDataFrame([(verdict, ",".join(cols))], "failure string, checked string")
