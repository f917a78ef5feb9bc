"""Jobs described by data: feature steps listed in a spec, and a data set taken from target to gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.operators import aggregates as A
from harborline.operators.features import derive_target, oof_target_encode, ordinal_encode, train_dataset_model
from harborline.operators.joins import lookup_join
from harborline.operators.profile import column_stats, text_columns
from harborline.operators.projections import clean_target, drop_leaky, low_value_target
from harborline.session import materialize


def _combined(df: DataFrame, op: Mapping) -> DataFrame:
    return df.withColumn(op["name"], S.combine_str([F.col(c) for c in op["columns"] if c in df.columns], op.get("sep", "_")))


def _clock(df: DataFrame, op: Mapping) -> DataFrame:
    source = op["source"]
    hour, minute = S.hhmm_split(F.col(source))
    return df.withColumns({op.get("hour_col", f"{source}_hour"): hour, op.get("minute_col", f"{source}_minute"): minute})


def _circled(df: DataFrame, op: Mapping) -> DataFrame:
    source, period = op["source"], float(op.get("period", 1.0))
    if period <= 0:
        return df
    sine, cosine = S.cyclic(F.col(source).try_cast("double"), period)
    return df.withColumns({op.get("sin_col", f"{source}_sin"): sine, op.get("cos_col", f"{source}_cos"): cosine})


def _distance(df: DataFrame, op: Mapping) -> DataFrame:
    return df.withColumn(op.get("name", "distance_km"), S.haversine_km(*[F.col(op[c]) for c in ("lat1", "lon1", "lat2", "lon2")]))


def _flagged(df: DataFrame, op: Mapping) -> DataFrame:
    return df.withColumn(op["name"], S.binary_flag(F.col(op["source"]), [str(v) for v in op.get("values", [])]))


# Per step: the fields it can't do without, the fields that name columns which must exist, and what it does.
STEPS = {
    "combine_str": (("name", "columns"), (), _combined),
    "hhmm_to_hour_minute": (("source",), ("source",), _clock),
    "cyclic": (("source",), ("source",), _circled),
    "haversine_km": (("lat1", "lon1", "lat2", "lon2"), ("lat1", "lon1", "lat2", "lon2"), _distance),
    "binary_flag": (("source", "name"), ("source",), _flagged),
}


def apply_feature_spec(df: DataFrame, operations: Sequence[Mapping], lookups: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Apply the listed steps in order; a step whose columns are absent, or of an unknown type, changes nothing.

    `lookup_join` names one of `lookups` as its `file`; of several rows for a key the smallest counts.
    """
    for op in operations:
        kind = str(op.get("type", "")).strip().lower()
        if kind == "lookup_join":
            other = (lookups or {}).get(op.get("file"))
            if other is None or op.get("left_on") not in df.columns or op.get("right_on") not in other.columns:
                continue
            picked = [c for c in op.get("select", []) if c in other.columns]
            df = lookup_join(df, other, op["left_on"], op["right_on"], picked, picked, op.get("prefix", "")) if picked else df
            continue
        needed, named, step = STEPS.get(kind, ((), (), None))
        if step is None or not all(op.get(k) for k in needed) or not all(op[k] in df.columns for k in named):
            continue
        if kind == "combine_str" and not any(c in df.columns for c in op["columns"]):
            continue
        df = step(df, op)
    return df


def dataset_job(
    df: DataFrame, features: Sequence[str], targets: Sequence[tuple[str, str]], key: Sequence[str], derived: Sequence[Mapping] = (),
    encode: Sequence[str] = (), industry: str = "ecommerce", tier: str = "minimum", trees: int = 20, seed: int = 42,
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(gate rows, log): derive targets, pass over weak ones, clean, leave out leaks, encode, fit and gate.

    `targets` are tried in order. `encode` columns get out-of-fold target means where the target has two classes; other
    text features get ordinals.
    """
    log: list[tuple[str, str]] = []
    for spec in derived:
        df = derive_target(df, **spec)
    known = {r["column_name"]: r for r in column_stats(df.select([t for t, _ in targets if t in df.columns] or df.columns[:1])).collect()}
    for target, task in targets:
        if target not in df.columns:
            log.append((target, "missing_target"))
            continue
        one = df.sparkSession.range(1)
        weak = one.select(low_value_target(F.lit(target), F.lit(task), F.lit(known[target]["n_distinct"]))).first()[0]
        if weak:
            log.append((target, weak))
            continue
        clean = clean_target(df, target, task)
        kept, _ = drop_leaky(clean, [c for c in features if c != target], target)
        # Read several times below; the target's numbers are parsed once.
        clean = materialize(clean.select(*dict.fromkeys([target, *kept, *key])))
        if task == "classification" and clean.select(target).distinct().limit(3).count() == 2 and encode:
            clean = oof_target_encode(clean, [c for c in encode if c in kept], target, key, seed=seed)
            kept = [c for c in kept if c not in encode] + [f"{c}_te" for c in encode if c in kept]
        for c in [c for c in text_columns(clean) if c in kept]:
            clean = ordinal_encode(clean, c)
            kept[kept.index(c)] = f"{c}_ordinal"
        report, steps = train_dataset_model(clean, kept, [(target, task)], key, trees, seed)
        log += steps
        if report is None:
            continue
        metrics = [c for c in report.columns if c not in ("target", "task_type")]
        long = report.unpivot(["target", "task_type"], metrics, "metric", "value")
        return A.benchmark_gate(long, A.thresholds(long, tier, industry), "target"), log
    return None, log
