"""Ordered features: lags, rolling statistics, smoothing, chunks, change logs, adjacent turns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.ordering import BLOCK, GROUP_ROWS, POS, over_ordered, positions, running_sum, top_per_group


def lag_features(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), lags: Sequence[int] = (1, 7, 30), group_rows: int = GROUP_ROWS) -> DataFrame:
    return over_ordered(
        df, partition_by, order_by, lambda w: {f"{column}_lag_{n}": F.lag(column, n).over(w) for n in lags}, before=max(lags), group_rows=group_rows
    )


def rolling_features(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), windows: Sequence[int] = (7, 30), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rolling mean and sample deviation; null until the window is full."""

    def build(w):
        out = {}
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            full = F.count(column).over(frame) == n
            out[f"{column}_rolling_mean_{n}"] = F.when(full, F.avg(column).over(frame))
            out[f"{column}_rolling_std_{n}"] = F.when(full, F.stddev_samp(column).over(frame))
        return out

    return over_ordered(df, partition_by, order_by, build, before=max(windows) - 1, group_rows=group_rows)


def adjacent_pairs(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], role: str, text: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each user row directly followed by an assistant row, with both texts."""
    paired = over_ordered(
        df, partition_by, order_by, lambda w: {"_next_role": F.lead(role).over(w), "reply": F.lead(text).over(w)}, after=1, group_rows=group_rows
    )
    return paired.filter((F.col(role) == "user") & (F.col("_next_role") == "assistant")).drop("_next_role")


# Rows per smoothing block: short enough that (1-alpha)^-rows stays far inside a double.
EMA_BLOCK = 256


def ema(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), alpha: float = 0.25, name: str | None = None) -> DataFrame:
    """e0 = x0; e = alpha*x + (1-alpha)*previous e, per group.

    Within a block of rows the recursion is a weighted running sum. The block ends follow the same
    recursion with weight (1-alpha)^256, carried back as many blocks as that weight is above the
    smallest double. Groups of any length are therefore cut over many tasks.
    """
    keep = 1.0 - alpha
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    out = name or f"{column}_ema"
    if alpha == 1.0:
        return df.withColumn(out, F.col(column).cast("double"))
    block_rows = max(8, min(EMA_BLOCK, int(600 / -math.log2(keep))))
    keys = list(partition_by)
    placed = positions(df, keys + list(order_by)).withColumn(BLOCK, F.floor(F.col(POS) / block_rows))
    first = F.min(POS).over(Window.partitionBy(*keys, BLOCK))
    local = placed.withColumn("_i", F.col(POS) - first)
    if keys:
        head = placed.groupBy(*keys).agg(F.min(POS).alias("_head"))
    else:
        head = placed.agg(F.min(POS).alias("_head"))
    starts = head.select("_head").withColumn("_is_head", F.lit(True))
    local = local.join(starts, local[POS] == starts["_head"], "left")
    x = F.col(column).cast("double")
    # The group's first value enters with weight 1, later ones with alpha.
    weight = F.when(F.col("_is_head"), F.lit(1.0)).otherwise(F.lit(alpha))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(weight * x * F.pow(F.lit(keep), -F.col("_i").cast("double"))).over(inside)
    local = local.withColumn("_e", scaled * F.pow(F.lit(keep), F.col("_i").cast("double"))).drop("_head", "_is_head")
    ends = local.groupBy(*keys, BLOCK).agg(F.max_by("_e", "_i").alias("_end"), (F.max("_i") + 1).alias("_len"))
    # Every block but a group's first and last is full, so distance in rows is a difference of sums.
    ends = running_sum(ends, keys, [BLOCK], {"_rows": F.col("_len")}) if keys else running_sum(ends, [], [BLOCK], {"_rows": F.col("_len")})
    reach = max(1, math.ceil(745.0 / (-math.log(keep) * block_rows)) + 1)
    back = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-reach, -1)
    earlier = F.collect_list(F.struct("_end", "_rows")).over(back)
    before = F.col("_rows") - F.col("_len")
    carry = F.aggregate(earlier, F.lit(0.0), lambda acc, p: acc + p["_end"] * F.pow(F.lit(keep), (before - p["_rows"]).cast("double")))
    carried = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_b"), carry.alias("_carry"))
    match = F.col(BLOCK) == F.col("_b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        local.join(carried, match)
        .withColumn(out, F.col("_e") + F.col("_carry") * F.pow(F.lit(keep), F.col("_i").cast("double") + 1.0))
        .drop(POS, BLOCK, "_i", "_e", "_b", "_carry", *[f"_k_{k}" for k in keys])
    )


def _chunked(df: DataFrame, points: int, order_by: Sequence[str]) -> DataFrame:
    """Near-equal consecutive chunks; the first (rows mod points) hold one row more."""
    n = df.count()
    size, extra = divmod(n, points)
    cut = extra * (size + 1)
    at = F.when(F.col(POS) < cut, F.floor(F.col(POS) / (size + 1))).otherwise(extra + F.floor((F.col(POS) - cut) / max(1, size)))
    return positions(df, order_by).withColumn("chunk", at.cast("int"))


def chunk_means(df: DataFrame, column: str, points: int, order_by: Sequence[str]) -> DataFrame:
    """Mean of each chunk of the non-null values in order. All values are used."""
    values = df.filter(F.col(column).isNotNull())
    return _chunked(values, points, order_by).groupBy("chunk").agg(F.avg(F.col(column).cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))


def chunk_counts(df: DataFrame, order_by: Sequence[str], points: int) -> DataFrame:
    """Rows in each of `points` chunks of the order."""
    return _chunked(df, points, order_by).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def turning_points(df: DataFrame, column: str, order_by: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row: sign changes among nonzero rounded steps, monotone or not, share of distinct steps, span."""
    v = F.col(column).cast("double")
    series = df.filter(v.isNotNull()).select(*order_by, v.alias("_v"))
    stepped = over_ordered(series, [], order_by, lambda w: {"_step": F.col("_v") - F.lag("_v").over(w)}, before=1, group_rows=group_rows)
    rounded = stepped.withColumn("_r", F.round("_step", 6))
    moves = rounded.filter(F.col("_r") != 0).withColumn("_s", F.signum("_r"))
    signs = over_ordered(moves, [], order_by, lambda w: {"_prev": F.lag("_s").over(w)}, before=1, group_rows=group_rows)
    turns = signs.agg(F.count_if(F.col("_s") != F.col("_prev")).alias("turning_points"))
    first_last = F.struct(*order_by)
    shape = rounded.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_and(F.col("_step") >= 0), F.lit(True)).alias("rising"),
        F.coalesce(F.bool_and(F.col("_step") <= 0), F.lit(True)).alias("falling"),
        (F.count_distinct("_r") / F.greatest(F.count("_r"), F.lit(1))).alias("unique_diff_ratio"),
        (F.max_by("_v", first_last) - F.min_by("_v", first_last)).alias("change"),
        F.avg("_v").alias("mean"),
        F.stddev_pop("_v").alias("std"),
    )
    row = turns.first()
    return shape.withColumn("turning_points", F.lit(row[0]).cast("long")).withColumn("monotone", F.col("rising") | F.col("falling")).drop("rising", "falling")


def best_by_priority(df: DataFrame, key: Sequence[str], name: str, score: str, keep: int = 3) -> DataFrame:
    """Highest score per name, best `keep` names per key, the first marked primary."""
    best = df.groupBy(*key, name).agg(F.max(score).alias(score))
    ranked = top_per_group(best, key, [F.desc(score), F.col(name)], keep)
    return ranked.withColumn("is_primary", F.col("rank") == 1)


def changelog_tail(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], n: int = 100) -> DataFrame:
    """The newest n entries of each task, with their global sequence number."""
    seq = positions(df, order_by).withColumn("seq", F.col(POS) + 1).drop(POS)
    return top_per_group(seq, partition_by, [F.desc("seq")], n, rank="_r").drop("_r")


def since(df: DataFrame, seq: int, column: str = "seq") -> DataFrame:
    return df.filter(F.col(column) > seq)


def last_turn_split(df: DataFrame, partition_by: Sequence[str], turn: str, role: str, text: str) -> DataFrame:
    """Rows of each conversation labelled `expected` (last assistant turn) or `prompt` (turns before it).

    Conversations without an assistant turn, or with a blank last one, are left out. Rows stay rows:
    a conversation of any length is never gathered in one cell.
    """
    ends = df.groupBy(*partition_by).agg(F.max(F.when(F.col(role) == "assistant", F.struct(F.col(turn).alias("t"), F.trim(text).alias("x")))).alias("_last"))
    usable = ends.filter(F.col("_last").isNotNull() & (F.col("_last.x") != "")).select(*partition_by, F.col("_last.t").alias("_end"))
    joined = df.join(usable, list(partition_by)).filter(F.col(turn) <= F.col("_end"))
    return joined.withColumn("part", F.when(F.col(turn) == F.col("_end"), "expected").otherwise("prompt")).drop("_end")


def prompt_text(split: DataFrame, partition_by: Sequence[str], turn: str, role: str, text: str, max_chars: int = 8_000_000) -> DataFrame:
    """Prompt as text, in order, in pieces of about `max_chars` characters (nearly always one piece)."""
    prompts = split.filter(F.col("part") == "prompt").withColumn("_line", F.concat(F.upper(role), F.lit(": "), F.trim(text)))
    placed = running_sum(prompts, partition_by, [turn], {"_chars": F.length("_line")})
    pieces = placed.withColumn("piece", F.floor((F.col("_chars") - F.length("_line")) / max_chars).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("_line").alias("x"))))
    return pieces.groupBy(*partition_by, "piece").agg(F.array_join(F.transform(lines, lambda p: p["x"]), "\n").alias("prompt"))
