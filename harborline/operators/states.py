"""Column profiles kept as mergeable states, so that new rows are added without reading the old ones.

A state is one row per column and group (a day, a file): counts, extremes, moments, and two sketches as binary columns,
one for distinct values and one for ranks. States merge by addition and by the sketches' own union; a profile is read
from the merged state. Counts, extremes and moments are exact, the sketches within their stated bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes of the sketches. Distinct counts are off by 1.6 % (one standard error), and exact while few; ranks by 0.7 %.
DISTINCT_BITS = 12
RANK_SIZE = 400
STATE_SCHEMA = (
    "column_name string, n bigint, nulls bigint, low double, high double, mean double, off double, distinct binary, ranks binary"
)


def column_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., STATE_SCHEMA): the state of each numeric column in each group, from one pass over the rows.

    `n` counts values that are not null; a column of nulls has an empty state.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = df.select(*by, cells.alias("c")).select(*by, "c.column_name", "c.v")
    n = F.count("v")
    return rows.groupBy(*by, "column_name").agg(
        n.alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), (F.var_pop("v") * n).alias("off"),
        F.hll_sketch_agg(F.col("v").cast("string"), DISTINCT_BITS).alias("distinct"), F.kll_sketch_agg_double("v", RANK_SIZE).alias("ranks"),
    )


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of larger groups from those of smaller ones; merging some first changes nothing but the sketches' error."""
    keys = [*by, "column_name"]
    # The mean of all comes first, so that deviations from it are summed and no digits are lost.
    middle = states.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_middle"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    away = F.col("n") * (F.col("mean") - F.col("_middle")) * (F.col("mean") - F.col("_middle"))
    return states.join(middle, same).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("_middle").alias("mean"),
        (F.sum("off") + F.sum(away)).alias("off"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks", RANK_SIZE).alias("ranks"),
    )


def read_states(states: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile that each state stands for: n, nulls, min, max, mean, std, n_distinct and one column `q<percent>` a quantile."""
    known = F.col("n") > 0
    at = lambda q: F.when(known, F.kll_sketch_get_quantile_double("ranks", F.lit(float(q)))).alias(f"q{round(100 * q)}")
    made = ("distinct", "ranks", "low", "high", "off", "mean", "n", "nulls")
    return states.select(
        *[c for c in states.columns if c not in made], "n", "nulls", F.col("low").alias("min"), F.col("high").alias("max"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("off") / (F.col("n") - 1))).alias("std"), F.hll_sketch_estimate("distinct").alias("n_distinct"), *[at(q) for q in quantiles],
    )
