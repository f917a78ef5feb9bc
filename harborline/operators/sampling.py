"""Deterministic samples, quotas and splits. Order by a hash of the key replaces a random generator."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.operators.ordering import GROUP_ROWS, POS, largest_group, positions, smallest, top_per_group

TOKEN = "_token"


def hash_token(key: Sequence[str], seed: int | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[F.col(c).cast("string") for c in key])), 256)


def hash_ranked(df: DataFrame, key: Sequence[str], seed: int | str, partition_by: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add the token and the 0-based `_rank` of each row in its group by token.

    Tokens are spread evenly, so their leading digits cut a big group into equal ordered slices;
    a row's rank is the size of the slices before it plus its rank inside its own.
    """
    keys = list(partition_by)
    tokened = df.withColumn(TOKEN, hash_token(key, seed))
    biggest = largest_group(df, keys)
    if biggest <= group_rows and keys:
        w = Window.partitionBy(*keys).orderBy(TOKEN, *key)
        return tokened.withColumn("_rank", F.row_number().over(w) - 1)
    digits = max(1, math.ceil(math.log(max(2, biggest / group_rows), 16)))
    sliced = tokened.withColumn("_slice", F.substring(TOKEN, 1, digits))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    match = F.col("_slice") == F.col("_s")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(TOKEN, *key)
    return (
        sliced.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, match)
        .withColumn("_rank", F.col("_start") + F.col("_at"))
        .drop("_slice", "_s", "_start", "_at", *[f"_k_{k}" for k in keys])
    )


def hash_sample(df: DataFrame, key: Sequence[str], cap: int, seed: int | str = 42) -> DataFrame:
    """The first `cap` rows by token (all rows when cap <= 0).

    Tokens are spread evenly, so the wanted rows lie under a token bound a little above cap / rows;
    only rows under it are sorted. Should too few lie there, all rows are.
    """
    if cap <= 0:
        return df
    tokened = df.withColumn(TOKEN, hash_token(key, seed))
    if cap <= 10_000:
        return smallest(tokened, [TOKEN, *key], cap).drop(TOKEN)
    total = df.count()
    share = (cap + 6.0 * math.sqrt(cap) + 50.0) / max(1, total)
    if share < 0.5:
        bound = f"{min(16**12 - 1, int(share * 16**12)):012x}"
        near = tokened.filter(F.col(TOKEN) < bound)
        if near.count() >= cap:
            tokened = near
    return smallest(tokened, [TOKEN, *key], cap).drop(TOKEN)


def cap_rows(df: DataFrame, key: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """A simple random sample of exactly min(n, rows) rows."""
    return hash_sample(df, key, n, seed)


def top_k(df: DataFrame, order_by: Sequence[Column | str], k: int) -> DataFrame:
    return smallest(df, order_by, k)


def quota_select(df: DataFrame, group: str, quotas: dict[str, int], order_by: Sequence[Column]) -> DataFrame:
    """The first quota rows of each listed group; raises when a group is short."""
    have = {r[0]: r[1] for r in df.filter(F.col(group).isin(*quotas)).groupBy(group).count().collect()}
    short = {g: (have.get(g, 0), q) for g, q in quotas.items() if have.get(g, 0) < q}
    if short:
        raise ValueError(f"groups with fewer rows than their quota (have, need): {short}")
    ranked = top_per_group(df.filter(F.col(group).isin(*quotas)), [group], order_by, max(quotas.values()))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(group))
    return ranked.filter(F.col("rank") <= quota)


def batch_sample(df: DataFrame, key: Sequence[str], order_by: Sequence[str], n: int, batch: int, seed: int | str = 42) -> DataFrame:
    """n rows: an equal share of every run of `batch` rows, then trimmed or topped up by token."""
    total = df.count()
    if n <= 0 or total <= n:
        return df
    if batch <= 0:
        return hash_sample(df, key, n, seed)
    share = max(1, n // math.ceil(total / batch))
    placed = positions(df, order_by).withColumn("_batch", F.floor(F.col(POS) / batch)).withColumn(TOKEN, hash_token(key, seed))
    w = Window.partitionBy("_batch").orderBy(TOKEN, *key)
    ranked = placed.withColumn("_late", (F.row_number().over(w) > share).cast("int"))
    return smallest(ranked, ["_late", TOKEN, *key], n).drop(POS, "_batch", TOKEN, "_late")


def stratified_sample(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """max(1, round(n * share)) rows of each class by token, trimmed to n by token."""
    total = df.count()
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed(label, "_label")
    quota = sizes.withColumn("_quota", F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(n / max(1, total))).cast("long")))
    ranked = hash_ranked(df, key, seed, [label])
    kept = ranked.join(quota, F.col(label).eqNullSafe(F.col("_label"))).filter(F.col("_rank") < F.col("_quota"))
    return smallest(kept, [TOKEN, *key], n).drop(TOKEN, "_rank", "_label", "_size", "_quota")


def split_assign(df: DataFrame, ident: str, seed: int | str = 42, train: float = 0.8, val: float = 0.1, name: str = "split") -> DataFrame:
    u = S.unit_hash(F.col(ident), seed)
    return df.withColumn(name, F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


# What a download's format and name are worth.
RESOURCE_SCORES = [("english", 3), ("traditional chinese", -3), ("simplified chinese", -3), ("api", -1)]


def pick_resources(df: DataFrame, package: str, per_package: int, fmt: str, name: str, url: str, order_by: Sequence[str]) -> DataFrame:
    """The best resources of each package: json before csv, English preferred, ties in given order."""
    f, title = F.lower(F.trim(fmt)), F.lower(name)
    chinese = title.contains("traditional chinese") | title.contains("simplified chinese")
    score = (
        F.when(f == "json", 4).otherwise(0)
        + F.when(title.contains("english"), 3).otherwise(0)
        - F.when(chinese, 3).otherwise(0)
        - F.when(title.contains("api"), 1).otherwise(0)
    )
    usable = df.filter(F.col(url).startswith("http") & f.isin("json", "csv")).withColumn("score", score)
    return top_per_group(usable, [package], [F.desc("score"), *[F.col(c) for c in order_by]], max(1, per_package))
