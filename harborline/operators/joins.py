"""Lookups, star joins and set filters.

No side is force-broadcast: Spark broadcasts a side whose measured size is under its threshold and
otherwise sorts and merges, with AQE splitting hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.session import materialize


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key. An aggregate, so copies of a hot key shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_r"))
    return picked.select(*keys, "_r.*").select(df.columns)


def first_value_per_key(df: DataFrame, keys: Sequence[str], value: str, order_by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order_by)).alias(name))


def lookup_join(
    df: DataFrame, lookup: DataFrame, left_on: str, right_on: str, select: Sequence[str], order_by: Sequence[str], prefix: str = ""
) -> DataFrame:
    """Left join to the first lookup row per key, its columns prefixed."""
    keep = [c for c in select if c in lookup.columns and c != right_on]
    if not keep:
        return df
    needed = list(dict.fromkeys([right_on, *keep, *order_by]))
    one = first_per_key(lookup.select(*needed), [right_on], order_by)
    one = one.select(F.col(right_on).alias("_lookup_key"), *[F.col(c).alias(f"{prefix}{c}") for c in keep])
    return df.join(one, df[left_on] == one["_lookup_key"], "left").drop("_lookup_key")


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Fact left-joined to each (dim, fact key, dim key, columns, order); the fact's own columns win a name clash."""
    out = fact
    for dim, fact_key, dim_key, columns, order_by in dims:
        fresh = [c for c in columns if c not in out.columns]
        out = lookup_join(out, dim, fact_key, dim_key, fresh, order_by)
    return out


def agg_join_back(fact: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Statistics per key joined back on each row."""
    stats = fact.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return fact.join(stats, list(keys), "left")


def composite_lookup(
    fact: DataFrame, mapping: DataFrame, keys: Sequence[str], value: str, own: str, order_by: Sequence[str]
) -> DataFrame:
    """Mapped value (lower case) by several keys, else the row's own; flag 1 only where both agree."""
    first = first_value_per_key(mapping, keys, value, order_by, "_mapped")
    joined = fact.join(first, list(keys), "left")
    mapped = F.lower(F.col("_mapped").cast("string"))
    return joined.withColumns(
        {
            "mapped_value": F.coalesce(mapped, F.lower(F.col(own).cast("string"))),
            "match_flag": F.coalesce((F.lower(F.col(own).cast("string")) == mapped).cast("int"), F.lit(0)),
        }
    ).drop("_mapped")


def broadcast_row(df: DataFrame, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Apply a one-row table to every row; exactly one row is read, so its values become literals."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row, found {'none' if not rows else 'more'}")
    return df.withColumns({f"{prefix}{c}": F.lit(v) for c, v in rows[0].asDict().items()})


def map_key_join(a: DataFrame, a_json: str, a_type: str, b: DataFrame, b_json: str, b_type: str) -> DataFrame:
    """(map_key, a_value, b_value): two JSON maps joined on their shared keys."""
    left = a.select(F.explode(F.from_json(a_json, f"map<string,{a_type}>")).alias("map_key", "a_value"))
    right = b.select(F.explode(F.from_json(b_json, f"map<string,{b_type}>")).alias("map_key", "b_value"))
    return left.filter(F.col("a_value").isNotNull()).join(right.filter(F.col("b_value").isNotNull()), "map_key")


def resolve_chains(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, canonical): follow links to their end.

    Each round doubles the distance covered, so a chain of length n takes log2(n) joins. A node on
    a loop, or leading into one, resolves to the loop's smallest node.
    """
    links = edges.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    links = links.groupBy("n").agg(F.min("p").alias("p"))
    known = links.select(F.col("n").alias("_n")).distinct()
    # A link to a node without a row of its own ends there.
    ends = links.join(known, links["p"] == known["_n"], "left_anti").select(F.col("p").alias("n"), "p").distinct()
    state = materialize(links.unionByName(ends).withColumn("low", F.least("n", "p")))
    total = state.count()
    rounds = max(1, math.ceil(math.log2(max(2, total))) + 1)
    for _ in range(rounds):
        nxt = state.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("low").alias("plow"))
        step = state.join(nxt, "p", "left").select(
            "n", F.coalesce("pp", "p").alias("pp"), F.least("low", F.coalesce("plow", "low")).alias("low"), F.col("p").alias("old")
        )
        step = materialize(step)
        moved = step.filter(F.col("pp") != F.col("old")).limit(1).count()
        state = step.select("n", F.col("pp").alias("p"), "low")
        if not moved:
            break
    # Ends point at themselves; whatever else is pointed at lies on a loop, whose smallest node it saw.
    at_end = state.select(F.col("n").alias("p"), F.when(F.col("n") == F.col("p"), F.col("n")).otherwise(F.col("low")).alias("canonical"))
    return (
        state.join(at_end, "p", "left")
        .join(links.select("n"), "n", "left_semi")
        .select(F.col("n").alias(node), F.coalesce("canonical", "p").alias("canonical"))
    )


def keep_set(df: DataFrame, keep: DataFrame, on: str, keep_on: str) -> DataFrame:
    return df.join(keep, df[on] == keep[keep_on], "left_semi")


def removed(df: DataFrame, keep: DataFrame, on: str, keep_on: str, reason: str) -> DataFrame:
    return df.join(keep, df[on] == keep[keep_on], "left_anti").withColumn("reason", F.lit(reason))


def status_join(specs: DataFrame, models: DataFrame) -> DataFrame:
    """specs(dataset_id, enabled, skip) with models(dataset_id, model_id): trained / pending / skipped."""
    joined = specs.join(models.groupBy("dataset_id").agg(F.min("model_id").alias("model_id")), "dataset_id", "left")
    active = F.col("enabled") & ~F.col("skip")
    return joined.select(
        "dataset_id",
        F.when(active, F.col("model_id")).alias("model_id"),
        F.when(~active, "skipped").when(F.col("model_id").isNotNull(), "trained").otherwise("pending").alias("status"),
    )


def scoped_alias_join(aliases: DataFrame, workers: DataFrame) -> DataFrame:
    """(dataset_id, alias, canonical) from approved aliases whose scope covers the worker.

    aliases(seq, canonical_column, alias, status, categories, worker_dataset_ids);
    workers(category, dataset_id, column_name). An empty list means no restriction. The canonical
    column must be one of the worker's, so the join is on its token; the first canonical by `seq` wins.
    """
    from harborline.functions.scalars import normalize_token

    usable = aliases.filter((F.col("status") == "approved") & (F.trim("canonical_column") != "") & (F.trim("alias") != ""))
    # Many entries may say the same: only the first of those can win, so the others meet no worker.
    said = usable.groupBy(normalize_token(F.col("canonical_column")).alias("_token"), F.trim("alias").alias("alias"), "categories", "worker_dataset_ids")
    left = said.agg(F.when(F.count_if(F.col("seq").isNull()) == 0, F.min("seq")).alias("seq"))
    right = workers.select("category", "dataset_id", "column_name", normalize_token(F.col("column_name")).alias("_token"))
    none_or = lambda scope, v: (F.coalesce(F.size(scope), F.lit(0)) <= 0) | F.array_contains(scope, F.col(v))
    hit = left.join(right, "_token").filter(none_or("categories", "category") & none_or("worker_dataset_ids", "dataset_id"))
    return hit.groupBy("category", "dataset_id", "alias").agg(
        F.min_by("column_name", F.struct("seq", "column_name")).alias("canonical")
    )
