"""Deduplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import scalars as S


def content_dedupe(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row of each distinct content. `order_by` must identify a row.

    Only digests and order columns are grouped (a mass of copies shrinks map-side); the wide rows
    meet the winners in one semi join.
    """
    order = list(order_by)
    winners = (
        df.select(S.canonical_hash(cols).alias("_h"), *order)
        .groupBy("_h").agg(F.min(F.struct(*order)).alias("_w")).select("_w.*")
    )
    return df.join(winners, order, "left_semi")


def fingerprint_groups(catalogue: DataFrame) -> DataFrame:
    """catalogue(dataset_id, suffix, n_rows, n_cols, size, columns): fingerprint, canonical id, copy or not."""
    fp = F.sha2(
        F.concat_ws("|", "suffix", F.col("n_rows").cast("string"), F.col("n_cols").cast("string"), F.col("size").cast("string"), F.array_join(F.array_sort("columns"), ",")), 256
    )
    marked = catalogue.withColumn("fingerprint", fp)
    first = marked.groupBy("fingerprint").agg(F.min("dataset_id").alias("canonical_id"))
    joined = marked.join(first, "fingerprint")
    return joined.withColumn("duplicate_of", F.when(F.col("dataset_id") != F.col("canonical_id"), F.col("canonical_id")))


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def column_sets(provided: DataFrame, known: DataFrame) -> DataFrame:
    """(token, state): matched, missing (known only) or extra (provided only)."""
    p = provided.select(F.col(provided.columns[0]).alias("token")).distinct().withColumn("_p", F.lit(1))
    k = known.select(F.col(known.columns[0]).alias("token")).distinct().withColumn("_k", F.lit(1))
    state = F.when(F.col("_p").isNotNull() & F.col("_k").isNotNull(), "matched").when(F.col("_k").isNotNull(), "missing").otherwise("extra")
    return p.join(k, "token", "full").select("token", state.alias("state"))


def ordered_unique_merge(a: Column, b: Column, cap: int, normalize: bool = True) -> Column:
    """Union of two lists in first-seen order, one entry per token, the last `cap` kept."""
    merged = F.filter(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    token = (lambda x: S.normalize_token(x)) if normalize else (lambda x: F.trim(x))
    tokens = F.transform(merged, token)
    firsts = F.filter(merged, lambda x, i: F.array_position(tokens, F.element_at(tokens, i + 1)) == i + 1)
    return F.slice(firsts, F.greatest(F.size(firsts) - cap + 1, F.lit(1)), F.lit(cap))
