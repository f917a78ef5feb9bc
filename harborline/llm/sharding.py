"""Extendible hashing: shards bounded in bytes, found by splitting only what is too large.

The bits of a row's key hash address a directory. Bytes are summed per cell of the directory (map-side first), the sums
are rolled up along the prefixes, and every cell belongs to the shortest prefix whose bytes fit the limit. Cells too
large even at full directory depth are taken up again, alone, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import fresh, whole
from harborline.session import materialize

LIMIT_BYTES = 64 << 20
WORD = 60


def key_bits(*keys: str) -> Column:
    """60 hash bits per key column, as text of 0 and 1; null keys hash as empty."""
    word = lambda k: F.lpad(F.conv(F.substring(F.md5(F.coalesce(F.col(k).cast("string"), F.lit(""))), 1, 15), 16, 2), WORD, "0")
    return F.concat(*[word(k) for k in keys])


def assign_shards(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: int = LIMIT_BYTES, step: int = 8, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns of every row with `shard` (its prefix bits), `shard_depth`, `n_bytes` and `shard_bytes`.

    Rows are spread by the bits of keys[0], then of keys[1] and so on, so a key that holds a third of all rows goes on
    being split by the next one. Rows alike in all keys can't be told apart: such an item over the limit has a shard of
    its own at full depth. Null or empty text: 0 bytes. Null key: hashes as empty. Empty table: no rows.
    """
    if set(carry) & {"shard", "shard_depth", "n_bytes", "shard_bytes"}:
        raise ValueError("a carried column has a result's name")
    bits, n_bytes = fresh(df, "bits", "n_bytes")
    rows = materialize(df.select(*carry, key_bits(*keys).alias(bits), F.octet_length(whole(text_col)).cast("long").alias(n_bytes)))
    total = rows.agg(F.sum(n_bytes)).first()[0] or 0
    full = WORD * len(keys)
    below, depth = 0, min(full, max(step, math.ceil(math.log2(total / limit + 1)) + 4))
    done = None
    while True:
        cut = F.substring(F.col(bits), 1, depth)
        cells = rows.groupBy(cut.alias("cell")).agg(F.sum(n_bytes).alias("b"))
        levels = cells.select("cell", "b", F.explode(F.sequence(F.lit(below), F.lit(depth))).alias("level")).withColumn("prefix", F.expr("substring(cell, 1, level)"))
        sums = levels.groupBy("level", "prefix").agg(F.sum("b").alias("shard_bytes")).filter((F.col("shard_bytes") <= limit) | (F.col("level") == full))
        # The directory: for every cell the shortest prefix that fits, if any.
        directory = levels.join(sums, ["level", "prefix"]).groupBy("cell").agg(F.min(F.struct("level", "prefix", "shard_bytes")).alias("s"))
        directory = materialize(directory)
        placed = rows.withColumn("cell", cut).join(directory, "cell", "left")
        fits = placed.filter("s is not null").select(*carry, F.col("s.prefix").alias("shard"), F.col("s.level").alias("shard_depth"), F.col(n_bytes).alias("n_bytes"), "s.shard_bytes")
        done = fits if done is None else done.unionByName(fits)
        if depth == full:
            return done
        rest = placed.filter("s is null").select(*carry, bits, n_bytes)
        if rest.isEmpty():
            return done
        rows = materialize(rest)
        below, depth = depth, min(full, depth + step)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the rows as one folder per shard; `df` must carry every wanted column."""
    df.select(*df.columns, F.col("shard").alias("shard_id")).write.partitionBy("shard_id").parquet(path, **options)
