"""Writers. Row-level output goes straight from executors; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_by(df: DataFrame, by: Sequence[str], files_per_value: int = 16) -> DataFrame:
    """Shuffle so that each value lands in at most `files_per_value` tasks, a hot value in several."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_value))
    return df.repartition(*[F.col(c) for c in by], salt)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite", files_per_value: int = 16) -> None:
    """zstd parquet, one folder per value of `by`."""
    spread_by(df, by, files_per_value).write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def write_jsonl_by_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """JSON lines, one folder per split under path/by_split; that folder read as a whole is all of them."""
    spread_by(df, [split_col]).write.mode(mode).partitionBy(split_col).json(f"{path}/by_split")


def route_split(df: DataFrame, code_col: str, code_sets: dict[str, Sequence[str]], default: str = "other") -> DataFrame:
    """Add `route`: the set that holds the row's code, else the default."""
    out = F.lit(default)
    for name, codes in reversed(list(code_sets.items())):
        out = F.when(F.col(code_col).isin(*codes), F.lit(name)).otherwise(out)
    return df.withColumn("route", out)
