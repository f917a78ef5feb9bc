"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this package, with its SQL where SQL can say it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def whole(c: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case, all else unchanged. On pure ASCII the built-in does just that and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the columns under different seeds; together they stand for the value."""
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't use, for working columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


# Powers of an odd number and of its inverse modulo 2**64, grown as texts ask for them.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_LOCK = threading.Lock()


def _powers(base: int, n: int) -> np.ndarray:
    with _LOCK:
        have = _POWERS.get(base)
        if have is None or len(have) < n:
            size = max(1 << 20, 1 << (n - 1).bit_length())
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
            _POWERS[base] = have
    return have


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts that lie one behind the other in `data`.

    Returns start and end of every word and, per text, where its words begin (one entry more than texts).
    """
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = solid
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(edge & (~before | cut))
    ends = np.flatnonzero(before & (~edge | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums over the bytes."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * _powers(_BASE, max(n, 1))[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, max(n, 1))[starts] + (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + h[i : i + n]
    return mix(out)


# Bytes of text that one step of the vectorised code takes together; a longer text is taken alone.
SLICE_BYTES = 1 << 20


def text_slices(column) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """An Arrow string column cut in slices of bounded bytes: first row, end row, bytes, offsets (nulls are empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return []
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    out, first = [], 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        out.append((first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]))
        first = end
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node of its component.

    Each round every node points to the smallest label around it and labels are then followed twice as far;
    the table is written each round, so lineage stays short. The driver sees one number per round.
    """
    both = materialize(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).filter("x <> y").distinct())
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root")))
    while True:
        # What the neighbours point to, gathered map-side before the shuffle.
        seen = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        # A root that has a smaller neighbour anywhere in its group is hung below it.
        hung = (
            labels.join(seen, labels.node == seen.x)
            .groupBy(F.col("root").alias("r"))
            .agg(F.min(F.least("near", "root")).alias("low"))
            .filter("low < r")
        )
        hung = materialize(hung)
        if hung.isEmpty():
            return labels
        # Follow hung roots to their end: chains of roots only get shorter.
        jump = hung
        while True:
            far = jump.alias("p").join(jump.alias("q"), F.col("p.low") == F.col("q.r"), "left").select("p.r", F.coalesce("q.low", "p.low").alias("low"), F.col("q.r").isNotNull().alias("moved"))
            far = materialize(far)
            jump = far.select("r", "low")
            if far.filter("moved").isEmpty():
                break
        labels = materialize(labels.join(jump, labels.root == jump.r, "left").select("node", F.coalesce("low", "root").alias("root")))
