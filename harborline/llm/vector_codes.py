"""Vectors stored as short codes: each is cut in parts, and each part is replaced by the nearest entry of a codebook.

Codebooks are fitted by rounds of assignment and averaging, in whole numbers, so that results are exact whatever the
order of work. The parts of one position are sorted along a Hilbert curve and packed in flat blocks of neighbours, each
with the least and greatest value of every component (its box) and the sum of its parts. In a round, the distances from
a codebook entry to the nearest and the farthest point of a box bound its distances to all parts inside: entries that
can't be nearest to any of them are left out. Where one entry remains, the block is assigned by its count and sum alone;
else the remaining entries are compared in one small kernel. Only sums and counts by codebook entry reach the driver.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.session import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_PARTS = 256
# Whole numbers are held at this bound. Up to NARROW, 64 bits hold every squared distance; beyond it Python's numbers do.
BOUND = 1 << 50
NARROW = 1 << 24
MOST_ERROR = ((1 << 63) - 1) // 256


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a null vector or one with a null or non-finite component."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    held = lambda v: F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), x(v) * scale))
    return F.when(~bad, F.transform(vector, lambda v: F.floor(held(v))))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows, components) along a Hilbert curve; `bits` a component, 62 in all at most."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _cut(parts: int, low: float, high: float):
    """Rows of vectors to rows of (part, key, rid, value): values as bytes, keys on a grid between `low` and `high`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            rows = _matrix(b.column("v")).astype(np.int64)
            length = rows.shape[1] // parts
            shown = min(length, 62)
            bits = max(1, min(12, 62 // shown))
            for p in range(parts):
                mine = np.ascontiguousarray(rows[:, p * length : (p + 1) * length])
                at = (mine[:, :shown] - low) / max(high - low, 1.0) * (1 << bits)
                keys = hilbert_keys(np.clip(at, 0, (1 << bits) - 1).astype(np.int64), bits)
                flat = pa.array([v.tobytes() for v in mine], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), p, np.int32)), pa.array(keys), b.column("rid"), flat], ["part", "key", "rid", "value"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task to blocks of one part position each."""

    def blocks(part: int, rids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cuts = [slice(i, i + BLOCK_PARTS) for i in range(0, len(rids), BLOCK_PARTS)]
        raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(cuts), part, np.int32)),
                raw(values[c].min(axis=0) for c in cuts), raw(values[c].max(axis=0) for c in cuts), raw(values[c].sum(axis=0) for c in cuts),
                raw(rids[c] for c in cuts), raw(values[c] for c in cuts),
            ],
            ["part", "low", "high", "total", "rids", "flat"],
        )

    part, rids, values = -1, np.zeros(0, np.int64), None
    for b in batches:
        which = b.column("part").to_numpy()
        length = len(b.column("value")[0].as_py()) // 8 if len(b) else 0
        got = np.frombuffer(b"".join(b.column("value").to_pylist()), np.int64).reshape(len(b), length)
        ids = b.column("rid").to_numpy()
        for p in np.unique(which):
            mine = which == p
            if p != part or values is None:
                if len(rids):
                    yield blocks(part, rids, values)
                part, rids, values = int(p), ids[mine], got[mine]
            else:
                rids, values = np.concatenate([rids, ids[mine]]), np.vstack([values, got[mine]])
            full = len(rids) // BLOCK_PARTS * BLOCK_PARTS
            if full:
                yield blocks(part, rids[:full], values[:full])
                rids, values = rids[full:], values[full:]
    if len(rids):
        yield blocks(part, rids, values)


def shortlist(book: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to some point of the box, in order. An entry is out if even its nearest point of the box
    is farther than another entry's farthest point."""
    under, over = low - book, book - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest_entries(book: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row, ties to the lower entry."""
    off = values[:, None, :] - book[None, :, :]
    far = (off * off).sum(axis=2)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(values)), best]


def _read_blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray, kind: type):
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("part", "low", "high", "total", "rids", "flat")]
        for part, low, high, total, rids, flat in zip(*columns):
            book = books[part]
            low, high = (np.frombuffer(x, np.int64).astype(kind) for x in (low, high))
            listed = shortlist(book, low, high)
            yield part, book, listed, np.frombuffer(total, np.int64), len(rids) // 8, rids, flat


def _sums(books: np.ndarray, kind: type):
    """Counts and sums of the parts by nearest entry: one row per part position, entry and component, a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, length = books.shape
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros(books.shape, object)
        for part, book, listed, total, n, _, flat in _read_blocks(batches, books, kind):
            if len(listed) == 1:
                counts[part, listed[0]] += n
                sums[part, listed[0]] += total.astype(object)
                continue
            values = np.frombuffer(flat, np.int64).reshape(n, length)
            best, _ = nearest_entries(book[listed], values.astype(kind))
            for e in np.unique(best):
                mine = values[best == e]
                counts[part, listed[e]] += len(mine)
                sums[part, listed[e]] += mine.sum(axis=0).astype(object)
        p, e = np.nonzero(counts)
        if len(p):
            flat_sums = [decimal.Decimal(int(x)) for x in sums[p, e].reshape(-1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, length)), pa.array(np.repeat(e, length)), pa.array(np.tile(np.arange(length), len(p))), pa.array(np.repeat(counts[p, e], length)), pa.array(flat_sums, pa.decimal128(38, 0))],
                ["part", "entry", "at", "n", "total"],
            )

    return run


def _codes(books: np.ndarray, kind: type):
    """(rid, code moved to the part's place, squared distance) of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, length = books.shape
        for part, book, listed, _, n, rids, flat in _read_blocks(batches, books, kind):
            values = np.frombuffer(flat, np.int64).reshape(n, length).astype(kind)
            best, far = nearest_entries(book[listed], values)
            code = listed[best].astype(np.uint8)
            error = np.minimum(far, MOST_ERROR).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rids, np.int64)), pa.array(np.full(n, part, np.int32)), pa.array(code.astype(np.int32)), pa.array(error)], ["rid", "part", "entry", "off"])

    return run


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, `code`, `error`, `label_error` per usable row; codebooks as whole numbers (part, entry, component)).

    Vectors that are null or hold a null or non-finite component are left out. Components become floor(scale * x), held at
    2**50 either way; shorter vectors are padded with zeros to the longest length and that to a multiple of `parts`.
    Codebooks start from the `entries` smallest ids (of repeated ids the least vector; a null id comes after all others)
    and have fewer entries where there are fewer ids. Nearest is by squared distance, ties to the lower entry; averages are
    rounded down, an unused entry stays. `code` holds two hexadecimal digits a part, `error` the squared distances summed
    (one part's held at 2**63 / 256), `label_error` their sum over all rows of the label, null labels together. A repeated
    row is coded like the first. No usable row: no rows, codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, so that two digits name each")
    spark = df.sparkSession
    numbers = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(F.col(vector_col), scale).alias("v")).filter("v IS NOT NULL")
    row = numbers.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    longest = -(-max(row[0] or 0, 1) // parts) * parts
    kind = np.int64 if (row[1] or 0) <= NARROW and longest // parts <= 1 << 11 else object
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v")))
    kept = materialize(numbers.select(F.monotonically_increasing_id().alias("rid"), "id", "label", padded.alias("v")))
    order = F.col("id").asc_nulls_last()
    first_ids = kept.select("id").distinct().orderBy(order).limit(entries)
    first = first_ids.withColumnRenamed("id", "i").join(kept, F.col("i").eqNullSafe(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).orderBy(order).collect()
    length = longest // parts
    books = np.array([r["v"] for r in first], object).reshape(len(first), parts, length).transpose(1, 0, 2).astype(kind)
    out = "id {}, label {}, code string, error bigint, label_error bigint".format(dict(kept.dtypes)["id"], dict(kept.dtypes)["label"])
    if not first:
        return _named(spark.createDataFrame([], out), id_col, label_col), books
    # The grid of the curve leaves out the outermost hundredths, so that a few long vectors don't flatten all others.
    low, high = kept.select(F.explode("v").alias("x")).agg(F.percentile_approx("x", [0.01, 0.99], 1000)).first()[0]
    rows = kept.mapInArrow(_cut(parts, float(low), float(high)), "part int, key bigint, rid bigint, value binary")
    # Equal parts are told apart by their row, so that a very common vector is dealt over several tasks.
    ranged = rows.repartitionByRange("part", "key", "rid").sortWithinPartitions("part", "key", "rid")
    blocks = materialize(ranged.mapInArrow(_pack, "part int, low binary, high binary, total binary, rids binary, flat binary"))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books, kind), "part bigint, entry bigint, at bigint, n bigint, total decimal(38,0)")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    coded = blocks.mapInArrow(_codes(books, kind), "rid bigint, part int, entry int, off bigint")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda c: F.lower(F.lpad(F.hex(c["entry"]), 2, "0")))
    joined = coded.groupBy("rid").agg(F.array_join(digits, "").alias("code"), F.sum("off").alias("error"))
    scored = materialize(joined.join(kept.select("rid", "id", "label"), "rid").drop("rid"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    per_label = materialize(scored.groupBy(F.col("label").alias("l")).agg(F.least(most, F.sum(F.col("error").cast("decimal(28,0)"))).cast("long").alias("label_error")))
    told = scored.join(per_label, F.col("label").eqNullSafe(F.col("l"))).select("id", "label", "code", "error", "label_error")
    return _named(told, id_col, label_col), books


def _named(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return df.withColumnsRenamed({"id": id_col, "label": label_col}) if (id_col, label_col) != ("id", "label") else df


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all numbers by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def decode_vectors(coded: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code", out: str = "decoded") -> DataFrame:
    """Adds the vector that a code stands for (array<double>): its entries' components and half a step, scaled back."""
    parts, entries, _ = books.shape
    tables = [F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in books[p, e]]) for e in range(entries)]) for p in range(parts)]
    entry = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn(out, F.concat(*[F.get(tables[p], entry(p)) for p in range(parts)])) if entries else coded.withColumn(out, F.lit(None).cast("array<double>"))
