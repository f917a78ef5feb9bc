"""Row order without one-task windows.

Every ordered operator takes an explicit order ending in a unique column. A group, or a whole
table, that fits one task is handled by a plain window; its size is checked first. Beyond the
bound, rows are range-partitioned by (group, order), numbered, and cut into blocks of bounded
length, so a key holding a third of the table is spread over many tasks with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from harborline.session import materialize

# Rows one task may sort for a window. Larger groups take the block path.
GROUP_ROWS = 2_000_000
# Tables this small are numbered by one window.
TABLE_ROWS = 100_000

POS = "_pos"
BLOCK = "_block"


def require_order(order_by: Sequence[str]) -> list[str]:
    if not order_by:
        raise ValueError("order_by is required: rows of a DataFrame have no order of their own")
    return list(order_by)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group: a count with map-side combine over the key columns only."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def positions(df: DataFrame, order_by: Sequence[str], table_rows: int = TABLE_ROWS) -> DataFrame:
    """Add a 0-based global position by `order_by`."""
    order = require_order(order_by)
    if df.count() <= table_rows:
        w = Window.orderBy(*order)
        return df.withColumn(POS, (F.row_number().over(w) - 1).cast("long"))
    ranged = materialize(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # One row per partition: its size and where it starts.
    sizes = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("_first"))
        .orderBy("_part")
        .collect()
    )
    starts, seen = [], 0
    for row in sizes:
        starts.append((row["_part"], row["_first"], seen))
        seen += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _first long, _start long")
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(POS, F.col("_mid") - F.col("_first") + F.col("_start"))
        .drop("_part", "_mid", "_first", "_start")
    )


def over_ordered(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    group_rows: int = GROUP_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    `biggest` is the largest group's size where the caller knows it; else it is counted.

    On the block path the edge rows of each block are copied to its neighbour, so every frame is
    whole, and the copies are dropped afterwards.
    """
    keys, order = list(partition_by), require_order(order_by)
    if (largest_group(df, keys) if biggest is None else biggest) <= group_rows:
        w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
        return df.withColumns(build(w))
    if max(before, after) > group_rows:
        raise ValueError("the frame is longer than a block")
    size = F.lit(group_rows)
    placed = positions(df, keys + order, table_rows=min(TABLE_ROWS, group_rows))
    home = F.floor(F.col(POS) / size)
    at = F.col(POS) - home * size
    targets = F.array_compact(
        F.array(
            home,
            F.when(at >= size - before, home + 1),
            F.when(at < after, home - 1),
        )
    )
    copies = placed.withColumn("_home", home).withColumn(BLOCK, F.explode(targets))
    w = Window.partitionBy(*keys, BLOCK).orderBy(POS)
    return (
        copies.withColumns(build(w)).filter(F.col("_home") == F.col(BLOCK)).drop(POS, BLOCK, "_home")
    )


def running_sum(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    sums: dict[str, Column],
    group_rows: int = GROUP_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per group (nulls count as 0)."""
    zero = F.lit(0)
    return _running(df, partition_by, order_by, sums, group_rows, biggest, lambda c: F.coalesce(F.sum(c), zero), lambda a, b: a + F.coalesce(b, zero), zero)


def running_max(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    values: dict[str, Column],
    group_rows: int = GROUP_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """Add inclusive running maxima per group (nulls are passed over)."""
    return _running(df, partition_by, order_by, values, group_rows, biggest, F.max, F.greatest, None)


def _running(df, partition_by, order_by, values, group_rows, biggest, agg, plus, start) -> DataFrame:
    """Running aggregate: one window where groups are small, else inside blocks plus what came before each block."""
    keys, order = list(partition_by), require_order(order_by)
    names = list(values)
    upto_here = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    over = lambda c, w: agg(c).over(w) if start is None else F.coalesce(F.sum(c).over(w), start)
    bound = group_rows if keys else min(group_rows, TABLE_ROWS)
    if (largest_group(df, keys) if biggest is None else biggest) <= bound:
        w = upto_here(Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order))
        return df.withColumns({n: over(c, w) for n, c in values.items()})
    placed = materialize(
        positions(df.withColumns(values), keys + order, table_rows=min(TABLE_ROWS, group_rows)).withColumn(
            BLOCK, F.floor(F.col(POS) / F.lit(group_rows))
        )
    )
    # One row per (group, block); groups never span more blocks than rows / group_rows + 1.
    totals = placed.groupBy(*keys, BLOCK).agg(*[agg(F.col(n)).alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BLOCK).alias("_b"),
        *[over(F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n in names],
    )
    match = F.col(BLOCK) == F.col("_b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = upto_here(Window.partitionBy(*keys, BLOCK).orderBy(POS))
    local = placed.withColumns({n: over(F.col(n), inside) for n in names})
    return (
        local.join(carry, match, "left")
        .withColumns({n: plus(F.col(n), F.col(f"_c_{n}")) for n in names})
        .drop(POS, BLOCK, "_b", *[f"_k_{k}" for k in keys], *[f"_c_{n}" for n in names])
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], small_rows: int = 500_000
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of numeric columns, returned as fitted parameters.

    Small tables use the built-in `percentile`. Its buffer holds every distinct value, so larger
    ones bracket each wanted rank with `percentile_approx`, count what lies below the bracket and
    sort only the values inside it.
    """
    cols, probs = list(columns), list(probabilities)
    if df.count() <= small_rows:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probs))).alias(c) for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    accuracy = 10_000
    margin = 2.0 / accuracy
    ends = [p for q in probs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), ends, accuracy).alias(f"a_{c}") for c in cols],
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols],
    ).first()
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    open_: dict[int, tuple] = {}
    for k, c in enumerate(cols):
        for i, q in enumerate(probs):
            if sketch[f"n_{c}"]:
                open_[k * len(probs) + i] = (c, i, (sketch[f"n_{c}"] - 1) * q, sketch[f"a_{c}"][2 * i], sketch[f"a_{c}"][2 * i + 1])
    while open_:
        done = _ranked_values(df, open_, {c: sketch[f"n_{c}"] for c in cols})
        for b, (c, i, rank, lo, hi) in list(open_.items()):
            if done.get(b) is not None:
                a, z = done[b]
                found[c][i] = a + (rank - int(rank)) * (z - a)
                del open_[b]
            else:  # the bracket missed the rank: widen it
                width = max(hi - lo, abs(hi), 1e-9)
                open_[b] = (c, i, rank, max(sketch[f"lo_{c}"], lo - width), min(sketch[f"hi_{c}"], hi + width))
    return found


def _ranked_values(df: DataFrame, brackets: dict[int, tuple], rows: dict[str, int]) -> dict[int, tuple[float, float] | None]:
    """For each bracket the values at the two ranks around its own, where it holds both."""
    value = lambda c: F.col(c).cast("double")
    below = df.agg(*[F.count_if(value(c) < lo).alias(f"b{b}") for b, (c, _, _, lo, _) in brackets.items()]).first()
    inside = F.array(*[F.when((value(c) >= lo) & (value(c) <= hi), F.struct(F.lit(b).alias("b"), value(c).alias("v"))) for b, (c, _, _, lo, hi) in brackets.items()])
    counts = materialize(df.select(F.explode(F.array_compact(inside)).alias("x")).groupBy("x.b", "x.v").agg(F.count(F.lit(1)).alias("n")))
    upto = running_sum(counts, ["b"], ["v"], {"upto": F.col("n")})
    low = {b: int(rank) for b, (_, _, rank, _, _) in brackets.items()}
    high = {b: min(int(rank) + 1, rows[c] - 1) for b, (c, _, rank, _, _) in brackets.items()}
    at = lambda m: F.element_at(F.create_map(*[F.lit(x) for b in brackets for x in (b, m[b])]), F.col("b"))
    total = F.col("upto") + at({b: below[f"b{b}"] for b in brackets})
    picked = upto.groupBy("b").agg(F.min(F.when(total > at(low), F.col("v"))).alias("a"), F.min(F.when(total > at(high), F.col("v"))).alias("z"))
    out: dict[int, tuple[float, float] | None] = {}
    for r in picked.collect():  # one row per bracket
        fits = below[f"b{r['b']}"] <= low[r["b"]] and r["a"] is not None and r["z"] is not None
        out[r["b"]] = (r["a"], r["z"]) if fits else None
    return out


def smallest(df: DataFrame, order_by: Sequence[str | Column], n: int, driver_free_above: int = 10_000) -> DataFrame:
    """The first n rows by `order_by`. Large n is cut by position, so no task holds more than its share."""
    if n <= driver_free_above:
        return df.orderBy(*order_by).limit(n)
    names = [f"_o{i}" for i in range(len(order_by))]
    keyed = df.withColumns({a: (F.col(c) if isinstance(c, str) else c) for a, c in zip(names, order_by)})
    return positions(keyed, names).filter(F.col(POS) < n).drop(POS, *names)


# Up to this k Spark itself cuts every group to k rows in each map task before the shuffle.
GROUP_LIMIT_KEY = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_per_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int, rank: str = "rank", group_rows: int = GROUP_ROWS, salts: int = 256
) -> DataFrame:
    """The first k rows of each group with their 1-based rank.

    For small k the optimizer pushes the limit under the shuffle, so a hot group arrives cut down.
    For larger k a group beyond one task's bound is first cut to k rows in each of `salts` parts,
    which keeps every row that can be in the answer.
    """
    pushed = k <= int(df.sparkSession.conf.get(GROUP_LIMIT_KEY, "1000"))
    if not pushed and largest_group(df, keys) > group_rows:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order_by)
        df = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


# A side of a join this small is sent to every task; its rows are counted first.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows, marked for broadcast when they are few enough; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
