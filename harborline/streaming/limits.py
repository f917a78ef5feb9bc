"""A limit on events per key and window, over sorted blocks of events.

An event is accepted if fewer than `limit` accepted ones lie within the window before it. So of the accepted events in
order, the one `limit` places after event a is the first, behind its predecessor, that lies more than a window after
a. All keys of a block step along together: each step finds the next `limit` accepted events of every key from the
last `limit`, by one sorted search and a running maximum, and moves on by more than a window. What a block hands
to the next is its last `limit` accepted times. Blocks of a large key are gone through in stretches, many at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordering import GROUP_ROWS, POS, largest_group, positions
from harborline.session import materialize, scratch_path

SECOND = 1_000_000
RATE_COLUMNS = "accepted boolean, retry_after_seconds long"
# Rows of whole groups that one step of the vectorised code takes together.
STEP_ROWS = 200_000
# Stretches the largest key is cut in at least (if it has as many blocks). One task goes through a stretch, block by block.
STRETCHES = 24
# Rounds in which all stretches run again whose predecessor's hand-over changed; later only a key's first such one does.
EAGER_ROUNDS = 3


def limit_sorted(times: np.ndarray, starts: np.ndarray, held: Sequence[Sequence[int]], limit: int, window: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(accepted, seconds to wait, times handed on) for groups that lie one behind the other in `times`.

    `starts` has the first row of every group, in whose part times rise; `held` the last accepted times before it (at
    most `limit`, rising). An accepted time exactly one window old still counts.
    """
    n, groups = len(times), len(starts)
    accepted, retry = np.zeros(n, bool), np.zeros(n, np.int64)
    ends = np.append(starts[1:], n)
    if limit < 1 or n == 0:
        return accepted, np.full(n, max(1, window // SECOND), np.int64), [list(h) for h in held]
    before = np.zeros((groups, limit), np.int64)
    known = np.zeros((groups, limit), bool)
    for g, h in enumerate(held):
        if h:
            before[g, limit - len(h) :], known[g, limit - len(h) :] = h, True
    # One axis for all groups: each begins more than a window after the end of the one before.
    span = times[ends - 1] - times[starts] + 2 * window + 2
    moved = np.cumsum(span) - span - times[starts]
    axis = times + np.repeat(moved, ends - starts)
    ready = np.searchsorted(axis, axis + window, side="right")
    # The earliest place that each of the held times leaves open.
    free = np.searchsorted(axis, np.where(known, np.maximum(before, times[starts][:, None] - window - 1) + moved[:, None] + window, -1), side="right")
    at = np.clip(free, starts[:, None], ends[:, None])
    nth = np.arange(limit)
    last, alive = starts - 1, np.arange(groups)
    while len(alive):
        # Each is behind its predecessor, the first behind the last of the step before.
        at = np.maximum(np.maximum.accumulate(at - nth, axis=1), (last + 1)[:, None]) + nth
        inside = at < ends[alive][:, None]
        accepted[at[inside]] = True
        on = inside[:, -1]
        alive, at = alive[on], at[on]
        last, at = at[:, -1], np.minimum(ready[at], n)
    # A refused event waits for the oldest of the `limit` accepted before it.
    count = np.cumsum(accepted)
    base = np.append(0, count)[starts]
    sofar = count - np.repeat(base, ends - starts)
    taken = times[accepted]
    group = np.repeat(np.arange(groups), ends - starts)
    no = np.flatnonzero(~accepted)
    early = sofar[no] < limit
    oldest = np.empty(len(no), np.int64)
    oldest[early] = before[group[no[early]], sofar[no[early]]]
    oldest[~early] = taken[np.repeat(base, ends - starts)[no[~early]] + sofar[no[~early]] - limit] if len(taken) else 0
    retry[no] = np.maximum(1, (oldest + window - times[no]) // SECOND)
    through = np.append(0, count)
    handed = [[*h, *taken[max(through[a], through[b] - limit) : through[b]].tolist()][-limit:] for h, a, b in zip(held, starts, ends)]
    return accepted, retry, handed


def _group_starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[:1] = True
    for c in names:
        codes = table.column(c).combine_chunks()
        codes = pc.dictionary_encode(codes, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their first rows, from batches sorted by group."""
    kept: list[pa.RecordBatch] = []
    rows, step = 0, STEP_ROWS
    for b in batches:
        kept.append(b)
        rows += len(b)
        if rows < step:
            continue
        table = pa.Table.from_batches(kept)
        starts = _group_starts(table, names)
        cut = int(starts[-1])
        if cut == 0:  # one group so far: wait for more of it
            step *= 2
            continue
        yield table.slice(0, cut), starts[:-1]
        kept, rows, step = table.slice(cut).to_batches(), rows - cut, STEP_ROWS
    if rows:
        table = pa.Table.from_batches(kept)
        yield table, _group_starts(table, names)


def _limiter(group: Sequence[str], limit: int, window: int, keep: Sequence[str]) -> Callable:
    """Per row the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups((b for b in batches if len(b)), group):
            times = table.column("_us").to_numpy()
            held = [h or [] for h in table.column("_held").take(pa.array(starts)).to_pylist()]
            accepted, retry, _ = limit_sorted(times, starts, held, limit, window)
            out = table.select(list(keep)).append_column("accepted", pa.array(accepted)).append_column("retry_after_seconds", pa.array(retry))
            yield from out.combine_chunks().to_batches()

    return run


def rate_check(df: DataFrame, key: str, ts: str, ident: str, limit: int, window_seconds: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, ident, accepted, retry_after_seconds) for every event, in (ts, ident) order per key.

    Keys that fit one task are taken whole. Where a key is larger, events are cut in blocks of `group_rows`, in order, and
    blocks dealt to stretches. All stretches run at once, at first as if nothing came before; then those run again whose
    predecessor hands on other times than they began with, until none does. What is accepted soon depends little on the
    distant past, so few rounds are usual; the worst case is a round for each stretch of the largest key, each of one
    stretch a key. Null times are refused without a time to wait, null keys are one key. A limit below 1 refuses everything.
    """
    window = window_seconds * SECOND
    events = df.select(key, ident, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    types = dict(events.dtypes)
    rows_schema = f"`{key}` {types[key]}, `{ident}` {types[ident]}, {RATE_COLUMNS}"
    timed, order = events.filter("_us IS NOT NULL"), ["_us", ident]
    if largest_group(timed, [key]) <= group_rows:
        dealt = timed.withColumn("_held", F.lit(None).cast("array<bigint>")).repartition(key).sortWithinPartitions(key, *order)
        out = dealt.mapInArrow(_limiter([key], limit, window, [key, ident]), rows_schema)
    else:
        placed = materialize(positions(timed, [key, *order], table_rows=0).withColumn("_block", F.floor(F.col(POS) / F.lit(group_rows))))
        held = _hand_overs(placed, key, limit, window, group_rows)
        own = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))
        dealt = placed.join(held, own, "left").repartition(key, "_block").sortWithinPartitions(key, "_block", POS)
        out = dealt.select(key, ident, "_us", "_held", "_block").mapInArrow(_limiter([key, "_block"], limit, window, [key, ident]), rows_schema)
    untimed = events.filter("_us IS NULL").select(key, ident, F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("retry_after_seconds"))
    return out.unionByName(untimed)


def _through_stretches(limit: int, window: int) -> Callable:
    """Per block the times it begins with and hands on; the blocks of a stretch are taken in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for table, starts in _whole_groups((b for b in batches if len(b)), ["_k", "_s", "_block"]):
            times = table.column("_us").to_numpy()
            heads = table.select(["_k", "_s", "_block"]).take(pa.array(starts))
            opening = table.column("_opens").take(pa.array(starts)).to_pylist()
            given = table.column("_held").take(pa.array(starts)).to_pylist()
            began, handed = [], []
            for a, b, opens, first in zip(starts, np.append(starts[1:], len(times)), opening, given):
                held = first if opens else held
                began.append(held)
                held = limit_sorted(times[a:b], np.zeros(1, np.int64), [held], limit, window)[2][0]
                handed.append(held)
            lists = pa.list_(pa.int64())
            yield from heads.append_column("_held", pa.array(began, lists)).append_column("handed", pa.array(handed, lists)).combine_chunks().to_batches()

    return run


def _hand_overs(placed: DataFrame, key: str, limit: int, window: int, group_rows: int) -> DataFrame:
    """(_k, _b, _held): the times with which each block of a key that has several begins. One row per such block.

    Blocks of a key are dealt in order to stretches of equally many, none of more rows than fit one task.
    """
    types = dict(placed.dtypes)
    schema = f"_k {types[key]}, _s bigint, _b bigint, _held array<bigint>, handed array<bigint>"
    spans = materialize(placed.groupBy(F.col(key).alias("_k")).agg(F.min("_block").alias("_from"), F.max("_block").alias("_to")).filter("_to > _from"))
    most = spans.agg(F.max(F.col("_to") - F.col("_from") + 1)).first()[0] or 1
    each = max(1, min(-(-most // STRETCHES), GROUP_ROWS // group_rows))
    turn_of = F.col("_block") - F.col("_from")
    several = placed.join(spans, F.col(key).eqNullSafe(F.col("_k"))).select("_k", "_us", "_block", POS, F.floor(turn_of / each).alias("_s"), (turn_of % each == 0).alias("_opens"))
    path = scratch_path(placed.sparkSession, "stretches")
    several.write.partitionBy("_s").parquet(path)
    lines = placed.sparkSession.read.schema(several.schema).parquet(path)
    last = F.floor((F.col("_to") - F.col("_from")) / each)
    told = None
    todo = materialize(spans.select("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_s"), F.array().cast("array<bigint>").alias("_held")))
    same = lambda a, b: F.col(f"{a}._k").eqNullSafe(F.col(f"{b}._k")) & (F.col(f"{a}._s") == F.col(f"{b}._s"))
    turn = 0
    # Numbers of stretches to run, as many at most as the largest key has; only their files are read.
    while wanted := [r[0] for r in todo.select("_s").distinct().collect()]:
        dealt = lines.filter(F.col("_s").isin(wanted)).alias("l").join(todo.alias("t"), same("l", "t")).select("l._k", "l._s", "_us", "_block", "_opens", "_held", POS)
        ordered = dealt.repartition("_k", "_s").sortWithinPartitions("_k", "_s", POS)
        new = ordered.mapInArrow(_through_stretches(limit, window), schema)
        if told is not None:
            new = new.unionByName(told.alias("o").join(todo.alias("t"), same("o", "t"), "left_anti"))
        told = materialize(new)
        ends = told.groupBy("_k", "_s").agg(F.min_by("_held", "_b").alias("_held"), F.max_by("handed", "_b").alias("handed"))
        nexts = ends.select("_k", (F.col("_s") + 1).alias("_s"), F.col("handed").alias("_now"))
        differ = ends.alias("o").join(nexts.alias("n"), same("o", "n")).filter("o._held <> n._now").select("o._k", "o._s", F.col("n._now").alias("_held"))
        turn += 1
        if turn >= EAGER_ROUNDS:
            differ = differ.groupBy("_k").agg(F.min_by(F.struct("_s", "_held"), "_s").alias("f")).select("_k", "f._s", "f._held")
        todo = materialize(differ)
    return told.select("_k", "_b", "_held")
