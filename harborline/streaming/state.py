"""Rate limits, fixed sessions and task state, over tables and over streams.

The limiter lives in `limits`. A session is a small state machine that sees one event at a time; Spark
partitions, sorts and keeps the state. State is bounded per key: `limit` times for the limiter, two for a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harborline.functions import scalars as S
from harborline.operators.ordering import GROUP_ROWS, largest_group, over_ordered, running_max, running_sum
from harborline.session import materialize
from harborline.streaming.limits import RATE_COLUMNS, limit_sorted

SECOND = 1_000_000


class SessionRule:
    """A session lasts `ttl` from its start. The first access after that locks the key for `cooldown`;
    the first access after the lock starts a new session."""

    columns = "state string, session_start long, until long"

    def __init__(self, ttl_seconds: int = 3600, cooldown_seconds: int = 86400, start: int | None = None, locked: int | None = None):
        self.ttl, self.cooldown = ttl_seconds * SECOND, cooldown_seconds * SECOND
        self.start, self.locked = start, locked

    def see(self, t: int) -> tuple[str, int, int]:
        if self.locked is not None and t >= self.locked:
            self.start = self.locked = None
        if self.start is None:
            self.start = t
        if self.locked is None and t > self.start + self.ttl:
            self.locked = t + self.cooldown
        if self.locked is not None:
            return "locked", self.start, self.locked
        return "active", self.start, self.start + self.ttl



def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _run_sorted(df: DataFrame, group: Sequence[str], order: Sequence[str], make: Callable[[], object], columns: str, keep: Sequence[str]) -> DataFrame:
    """Feed each group's rows, in order and batch by batch, to a fresh rule. Memory holds one batch and one rule."""
    names = [c.split()[0] for c in columns.split(", ")]
    group = list(group)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rule = None, None
        for pdf in batches:
            rows = []
            for at, t in zip(zip(*[pdf[g] for g in group]), pdf["_us"]):
                if at != current:
                    current, rule = at, make()
                rows.append(rule.see(int(t)))
            made = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf[list(keep)], made], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep) + ", " + columns
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(step, schema)


def sessions(
    df: DataFrame, key: str, ts: str, ident: str, ttl_seconds: int = 3600, cooldown_seconds: int = 86400, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(key, ident, state, session_start, until) for every access; times in microseconds.

    Keys that fit one task are read in order, holding two numbers each. With a larger key, session
    starts are found by links instead, so that no task reads a whole key.
    """
    events = df.select(key, ident, _micros(ts).alias("_us"))
    if largest_group(events, [key]) <= group_rows:
        return _run_sorted(events, [key], ["_us", ident], lambda: SessionRule(ttl_seconds, cooldown_seconds), SessionRule.columns, [key, ident])
    return _linked_sessions(events, key, ident, ttl_seconds * SECOND, cooldown_seconds * SECOND, group_rows)


def _next_time(times: DataFrame, asked: DataFrame, key: str, at: str, name: str, or_equal: bool, group_rows: int) -> DataFrame:
    """Adds the first of times(key, _us) after (or at) the row's `at`: a backward running minimum over both, in blocks."""
    known = times.select(F.col(key), F.col("_us").alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_row"))
    wanted = asked.select(F.col(key), F.col(at).alias("_x"), F.lit(-1 if or_equal else 1).alias("_side"), F.col("_us").alias("_row")).filter(F.col("_x").isNotNull())
    both = known.unionByName(wanted).withColumns({"_back": -F.col("_x"), "_turn": -F.col("_side")})
    seen = {"_n": F.when(F.col("_side") == 0, -F.col("_x"))}
    filled = running_max(both, [key], ["_back", "_turn", "_row"], seen, group_rows)
    answers = filled.filter(F.col("_side") != 0).select(F.col(key), F.col("_row").alias("_us"), (-F.col("_n")).alias(name))
    return asked.join(answers, [key, "_us"], "left")


def _linked_sessions(events: DataFrame, key: str, ident: str, ttl: int, cooldown: int, group_rows: int) -> DataFrame:
    """Every access as a possible start is linked to the start that would follow it; the true starts are
    those reached from a key's first access. Each round doubles the links, so n sessions take log2(n) joins."""
    times = materialize(events.select(key, "_us").distinct())
    lock = materialize(_next_time(times, times.withColumn("_end", F.col("_us") + ttl), key, "_end", "_lock", False, group_rows).select(key, "_us", "_lock"))
    link = _next_time(times, lock.withColumn("_free", F.col("_lock") + cooldown), key, "_free", "_next", True, group_rows)
    link = materialize(link.select(key, "_us", "_next").filter(F.col("_next").isNotNull()))
    starts = materialize(times.groupBy(key).agg(F.min("_us").alias("_us")))
    while not link.isEmpty():
        reached = starts.join(link, [key, "_us"]).select(F.col(key), F.col("_next").alias("_us"))
        starts = materialize(starts.unionByName(reached).distinct())
        onward = link.select(F.col(key), F.col("_us").alias("_next"), F.col("_next").alias("_far"))
        link = materialize(link.join(onward, [key, "_next"]).select(F.col(key), F.col("_us"), F.col("_far").alias("_next")))
    opened = lock.join(starts, [key, "_us"], "left_semi")
    # Each time belongs to the last start at or before it.
    marked = times.join(starts.withColumn("_is", F.lit(True)), [key, "_us"], "left")
    owned = running_max(marked, [key], ["_us"], {"session_start": F.when(F.col("_is"), F.col("_us"))}, group_rows)
    known = owned.join(opened.select(F.col(key), F.col("_us").alias("session_start"), "_lock"), [key, "session_start"], "left")
    locked = F.coalesce(F.col("_us") >= F.col("_lock"), F.lit(False))
    stated = known.select(
        key, "_us", F.when(locked, "locked").otherwise("active").alias("state"), "session_start",
        F.when(locked, F.col("_lock") + cooldown).otherwise(F.col("session_start") + ttl).alias("until"),
    )
    return events.join(stated, [key, "_us"]).select(key, ident, "state", "session_start", "until")


See = Callable[[np.ndarray, "tuple | None"], "tuple[list[tuple], tuple]"]


def _stateful(df: DataFrame, key: str, ident: str, ts: str, see: See, columns: str, kept: str, horizon_seconds: int, delay: str) -> DataFrame:
    """A rule over a stream: one state (`kept`) per key, events of a trigger in (ts, ident) order. `see` takes their sorted
    times and the state, and returns the rows' `columns` and the new state.

    A key's state goes once the watermark (`delay` behind the newest event) is `horizon_seconds` past its last event,
    when it can't matter any more. Rows behind the watermark belong to split_late, before this.

    A key's events of one trigger are put in order together; the source's files per trigger bound them.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = sorted((int(t), i) for pdf in batches for t, i in zip(pdf["_us"], pdf[ident]))
        told, held = see(np.array([t for t, _ in rows], np.int64), state.get if state.exists else None)
        state.update(held)
        last = rows[-1][0] // 1000 + horizon_seconds * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], i, *t) for (_, i), t in zip(rows, told)], columns=[key, ident, *names])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{key}` {types[key]}, `{ident}` {types[ident]}, {columns}"
    return (
        df.select(key, ident, F.col(ts).cast("timestamp").alias("_ts"), _micros(ts).alias("_us"))
        .withWatermark("_ts", delay)
        .groupBy(key)
        .applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    )


def rate_stream(df: DataFrame, key: str, ts: str, ident: str, limit: int, window_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """limits.rate_check over a stream; a key's state is its last `limit` accepted times."""

    def see(times: np.ndarray, saved: tuple | None) -> tuple[list[tuple], tuple]:
        accepted, retry, held = limit_sorted(times, np.array([0]), [list(saved[0]) if saved else []], limit, window_seconds * SECOND)
        return list(zip(accepted.tolist(), retry.tolist())), (held[0],)

    return _stateful(df, key, ident, ts, see, RATE_COLUMNS, "times array<long>", window_seconds, delay)


def session_stream(df: DataFrame, key: str, ts: str, ident: str, ttl_seconds: int = 3600, cooldown_seconds: int = 86400, delay: str = "10 minutes") -> DataFrame:
    def see(times: np.ndarray, saved: tuple | None) -> tuple[list[tuple], tuple]:
        rule = SessionRule(ttl_seconds, cooldown_seconds, *(saved or (None, None)))
        return [rule.see(int(t)) for t in times], (rule.start, rule.locked)

    # A lock that the next access would set ends a cooldown after that access, so a silent key is as good as new.
    return _stateful(df, key, ident, ts, see, SessionRule.columns, "start long, locked long", ttl_seconds + cooldown_seconds, delay)


def gap_sessions(df: DataFrame, key: str, ts: str, ident: str, gap_seconds: int = 1800, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, ident, session, session_start): a session goes on until a pause longer than the gap; numbered from 1 per key."""
    events = df.select(key, ident, _micros(ts).alias("_us"))
    order = ["_us", ident]
    biggest = largest_group(events, [key])
    seen = over_ordered(events, [key], order, lambda w: {"_before": F.lag("_us").over(w)}, before=1, group_rows=group_rows, biggest=biggest)
    opens = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > gap_seconds * SECOND)
    numbered = running_sum(seen.withColumn("_open", opens.cast("long")), [key], order, {"session": F.col("_open")}, group_rows, biggest)
    started = running_max(numbered, [key], order, {"session_start": F.when(F.col("_open") == 1, F.col("_us"))}, group_rows, biggest)
    return started.select(key, ident, "session", "session_start")


def hourly_epoch_counts(df: DataFrame, ts: str, hours: int = 1) -> DataFrame:
    """(epoch, n): events per hour-wide epoch of a table. A stream takes windowed_counts, whose state is bounded."""
    return df.groupBy(S.hour_epoch(F.col(ts), hours).alias("epoch")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Hourly tumbling windows behind a watermark, for append mode: a closed hour is written once and its state dropped.

    Feed it the on-time side of split_late, so that no row is lost behind the watermark.
    """
    return df.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def state_progress(df: DataFrame, task: str, seq: str, state: str, progress: str) -> DataFrame:
    """Latest state and clamped progress of each task; also valid on a stream in update mode."""
    p = F.when(F.col(progress).isNotNull(), S.clamp(F.col(progress).cast("double"), 0.0, 1.0))
    return df.groupBy(task).agg(F.max_by(F.struct(F.col(state).alias("state"), p.alias("progress"), F.col(seq).alias("seq")), F.col(seq)).alias("_")).select(task, "_.*")


def expire_keys(held: DataFrame, expires: str, cooldown_until: str, now: Column, cooldown_hours: int = 24) -> DataFrame:
    """Sessions still worth keeping: neither past their lock nor past expiry, cooldown and one hour more (micros)."""
    hour = 3600 * SECOND
    gone = F.coalesce(now > F.col(cooldown_until), F.lit(False)) | (now > F.col(expires) + (cooldown_hours + 1) * hour)
    return held.filter(~gone)
