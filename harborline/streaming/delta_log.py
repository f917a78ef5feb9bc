"""Keyed tables kept up by a stream: small deltas by key bucket, merged when read and compacted in levels.

A batch writes only its own rows, already merged by key, into the buckets it touches. A manifest lists which pieces of
which bucket are live; it is written last, under the batch's number, by renaming a finished file. So a batch that is
repeated after a failure either finds its manifest and changes nothing, or writes over pieces that nobody has read.
When a bucket holds FANOUT pieces of one level they are merged into one of the next. After n batches a bucket has fewer
than FANOUT pieces in each of log(n) levels, and a row has been rewritten log(n) times.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
# Rows of a bucket that one task sorts and writes; a fuller bucket is dealt to several.
TASK_ROWS = 500_000
# Manifests kept, so that a reader of the one before the last still finds its files.
KEPT_MANIFESTS = 2


@dataclass(frozen=True)
class Keyed:
    """A table of the log: its columns, the key that deals rows to buckets, and how rows of equal key become one.

    `merge` must give the same rows whether it is applied to all pieces at once or to some of them first.
    """

    schema: str
    key: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 16


class DeltaLog:
    """One writer, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Keyed], fanout: int = FANOUT):
        self.spark, self.path, self.tables, self.fanout = spark, path.rstrip("/"), tables, fanout
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"manifests/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _state(self) -> dict:
        """{"batch": number, "live": {table: {bucket: [[folder, level], ...]}}}"""
        numbers = self._manifests()
        return self._load(numbers[-1]) if numbers else {"batch": -1, "live": {}}

    @property
    def batch(self) -> int:
        """The last batch that counts; -1 before the first."""
        return (self._manifests() or [-1])[-1]

    def _write(self, name: str, rows: DataFrame, folder: str, n: int = 0) -> list[str]:
        """Merged rows by bucket; the buckets that got any. `n` tells about how many rows there are, where that is known."""
        table = self.tables[name]
        slices = max(1, -(-n // (table.buckets * TASK_ROWS)))
        bucket = F.pmod(F.xxhash64(*table.key), F.lit(table.buckets)).cast("int")
        columns = [f.strip().split(" ")[0] for f in _fields(table.schema)]
        merged = table.merge(rows).select(*columns, bucket.alias("_bucket"))
        dealt = merged.repartition(table.buckets * slices, F.col("_bucket"), F.pmod(F.xxhash64(*columns), F.lit(slices)))
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}/{folder}")
        return [n.split("=")[1] for n in self._names(f"{name}/{folder}") if n.startswith("_bucket=")]

    def _read(self, name: str, pieces: list[tuple[str, str]]) -> DataFrame:
        reader = self.spark.read.schema(self.tables[name].schema)
        if not pieces:
            return self.spark.createDataFrame([], self.tables[name].schema)
        return reader.parquet(*[f"{self.path}/{name}/{folder}/_bucket={bucket}" for folder, bucket in pieces])

    def commit(self, batch: int, rows: dict[str, DataFrame], about: dict[str, int] | None = None) -> None:
        """Add a batch's rows of any of the tables. A batch that counts already changes nothing.

        `about` tells how many rows there are before they are merged, roughly, so that no task has to write too many.
        """
        state = self._state()
        if batch <= state["batch"]:
            return
        live, made = state["live"], set()
        for name, frame in rows.items():
            held = live.setdefault(name, {})
            for bucket in self._write(name, frame, f"d{batch}", (about or {}).get(name, 0)):
                held.setdefault(bucket, []).append([f"d{batch}", 0])
                made.add((name, f"d{batch}", bucket))
            made |= self._compact(name, held, batch)
        state = {"batch": batch, "live": live}
        self._publish(state)
        # Pieces merged on in the same batch are in no manifest.
        self._remove(made - _pieces(state))

    def _compact(self, name: str, held: dict[str, list], batch: int) -> set[tuple[str, str, str]]:
        """Merge levels that are full; the pieces written."""
        level, made = 0, set()
        while full := {b: own for b, all_ in held.items() if len(own := [p for p in all_ if p[1] == level]) >= self.fanout}:
            folder = f"c{batch}-{level}"
            rows = self._read(name, [(p, b) for b, own in full.items() for p, _ in own])
            self._write(name, rows, folder, rows.count())
            for b in full:
                # Older pieces are of higher levels and stand first.
                held[b] = [p for p in held[b] if p[1] != level] + [[folder, level + 1]]
                made.add((name, folder, b))
            level += 1
        return made

    def _publish(self, state: dict) -> None:
        draft, final = self._at(f"manifests/{state['batch']}.tmp"), self._at(f"manifests/{state['batch']}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"the manifest of batch {state['batch']} could not be put in place")
        numbers = self._manifests()
        kept = set().union(*[_pieces(self._load(n)) for n in numbers[-KEPT_MANIFESTS:]])
        for n in numbers[:-KEPT_MANIFESTS]:
            self._remove(_pieces(self._load(n)) - kept)
            self._fs.delete(self._at(f"manifests/{n}.json"), False)

    def _remove(self, pieces: set[tuple[str, str, str]]) -> None:
        for name, folder, bucket in pieces:
            self._fs.delete(self._at(f"{name}/{folder}/_bucket={bucket}"), True)
            if not any(x.startswith("_bucket=") for x in self._names(f"{name}/{folder}")):
                self._fs.delete(self._at(f"{name}/{folder}"), True)

    def read(self, name: str) -> DataFrame:
        """The table's rows as of the last batch, one per key."""
        live = self._state()["live"].get(name, {})
        return self.tables[name].merge(self._read(name, [(p, b) for b, own in live.items() for p, _ in own]))

    def pieces(self, name: str) -> dict[str, int]:
        """Live pieces of each bucket."""
        return {b: len(own) for b, own in self._state()["live"].get(name, {}).items()}


def _pieces(state: dict) -> set[tuple[str, str, str]]:
    return {(name, p, b) for name, held in state["live"].items() for b, own in held.items() for p, _ in own}


def _fields(schema: str) -> list[str]:
    """The schema's fields, cut at commas outside angle brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
