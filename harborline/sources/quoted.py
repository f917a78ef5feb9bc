"""Delimited files whose quoted cells hold line breaks, cut into records by all tasks at once.

A line break ends a record where the number of quotes before it is even. Each byte range of a file counts its quotes; a
running sum over the ranges of a file, one row each, says which of them begin inside quotes. Knowing that, every range is
cut by itself, in one pass over its lines. What a range can't finish (the end of a record that began before it, the
beginning of one that ends behind it) are its fragments, two at most, which are then joined by file and record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.operators.ordering import BROADCAST_ROWS
from harborline.session import materialize

# Pieces of a range, in the order in which they stand in it.
WHOLE, TAIL, MIDDLE, HEAD = range(4)
PIECES = "file string, block bigint, kind int, header boolean, text string"


class _Range:
    """The open record of the byte range that is being read."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block = file, block
        # A record that began before this range: its end here is a fragment.
        self.begun_before, self.open, self.lines, self.fresh = inside, inside, [], True
        self.header = False

    def close(self, kind: int) -> tuple:
        out = (self.file if kind else None, self.block, kind, self.header, "\n".join(self.lines))
        self.lines, self.begun_before, self.open, self.header = [], False, False, False
        return out

    def rest(self) -> list[tuple]:
        """What is left when the range ends inside quotes."""
        return [self.close(MIDDLE if self.begun_before else HEAD)] if self.open else []


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    for b in batches:
        if not len(b):
            continue
        files, blocks = b.column("file"), b.column("block").to_numpy()
        odd = b.column("odd").to_numpy(zero_copy_only=False).astype(bool)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        texts = b.column("value")
        alone, rows = [], []
        for first, end in zip([0, *new], [*new, len(b)]):
            file, block = files[int(first)].as_py(), int(blocks[first])
            if now is None or (file, block) != (now.file, now.block):
                rows += now.rest() if now else []
                now = _Range(file, block, bool(b.column("inside")[int(first)].as_py()))
            after = (np.cumsum(odd[first:end]) + now.open) % 2 == 1
            before = np.append(now.open, after[:-1])
            single = ~before & ~after
            if now.fresh and single[0] and block == 0:
                rows.append((None, block, WHOLE, True, texts[int(first)].as_py()))
                single[0] = False
                skip = 1
            else:
                skip = 0
                now.header = now.fresh and block == 0
            now.fresh = False
            alone.append(first + np.flatnonzero(single))
            # Only lines of records that span several lines are looked at one by one.
            for i in np.flatnonzero(before | after):
                if i < skip:
                    continue
                now.lines.append(texts[int(first + i)].as_py())
                now.open = True
                if not after[i]:
                    rows.append(now.close(TAIL if now.begun_before else WHOLE))
        kept = np.concatenate(alone)
        if len(kept):
            n = len(kept)
            whole = [pa.nulls(n, pa.string()), pa.array(blocks[kept]), pa.array(np.full(n, WHOLE, np.int32)), pa.array(np.zeros(n, bool)), texts.take(pa.array(kept))]
            yield pa.RecordBatch.from_arrays(whole, ["file", "block", "kind", "header", "text"])
        if rows:
            yield _pieces(rows)
    if now and now.open:
        yield _pieces(now.rest())


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "block", "kind", "header", "text"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, text): every record of the files under `path`, `header` true for the first one of a file.

    Line breaks inside quotes are kept; those between records are "\\n" or "\\r\\n". Empty lines between records are left
    out. A file that ends inside quotes ends its last record there.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = raw.withColumn("odd", (F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1)
    # One row per byte range; a file has its size / spark.sql.files.maxPartitionBytes of them.
    ranges = lines.groupBy("file", "block").agg(F.count_if("odd").alias("n"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.select("file", "block", (F.sum("n").over(upto) % 2 == 1).alias("inside")).filter("inside")
    inside = materialize(inside)
    if inside.count() <= BROADCAST_ROWS:
        # A broadcast join leaves the lines of a range in their order.
        marked = lines.join(F.broadcast(inside), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("nth", F.monotonically_increasing_id()).join(inside, ["file", "block"], "left")
        marked = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "nth")
    told = marked.select("value", "file", "block", "odd", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = materialize(told.mapInArrow(_cut, PIECES))
    whole = pieces.filter(F.col("kind") == WHOLE).select("header", "text")
    # Fragments of a file in order: a record's beginning, the ranges it runs through, its end.
    order = Window.partitionBy("file").orderBy("block", "kind")
    split = pieces.filter(F.col("kind") != WHOLE).withColumn("record", F.count_if(F.col("kind") == HEAD).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))), lambda p: p["text"])
    joined = split.groupBy("file", "record").agg(F.bool_or("header").alias("header"), F.array_join(parts, "\n").alias("text"))
    both = whole.unionByName(joined.select("header", "text"))
    return both.select("header", F.regexp_replace("text", "\r$", "").alias("text")).filter(F.col("header") | (F.col("text") != ""))


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header record: empty ones by place, repeated ones (in any case) with their place behind."""
    cells = [c.strip() for c in next(csv.reader([header.removeprefix("﻿")], delimiter=sep), [])]
    seen = [c.lower() for c in cells]
    return [c + (str(i) if seen.count(c.lower()) > 1 else "") if c else f"_c{i}" for i, c in enumerate(cells)]


def read_quoted(spark: SparkSession, path: str, sep: str, strict: bool = False) -> DataFrame:
    """All columns as text. Rows are parsed one by one, so a cell may hold line breaks; null where a row has no such cell."""
    records = quoted_records(spark, path)
    first = records.filter("header").agg(F.min("text")).first()[0]
    if first is None:
        return spark.createDataFrame([], "value string").drop("value")
    names = header_names(first, sep)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE", "multiLine": "true"}
    rows = records.filter(~F.col("header")).select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    return materialize(rows)
