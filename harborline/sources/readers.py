"""Readers for the file forms the engine takes in, and unpacking of nested payloads."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.sources.quoted import read_quoted

# Cell texts read as null, and separators that are sniffed for.
NULL_TOKENS = ["", "NA", "N/A", "null", "NULL", "\\N"]
SEPARATORS = [",", ";", "\t", "|"]
SNIFF_BYTES = 8192


def head_bytes(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first n bytes, unpacked if compressed, of the first data file under a path, folder or pattern; no more is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    seen = list(fs.globStatus(root) or [])
    while seen:
        seen.sort(key=lambda f: f.getPath().getName())
        first = seen.pop(0)
        if first.getPath().getName().startswith(("_", ".")):
            continue
        if first.isDirectory():
            seen = list(fs.listStatus(first.getPath())) + seen
        elif first.getLen():
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(first.getPath())
            stream = fs.open(first.getPath())
            stream = stream if codec is None else codec.createInputStream(stream)
            try:
                return bytes(stream.readNBytes(n))
            finally:
                stream.close()
    return b""


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Separator guessed from the first 8 KiB of the first file."""
    if path.lower().rstrip("/").endswith(".tsv"):
        return "\t"
    sample = head_bytes(spark, path).decode("utf-8", "replace")
    lines = sample.splitlines()
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(SEPARATORS)).delimiter
    except csv.Error:
        # Uneven lines: take the mark the header uses most.
        header = lines[0] if lines else ""
        best = max(SEPARATORS, key=header.count)
        return best if header.count(best) else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, strict: bool = False, multiline: bool = False) -> DataFrame:
    """Delimited text with a header: null tokens cleared, types that fit every value of the whole file, ragged lines cut.

    `strict` fails on malformed lines instead. `multiline` allows line breaks inside quotes; byte ranges then first count
    quotes (see `quoted`), so that such a file is read by all tasks too. Without it, Spark's own reader cuts at every line
    break. No value is lost to a type: one misfit keeps a column's texts.
    """
    mark = sep or sniff_separator(spark, path)
    if multiline:
        raw = read_quoted(spark, path, mark, strict)
    else:
        reader = spark.read.option("header", True).option("sep", mark).option("mode", "FAILFAST" if strict else "PERMISSIVE")
        raw = reader.option("quote", '"').option("escape", '"').csv(path)
    cleared = raw.select([F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return cast_by_content(cleared)


TYPES = ["bigint", "double", "date", "timestamp_ntz"]
# Rows from which types are ruled out before the whole table is asked.
HINT_ROWS = 1_000


def cast_by_content(df: DataFrame) -> DataFrame:
    """Give each text column the first of bigint, double, date and timestamp that all its values take, else leave it.

    A few rows rule out most types. The whole table is then asked about one type a column only, and again about the next
    one for columns with a misfit: once, as a rule. A column without values stays text.
    """
    if not df.columns:
        return df
    open_ = {c: [t for t in TYPES if found[t]] for c, found in _fits(df.limit(HINT_ROWS), {c: TYPES for c in df.columns}).items()}
    chosen: dict[str, str | None] = {c: None for c in df.columns}
    while open_ := {c: types for c, types in open_.items() if types}:
        found = _fits(df, {c: types[:1] for c, types in open_.items()})
        for c, types in list(open_.items()):
            if found[c]["any"] and found[c][types[0]]:
                chosen[c] = types[0]
            if not found[c]["any"] or chosen[c]:
                del open_[c]
            else:
                open_[c] = types[1:]
    return df.select([(F.col(f"`{c}`").try_cast(t) if t else F.col(f"`{c}`")).alias(c) for c, t in chosen.items()])


def _fits(df: DataFrame, asked: dict[str, list[str]]) -> dict[str, dict[str, bool]]:
    """Per column whether it has values (`any`) and whether all of them take each type asked; true without values."""
    checks, names = [], []
    for c, types in asked.items():
        v = F.col(f"`{c}`")
        checks.append(F.count(v) > 0)
        names.append((c, "any"))
        for t in types:
            misfit = v.try_cast(t).isNull()
            # A text with a clock time also casts to a date; such columns keep the time.
            misfit = misfit | v.rlike("[0-9]:[0-9]") if t == "date" else misfit
            checks.append(F.count_if(v.isNotNull() & misfit) == 0)
            names.append((c, t))
    row = df.agg(*[k.alias(f"_{i}") for i, k in enumerate(checks)]).first()
    out: dict[str, dict[str, bool]] = {c: {} for c in asked}
    for (c, t), yes in zip(names, row):
        out[c][t] = bool(yes)
    return out


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet under any suffix (.parquet, .pq, .parquet.zstd): the codec is in the file itself."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON: one array of objects or one object per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one-row count of rejected lines): blank, unparsable and non-object lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.col("value"), F.try_parse_json("value").alias("_v"), F.from_json("value", schema).alias("_row"))
    is_object = F.col("_v").isNotNull() & F.ltrim("value").startswith("{")
    good = parsed.filter(is_object).select("_row.*")
    rejected = parsed.agg(F.count_if(~F.coalesce(is_object, F.lit(False))).alias("rejected"))
    return good, rejected


def read_head(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows, for hints; the limit reaches the scan."""
    return spark.read.parquet(path).limit(n)


# File suffixes taken as data sets, and file names that are never data.
DATA_SUFFIXES = r"\.(csv|tsv|txt|parquet|pq|json|jsonl|parquet\.zstd)$"
SKIP_NAMES = r"/(_[^/]*|metadata\.json)$"


def discover_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(dataset_id, path, size) of every data file under a folder, from listing metadata only.

    The id joins the relative path's parts, cleaned, with "__"; ids over 140 characters keep 125
    and ten digits of the path's digest.
    """
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", F.col("length").alias("size"))
        .filter(F.lower("path").rlike(DATA_SUFFIXES) & ~F.lower("path").rlike(SKIP_NAMES))
    )
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{re.escape(base)}/", "")
    stem = F.regexp_replace(F.lower(rel), DATA_SUFFIXES, "")
    cleaned = F.transform(
        F.split(stem, "/"), lambda p: F.regexp_replace(F.regexp_replace(p, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    )
    full = F.array_join(F.filter(cleaned, lambda p: p != ""), "__")
    short = F.concat(F.substring(full, 1, 125), F.lit("_"), F.substring(F.sha2(rel, 256), 1, 10))
    return files.select(F.when(F.length(full) <= 140, full).otherwise(short).alias("dataset_id"), "path", "size")


def pages_to_lines(df: DataFrame, text_col: str) -> DataFrame:
    """One row per non-blank line with 1-based page and line numbers; form feeds part the pages."""
    pages = df.select("*", F.posexplode(F.split(text_col, "\f")).alias("_p", "_page")).drop(text_col)
    lines = pages.select("*", F.posexplode(F.split("_page", "\n")).alias("_l", "_line")).drop("_page")
    return (
        lines.withColumn("page_number", F.col("_p") + 1)
        .withColumn("line_number", F.col("_l") + 1)
        .withColumn("line", F.trim("_line"))
        .filter(F.col("line") != "")
        .drop("_p", "_l", "_line")
    )


def union_tagged(frames: dict[str, DataFrame], tag_col: str) -> DataFrame:
    """Frames stacked by column name, each tagged, missing columns null."""
    tagged = [df.withColumn(tag_col, F.lit(tag)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


SERIES_SCHEMA = "array<struct<seriesNo:string,rowText:string,uoM:string,columns:array<struct<key:string,value:string>>>>"


def explode_series_cells(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested rows -> columns[] cells as long rows (series, unit, period, value)."""
    rows = df.select(*keep, F.explode(F.from_json(json_col, SERIES_SCHEMA)).alias("r"))
    cells = rows.select(*keep, "r.seriesNo", "r.rowText", "r.uoM", F.explode("r.columns").alias("c"))
    return cells.select(
        *keep,
        F.col("seriesNo").alias("series_no"),
        F.col("rowText").alias("series"),
        F.col("uoM").alias("unit"),
        F.col("c.key").alias("period"),
        F.col("c.value").try_cast("double").alias("value"),
    )


INDICATOR_SCHEMA = (
    "struct<page:int,pages:int,total:long,rows:array<struct<country:struct<id:string,value:string>,"
    "indicator:struct<id:string,value:string>,date:string,value:double>>>"
)


def flatten_indicator_pages(df: DataFrame, json_col: str) -> DataFrame:
    """Indicator API pages as flat rows with their page numbers."""
    page = df.select(F.from_json(json_col, INDICATOR_SCHEMA).alias("p"))
    rows = page.select("p.page", "p.total", F.explode("p.rows").alias("r"))
    return rows.select(
        "page",
        "total",
        F.col("r.country.id").alias("country_id"),
        F.col("r.country.value").alias("country"),
        F.col("r.indicator.id").alias("indicator_id"),
        F.col("r.indicator.value").alias("indicator"),
        F.col("r.date").alias("period"),
        F.col("r.value").alias("value"),
    )


def header_array_to_rows(df: DataFrame, json_col: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Array of arrays whose first row is the header: one string row per later entry, by header name."""
    arr = df.select(*keep, F.from_json(json_col, "array<array<string>>").alias("a"))
    rows = arr.select(*keep, F.col("a")[0].alias("_head"), F.explode(F.slice("a", 2, F.size("a"))).alias("_row"))
    return rows.select(
        *keep,
        *[
            F.when(F.array_position("_head", c) > 0, F.try_element_at("_row", F.array_position("_head", c).cast("int"))).alias(c)
            for c in columns
        ],
    )
