"""Stream sources and sinks: file feeds, late rows, and a registry kept up by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.registry import ALIAS_SCHEMA, TEXT_SCHEMA, alias_key, alias_texts, usable_sightings
from harborline.session import scratch_path
from harborline.streaming.delta_log import DeltaLog, Keyed


def file_feed(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is read from what is there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def run_to_table(df: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Process all that is available into parquet and read it. Exactly once, from the checkpoint's log."""
    spark = df.sparkSession
    path, log = scratch_path(spark, name), checkpoint or scratch_path(spark, f"{name}-log")
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, name: str, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process all that is available, handing each micro-batch to `each` (which must be safe to repeat)."""
    log = checkpoint or scratch_path(df.sparkSession, f"{name}-log")
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def tail_events(feed: DataFrame, seq: str, after: int) -> DataFrame:
    """The part of a change feed after a sequence number; the checkpoint remembers files already read."""
    return feed.filter(F.col(seq) > after)


AT = "struct<batch:bigint,seq:bigint>"
VALUES = (
    f"key string, first_at {AT}, canonical_column string, alias string, status string, last_at {AT}, source string, confidence double, "
    "first_seen timestamp_ntz, last_seen timestamp_ntz, hit_count bigint"
)


def _merged_values(rows: DataFrame) -> DataFrame:
    """What was seen first or last of each key, with its place, so that merged rows can be merged again."""
    return rows.groupBy("key").agg(
        F.min("first_at").alias("first_at"), F.min_by("canonical_column", "first_at").alias("canonical_column"), F.min_by("alias", "first_at").alias("alias"),
        F.min_by("status", "first_at").alias("status"), F.max("last_at").alias("last_at"), F.max_by("source", "last_at").alias("source"), F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hit_count").alias("hit_count"),
    )


class AliasLog:
    """A registry of aliases as a log of deltas: single values, list entries and texts of each key are tables of their own."""

    def __init__(self, spark: SparkSession, path: str):
        tables = {
            "values": Keyed(VALUES, ("key",), _merged_values),
            "items": Keyed("key string, kind string, item string", ("key", "kind", "item"), lambda rows: rows.distinct()),
            "texts": Keyed(TEXT_SCHEMA, ("key", "kind", "at", "ord"), lambda rows: rows),
        }
        self.log = DeltaLog(spark, path, tables)

    def add(self, batch: DataFrame, number: int) -> None:
        if number <= self.log.batch:
            return
        seen = usable_sightings(batch).withColumn("key", alias_key())
        at = lambda seq: F.struct(F.lit(number).cast("bigint").alias("batch"), seq.alias("seq"))
        # Equal texts are brought together first: texts kept in an aggregate would have every row sorted. No place is before all.
        alike = seen.groupBy("key", F.trim("canonical_column").alias("canonical_column"), F.trim("alias").alias("alias"), "source").agg(
            F.when(F.count_if(F.col("seq").isNull()) == 0, F.min("seq")).alias("from"), F.max("seq").alias("to"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
            F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("hit_count"),
        )
        values = alike.select(
            "key", at(F.col("from")).alias("first_at"), "canonical_column", "alias", F.lit("candidate").alias("status"), at(F.col("to")).alias("last_at"), "source", "confidence", "first_seen", "last_seen", "hit_count"
        )
        entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.trim(c).alias("item"))
        entries = F.explode(F.array(entry("categories", "category"), entry("worker_dataset_ids", "worker_dataset_id")))
        items = seen.select("key", entries.alias("e")).select("key", "e.kind", "e.item").filter("item <> ''")
        n = batch.count()
        # A sighting adds a note and at least as much evidence.
        self.log.commit(number, {"values": values, "items": items, "texts": alias_texts(batch)}, {"values": n, "items": 2 * n, "texts": 3 * n})

    def latest(self) -> tuple[int, DataFrame]:
        """(last batch, the registry in ALIAS_SCHEMA)."""
        lists = self.log.read("items").groupBy("key").pivot("kind", ["categories", "worker_dataset_ids"]).agg(F.array_sort(F.collect_list("item")))
        none = F.array().cast("array<string>")
        told = self.log.read("values").join(lists, "key", "left")
        names = [f.split(" ")[0] for f in ALIAS_SCHEMA.split(", ")]
        return self.log.batch, told.withColumns({c: F.coalesce(c, none) for c in ("categories", "worker_dataset_ids")}).select(*names)


def stream_upsert(batches: DataFrame, path: str, checkpoint: str | None = None) -> AliasLog:
    """Merge a stream of alias sightings into a registry kept as a log: a micro-batch writes its own keys' buckets only.

    A batch that is repeated after a failure changes nothing. Notes and evidence are kept whole; `upserted_texts` reads them.
    """
    table = AliasLog(batches.sparkSession, path)
    run_batches(batches, "alias-upsert", "append", table.add, checkpoint)
    return table


def upserted_texts(table: AliasLog) -> DataFrame:
    """TEXT_SCHEMA: all notes and evidence of the registry's batches."""
    return table.log.read("texts")


def split_late(feed: DataFrame, ts: str, path: str, delay_seconds: int = 600, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows older than the newest earlier time less ten minutes go to a side table.

    Nothing is dropped. The newest time is kept with each finished batch, so a restart knows it.
    """
    spark = feed.sparkSession
    newest_of = lambda rows: rows.groupBy("kind").agg(F.max("mark").alias("mark"))
    marks = DeltaLog(spark, f"{path}/marks", {"marks": Keyed("kind string, mark bigint", ("kind",), newest_of, 1)})
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def sort_out(batch: DataFrame, number: int) -> None:
        if marks.batch >= number:
            return
        row = marks.read("marks").first()
        mark = row["mark"] if row is not None and row["mark"] is not None else None
        late = (micros < F.lit(mark - delay_seconds * 1_000_000)) if mark is not None else F.lit(False)
        late = F.coalesce(late, F.lit(False))
        batch = batch.persist()  # read three times below
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        newest = batch.agg(F.max(micros)).first()[0]
        top = max(x for x in (mark, newest) if x is not None) if (mark is not None or newest is not None) else None
        batch.unpersist()
        marks.commit(number, {"marks": spark.createDataFrame([("newest", top)], "kind string, mark bigint")})

    run_batches(feed, "late", "append", sort_out, checkpoint)
    read = lambda kind: spark.read.schema(feed.schema).parquet(f"{path}/{kind}")
    return read("on_time"), read("late")
