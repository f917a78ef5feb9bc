"""Registries and catalogues as tables: merge, promote, catalogue, manifest, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import rules as K
from harborline.functions import scalars as S
from harborline.operators.joins import scoped_alias_join, status_join
from harborline.operators.ordering import top_per_group
from harborline.operators.sets import fingerprint_groups
from harborline.session import materialize

ALIAS_SCHEMA = (
    "canonical_column string, alias string, status string, confidence double, source string, categories array<string>, "
    "worker_dataset_ids array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz, hit_count long"
)
BATCH_SCHEMA = (
    "seq long, event_time timestamp_ntz, canonical_column string, alias string, confidence double, source string, "
    "category string, worker_dataset_id string, note string, evidence array<string>"
)
# Notes and evidence of a registry are rows of a table of their own, to which batches only add.
TEXT_SCHEMA = "key string, kind string, at long, ord int, text string"


def alias_key() -> Column:
    return F.concat_ws("|", S.unicode_token(F.col("canonical_column")), S.unicode_token(F.col("alias")))


def semantic_key() -> Column:
    return S.unicode_token(F.col("target_column"))


def _text_rows(rows: DataFrame, at: Column, lists: dict[str, Column]) -> DataFrame:
    """TEXT_SCHEMA: the non-blank texts of each row's lists."""

    # A part for each list, so that who reads one kind doesn't make the others.
    def entries(kind: str, texts: Column) -> DataFrame:
        every = rows.select("key", F.lit(kind).alias("kind"), at.cast("long").alias("at"), F.posexplode(texts).alias("ord", "text"))
        return every.withColumn("text", F.trim("text")).filter("text <> ''")

    return reduce(DataFrame.unionByName, [entries(k, c) for k, c in lists.items()])


def registry_texts(registry: DataFrame, key: Column, kinds: Sequence[str]) -> DataFrame:
    """TEXT_SCHEMA: the lists that a registry was handed over with; they precede every batch."""
    return _text_rows(registry.withColumn("key", key), F.lit(-1), {k: F.col(k) for k in kinds})


def alias_texts(batch: DataFrame) -> DataFrame:
    """TEXT_SCHEMA: all notes and evidence of a batch of sightings. A note is evidence, too."""
    with_note = F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.array(F.coalesce("note", F.lit(""))))
    return _text_rows(usable_sightings(batch).withColumn("key", alias_key()), F.col("seq"), {"notes": F.array("note"), "evidence": with_note})


def semantic_texts(batch: DataFrame) -> DataFrame:
    """TEXT_SCHEMA: all evidence of a batch of meanings."""
    return _text_rows(batch.withColumn("key", semantic_key()).filter("key <> ''"), F.col("seq"), {"evidence": F.col("evidence")})


def read_texts(texts: DataFrame, kind: str, last: int | None = None) -> DataFrame:
    """(key, kind): each key's texts in order, all of them or the last few; evidence is listed once, where it was first seen."""
    items = texts.filter(F.col("kind") == kind)
    if kind == "evidence":
        items = items.groupBy("key", "text").agg(F.min(F.struct("at", "ord")).alias("o"))
    else:
        items = items.select("key", "text", F.struct("at", "ord").alias("o"))
    if last is not None:
        items = top_per_group(items, ["key"], [F.desc("o"), F.desc("text")], last)
    # Sorted natively, not by a comparing function called for every two texts.
    return items.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("o", "text")))["text"].alias(kind))


def usable_sightings(batch: DataFrame) -> DataFrame:
    """Sightings whose two names are not blank and do not name the same token."""
    named = batch.filter((F.trim("canonical_column") != "") & (F.trim("alias") != ""))
    return named.filter(S.unicode_token(F.col("canonical_column")) != S.unicode_token(F.col("alias")))


def _set(rows: DataFrame, column: str) -> DataFrame:
    """(key, column): sorted distinct non-blank values, made distinct before they are gathered."""
    items = rows.filter(F.trim("item") != "").select("key", F.trim("item").alias("item")).distinct()
    return items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias(column))


def _listed(old: DataFrame, new: DataFrame, column: str, single: Column) -> DataFrame:
    """(key, item): the registry's list entries and the batch's single values."""
    return old.select("key", F.explode(column).alias("item")).unionByName(new.select("key", single.alias("item")))


def _with_lists(merged: DataFrame, parts: Sequence[DataFrame], schema: str) -> DataFrame:
    """Single values and lists of each key, in the schema's columns; a missing list is empty."""
    out = reduce(lambda a, b: a.join(b, "key", "left"), parts, merged)
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return out.select(*[F.coalesce(F.col(n), F.array().cast(t)).alias(n) if t.startswith("array") else F.col(n) for n, t in fields])


def upsert_aliases(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge new alias sightings into the registry; one row per (canonical, alias) token pair.

    Confidence is the highest, hits add up, categories and data sets unite. Approved and rejected entries
    keep their status, all others are candidates. Pairs naming the same token are skipped. The batch's notes
    and evidence are `alias_texts`, to be added to the registry's table of them.
    """
    # Both sides are read several times below; the batch may come from a costly job or a stream.
    old = materialize(registry.withColumn("key", alias_key()))
    new = materialize(usable_sightings(batch).withColumn("key", alias_key()))
    start = F.lit(-1).cast("long")
    one_old = old.select(
        "key", start.alias("at"), "canonical_column", "alias", F.lower("status").alias("status"), "confidence", "source", "first_seen", "last_seen", F.col("hit_count").alias("hits")
    )
    one_new = new.select(
        "key", F.col("seq").alias("at"), F.trim("canonical_column").alias("canonical_column"), F.trim("alias").alias("alias"), F.lit("candidate").alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "source", F.col("event_time").alias("first_seen"), F.col("event_time").alias("last_seen"), F.lit(1).cast("long").alias("hits"),
    )
    # Equal texts are brought together first: texts kept in an aggregate would have every row sorted.
    alike = one_old.unionByName(one_new).groupBy("key", "canonical_column", "alias", "status", "source").agg(
        F.min("at").alias("from"), F.max("at").alias("to"), F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits"),
    )
    merged = alike.groupBy("key").agg(
        F.min_by("canonical_column", "from").alias("canonical_column"), F.min_by("alias", "from").alias("alias"), F.min_by("status", "from").alias("_s"),
        F.max("confidence").alias("confidence"), F.max_by("source", "to").alias("source"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hit_count"),
    )
    merged = merged.withColumn("status", F.when(F.col("_s").isin("approved", "rejected"), F.col("_s")).otherwise("candidate")).drop("_s")

    parts = [
        _set(_listed(old, new, "categories", F.col("category")), "categories"),
        _set(_listed(old, new, "worker_dataset_ids", F.col("worker_dataset_id")), "worker_dataset_ids"),
    ]
    return _with_lists(merged, parts, ALIAS_SCHEMA)


def promote(registry: DataFrame, min_hits: int = 3, min_confidence: float = 0.9) -> DataFrame:
    ready = (F.lower("status") == "candidate") & (F.col("hit_count") >= min_hits) & (F.col("confidence") >= min_confidence)
    return registry.withColumn("status", F.when(ready, "approved").otherwise(F.col("status")))


def live_aliases(registry: DataFrame, seq: str, category: str | None = None, include_candidates: bool = True) -> DataFrame:
    """(alias, canonical): approved, or candidates seen 3 times at 0.95; the last entry of an alias wins."""
    status = F.lower(F.coalesce("status", F.lit("candidate")))
    sure = (status == "candidate") & (F.col("confidence") >= 0.95) & (F.col("hit_count") >= 3) & F.lit(include_candidates)
    live = registry.filter((status == "approved") | sure).filter((F.trim("canonical_column") != "") & (F.trim("alias") != ""))
    if category:
        live = live.filter((F.coalesce(F.size("categories"), F.lit(0)) <= 0) | F.array_contains("categories", category))
    return live.groupBy(F.trim("alias").alias("alias")).agg(F.max_by(F.trim("canonical_column"), F.col(seq)).alias("canonical"))


SEMANTIC_SCHEMA = (
    "target_column string, meaning string, status string, confidence double, categories array<string>, worker_model_ids array<string>, "
    "first_seen timestamp_ntz, last_seen timestamp_ntz, hit_count long"
)


def upsert_semantics(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge target meanings: the alias merge keyed by the target's token; the first non-empty meaning stays.

    registry has SEMANTIC_SCHEMA; batch(seq, event_time, target_column, meaning, confidence, category,
    worker_model_id, evidence). Approved and rejected entries keep their status. The batch's evidence is
    `semantic_texts`.
    """
    old = materialize(registry.withColumn("key", semantic_key()).filter(F.col("key") != ""))
    new = materialize(batch.withColumn("key", semantic_key()).filter(F.col("key") != ""))
    one_old = old.select("key", F.lit(-1).cast("long").alias("at"), "target_column", "meaning", F.lower("status").alias("status"), "confidence", "first_seen", "last_seen", F.col("hit_count").alias("hits"))
    one_new = new.select(
        "key", F.col("seq").alias("at"), "target_column", "meaning", F.lit("candidate").alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.col("event_time").alias("first_seen"), F.col("event_time").alias("last_seen"), F.lit(1).cast("long").alias("hits"),
    )
    stated = F.when(F.trim(F.coalesce("meaning", F.lit(""))) != "", F.col("at"))
    merged = one_old.unionByName(one_new).groupBy("key").agg(
        F.min_by("target_column", "at").alias("target_column"), F.min_by("meaning", stated).alias("meaning"), F.min_by("status", "at").alias("_s"),
        F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hit_count"),
    )
    merged = merged.withColumn("status", F.when(F.col("_s").isin("approved", "rejected"), F.col("_s")).otherwise("candidate")).drop("_s")
    parts = [
        _set(_listed(old, new, "categories", F.col("category")), "categories"),
        _set(_listed(old, new, "worker_model_ids", F.col("worker_model_id")), "worker_model_ids"),
    ]
    return _with_lists(merged, parts, SEMANTIC_SCHEMA)


def catalogue(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per table (frame, category): rows, columns, fingerprint and the table it duplicates."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("dataset_id"), F.lit(category).alias("category"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
            F.lit("parquet").alias("suffix"), F.lit(0).alias("size"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        for name, (df, category) in tables.items()
    ]
    return fingerprint_groups(reduce(lambda a, b: a.unionByName(b), rows)).select("dataset_id", "category", "n_rows", "n_cols", "columns", "fingerprint", "duplicate_of")


def build_manifest(specs: DataFrame, models: DataFrame, columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per trained or pending worker: status, column and synonym counts, and its columns in order.

    specs(dataset_id, category, enabled, skip), models(dataset_id, model_id),
    columns(category, dataset_id, column_name), aliases as for scoped_alias_join.
    """
    active = status_join(specs.select("dataset_id", "enabled", "skip"), models).filter(F.col("status") != "skipped")
    named = active.join(specs.select("dataset_id", "category"), "dataset_id")
    listed = columns.select("category", "dataset_id", "column_name").distinct()
    sizes = listed.groupBy("category", "dataset_id").agg(F.array_sort(F.collect_list("column_name")).alias("columns"), F.count(F.lit(1)).alias("n_columns"))
    synonyms = scoped_alias_join(aliases, listed).groupBy("category", "dataset_id").agg(F.count(F.lit(1)).alias("n_synonyms"))
    out = named.join(sizes, ["category", "dataset_id"], "left").join(synonyms, ["category", "dataset_id"], "left")
    return out.withColumns({"n_columns": F.coalesce("n_columns", F.lit(0)), "n_synonyms": F.coalesce("n_synonyms", F.lit(0))})


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_workers"), F.count_if(F.col("status") == "trained").alias("n_trained"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.sum("n_columns").alias("n_columns")
    )


def category_tokens(targets: DataFrame, keywords: DataFrame) -> DataFrame:
    """(category, token): words of typical targets and of keywords, less stop words, plus the metric words."""
    split = lambda df, stop: (
        df.select("category", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("token")).filter((F.col("token") != "") & ~F.col("token").isin(*stop))
    )
    own = split(targets, K.TARGET_STOP_TOKENS).unionByName(split(keywords, K.KEYWORD_STOP_TOKENS)).distinct()
    every = own.select("category").distinct().select("category", F.explode(F.array(*map(F.lit, K.METRIC_TOKENS))).alias("token"))
    return own.unionByName(every).distinct()


def manifest_columns(columns: DataFrame) -> DataFrame:
    """(category, column_name): sorted distinct columns of each category."""
    return columns.select("category", F.trim("column_name").alias("column_name")).filter(F.col("column_name") != "").distinct()


def manifest_dataset_ids(columns: DataFrame) -> DataFrame:
    return columns.select("category", F.trim(F.col("dataset_id").cast("string")).alias("dataset_id")).filter(F.col("dataset_id") != "").distinct()


def category_union_columns(columns: DataFrame, order_by: Sequence[str], first: int | None = None) -> DataFrame:
    """The columns of a category by order of appearance, one per token, or the first few."""
    token = S.unicode_token(F.col("column_name"))
    firsts = columns.filter(token != "").groupBy("category", token.alias("token")).agg(F.min(F.struct(*order_by, "column_name")).alias("o"))
    # A category has as many rows as column names.
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("o"))) if first is None else top_per_group(firsts, ["category"], [F.col("o")], first)
    return ranked.select("category", F.col("o.column_name").alias("column_name"), "rank")


RETENTION_HOURS = [("chats", 168), ("reports", 336), ("intake", 72), ("state", 72), ("debug", 48)]


def plan_retention(files: DataFrame, kind: str, modified: str, now: Column, hours: Sequence[tuple[str, int]] = tuple(RETENTION_HOURS)) -> DataFrame:
    """Adds ttl_hours and expired (modified before now - ttl). A plan only: nothing is deleted."""
    ttl = F.create_map(*[F.lit(x) for kv in hours for x in kv])
    listed = files.filter(F.col(kind).isin(*[k for k, _ in hours])).withColumn("ttl_hours", ttl[F.col(kind)])
    return listed.withColumn("expired", S.epoch_seconds(F.col(modified)) < S.epoch_seconds(now) - F.col("ttl_hours") * 3600)


def catalogue_upsert(current: DataFrame, rows: DataFrame, default_category: str = "operations") -> DataFrame:
    """Replace each data set's entry with the newest; the category has a default."""
    fresh = rows.withColumn("category", F.coalesce("category", F.lit(default_category)))
    return current.join(fresh.select("dataset_id").distinct(), "dataset_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
