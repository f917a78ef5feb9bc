"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from harborline.operators import features as E
from harborline.operators import joins as J
from harborline.operators.registry import BATCH_SCHEMA, TEXT_SCHEMA, read_texts, upsert_aliases
from harborline.operators.specs import dataset_job
from harborline.plans import load_all
from harborline.plans.registry import QUERIES
from harborline.streaming import delta_log
from harborline.streaming.delta_log import DeltaLog, Keyed
from harborline.streaming.streams import AliasLog

load_all()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _written(monkeypatch, module):
    out, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: out.append(df.columns) or write(df))
    return out


def test_training_rows_are_made_once(spark, monkeypatch):
    """Fitting reads written rows, so the target's numbers are parsed once, not in each of its passes."""
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], f"{i % 7 * 3 + i % 2}.5") for i in range(200)], "id long, x double, c string, y string")
    written = _written(monkeypatch, E)
    report, log = E.train_dataset_model(df, ["x"], [("none", "regression"), ("y", "regression")], ["id"], trees=2)
    assert log == [("none", "missing_target"), ("y", "trained")] and written == [["y", "x", "_held"]]
    assert 0 < report.first()["r2"] <= 1
    del written[:]
    gate, log = dataset_job(df, ["x", "c"], [("y", "regression")], ["id"], trees=2, industry="shipping_freight")
    assert log == [("y", "trained")] and {r["metric"] for r in gate.collect()} == {"r2", "rmse_normalized", "mae_normalized"}
    # The codes of one text column, then the rows.
    assert written == [["value", "code"], ["y", "x", "c_ordinal", "_held"]]


def test_full_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta_log, "TASK_ROWS", 10)
    log = DeltaLog(spark, str(tmp_path), {"t": Keyed("key string, n bigint", ("key",), lambda rows: rows, 1)})
    log.commit(0, {"t": spark.range(200).select(F.lit("k").alias("key"), F.col("id").alias("n"))}, {"t": 200})
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")]
    assert len(files) > 5
    assert sorted(r["n"] for r in log.read("t").collect()) == list(range(200))


def _sightings(spark):
    rows = [(i if i != 3 else None, None, " Weight ", "mass" if i % 2 else "MASS", i / 100, f"s{i}", "c", "w", None, None) for i in range(1, 40)]
    return spark.createDataFrame(rows, BATCH_SCHEMA)


def test_sightings_of_equal_names_meet_first(spark, tmp_path):
    """First and last values are those of the rows seen first and last, a missing place in a stream before all."""
    table = AliasLog(spark, str(tmp_path))
    table.add(_sightings(spark), 0)
    got = table.latest()[1].first()
    assert (got["alias"], got["source"], got["hit_count"], got["confidence"]) == ("mass", "s39", 39, 0.39)
    old = spark.createDataFrame([("Weight", "mass", "approved", 0.1, "old", ["b"], ["v"], None, None, 2)], "canonical_column string, alias string, status string, confidence double, source string, categories array<string>, worker_dataset_ids array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz, hit_count long")
    merged = upsert_aliases(old, _sightings(spark))
    r = merged.first()
    assert (r["alias"], r["status"], r["source"], r["hit_count"], r["categories"]) == ("mass", "approved", "s39", 41, ["b", "c"])
    # Texts kept in an aggregate make it sort its input: that is no longer every row, but one of each spelling.
    lines = optimized(merged).splitlines()
    at = next(i for i, line in enumerate(lines) if "min_by(" in line)
    assert "Aggregate" in lines[at + 1]


def test_texts_are_sorted_natively(spark):
    texts = spark.createDataFrame([("k", "notes", i % 5, i, f"t{i}") for i in range(9, -1, -1)], TEXT_SCHEMA)
    df = read_texts(texts, "notes")
    assert df.first()["notes"] == ["t0", "t5", "t1", "t6", "t2", "t7", "t3", "t8", "t4", "t9"]
    assert "lambda" not in optimized(df)


def test_alias_entries_that_say_the_same_join_once(spark):
    entries = [(i, "Qty!", " n ", "approved", [], None) for i in range(5, 500)] + [(None, "qty", "m", "approved", ["a"], []), (1, "qty", "m", "approved", ["b"], [])]
    aliases = spark.createDataFrame(entries, "seq long, canonical_column string, alias string, status string, categories array<string>, worker_dataset_ids array<string>")
    workers = spark.createDataFrame([("a", "d", "qty"), ("a", "d", "QTY"), ("b", "e", "Qty")], "category string, dataset_id string, column_name string")
    df = J.scoped_alias_join(aliases, workers)
    assert sorted(tuple(r) for r in df.collect()) == [("a", "d", "m", "QTY"), ("a", "d", "n", "QTY"), ("b", "e", "m", "Qty"), ("b", "e", "n", "Qty")]
    plan = optimized(df)
    assert plan.rindex("Aggregate") > plan.index("Join")


def test_one_file_is_spread_before_costly_texts(spark, tmp_path):
    spark.createDataFrame([(i, i % 5, 10.0 * i) for i in range(8)], "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "view", 7), (2, "purchase", 3)], "event_id long, event_type string, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    fx = QUERIES["F27_fx_to_usd"](spark, str(tmp_path))
    assert {r["c_custkey"]: r["converted"] for r in fx.collect()}[6] == "due $64.80 USD today"
    assert "Repartition" in optimized(fx)
    scored = QUERIES["F35_score_samples"](spark, str(tmp_path))
    assert sorted((r["event_id"], r["mapping_top1"], r["mapping_top3"]) for r in scored.collect()) == [(1, None, None), (2, 1.0, 1.0)]
    assert "Repartition" in optimized(scored)
