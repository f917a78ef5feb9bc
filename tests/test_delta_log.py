"""The log of deltas: bounded pieces, repeated and broken-off batches, restarts of a stream."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from harborline.operators.registry import ALIAS_SCHEMA, BATCH_SCHEMA, read_texts, upsert_aliases
from harborline.operators.states import STATE_SCHEMA, column_states, merged_states, read_states
from harborline.plans.registry_queries import _batch
from harborline.streaming.delta_log import DeltaLog, Keyed, _fields
from harborline.streaming.streams import AliasLog, stream_upsert, upserted_texts

SUMS = Keyed("k int, n bigint", ("k",), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), 3)


def test_batches_add_up_in_few_pieces(spark, tmp_path):
    r, want = random.Random(1), {}
    log = DeltaLog(spark, str(tmp_path), {"sums": SUMS}, fanout=3)
    assert log.batch == -1 and log.read("sums").count() == 0
    for b in range(12):
        rows = [(r.randrange(9) if b % 4 else 5, r.randrange(100)) for _ in range(6)]
        before = log.pieces("sums")
        log.commit(b, {"sums": spark.createDataFrame(rows, "k int, n bigint")})
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        # One key touches one bucket.
        assert b % 4 or not before or sum(before[x] != n for x, n in log.pieces("sums").items()) <= 1
        assert dict(map(tuple, log.read("sums").collect())) == want
        again = DeltaLog(spark, str(tmp_path), {"sums": SUMS}, fanout=3)
        again.commit(b, {"sums": spark.createDataFrame([(1, 10**6)], "k int, n bigint")})
        assert again.batch == b and dict(map(tuple, again.read("sums").collect())) == want
    # At most two pieces in each of the levels of 1, 3 and 9 batches.
    assert max(log.pieces("sums").values()) <= 6
    # Nothing is left on disk but what the last two manifests name.
    assert log._manifests() == [10, 11]
    named = {(f, b) for n in (10, 11) for b, own in log._load(n)["live"]["sums"].items() for f, _ in own}
    assert {(f, b.split("=")[1]) for f in os.listdir(tmp_path / "sums") for b in os.listdir(tmp_path / "sums" / f) if "=" in b} == named


def test_a_batch_broken_off_is_written_again(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path), {"sums": SUMS})
    log.commit(0, {"sums": spark.createDataFrame([(1, 1)], "k int, n bigint")})
    log._publish = lambda state: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        log.commit(1, {"sums": spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, n bigint")})
    again = DeltaLog(spark, str(tmp_path), {"sums": SUMS})
    assert again.batch == 0 and [tuple(r) for r in again.read("sums").collect()] == [(1, 1)]
    again.commit(1, {"sums": spark.createDataFrame([(2, 7)], "k int, n bigint")})
    assert sorted(tuple(r) for r in again.read("sums").collect()) == [(1, 1), (2, 7)]


def test_fields_of_nested_schemas():
    assert [f.strip() for f in _fields("a struct<x:int,y:map<int,int>>, b int")] == ["a struct<x:int,y:map<int,int>>", "b int"]


def test_stream_over_triggers_and_restarts_equals_one_merge(spark, tmp_path):
    batch = _batch(spark, "/root/testdata/sf0.001").filter("seq IS NOT NULL")
    parts = F.pmod(F.xxhash64("seq"), F.lit(4))
    for k in range(4):
        if k == 2:  # the stream stops and starts again from its checkpoint
            table = stream_upsert(feed, f"{tmp_path}/registry", f"{tmp_path}/log")
            assert table.latest()[0] == 1
        batch.filter(parts == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        feed = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    table = stream_upsert(feed, f"{tmp_path}/registry", f"{tmp_path}/log")
    number, rows = table.latest()
    want = upsert_aliases(spark.createDataFrame([], ALIAS_SCHEMA), batch)
    keep = [c for c in rows.columns if c not in ("canonical_column", "alias", "source")]
    keep += [F.lower(F.col(c)).alias(c) for c in ("canonical_column", "alias")]
    assert number == 3 and rows.columns == want.columns
    assert rows.select(keep).exceptAll(want.select(keep)).isEmpty() and rows.count() == want.count()
    texts = read_texts(upserted_texts(table), "notes")
    assert texts.agg(F.sum(F.size("notes"))).first()[0] == batch.filter("trim(note) <> ''").count()
    assert AliasLog(spark, f"{tmp_path}/registry").latest()[0] == 3
    assert batch.columns == spark.createDataFrame([], BATCH_SCHEMA).columns


def test_profile_states_of_days_in_a_log(spark, tmp_path):
    """States of a new day are added without the old days' rows; the profile is that of all rows."""
    r = random.Random(8)
    rows = [(b, float(r.randrange(5_000)) if r.random() < 0.9 else None, None, 1e9 + r.random()) for b in range(5) for _ in range(800)]
    kept = Keyed(f"day int, {STATE_SCHEMA}", ("day", "column_name"), lambda s: merged_states(s, ["day"]), 2)
    log = DeltaLog(spark, str(tmp_path), {"states": kept}, fanout=3)
    for day in range(5):
        half = [x for x in rows if x[0] == day]
        for k in range(2):
            frame = spark.createDataFrame(half[k::2], "day int, a double, none double, big double")
            log.commit(2 * day + k, {"states": column_states(frame, ["a", "none", "big"], ["day"])})
    got = {x["column_name"]: x for x in read_states(merged_states(log.read("states"))).collect()}
    values = [a for _, a, _, _ in rows if a is not None]
    one = got["a"]
    assert (one["n"], one["nulls"], one["min"], one["max"]) == (len(values), len(rows) - len(values), min(values), max(values))
    assert abs(one["mean"] - statistics.fmean(values)) < 1e-6 and abs(one["std"] - statistics.stdev(values)) < 1e-6
    assert abs(one["n_distinct"] - len(set(values))) <= 0.06 * len(set(values))
    for q in (25, 50, 75):
        assert abs(sum(v <= one[f"q{q}"] for v in values) / len(values) - q / 100) < 0.02
    assert got["none"]["n"] == 0 and got["none"]["nulls"] == len(rows) and got["none"]["q50"] is None and got["none"]["n_distinct"] == 0
    big = [x for *_, x in rows]
    assert abs(got["big"]["std"] - statistics.stdev(big)) < 1e-3
    assert log.read("states").select("day").distinct().count() == 5
