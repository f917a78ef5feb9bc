"""The block paths give what one window gives, on groups cut into small blocks."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from harborline.operators import ordering as O
from harborline.operators import sampling as T
from harborline.operators import windows as W
from harborline.session import CHECKPOINT_KEY, checkpoint_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; one key holds a third, and many times are equal."""
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(200), round(rng.uniform(0, 100), 2)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k int, t int, v double").cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == b.count()


def test_order_is_required(skewed):
    with pytest.raises(ValueError):
        W.lag_features(skewed, "v", [])


def test_positions(skewed):
    got = O.positions(skewed, ["t", "id"], table_rows=10).select("id", O.POS)
    want = skewed.select("id", (F.row_number().over(Window.orderBy("t", "id")) - 1).cast("long").alias(O.POS))
    assert same(got, want)


def test_lag_and_rolling_over_blocks(skewed):
    for keys in (["k"], []):
        one = W.lag_features(skewed, "v", ["t", "id"], keys, [1, 7])
        assert same(one, W.lag_features(skewed, "v", ["t", "id"], keys, [1, 7], group_rows=50).select(one.columns))
        r1 = W.rolling_features(skewed, "v", ["t", "id"], keys, [5]).select("id", F.round("v_rolling_mean_5", 9).alias("m"), F.round("v_rolling_std_5", 6).alias("s"))
        r2 = W.rolling_features(skewed, "v", ["t", "id"], keys, [5], group_rows=37).select("id", F.round("v_rolling_mean_5", 9).alias("m"), F.round("v_rolling_std_5", 6).alias("s"))
        assert same(r1, r2)


def test_frame_longer_than_block_is_refused(skewed):
    with pytest.raises(ValueError):
        W.lag_features(skewed, "v", ["t", "id"], ["k"], [60], group_rows=50)


def test_running_sum_over_blocks(skewed):
    for keys in (["k"], []):
        one = O.running_sum(skewed, keys, ["t", "id"], {"s": F.col("id")})
        assert same(one, O.running_sum(skewed, keys, ["t", "id"], {"s": F.col("id")}, group_rows=41).select(one.columns))


def test_running_max_over_blocks(skewed):
    value = {"m": F.when(F.col("v") > 60, F.col("v"))}
    for keys in (["k"], []):
        one = O.running_max(skewed, keys, ["t", "id"], value)
        assert same(one, O.running_max(skewed, keys, ["t", "id"], value, group_rows=41).select(one.columns))


def test_rolling_needs_full_window(spark):
    six = spark.createDataFrame([(i, float(i)) for i in range(6)], "i int, v double")
    assert W.rolling_features(six, "v", ["i"], windows=[7]).filter("v_rolling_mean_7 is not null").isEmpty()


@pytest.mark.parametrize("alpha", [0.25, 0.01, 0.9])
def test_ema_matches_recursion(skewed, alpha):
    got = {r["id"]: r["v_ema"] for r in W.ema(skewed, "v", ["t", "id"], ["k"], alpha).collect()}
    last = {}
    for r in sorted(skewed.collect(), key=lambda r: (r["t"], r["id"])):
        last[r["k"]] = r["v"] if r["k"] not in last else alpha * r["v"] + (1 - alpha) * last[r["k"]]
        assert math.isclose(got[r["id"]], last[r["k"]], rel_tol=1e-9)


def test_ema_small(spark):
    three = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "i int, x double")
    assert [r["x_ema"] for r in W.ema(three, "x", ["i"]).orderBy("i").collect()] == pytest.approx([1, 1.25, 1.6875])


def test_ema_over_a_whole_table(skewed):
    got = {r["id"]: r["v_ema"] for r in W.ema(skewed, "v", ["t", "id"], [], 0.25).collect()}
    e = None
    for r in sorted(skewed.collect(), key=lambda r: (r["t"], r["id"])):
        e = r["v"] if e is None else 0.25 * r["v"] + 0.75 * e
        assert math.isclose(got[r["id"]], e, rel_tol=1e-9)


def test_exact_quantiles_both_ways(skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    a = O.exact_quantiles(skewed, ["v", "k"], probs)
    b = O.exact_quantiles(skewed, ["v", "k"], probs, small_rows=0)
    for c in a:
        assert a[c] == pytest.approx(b[c])


def test_quantile_interpolates(spark):
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert O.exact_quantiles(four, ["v"], [0.25])["v"] == [1.75]
    assert O.exact_quantiles(four, ["v"], [0.25], small_rows=0)["v"] == [1.75]


def test_top_per_group_salted(spark, skewed):
    order = [F.desc("v"), F.col("id")]
    plain = O.top_per_group(skewed, ["k"], order, 5)
    spark.conf.set(O.GROUP_LIMIT_KEY, "1")
    try:
        assert same(plain, O.top_per_group(skewed, ["k"], order, 5, group_rows=20))
    finally:
        spark.conf.unset(O.GROUP_LIMIT_KEY)


def test_group_limit_is_pushed_below_the_shuffle(skewed):
    plan = O.top_per_group(skewed, ["k"], [F.desc("v"), F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_smallest_by_position(skewed):
    assert same(O.smallest(skewed, ["t", "id"], 40), O.smallest(skewed, ["t", "id"], 40, driver_free_above=5).select(skewed.columns))


def test_hash_ranks_in_slices(skewed):
    for keys in (["k"], []):
        a = T.hash_ranked(skewed, ["id"], 1, keys).select("id", F.col("_rank").cast("long"))
        b = T.hash_ranked(skewed, ["id"], 1, keys, group_rows=30).select("id", F.col("_rank").cast("long"))
        assert same(a, b)


def test_hash_sample_bound_keeps_the_same_rows(spark):
    many = spark.range(60_000)
    a = T.hash_sample(many, ["id"], 12_000)
    b = many.withColumn("x", T.hash_token(["id"], 42)).orderBy("x").limit(12_000).drop("x")
    assert same(a, b)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.conf.get(CHECKPOINT_KEY)
