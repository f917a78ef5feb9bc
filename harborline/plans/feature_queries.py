"""Registered queries for encoders, scalers, target features and model jobs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.operators import features as E
from harborline.operators.linear import fit_linear, linear_report
from harborline.operators.specs import apply_feature_spec, dataset_job
from harborline.plans.registry import query, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("E1_label_encode", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_encoded FROM part")
def e1(spark, d):
    return E.label_encode(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").drop("p_brand")


@query(
    "E2_onehot",
    """SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "o_orderpriority_1-urgent", CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "o_orderpriority_2-high", CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS "o_orderpriority_3-medium",
       CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "o_orderpriority_4-not_specified", CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "o_orderpriority_5-low" FROM orders""",
)
def e2(spark, d):
    return E.onehot(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").drop("o_orderpriority")


@query(
    "E3_ordinal_encode",
    """WITH b AS (SELECT p_partkey, coalesce(CASE WHEN quality = 1 THEN p_brand END, 'unknown') AS v FROM part LEFT JOIN labels ON p_partkey = doc_id) SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY v) AS INTEGER) AS brand_ordinal FROM b""",
)
def e3(spark, d):
    p = table(spark, d, "part").join(table(spark, d, "labels"), F.col("p_partkey") == F.col("doc_id"), "left")
    return E.ordinal_encode(p.select("p_partkey", F.when(F.col("quality") == 1, F.col("p_brand")).alias("brand")), "brand").drop("brand")


@query(
    "E4_frequency_encode",
    """WITH f AS (SELECT p_name, count(*) / (SELECT count(*) FROM part WHERE p_size <= 25) AS r FROM part WHERE p_size <= 25 GROUP BY 1) SELECT p_partkey, round(coalesce(r, 0.0), 8) AS p_name_freq FROM part LEFT JOIN f USING (p_name)""",
)
def e4(spark, d):
    """Fitted on small parts, applied to all."""
    p = table(spark, d, "part")
    params = E.fit_frequencies(p.filter("p_size <= 25"), "p_name")
    return E.frequency_encode(p.select("p_partkey", "p_name"), "p_name", params).select("p_partkey", F.round("p_name_freq", 8).alias("p_name_freq"))


@query(
    "E5_dummies",
    """SELECT c.c_custkey, c.c_name, CAST(coalesce(l.quality::VARCHAR, 'unknown') = '0' AS INTEGER) AS grade_0, CAST(coalesce(l.quality::VARCHAR, 'unknown') = '1' AS INTEGER) AS grade_1, CAST(l.quality IS NULL AS INTEGER) AS grade_unknown
       FROM customer c LEFT JOIN labels l ON c.c_custkey = l.doc_id""",
)
def e5(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "labels"), F.col("c_custkey") == F.col("doc_id"), "left")
    return E.dummies(c.select("c_custkey", "c_name", F.col("quality").alias("grade")), ["grade"])


@query(
    "E6_text_hash",
    r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS DOUBLE) AS n_tokens, 64 AS width FROM documents""",
)
def e6(spark, d):
    h = E.text_hash(table(spark, d, "documents").select("doc_id", "text"), "text", 64)
    arr = vector_to_array("text_hashed")
    return h.select("doc_id", F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("n_tokens"), F.size(arr).alias("width"))


@query(
    "E7_numeric_coercion",
    """SELECT o_orderkey, o_totalprice AS price_text, o_orderpriority AS priority_text FROM orders""",
)
def e7(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("USD "), F.format_number("o_totalprice", 2)).alias("price_text"), F.concat(F.lit("x"), F.substring("o_orderpriority", 2, 30)).alias("priority_text"))
    out, _ = E.numeric_coercion(o, ["price_text", "priority_text"])
    restore = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return out.drop("priority_text").join(restore, "o_orderkey").withColumnRenamed("o_orderpriority", "priority_text")


@query(
    "E8_standard_scale",
    f"SELECT {_K}, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS l_quantity_scaled, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS l_extendedprice_scaled FROM lineitem",
)
def e8(spark, d):
    li = table(spark, d, "lineitem")
    out = E.scale(li, E.fit_standard(li, ["l_quantity", "l_extendedprice"]))
    return out.select(*_KEY, *[F.round(c, 6).alias(c) for c in ("l_quantity_scaled", "l_extendedprice_scaled")])


@query("E9_minmax_scale", f"SELECT {_K}, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS l_extendedprice_scaled FROM lineitem")
def e9(spark, d):
    li = table(spark, d, "lineitem")
    return E.scale(li, E.fit_minmax(li, ["l_extendedprice"])).select(*_KEY, F.round("l_extendedprice_scaled", 6).alias("l_extendedprice_scaled"))


@query(
    "E10_robust_scale",
    f"WITH q AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS r FROM lineitem) SELECT {_K}, round((l_extendedprice - m) / r, 6) AS l_extendedprice_scaled FROM lineitem, q",
)
def e10(spark, d):
    li = table(spark, d, "lineitem")
    return E.scale(li, E.fit_robust(li, ["l_extendedprice"])).select(*_KEY, F.round("l_extendedprice_scaled", 6).alias("l_extendedprice_scaled"))


@query(
    "E11_engineer",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus_encoded, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_encoded,
       round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_samp(o_custkey) FROM orders), 6) AS o_custkey_scaled, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(isodow(o_orderdate) AS INTEGER) AS o_orderdate_weekday FROM orders""",
)
def e11(spark, d):
    out, _ = E.engineer(table(spark, d, "orders"), target="o_totalprice")
    return out.select("o_orderkey", "o_orderstatus_encoded", "o_orderpriority_encoded", F.round("o_custkey_scaled", 6).alias("o_custkey_scaled"), "o_orderdate_year", "o_orderdate_weekday")


@query("E12_prepare_matrix", f"SELECT {_K}, 6 AS width, round(l_quantity + l_extendedprice + l_tax, 4) AS total FROM lineitem")
def e12(spark, d):
    m = E.prepare_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"], width=6)
    arr = vector_to_array("features")
    return m.select(*_KEY, F.size(arr).alias("width"), F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(
    "E13_replay_features",
    """WITH f AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)), r AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders) AS r FROM orders GROUP BY 1)
       SELECT o_orderkey AS order_id, CAST(NULL AS DOUBLE) AS demand, CAST(code AS INTEGER) AS o_orderpriority_ordinal, round(r, 8) AS o_orderstatus_freq, o_totalprice AS price FROM orders JOIN f USING (o_orderpriority) JOIN r USING (o_orderstatus) WHERE o_orderstatus IN ('F', 'O')""",
)
def e13(spark, d):
    o = table(spark, d, "orders")
    meta = E.FeatureMeta(
        aliases={"o_orderkey": "order_id"}, columns={"demand": "double"}, filter=("o_orderstatus", ["F", "O"]),
        ordinal={"o_orderpriority": E.fit_codes(o, "o_orderpriority", "unknown", 1)}, frequency={"o_orderstatus": E.fit_frequencies(o, "o_orderstatus")}, numeric=["price"],
    )
    new = o.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"))
    return E.replay_features(new, meta).select("order_id", "demand", "o_orderpriority_ordinal", F.round("o_orderstatus_freq", 8).alias("o_orderstatus_freq"), "price")


@query("E14_train_dataset_model")
def e14(spark, d):
    """Predict the price of an order line; the first listed target is absent and falls through."""
    li = table(spark, d, "lineitem")
    report, _ = E.train_dataset_model(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], [("missing", "regression"), ("l_extendedprice", "regression")], _KEY, trees=10)
    return report


@query(
    "E14_linear_model",
    """WITH f AS (SELECT l_quantity AS x, l_tax AS z, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 5 <> 0),
        s AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM f),
        w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c FROM s),
        p AS (SELECT l_extendedprice AS y, my - b * mx - c * mz + b * l_quantity + c * l_tax AS p FROM lineitem, w WHERE l_orderkey % 5 = 0),
        r AS (SELECT count(*) AS rows, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM p)
        SELECT round(b, 4) AS w_quantity, round(c, 4) AS w_tax, round(my - b * mx - c * mz, 4) AS intercept, n AS fitted, rows, round(r2, 8) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse FROM w, r""",
)
def e14l(spark, d):
    """The price of an order line from quantity and tax, fitted on four fifths of the orders and scored on the others."""
    li = table(spark, d, "lineitem")
    model = fit_linear(li.filter("l_orderkey % 5 <> 0"), ["l_quantity", "l_tax"], "l_extendedprice")
    told = [F.round(F.lit(v), 4).alias(n) for n, v in zip(("w_quantity", "w_tax", "intercept"), (*model.weights, model.intercept))]
    report = linear_report(li.filter("l_orderkey % 5 = 0"), model, "l_extendedprice")
    return report.select(*told, F.lit(model.rows).cast("bigint").alias("fitted"), "rows", F.round("r2", 8).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query(
    "E11_feature_spec",
    """SELECT s_suppkey, coalesce(s_name, '') || '-' || n_name AS label, CAST(s_suppkey % 2400 // 100 AS INTEGER) AS clock_hour, CAST(s_suppkey % 100 % 60 AS INTEGER) AS minute, round(sin(s_suppkey * 2 * pi() / 24), 8) AS turn_sin,
         CAST(s_nationkey IN (3, 7) AS INTEGER) AS picked, n_name AS n_n_name, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(s_nationkey - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(s_nationkey::DOUBLE)) * pow(sin(radians(s_nationkey - 20.0) / 2), 2))), 4) AS distance_km
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def e11s(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", ((F.col("s_suppkey") % 2400) - (F.col("s_suppkey") % 100) + F.col("s_suppkey") % 100 % 60).alias("clock"))
    s = s.withColumns({"a": F.lit(10.0), "b": F.lit(20.0)})
    steps = [
        {"type": "lookup_join", "file": "nations", "left_on": "s_nationkey", "right_on": "n_nationkey", "select": ["n_name"], "prefix": "n_"},
        {"type": "combine_str", "columns": ["s_name", "n_n_name", "absent"], "name": "label", "sep": "-"},
        {"type": "hhmm_to_hour_minute", "source": "clock", "minute_col": "minute"},
        {"type": "cyclic", "source": "s_suppkey", "period": 24, "sin_col": "turn_sin"},
        {"type": "binary_flag", "source": "s_nationkey", "name": "picked", "values": [3, 7]},
        {"type": "haversine_km", "lat1": "a", "lon1": "b", "lat2": "s_nationkey", "lon2": "s_nationkey"},
        {"type": "binary_flag", "source": "absent", "name": "never", "values": [1]},
        {"type": "unheard_of"},
    ]
    out = apply_feature_spec(s, steps, {"nations": table(spark, d, "nation")})
    return out.select("s_suppkey", "label", "clock_hour", "minute", F.round("turn_sin", 8).alias("turn_sin"), "picked", "n_n_name", F.round("distance_km", 4).alias("distance_km"))


@query("E14_dataset_job", "SELECT 'l_extendedprice' AS target, m AS metric, 3 AS n_tried FROM (SELECT unnest(['r2', 'rmse_normalized', 'mae_normalized']) AS m) WHERE (SELECT count(*) FROM lineitem) > 0")
def e14j(spark, d):
    """The first target is absent, the second weak; the third is trained on numbers and an encoded text, and gated."""
    li = table(spark, d, "lineitem").withColumn("row_label", F.col("l_linestatus"))
    gate, log = dataset_job(
        li, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], [("absent", "regression"), ("row_label", "classification"), ("l_extendedprice", "regression")],
        ["l_orderkey", "l_linenumber"], trees=5, industry="shipping_freight",
    )
    return gate.select("target", "metric", F.lit(len(log)).alias("n_tried"))


@query(
    "E16_realism_checks",
    """SELECT CAST(NULL AS VARCHAR) AS failure, 'revenue,order_count,load' AS checked WHERE (SELECT count(*) FROM orders) > 0""",
)
def e16(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", F.col("o_totalprice").alias("revenue"), (F.col("o_custkey") % 97).alias("order_count"), (F.col("o_orderkey") % 13).alias("load"))
    return E.realism_checks(o.withColumnRenamed("o_orderdate", "event_date"), "event_date")


@query(
    "W4_oof_target_encode",
    """WITH t AS (SELECT o_orderkey, o_orderpriority AS v, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END AS y, CAST(CAST('0x' || substr(sha256('42:' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS f FROM orders),
       p AS (SELECT v, f, sum(y) AS s, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT v, sum(s) AS s, sum(n) AS n FROM p GROUP BY 1), m AS (SELECT avg(y)::DOUBLE AS mu FROM t)
       SELECT o_orderkey, round(CASE WHEN w.n - p.n < 1 THEN mu ELSE (w.s - p.s + 20 * mu) / (w.n - p.n + 20) END, 6) AS priority_te FROM t JOIN p USING (v, f) JOIN w USING (v), m""",
)
def w4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(F.col("o_totalprice") > 200000, "yes").otherwise("no").alias("y"))
    return E.oof_target_encode(o, ["priority"], "y", ["o_orderkey"]).select("o_orderkey", F.round("priority_te", 6).alias("priority_te"))


@query(
    "F16_norm_calendar",
    """WITH m AS (SELECT median(o_totalprice) AS p FROM orders) SELECT o_orderkey, month(o_orderdate) / 12.0::DOUBLE AS month_norm, isodow(o_orderdate) / 7.0::DOUBLE AS weekday_norm, CAST(o_totalprice >= p AS INTEGER) AS is_high_price FROM orders, m""",
)
def f16(spark, d):
    o = table(spark, d, "orders").withColumns({"m": F.month("o_orderdate"), "w": S.iso_weekday(F.col("o_orderdate"))})
    return E.norm_calendar(o, "m", "w", {"is_high_price": "o_totalprice"}).select("o_orderkey", "month_norm", "weekday_norm", "is_high_price")


_CARD = {"a": (29.5, 23.6), "b": (33.0, 28.3), "c": (40.1, 38.9), "d": (45.4, 44.8), "e": (56.6, 55.5)}
_CARD_SQL = "(VALUES " + ", ".join(f"('{z}', {a}::DOUBLE, {b}::DOUBLE)" for z, (a, b) in _CARD.items()) + ") c(z, fixed, extra)"


@query(
    "F17_shipment_charge",
    f"""WITH t AS (SELECT {_K}, l_quantity / 10 AS w, CASE lower(l_returnflag) WHEN 'a' THEN 'a' ELSE 'd' END AS z, l_extendedprice / 100 AS billed FROM lineitem),
        s AS (SELECT t.*, greatest(0.5, ceil(w / 0.5) * 0.5)::DOUBLE AS slab, fixed, extra FROM t JOIN {_CARD_SQL} USING (z)), e AS (SELECT *, fixed + greatest(0, round_even((slab - 0.5) / 0.5, 0)) * extra AS x FROM s)
        SELECT {_K}, slab AS weight_slab_kg, 'fwd_' || z AS rate_key, round(x, 4) AS expected_charge, round(billed - x, 4) AS charge_delta, CAST(billed - x > 1.0 AS INTEGER) AS overbilled_flag FROM e""",
)
def f17(spark, d):
    li = table(spark, d, "lineitem").withColumns({"w": F.col("l_quantity") / 10, "billed": F.col("l_extendedprice") / 100})
    out = E.shipment_charge(li, "w", "l_returnflag", "billed", _CARD)
    return out.select(*_KEY, "weight_slab_kg", "rate_key", F.round("expected_charge", 4).alias("expected_charge"), F.round("charge_delta", 4).alias("charge_delta"), "overbilled_flag")


@query("F18_median_split", "SELECT o_orderkey, CASE WHEN o_totalprice >= (SELECT median(o_totalprice) FROM orders) THEN 'high' ELSE 'low' END AS level FROM orders")
def f18(spark, d):
    return E.derive_target(table(spark, d, "orders"), "median_split", "o_totalprice", "level").select("o_orderkey", "level")


@query("F18_threshold_split", "SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'big' ELSE 'small' END AS level FROM orders")
def f18t(spark, d):
    return E.derive_target(table(spark, d, "orders"), "threshold_split", "o_totalprice", "level", threshold=250000.0, high_label="big", low_label="small").select("o_orderkey", "level")


@query("F18_length_median", "SELECT doc_id, CASE WHEN length(text) >= (SELECT median(length(text)) FROM documents) THEN 'long' ELSE 'short' END AS size FROM documents")
def f18l(spark, d):
    return E.derive_target(table(spark, d, "documents"), "length_median", "text", "size").select("doc_id", "size")


@query("F18_categorical_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hot' WHEN '5-LOW' THEN 'cold' END AS heat FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def f18c(spark, d):
    return E.derive_target(table(spark, d, "orders"), "categorical_map", "o_orderpriority", "heat", map={"1-URGENT": "hot", "5-LOW": "cold"}).select("o_orderkey", "heat")


@query(
    "F18_keyword_polarity",
    """WITH h AS (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS p, contains(lower(text), 'les')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'los')::INT AS n FROM documents)
       SELECT doc_id, CASE WHEN p > n THEN 'positive' ELSE 'negative' END AS polarity FROM h WHERE p <> n""",
)
def f18k(spark, d):
    return E.derive_target(table(spark, d, "documents"), "keyword_polarity", "text", "polarity", positive=["the", "and"], negative=["les", "der", "los"]).select("doc_id", "polarity")


@query(
    "F43_impute_mean_numeric",
    """WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS cost FROM events) SELECT event_id, round(coalesce(cost, (SELECT avg(cost) FROM t)), 6) AS cost FROM t""",
)
def f43(spark, d):
    ev = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("cost"))
    return E.impute_mean_numeric(ev, ["cost"]).select("event_id", F.round("cost", 6).alias("cost"))
