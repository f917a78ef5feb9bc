"""Registered queries for joins and the tables derived with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.functions import scalars as S
from harborline.operators import joins as J
from harborline.operators.ordering import positions, small_side
from harborline.plans.registry import query, table


@query(
    "J1_lookup_join",
    "SELECT o_orderkey, o_custkey, c_mktsegment AS cust_c_mktsegment, c_acctbal AS cust_c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def j1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.lookup_join(o, table(spark, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment", "c_acctbal"], ["c_custkey", "c_name"], prefix="cust_")


@query(
    "J2_star_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderpriority, o_custkey, p_brand, p_type, s_nationkey, c_mktsegment FROM lineitem
       LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def j2(spark, d):
    fact = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return J.star_join(
        fact,
        [
            (table(spark, d, "orders"), "l_orderkey", "o_orderkey", ["o_orderpriority", "o_custkey"], ["o_orderkey"]),
            (table(spark, d, "part"), "l_partkey", "p_partkey", ["p_brand", "p_type"], ["p_partkey"]),
            (table(spark, d, "supplier"), "l_suppkey", "s_suppkey", ["s_nationkey"], ["s_suppkey"]),
            (table(spark, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment"], ["c_custkey"]),
        ],
    )


@query(
    "J3_agg_join_back",
    """WITH a AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS session_count, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS unique_priorities, round(sum(o_totalprice), 2) / count(*) AS avg_price FROM orders GROUP BY 1)
       SELECT o_orderkey, o_custkey, session_count, unique_priorities, avg_price FROM orders LEFT JOIN a USING (o_custkey)""",
)
def j3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    out = J.agg_join_back(
        o, ["o_custkey"],
        {"session_count": F.count(F.lit(1)), "unique_priorities": F.count_distinct("o_orderpriority"), "avg_price": F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))},
    )
    return out.select("o_orderkey", "o_custkey", "session_count", "unique_priorities", "avg_price")


@query(
    "J4_composite_lookup",
    """WITH m AS (SELECT l_partkey, l_suppkey, arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS mapped FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(lower(mapped), lower(l_linestatus)) AS mapped_value,
         coalesce(CAST(lower(l_linestatus) = lower(mapped) AS INTEGER), 0) AS match_flag FROM lineitem LEFT JOIN m USING (l_partkey, l_suppkey)""",
)
def j4(spark, d):
    li = table(spark, d, "lineitem")
    zone_map = li.filter(F.col("l_quantity") > 25).select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    fact = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    out = J.composite_lookup(fact, zone_map, ["l_partkey", "l_suppkey"], "l_returnflag", "l_linestatus", ["l_shipdate", "l_orderkey", "l_linenumber"])
    return out.drop("l_linestatus")


@query(
    "J5_broadcast_row",
    """WITH r AS (SELECT round(avg(l_tax), 6) AS avg_tax, max(l_quantity) AS max_quantity FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * avg_tax, 8) AS expected_tax, l_quantity / max_quantity AS load FROM lineitem, r""",
)
def j5(spark, d):
    li = table(spark, d, "lineitem")
    card = li.agg(F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.max("l_quantity").alias("max_quantity"))
    out = J.broadcast_row(li, card)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * F.col("avg_tax"), 8).alias("expected_tax"),
        (F.col("l_quantity") / F.col("max_quantity")).alias("load"),
    )


@query(
    "J6_map_key_join",
    """SELECT CAST(l_orderkey AS VARCHAR) AS route_id, CAST(count(*) AS DOUBLE) AS n_stops, round(avg(l_quantity), 6) AS pos_mean, max(l_quantity) - min(l_quantity) AS pos_span,
         max(l_quantity) AS pos_max, min(l_quantity) AS pos_min, max(o_totalprice) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) >= 2""",
)
def j6(spark, d):
    """Stop positions and scores arrive as JSON maps keyed by route."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    stops = li.select(F.to_json(F.create_map(F.col("l_orderkey").cast("string"), F.create_map(F.col("l_linenumber").cast("string"), "l_quantity"))).alias("js"))
    scores = o.select(F.to_json(F.create_map(F.col("o_orderkey").cast("string"), "o_totalprice")).alias("js"))
    both = J.map_key_join(stops, "js", "map<string,double>", scores, "js", "double")
    pos = both.select(F.col("map_key").alias("route_id"), "b_value", F.explode(F.map_values("a_value")).alias("pos"))
    return (
        pos.groupBy("route_id")
        .agg(
            F.count("pos").cast("double").alias("n_stops"), F.round(F.avg("pos"), 6).alias("pos_mean"), (F.max("pos") - F.min("pos")).alias("pos_span"),
            F.max("pos").alias("pos_max"), F.min("pos").alias("pos_min"), F.max("b_value").alias("score"),
        )
        .filter(F.col("n_stops") >= 2)
    )


@query("J11_resolve_chains", "SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 7 = 6 THEN 6 ELSE c_custkey % 7 END AS canonical FROM customer")
def j11(spark, d):
    """Each customer is a copy of the one seven before it; the first seven are originals."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return J.resolve_chains(c.select(key.alias("dataset_id"), F.when(key >= 7, key - 7).otherwise(key).alias("worker_of")), "dataset_id", "worker_of")


@query(
    "J12_keep_removed",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'kept' ELSE 'not_in_passed_set' END AS reason FROM orders""",
)
def j12(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    passed = table(spark, d, "lineitem").filter(F.col("l_quantity") > 45).select("l_orderkey")
    kept = J.keep_set(o, passed, "o_orderkey", "l_orderkey").withColumn("reason", F.lit("kept"))
    return kept.unionByName(J.removed(o, passed, "o_orderkey", "l_orderkey", "not_in_passed_set"))


@query(
    "J13_status_join",
    """WITH m AS (SELECT l_partkey AS dataset_id, min(l_orderkey) AS model_id FROM lineitem WHERE l_quantity >= 48 GROUP BY 1)
       SELECT p_partkey AS dataset_id, CASE WHEN p_size > 5 AND p_type <> 'PROMO' THEN model_id END AS model_id,
         CASE WHEN NOT (p_size > 5 AND p_type <> 'PROMO') THEN 'skipped' WHEN model_id IS NOT NULL THEN 'trained' ELSE 'pending' END AS status
       FROM part LEFT JOIN m ON p_partkey = m.dataset_id""",
)
def j13(spark, d):
    specs = table(spark, d, "part").select(F.col("p_partkey").alias("dataset_id"), (F.col("p_size") > 5).alias("enabled"), (F.col("p_type") == "PROMO").alias("skip"))
    models = table(spark, d, "lineitem").filter(F.col("l_quantity") >= 48).select(F.col("l_partkey").alias("dataset_id"), F.col("l_orderkey").alias("model_id"))
    return J.status_join(specs, models)


@query(
    "J14_scoped_alias_join",
    """WITH w AS (SELECT DISTINCT p_type AS category, p_brand AS dataset_id, unnest(string_split(p_name, ' ')) AS column_name FROM part),
       a AS (SELECT c_custkey AS seq, (SELECT list(DISTINCT x ORDER BY x) FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part))[1 + c_custkey % (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part))] AS canonical_column,
            lower(c_mktsegment) || '_' || c_nationkey AS alias, c_acctbal > 0 AS approved, CASE WHEN c_nationkey < 8 THEN 'ECONOMY' WHEN c_nationkey < 16 THEN 'SMALL' END AS cat, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Brand#2' END AS ds FROM customer)
       SELECT category, dataset_id, alias, arg_min(column_name, (seq, column_name)) AS canonical FROM a JOIN w ON a.canonical_column = w.column_name
       WHERE approved AND (cat IS NULL OR cat = category) AND (ds IS NULL OR ds = dataset_id) GROUP BY 1, 2, 3""",
)
def j14(spark, d):
    part, c = table(spark, d, "part"), table(spark, d, "customer")
    workers = part.select(F.col("p_type").alias("category"), F.col("p_brand").alias("dataset_id"), F.explode(F.split("p_name", " ")).alias("column_name")).distinct()
    # Customers take the words of part names in turn as canonical columns.
    vocab = positions(workers.select(F.col("column_name").alias("canonical_column")).distinct(), ["canonical_column"])
    c = c.withColumn("_turn", F.col("c_custkey") % vocab.count()).join(small_side(vocab), F.col("_turn") == F.col("_pos"))
    n = F.col("c_nationkey")
    empty = F.array().cast("array<string>")
    aliases = c.select(
        F.col("c_custkey").alias("seq"),
        "canonical_column",
        F.concat(F.lower("c_mktsegment"), F.lit("_"), n.cast("string")).alias("alias"),
        F.when(F.col("c_acctbal") > 0, "approved").otherwise("candidate").alias("status"),
        F.when(n < 8, F.array(F.lit("ECONOMY"))).when(n < 16, F.array(F.lit("SMALL"))).otherwise(empty).alias("categories"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("Brand#2"))).otherwise(empty).alias("worker_dataset_ids"),
    )
    return J.scoped_alias_join(aliases, workers)


@query(
    "W10_dedupe_first",
    "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey)) AS l_quantity FROM lineitem GROUP BY l_orderkey",
)
def w10(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return J.first_per_key(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_quantity")


@query("A8_first_per_key", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY o_custkey")
def a8(spark, d):
    return J.first_value_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"], "first_priority")


@query(
    "A7_order_rollup",
    """SELECT l_orderkey AS order_id, round(sum(l_quantity), 4) AS total_qty, CAST(count(DISTINCT l_partkey) AS BIGINT) AS distinct_sku_count, round(sum(l_quantity * coalesce(p_size, 0)), 4) AS weight_sum
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
)
def a7(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = li.join(p, li.l_partkey == p.p_partkey, "left")
    return joined.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.round(F.sum("l_quantity"), 4).alias("total_qty"), F.count_distinct("l_partkey").alias("distinct_sku_count"),
        F.round(F.sum(F.col("l_quantity") * F.coalesce("p_size", F.lit(0))), 4).alias("weight_sum"),
    )


@query(
    "A6_distinct_per_key",
    """SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts, CAST(count(DISTINCT q.quality) + max((q.quality IS NULL)::INT) AS BIGINT) AS n_quality
       FROM lineitem LEFT JOIN labels q ON l_partkey = q.doc_id GROUP BY l_suppkey""",
)
def a6(spark, d):
    li, q = table(spark, d, "lineitem"), table(spark, d, "labels")
    return li.join(q, li.l_partkey == q.doc_id, "left").groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("n_parts"), S.distinct_with_null("quality").alias("n_quality")
    )
