"""Registered queries for readers and writers: each writes tables out and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.plans.registry import query, table
from harborline.session import scratch_path
from harborline.sources import readers as R
from harborline.sources import writers as W


@query(
    "S1_read_delimited",
    """SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority, CASE WHEN l.quality = 0 THEN NULL ELSE o.o_orderstatus END AS status,
       CAST(o.o_orderdate AS DATE) AS order_day FROM orders o LEFT JOIN labels l ON o.o_orderkey = l.doc_id""",
)
def s1(spark, d):
    """Orders as semicolon text, with the token N/A standing for null."""
    o, labels = table(spark, d, "orders"), table(spark, d, "labels")
    path = scratch_path(spark, "csv")
    (
        o.join(labels, o.o_orderkey == labels.doc_id, "left")
        .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                F.when(F.col("quality") == 0, "N/A").otherwise(F.col("o_orderstatus")).alias("status"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))
        .write.option("header", True).option("sep", ";").csv(path)
    )
    return R.read_delimited(spark, path)


@query("S1_late_text", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS code, o_totalprice FROM orders")
def s1_late(spark, d):
    """One text at the very end of a column of numbers keeps the column text, with no value lost."""
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    path = scratch_path(spark, "late")
    code = F.concat(F.when(F.col("o_orderkey") == last, "x").otherwise(""), F.col("o_custkey").cast("string"))
    o.orderBy("o_orderkey").select("o_orderkey", code.alias("code"), "o_totalprice").write.option("header", True).csv(path)
    return R.read_delimited(spark, path)


@query("S1_quoted_breaks", "SELECT c_custkey, c_name || chr(10) || c_custkey || ',' || '\"q\"' AS note FROM customer")
def s1_breaks(spark, d):
    """Line breaks, separators and quotes inside quoted cells."""
    c = table(spark, d, "customer")
    path = scratch_path(spark, "breaks")
    note = F.concat(F.col("c_name"), F.lit("\n"), F.col("c_custkey").cast("string"), F.lit(',"q"'))
    c.select("c_custkey", note.alias("note")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return R.read_delimited(spark, path, sep=",", multiline=True)


@query("S2_read_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2(spark, d):
    path = scratch_path(spark, "nation.parquet.zstd")
    table(spark, d, "nation").write.option("compression", "zstd").parquet(path)
    return R.read_parquet(spark, path)


@query("S3_read_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s3(spark, d):
    path = scratch_path(spark, "json")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    # Each file holds one JSON array.
    batch = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("b")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    batch.write.partitionBy("b").text(path)
    return R.read_json(spark, path, "c_custkey long, c_name string, c_acctbal double").drop("b")


@query("S4_read_jsonl_tolerant", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type NOT IN ('error', 'signup')")
def s4(spark, d):
    """Errors are written as broken lines and sign-ups as arrays; both are skipped."""
    path = scratch_path(spark, "jsonl")
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    js = F.to_json(F.struct("*"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{bad "), js)).when(F.col("event_type") == "signup", F.concat(F.lit("["), js, F.lit("]"))).otherwise(js)
    ev.select(line.alias("value")).write.text(path)
    return R.read_jsonl_tolerant(spark, path, "event_id long, user_id long, event_type string, value double")[0]


@query(
    "S5_pages_to_lines",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS pn FROM documents),
       l AS (SELECT doc_id, pn, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) AS ln FROM p)
       SELECT doc_id, CAST(pn AS INTEGER) AS page_number, CAST(ln AS INTEGER) AS line_number, trim(line) AS line FROM l WHERE trim(line) <> ''""",
)
def s5(spark, d):
    return R.pages_to_lines(table(spark, d, "documents").select("doc_id", "text"), "text")


@query(
    "S6_union_tagged",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS sheet FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier""",
)
def s6(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.union_tagged({"customer": c, "supplier": s}, "sheet")


@query(
    "S8_discover_datasets",
    """SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings',
       'pages', 'benchmark', 'labels', 'conversations']) AS dataset_id, TRUE AS has_bytes""",
)
def s8(spark, d):
    return R.discover_datasets(spark, d).select("dataset_id", (F.col("size") > 0).alias("has_bytes"))


@query("S9_write_partitioned", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def s9(spark, d):
    path = scratch_path(spark, "by_flag")
    W.write_partitioned(table(spark, d, "lineitem"), path, ["l_returnflag"])
    back = spark.read.parquet(path)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "S10_write_jsonl_by_split",
    "SELECT conv_id, turn, role, text, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM conversations",
)
def s10(spark, d):
    path = scratch_path(spark, "splits")
    k = F.col("conv_id") % 10
    conv = table(spark, d, "conversations").withColumn("split", F.when(k < 8, "train").when(k == 8, "val").otherwise("test"))
    W.write_jsonl_by_split(conv, path)
    return spark.read.schema("conv_id long, turn long, role string, text string, split string").json(f"{path}/by_split")


@query(
    "S11_route_split",
    """SELECT c_custkey, c_name, CASE WHEN n_regionkey = 2 THEN 'asia' WHEN n_regionkey = 3 THEN 'europe' WHEN n_regionkey = 1 THEN 'us' ELSE 'other' END AS route
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def s11(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    coded = c.join(n, c.c_nationkey == n.n_nationkey)
    routed = W.route_split(coded, "n_regionkey", {"asia": [2], "europe": [3], "us": [1]})
    path = scratch_path(spark, "routes")
    W.write_partitioned(routed.select("c_custkey", "c_name", "route"), path, ["route"])
    return spark.read.parquet(path)


@query("S12_read_head", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM lineitem LIMIT 2000)")
def s12(spark, d):
    return R.read_head(spark, f"{d}/lineitem.parquet", 2000).agg(F.count(F.lit(1)).alias("n"))


@query(
    "S13_explode_series_cells",
    """SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS series_no, o_orderpriority AS series, 'USD' AS unit,
       strftime(o_orderdate, '%Y-%m') AS period, o_totalprice AS value FROM orders""",
)
def s13(spark, d):
    o = table(spark, d, "orders")
    cell = F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("key"), F.col("o_totalprice").cast("string").alias("value"))
    row = F.struct(F.col("o_orderkey").cast("string").alias("seriesNo"), F.col("o_orderpriority").alias("rowText"), F.lit("USD").alias("uoM"), F.array(cell).alias("columns"))
    js = o.select("o_custkey", F.to_json(F.array(row)).alias("payload"))
    return R.explode_series_cells(js, "payload", ["o_custkey"])


@query(
    "S14_flatten_indicator_pages",
    """SELECT CAST(n_regionkey AS INTEGER) AS page, CAST(count(*) OVER () AS BIGINT) AS total, CAST(c_nationkey AS VARCHAR) AS country_id, n_name AS country,
       'BAL' AS indicator_id, c_mktsegment AS indicator, CAST(c_custkey AS VARCHAR) AS period, c_acctbal AS value
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def s14(spark, d):
    """Customer balances as one API page per nation, then flattened."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    both = c.join(n, c.c_nationkey == n.n_nationkey)
    total = F.lit(both.count()).alias("total")
    item = F.struct(
        F.struct(F.col("c_nationkey").cast("string").alias("id"), F.col("n_name").alias("value")).alias("country"),
        F.struct(F.lit("BAL").alias("id"), F.col("c_mktsegment").alias("value")).alias("indicator"),
        F.col("c_custkey").cast("string").alias("date"),
        F.col("c_acctbal").alias("value"),
    )
    # Pages hold at most 100 rows, so one nation's rows never gather in one cell.
    paged = both.groupBy("n_regionkey", F.floor(F.col("c_custkey") / 100).alias("part")).agg(F.collect_list(item).alias("rows"))
    page = paged.select(
        F.to_json(F.struct(F.col("n_regionkey").alias("page"), F.lit(1).alias("pages"), total, "rows")).alias("payload")
    )
    return R.flatten_indicator_pages(page, "payload")


@query(
    "S15_header_array_to_rows",
    "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(NULL AS VARCHAR) AS absent FROM part",
)
def s15(spark, d):
    p = table(spark, d, "part")
    payload = F.to_json(F.array(F.array(F.lit("name"), F.lit("brand")), F.array("p_name", "p_brand")))
    return R.header_array_to_rows(p.select("p_partkey", payload.alias("payload")), "payload", ["name", "brand", "absent"], ["p_partkey"])
