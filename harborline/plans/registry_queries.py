"""Registered queries for registries, catalogues and corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.functions import rules as K
from harborline.operators import corpus as C
from harborline.operators import registry as R
from harborline.operators.windows import adjacent_pairs
from harborline.plans.registry import query, table
from harborline.session import scratch_path
from harborline.sources.writers import write_jsonl_by_split

_EMPTY = "array<string>"


def _registry(spark, d):
    """One entry per brand and part type, from the parts."""
    p = table(spark, d, "part")
    g = p.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("m"), F.count(F.lit(1)).alias("n"))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return g.select(
        F.col("p_brand").alias("canonical_column"), F.lower("p_type").alias("alias"),
        F.when(F.col("m") > 48, "approved").when(F.col("m") < 40, "rejected").otherwise("candidate").alias("status"), (F.col("m") / 50).alias("confidence"), F.lit("parts").alias("source"),
        F.array(F.lit("base")).alias("categories"), F.array(F.col("p_type")).alias("worker_dataset_ids"), day.alias("first_seen"), day.alias("last_seen"), F.col("n").alias("hit_count"),
        F.array(F.lit("made")).alias("notes"), F.array(F.lit("made"), F.lit("parts")).alias("evidence"),
    )


def _batch(spark, d):
    """Order lines as sightings of their part's brand and type."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    both = li.join(p, li.l_partkey == p.p_partkey)
    seq = F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10
    return both.select(
        seq.alias("seq"), F.col("l_shipdate").alias("event_time"), F.col("p_brand").alias("canonical_column"), F.upper("p_type").alias("alias"), F.round(F.col("l_quantity") / 55, 4).alias("confidence"),
        F.lit("lines").alias("source"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("worker_dataset_id"), F.concat(F.lit("tax "), F.col("l_tax").cast("string")).alias("note"),
        F.array(F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))).alias("evidence"),
    )


_REG = """reg AS (SELECT p_brand AS canonical_column, lower(p_type) AS alias, CASE WHEN max(p_size) > 48 THEN 'approved' WHEN max(p_size) < 40 THEN 'rejected' ELSE 'candidate' END AS status, max(p_size) / 50 AS confidence, count(*) AS hit_count FROM part GROUP BY 1, 2, p_type)"""
_BAT = """bat AS (SELECT p_brand AS canonical_column, lower(p_type) AS alias, round(l_quantity / 55, 4) AS confidence, l_shipdate AS event_time, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "R1_upsert_aliases",
    f"""WITH {_REG}, {_BAT}, b AS (SELECT canonical_column, alias, count(*) AS n, max(confidence) AS c, max(event_time) AS t, array_to_string(list_sort(list_distinct(list_concat(['base'], list(DISTINCT l_returnflag)))), ',') AS cats, count(DISTINCT l_linestatus) + 1 AS ids FROM bat GROUP BY 1, 2)
        SELECT canonical_column, alias, status, round(greatest(reg.confidence, coalesce(c, 0)), 6) AS confidence, CASE WHEN n IS NULL THEN 'parts' ELSE 'lines' END AS source, coalesce(cats, 'base') AS categories, CAST(coalesce(ids, 1) AS INTEGER) AS n_datasets,
          CAST(reg.hit_count + coalesce(n, 0) AS BIGINT) AS hit_count, CAST(1 + coalesce(n, 0) AS INTEGER) AS n_notes FROM reg LEFT JOIN b USING (canonical_column, alias)""",
)
def r1(spark, d):
    reg, batch = _registry(spark, d), _batch(spark, d)
    texts = R.registry_texts(reg, R.alias_key(), ["notes", "evidence"]).unionByName(R.alias_texts(batch))
    notes = R.read_texts(texts, "notes")
    out = R.upsert_aliases(reg, batch).withColumn("key", R.alias_key()).join(notes, "key", "left")
    return out.select(
        "canonical_column", "alias", "status", F.round("confidence", 6).alias("confidence"), "source", F.array_join("categories", ",").alias("categories"),
        F.size("worker_dataset_ids").alias("n_datasets"), "hit_count", F.size(F.coalesce("notes", F.array().cast(_EMPTY))).alias("n_notes"),
    )


@query(
    "R2_promote",
    f"WITH {_REG} SELECT canonical_column, alias, CASE WHEN status = 'candidate' AND hit_count >= 15 AND confidence >= 0.9 THEN 'approved' ELSE status END AS status FROM reg",
)
def r2(spark, d):
    return R.promote(_registry(spark, d), 15, 0.9).select("canonical_column", "alias", "status")


@query(
    "R3_live_aliases",
    f"WITH {_REG} SELECT alias, arg_max(canonical_column, canonical_column) AS canonical FROM reg WHERE status = 'approved' OR (status = 'candidate' AND confidence >= 0.95 AND hit_count >= 3) GROUP BY alias",
)
def r3(spark, d):
    return R.live_aliases(_registry(spark, d), "canonical_column", category="base")


@query(
    "R4_upsert_semantics",
    """WITH r AS (SELECT event_type AS target, -1 AS pos, CASE WHEN event_type = 'view' THEN '' ELSE 'old ' || event_type END AS meaning, 0.2::DOUBLE AS conf, 5 AS hits, 'base' AS cat, NULL::TIMESTAMP AS t FROM events GROUP BY 1),
       b AS (SELECT event_type AS target, event_id AS pos, CASE WHEN value > 20 THEN 'seen ' || user_id ELSE '' END AS meaning, least(1.0, value / 200) AS conf, 1 AS hits, 'day' || isodow(ts) AS cat, ts AS t FROM events), u AS (SELECT * FROM r UNION ALL SELECT * FROM b),
       f AS (SELECT event_type AS target, CAST(count(DISTINCT user_id) AS INTEGER) AS n_evidence FROM events GROUP BY 1)
       SELECT target AS target_column, arg_min(meaning, pos) FILTER (meaning <> '') AS meaning, CASE WHEN target = 'click' THEN 'approved' ELSE 'candidate' END AS status, round(max(conf), 6) AS confidence, CAST(sum(hits) AS BIGINT) AS hit_count,
         array_to_string(list_sort(list(DISTINCT cat)), ',') AS categories, max(t) AS last_seen, max(n_evidence) AS n_evidence FROM u JOIN f USING (target) GROUP BY target""",
)
def r4(spark, d):
    ev = table(spark, d, "events")
    none, kind = F.lit(None).cast("timestamp_ntz"), F.col("event_type")
    reg = ev.select("event_type").distinct().select(
        kind.alias("target_column"), F.when(kind == "view", "").otherwise(F.concat(F.lit("old "), kind)).alias("meaning"), F.when(kind == "click", "approved").otherwise("candidate").alias("status"),
        F.lit(0.2).alias("confidence"), F.array(F.lit("base")).alias("categories"), F.array().cast(_EMPTY).alias("worker_model_ids"), F.array().cast(_EMPTY).alias("evidence"),
        none.alias("first_seen"), none.alias("last_seen"), F.lit(5).cast("long").alias("hit_count"),
    )
    batch = ev.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("event_time"), F.upper("event_type").alias("target_column"),
        F.when(F.col("value") > 20, F.concat(F.lit("seen "), F.col("user_id").cast("string"))).otherwise("").alias("meaning"), F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"),
        F.concat(F.lit("day"), (F.weekday("ts") + 1).cast("string")).alias("category"), F.lit("w1").alias("worker_model_id"), F.array(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("evidence"),
    )
    texts = R.registry_texts(reg, R.semantic_key(), ["evidence"]).unionByName(R.semantic_texts(batch))
    evidence = R.read_texts(texts, "evidence")
    out = R.upsert_semantics(reg, batch).withColumn("key", R.semantic_key()).join(evidence, "key", "left")
    return out.select(
        "target_column", "meaning", "status", F.round("confidence", 6).alias("confidence"), "hit_count", F.array_join("categories", ",").alias("categories"), "last_seen", F.size(F.coalesce("evidence", F.array().cast(_EMPTY))).alias("n_evidence")
    )


_TABLES = {"region": "geo", "nation": "geo", "customer": "party", "supplier": "party", "part": "product", "orders": "sales", "lineitem": "sales", "events": "activity", "documents": "text", "labels": "text", "conversations": "text", "pages": "text", "benchmark": "text", "embeddings": "text"}
_WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "labels": 3, "conversations": 4, "pages": 3, "benchmark": 2, "embeddings": 3}


@query(
    "R6_catalogue",
    " UNION ALL ".join(f"SELECT '{t}' AS dataset_id, '{c}' AS category, CAST(count(*) AS BIGINT) AS n_rows, {_WIDTHS[t]} AS n_cols, CAST(NULL AS VARCHAR) AS duplicate_of FROM {t}" for t, c in _TABLES.items()),
)
def r6(spark, d):
    out = R.catalogue({t: (table(spark, d, t), c) for t, c in _TABLES.items()})
    return out.select("dataset_id", "category", "n_rows", "n_cols", "duplicate_of")


def _manifest_parts(spark, d):
    p, li, c = table(spark, d, "part"), table(spark, d, "lineitem"), table(spark, d, "customer")
    specs = p.groupBy(F.col("p_brand").alias("dataset_id")).agg(F.max("p_type").alias("category"), (F.avg("p_size") > 22).alias("enabled"), (F.count(F.lit(1)) < 5).alias("skip"))
    both = li.filter("l_quantity >= 49").join(p, li.l_partkey == p.p_partkey)
    models = both.filter("p_retailprice > 950").select(F.col("p_brand").alias("dataset_id"), F.col("l_orderkey").alias("model_id"))
    cols = p.join(specs, p.p_brand == specs.dataset_id).select("category", "dataset_id", F.explode(F.split("p_name", " ")).alias("column_name"))
    empty = F.array().cast(_EMPTY)
    aliases = c.select(
        F.col("c_custkey").alias("seq"), F.lit("ring").alias("canonical_column"), F.lower("c_mktsegment").alias("alias"), F.lit("approved").alias("status"),
        F.when(F.col("c_nationkey") < 3, F.array(F.lit("SMALL"))).otherwise(empty).alias("categories"), empty.alias("worker_dataset_ids"),
    )
    return specs, models, cols, aliases


_SPEC = "sp AS (SELECT p_brand AS dataset_id, max(p_type) AS category, avg(p_size) > 22 AS enabled, count(*) < 5 AS skip FROM part GROUP BY 1), mo AS (SELECT p_brand AS dataset_id, min(l_orderkey) AS model_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND p_retailprice > 950 GROUP BY 1), co AS (SELECT DISTINCT category, dataset_id, unnest(string_split(p_name, ' ')) AS column_name FROM part JOIN sp ON p_brand = dataset_id)"


@query(
    "R7_build_manifest",
    f"""WITH {_SPEC}, k AS (SELECT dataset_id, string_agg(column_name, ',' ORDER BY column_name) AS columns, count(*) AS n, bool_or(column_name = 'ring') AS ring FROM co GROUP BY 1)
        SELECT sp.category, sp.dataset_id, model_id, CASE WHEN model_id IS NULL THEN 'pending' ELSE 'trained' END AS status, columns, CAST(n AS BIGINT) AS n_columns, CAST(CASE WHEN ring THEN (SELECT count(DISTINCT lower(c_mktsegment)) FROM customer) ELSE 0 END AS BIGINT) AS n_synonyms
        FROM sp LEFT JOIN mo USING (dataset_id) LEFT JOIN k USING (dataset_id) WHERE enabled AND NOT skip""",
)
def r7(spark, d):
    m = R.build_manifest(*_manifest_parts(spark, d))
    return m.select("category", "dataset_id", "model_id", "status", F.array_join("columns", ",").alias("columns"), "n_columns", "n_synonyms")


@query(
    "R7_manifest_counts",
    f"""WITH {_SPEC}, k AS (SELECT dataset_id, count(*) AS n FROM co GROUP BY 1)
        SELECT category, CAST(count(*) AS BIGINT) AS n_workers, CAST(count(model_id) AS BIGINT) AS n_trained, CAST(count(*) - count(model_id) AS BIGINT) AS n_pending, CAST(sum(n) AS BIGINT) AS n_columns FROM sp LEFT JOIN mo USING (dataset_id) LEFT JOIN k USING (dataset_id) WHERE enabled AND NOT skip GROUP BY 1""",
)
def r7c(spark, d):
    return R.manifest_counts(R.build_manifest(*_manifest_parts(spark, d)))


@query(
    "R8_category_tokens",
    f"""WITH t AS (SELECT lang AS category, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token, 1 AS k FROM documents UNION ALL SELECT p_type, unnest(string_split(p_name, ' ')), 2 FROM part),
        o AS (SELECT DISTINCT category, token FROM t WHERE token <> '' AND NOT (k = 1 AND token IN ('flag', 'bucket', 'tier', 'risk', 'event')) AND NOT (k = 2 AND token IN ('risk', 'flow')))
        SELECT category, token FROM o UNION SELECT category, unnest([{", ".join(f"'{t}'" for t in K.METRIC_TOKENS)}]) FROM (SELECT DISTINCT category FROM o)""",
)
def r8(spark, d):
    targets = table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("text").alias("name"))
    return R.category_tokens(targets, table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("name")))


@query("R9_manifest_columns", "SELECT DISTINCT p_type AS category, unnest(string_split(p_name, ' ')) AS column_name FROM part")
def r9(spark, d):
    return R.manifest_columns(table(spark, d, "part").select(F.col("p_type").alias("category"), F.explode(F.split("p_name", " ")).alias("column_name")))


@query(
    "R9_category_union_columns",
    """WITH f AS (SELECT p_type AS category, lower(replace(p_name, ' ', '')) AS token, min((p_partkey, p_name)) AS o FROM part GROUP BY 1, 2), r AS (SELECT category, o, CAST(row_number() OVER (PARTITION BY category ORDER BY o) AS INTEGER) AS rank FROM f)
       SELECT category, (SELECT p_name FROM part WHERE p_partkey = struct_extract_at(o, 1)) AS column_name, rank FROM r""",
)
def r9u(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("column_name"), "p_partkey")
    return R.category_union_columns(p, ["p_partkey"])


@query(
    "R13_plan_retention",
    """WITH n AS (SELECT max(ts) AS now FROM events), f AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'chats' WHEN 'click' THEN 'reports' WHEN 'purchase' THEN 'intake' WHEN 'error' THEN 'debug' ELSE 'other' END AS kind, ts FROM events),
       t AS (SELECT *, CASE kind WHEN 'chats' THEN 168 WHEN 'reports' THEN 336 WHEN 'intake' THEN 72 ELSE 48 END AS ttl_hours FROM f WHERE kind <> 'other') SELECT event_id, kind, ttl_hours, epoch_us(ts) < epoch_us(now) - ttl_hours::BIGINT * 3600000000 AS expired FROM t, n""",
)
def r13(spark, d):
    ev = table(spark, d, "events")
    now = F.lit(ev.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    kind = F.when(F.col("event_type") == "view", "chats").when(F.col("event_type") == "click", "reports").when(F.col("event_type") == "purchase", "intake").when(F.col("event_type") == "error", "debug").otherwise("other")
    return R.plan_retention(ev.select("event_id", kind.alias("kind"), "ts"), "kind", "ts", now).drop("ts")


@query(
    "R14_catalogue_upsert",
    """SELECT p_partkey AS dataset_id, p_type AS category, CAST(p_size AS BIGINT) AS n_rows FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
       UNION ALL SELECT l_partkey, 'operations', count(*) FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey""",
)
def r14(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("dataset_id"), F.col("p_type").alias("category"), F.col("p_size").cast("long").alias("n_rows"))
    new = table(spark, d, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_partkey").alias("dataset_id")).agg(F.lit(None).cast("string").alias("category"), F.count(F.lit(1)).alias("n_rows"))
    return R.catalogue_upsert(old, new)


def _extracts(spark, d):
    """All seven logs, read off the test tables."""
    conv, ev, o = table(spark, d, "conversations"), table(spark, d, "events"), table(spark, d, "orders")
    docs, labels, p = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "part")
    place = lambda df, c: df.withColumns({"industry": F.lit("shipping"), "category": F.col(c)})
    pairs = adjacent_pairs(conv, ["conv_id"], ["turn", "role"], "role", "text")
    asked = conv.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("question_id"), F.col("text").alias("question"), F.lit("").alias("hint"))
    n = F.length("text")
    answered = place(conv.filter("role = 'user'"), "role").select(
        "conv_id", F.col("turn").alias("question_id"), F.col("text").alias("answer_raw"), n.cast("string").alias("normalized"), "industry", "category",
        F.when(n < 60, "benchmark_default").otherwise("user_provided").alias("source"), F.least(F.lit(1.0), n / 400).alias("confidence"),
    )
    routes = place(o, "o_orderpriority").withColumns({"decision": F.when(F.col("o_totalprice") > 300000, "ACCEPT").otherwise("REJECT"), "score": F.col("o_totalprice") / 600000, "columns": F.col("o_orderkey").cast("string")})
    alias = place(ev, "event_type").withColumns({"event_type": F.when(F.col("event_type") == "error", "other").otherwise("alias_inference"), "alias": F.col("user_id").cast("string"), "canonical_column": F.col("category"), "status": F.lit("candidate"), "confidence": F.col("value") / 100})
    semantic = place(p, "p_type").withColumns({"target_column": F.col("p_brand"), "meaning": F.col("p_name"), "confidence": F.col("p_size") / 50})
    reports = place(docs.join(labels, "doc_id"), "lang").withColumns({"worker_id": F.col("source"), "summary": F.col("text"), "prediction_mean": F.col("quality") * 1.0})
    chats = place(pairs, "role").withColumn("guarded", F.length("text") < 80)
    boot = place(p, "p_type").withColumns({"worker_id": F.col("p_brand"), "columns": F.col("p_name")})
    return [
        C.intake_examples(answered, asked), C.routing_examples(routes), C.alias_examples(alias), C.semantic_examples(semantic), C.report_examples(reports), C.chat_examples(chats), C.bootstrap_examples(boot),
    ]


@query(
    "R10_corpus_examples",
    """WITH pr AS (SELECT length(text) AS n FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nr FROM conversations) WHERE role = 'user' AND nr = 'assistant'), u AS (SELECT length(text) AS n FROM conversations WHERE role = 'user')
       SELECT 'intake_parse' AS task_type, CAST(count(*) AS BIGINT) AS n FROM u UNION ALL SELECT 'intake_reframe', count(*) FROM u WHERE n < 60 OR n / 400 < 0.5 UNION ALL SELECT 'routing_decision', count(*) FROM orders UNION ALL SELECT 'alias_mapping', count(*) FROM events WHERE event_type <> 'error'
       UNION ALL SELECT 'target_semantics', count(*) FROM part UNION ALL SELECT 'report_synthesis', count(*) FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'chat_grounded_response', count(*) FROM pr WHERE n >= 80 UNION ALL SELECT 'chat_guardrail', count(*) FROM pr WHERE n < 80 HAVING count(*) > 0
       UNION ALL SELECT 'worker_selection', count(*) FROM part""",
)
def r10(spark, d):
    parts = _extracts(spark, d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "R11_build_corpus",
    """SELECT 'routing_decision' AS task_type, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'alias_mapping', count(*) FROM (SELECT DISTINCT event_type, user_id, value FROM events WHERE event_type <> 'error')
       UNION ALL SELECT 'target_semantics', count(*) FROM (SELECT DISTINCT p_type, p_brand, p_name, p_size FROM part) UNION ALL SELECT 'worker_selection', count(*) FROM (SELECT DISTINCT p_type, p_brand, p_name FROM part)""",
)
def r11(spark, d):
    """The corpus written as JSON lines by split and read back; counts of the tasks that SQL can restate."""
    corpus = C.build_corpus(_extracts(spark, d))
    path = scratch_path(spark, "corpus")
    write_jsonl_by_split(corpus, path)
    back = spark.read.schema("record_id string, task_type string, split string").json(f"{path}/by_split")
    kept = back.filter(F.col("task_type").isin("routing_decision", "alias_mapping", "target_semantics", "worker_selection"))
    return kept.groupBy("task_type").agg(F.count_distinct("record_id").alias("n"))
