"""The registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.llm.common import ORACLES, QUERIES, query, whole
from harborline.llm.fingerprints import fingerprint_text, fingerprints, likeness, with_next
from harborline.llm.jaccard import join_sets
from harborline.llm.line_dedup import dedup_lines
from harborline.llm.mixing import mix_sources
from harborline.llm.neighbours import nearest
from harborline.llm.packing import pack_documents
from harborline.llm.periodic import collapse_runs
from harborline.llm.quality import THRESHOLD, fit_quality, held_out, score_quality
from harborline.llm.secret_scan import scan_secrets, spans_text
from harborline.llm.sharding import LIMIT_BYTES, assign_shards
from harborline.llm.substrings import dedup_substrings
from harborline.llm.tokens import token_digests
from harborline.llm.vector_codes import codebooks_sha256, compress_vectors
from harborline.plans.registry import table

__all__ = ["ORACLES", "QUERIES"]


@query(
    "op1_line_dedup",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.*, coalesce(k.doc_id > r.keeper, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
)
def op1(spark, d):
    out = dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op2_sharding",
    f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
        p AS (SELECT doc_id, n_bytes, CAST(l AS INTEGER) AS level, substr(bits, 1, l::INTEGER) AS prefix FROM d, range(0, 61) r(l)),
        s AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY level, prefix) AS BIGINT) AS shard_bytes FROM p),
        f AS (SELECT doc_id, n_bytes, min((level, prefix, shard_bytes)) AS m FROM s WHERE shard_bytes <= {LIMIT_BYTES} OR level = 60 GROUP BY doc_id, n_bytes)
        SELECT doc_id, m[2] AS shard, m[1] AS shard_depth, n_bytes, m[3] AS shard_bytes FROM f""",
)
def op2(spark, d):
    return assign_shards(table(spark, d, "documents"))


@query("op4_secret_scans")
def op4(spark, d):
    found = scan_secrets(table(spark, d, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] <= 3)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@query("op10_fingerprints")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", whole("text").alias("text"))
    both = with_next(fingerprints(docs), "doc_id", ["text", "fingerprint"], tie_by="text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = fingerprints(both.withColumn("edited", edited), "edited", "edited_fingerprint")
    return out.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("fingerprint")).alias("fingerprint"), fingerprint_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


@query("op3_nearest_neighbours")
def op3(spark, d):
    return nearest(table(spark, d, "embeddings"))


@query("op5_best_fit_packing")
def op5(spark, d):
    out = pack_documents(table(spark, d, "documents"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_quality_classifier")
def op6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, d, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op7_ngram_jaccard_join")
def op7(spark, d):
    out = join_sets(table(spark, d, "documents"), words=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op8_substring_dedup")
def op8(spark, d):
    out = dedup_substrings(table(spark, d, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op9_bpe_codec")
def op9(spark, d):
    out = token_digests(table(spark, d, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def with_planted_runs(docs, id_col="doc_id", text_col="text"):
    """The texts of ids whose crc32 ends in 0 begin to repeat: from word a on, each is one of the p words from a."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(whole(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, a, p = F.col("_n"), F.col("_a"), F.col("_p")
    cut = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    cut = cut.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    cut = cut.withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), a), again), " ")
    return cut.withColumn(text_col, F.when(n > 0, planted).otherwise(F.col(text_col))).drop("_words", "_n", "_a", "_p")


@query("op11_periodic_runs")
def op11(spark, d):
    out = collapse_runs(with_planted_runs(table(spark, d, "documents").select("doc_id", "text")))
    run = F.col("longest_run")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), run["start"].alias("start"), run["length"].alias("length"), run["period"].alias("period"),
        F.floor(1000 * run["length"] / run["period"]).alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _codes_sql(parts=8, entries=16, rounds=6, scale=4096):
    """The rounds written out: parts against the entries of their position, then sums by nearest entry."""
    far = "list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"f{r} AS (SELECT c.vec_id, c.part, b.entry, CAST({far} AS BIGINT) AS off FROM c JOIN b{r} b ON b.part = c.part)")
        steps.append(f"a{r} AS (SELECT vec_id, part, min((off, entry)) AS m FROM f{r} GROUP BY 1, 2)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT a.part, a.m[2] AS entry, i, CAST(floor(sum(c.x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM a{r} a JOIN c ON c.vec_id = a.vec_id AND c.part = a.part, g WHERE i <= len(c.x) GROUP BY 1, 2, 3)")
            steps.append(f"l{r} AS (SELECT part, entry, list(x ORDER BY i) AS x FROM u{r} GROUP BY 1, 2)")
            steps.append(f"b{r + 1} AS (SELECT b.part, b.entry, coalesce(l.x, b.x) AS x FROM b{r} b LEFT JOIN l{r} l ON l.part = b.part AND l.entry = b.entry)")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        g AS (SELECT CAST(range AS BIGINT) + 1 AS i FROM range(0, 4096)),
        c AS (SELECT vec_id, CAST(p AS INTEGER) AS part, list_slice(x, CAST(p * (len(x) // {parts}) + 1 AS BIGINT), CAST((p + 1) * (len(x) // {parts}) AS BIGINT)) AS x FROM v, range(0, {parts}) t(p)),
        s AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS entry FROM v ORDER BY vec_id LIMIT {entries}),
        b0 AS (SELECT c.part, s.entry, c.x FROM s JOIN c ON c.vec_id = s.vec_id),
        {", ".join(steps)},
        e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m[2])), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
        k AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v ON v.vec_id = e.vec_id, k"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, d):
    coded, books = compress_vectors(table(spark, d, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


@query(
    "op13_source_mixing",
    r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS turn, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
        c AS (SELECT *, sum(source_size) OVER () AS whole, sum(weight) OVER () AS all_weight, sum(3 * source_size) OVER o AS caps, sum(weight) OVER o AS weights FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, turn ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, CAST(whole - caps + 3 * source_size AS DOUBLE) * weight >= CAST(3 * source_size AS DOUBLE) * (all_weight - weights + weight) AS is_full FROM c),
        t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(whole - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0) AS DOUBLE) * weight / sum(weight) FILTER (NOT is_full) OVER () END AS target FROM f),
        p AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, CAST(doc_id AS VARCHAR), size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS begun FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, goal - begun)) + greatest(0, least(size, goal - source_size - begun)) + greatest(0, least(size, goal - 2 * source_size - begun)) AS BIGINT) AS taken FROM p""",
)
def op13(spark, d):
    out = mix_sources(table(spark, d, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("pipeline")
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
