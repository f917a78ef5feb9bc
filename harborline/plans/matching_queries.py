"""Registered queries for schema matching: languages are categories, documents workers, words columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import matching as M
from harborline.plans.registry import query, table
from harborline.session import fan_out


def _words(df, *keep):
    return fan_out(df.select("text", *keep)).select("*", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("column_name")).drop("text")


def _manifest(spark, d):
    return _words(table(spark, d, "documents"), F.col("lang").alias("category"), F.col("doc_id").alias("worker"))


def _provided(spark, d):
    return _words(table(spark, d, "benchmark"))


def _part_names(spark, d):
    p = table(spark, d, "part")
    return p.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_type", F.regexp_replace("p_name", " ", "")))).alias("column_name"))


_W = "unnest(string_split_regex(lower(text), '[^a-z0-9]+'))"
_MARKED = f"""g AS (SELECT DISTINCT {_W} AS token FROM benchmark), m AS (SELECT DISTINCT lang AS category, doc_id AS worker, {_W} AS token FROM documents),
  k AS (SELECT m.*, g.token IS NOT NULL AS hit FROM m LEFT JOIN g USING (token) WHERE m.token <> ''), w AS (SELECT category, worker, count(*) AS n, count(*) FILTER (hit) AS matched FROM k GROUP BY 1, 2)"""


@query(
    "J7_column_overlap_match",
    f"""WITH {_MARKED}, r AS (SELECT category, token, bool_or(hit) AS hit, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, token) AS o FROM k GROUP BY 1, 2),
        c AS (SELECT category, count(*) FILTER (hit) / count(*) AS cs FROM r GROUP BY 1), b AS (SELECT category, max(matched / n) AS ws FROM w GROUP BY 1)
        SELECT category, round(cs, 4) AS category_score, round(ws, 4) AS best_worker_score, round(greatest(cs, ws), 4) AS score FROM c JOIN b USING (category)""",
)
def j7(spark, d):
    return M.column_overlap_match(_manifest(spark, d), _provided(spark, d))


@query(
    "J7_top_workers",
    f"""WITH {_MARKED}, s AS (SELECT category, worker, matched, round(matched / n, 4) AS score FROM w WHERE matched > 0)
        SELECT category, worker, score, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, worker) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
)
def j7w(spark, d):
    return M.top_workers(_manifest(spark, d), _provided(spark, d)).select("category", "worker", "score", "rank")


@query(
    "J7_missing_columns",
    f"""WITH {_MARKED}, s AS (SELECT category, worker, round(matched / n, 4) AS score FROM w WHERE matched > 0), t AS (SELECT category, worker FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, worker) = 1),
        l AS (SELECT k.category, k.worker, token, 0::BIGINT AS n FROM k JOIN t USING (category, worker) WHERE NOT hit),
        o AS (SELECT category, CAST(NULL AS BIGINT) AS worker, token, count(*) AS n FROM k WHERE category NOT IN (SELECT category FROM l) GROUP BY category, token)
        SELECT category, worker, token AS column_name, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS INTEGER) AS rank FROM (SELECT * FROM l UNION ALL SELECT * FROM o)""",
)
def j7m(spark, d):
    return M.missing_columns(_manifest(spark, d), _provided(spark, d))


@query(
    "J8_blend_and_decide",
    f"""WITH {_MARKED}, s AS (SELECT worker % 3 AS industry, category || '-' || worker AS category, worker, round(matched / n, 4) AS score FROM w),
        b AS (SELECT s.industry, s.category, score, coalesce(quality * 0.5::DOUBLE + toxic * 0.25::DOUBLE, 0) AS sem FROM s LEFT JOIN labels ON worker = doc_id), z AS (SELECT *, CAST(round(CAST(score AS DECIMAL(18,9)) * 0.85 + CAST(sem AS DECIMAL(18,9)) * 0.15, 4) AS DOUBLE) AS blended FROM b)
        SELECT industry, category, score, sem AS semantic_score, blended AS blended_score, CASE WHEN score >= 0.8 THEN 'ACCEPT' WHEN score >= 0.2 THEN 'PARTIAL_ACCEPT' ELSE 'REJECT' END AS decision,
          CAST(row_number() OVER (PARTITION BY industry ORDER BY blended DESC, score DESC, category) AS INTEGER) AS rank FROM z""",
)
def j8(spark, d):
    marked = M.mark_provided(M.manifest_tokens(_manifest(spark, d)), _provided(spark, d))
    name = F.concat_ws("-", "category", F.col("worker").cast("string"))
    scores = M.worker_scores(marked).select((F.col("worker") % 3).alias("industry"), name.alias("category"), F.round("score", 4).alias("score"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    semantic = docs.select(F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("category"), (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("confidence"))
    return M.blend_and_decide(scores, semantic)


@query(
    "J10_semantic_route",
    f"""WITH {_MARKED}, o AS (SELECT category, max(matched / n) AS v FROM w GROUP BY 1)
        SELECT category, round(least(1.0, v * 0.8::DOUBLE + CASE category WHEN 'en' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.1::DOUBLE ELSE 0 END), 4) AS confidence FROM o""",
)
def j10(spark, d):
    return M.semantic_route(_manifest(spark, d), _provided(spark, d), "Late arrivals in the en region", {"en": ["late", "arrivals"], "fr": ["region", "missing"], "de": ["nothing"]})


@query(
    "J9_levenshtein_match",
    f"""WITH g AS (SELECT DISTINCT {_W} AS r FROM benchmark), p AS (SELECT DISTINCT lower(n) AS l FROM (SELECT unnest(string_split(p_name, ' ')) AS n FROM part UNION ALL SELECT replace(p_name, ' ', '') FROM part UNION ALL SELECT p_type FROM part)),
        s AS (SELECT l, r, 1 - levenshtein(l, r) / greatest(length(l), length(r)) AS score FROM p, g WHERE l <> '' AND r <> '')
        SELECT l AS name, arg_min(r, (-score, r)) AS match, round(max(score), 4) AS score FROM s WHERE score >= 0.55 GROUP BY l""",
)
def j9l(spark, d):
    """The same names by edit distance, at a lower floor."""
    return M.levenshtein_match(_part_names(spark, d), _provided(spark, d), 0.55)


@query("J9_fuzzy_match")
def j9(spark, d):
    """Part names and types against the words of the benchmark, best match each."""
    return M.fuzzy_match(_part_names(spark, d), _provided(spark, d), 0.78, 0.92)
