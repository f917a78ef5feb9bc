"""Scores of predicted texts against expected ones, by task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.scalars import clamp
from harborline.functions.text import exact_match, json_repair_extract, word_f1

# Tasks whose answer is JSON, and the tasks each score belongs to.
JSON_TASKS = [
    "intake_parse", "routing_decision", "column_mapping_decision", "alias_mapping", "target_semantic_guess",
    "target_semantics_resolution", "worker_selection", "l1_synthesis",
]
MAPPING_TASKS = ["alias_mapping", "column_mapping_decision"]
WORKER_TASKS = ["worker_selection", "routing_decision"]
CHAT_TASKS = ["chat_grounded_response", "chat_guardrail"]
# Where JSON answers keep their candidates.
CANDIDATE_LISTS = ["top_candidates", "candidate_columns", "candidates"]
CANDIDATE_NAMES = ["canonical_column", "column", "name"]
MAPPING_NAMES = ["canonical_column", "to", "mapped_to", "canonical"]
WORKER_LISTS = ["top_workers", "worker_hypotheses"]


def _at(js: Column, path: str) -> Column:
    return F.get_json_object(js, f"$.{path}")


def _items(js: Column, path: str) -> Column:
    """A JSON list as texts; objects stay JSON text."""
    return F.coalesce(F.from_json(_at(js, path), "array<string>"), F.array().cast("array<string>"))


def _named(items: Column, names: Sequence[str], plain: bool) -> Column:
    """Texts of the items: the named fields of objects, in order, and plain texts where allowed."""
    pick = lambda x: F.when(F.ltrim(x).startswith("{"), F.array(*[_at(x, n) for n in names])).otherwise(F.array(x if plain else F.lit(None).cast("string")))
    return F.flatten(F.transform(items, pick))


def _clean(texts: Column) -> Column:
    return F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def mapping_candidates(js: Column) -> Column:
    lists = [_named(_items(js, n), CANDIDATE_NAMES, True) for n in CANDIDATE_LISTS]
    rows = _items(js, "column_mappings")
    nested = F.flatten(F.transform(rows, lambda r: F.concat(F.array(*[_at(r, n) for n in MAPPING_NAMES]), _named(_items(r, "candidates"), ["canonical_column"], True))))
    return _clean(F.concat(F.array(_at(js, "canonical_column")), *lists, nested))


def worker_ids(js: Column) -> Column:
    return _clean(F.concat(F.array(_at(js, "worker_model_id")), *[_named(_items(js, n), ["worker_model_id"], False) for n in WORKER_LISTS]))


def loose_double(text: Column) -> Column:
    """A number with thousands marks, else the first number in the text."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.coalesce(plain.try_cast("double"), F.regexp_extract(plain, r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double"))


def parse_accuracy(expected: Column, predicted: Column) -> Column:
    """Mean of source agreement, relative closeness of the value and closeness of the confidence."""
    source = lambda js: F.lower(F.trim(F.coalesce(_at(js, "answer_source"), F.lit(""))))
    number = lambda js, n: loose_double(_at(js, n))
    e, p = number(expected, "normalized_answer"), number(predicted, "normalized_answer")
    ec, pc = number(expected, "parse_confidence"), number(predicted, "parse_confidence")
    near = lambda gap: 1.0 - clamp(gap, 0.0, 1.0)
    parts = F.array_compact(
        F.array(
            F.when(source(expected) != "", (source(expected) == source(predicted)).cast("double")),
            F.when(e.isNotNull() & p.isNotNull(), near(F.abs(p - e) / F.greatest(F.lit(1.0), F.abs(e)))),
            F.when(ec.isNotNull() & pc.isNotNull(), near(F.abs(pc - ec))),
        )
    )
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0)


def score_samples(df: DataFrame, key: Sequence[str], task: str, expected: str, predicted: str) -> DataFrame:
    """(key, task, seven scores): null where a score does not belong to the task."""
    t = F.col(task)
    scored = df.join(word_f1(df, key, predicted, expected), list(key)).withColumns({"_e": json_repair_extract(F.col(expected)), "_p": json_repair_extract(F.col(predicted))})
    # Candidates are used several times and only by their tasks.
    mapping, worker = t.isin(*MAPPING_TASKS), t.isin(*WORKER_TASKS)
    scored = scored.withColumns({
        "_em": F.when(mapping, mapping_candidates(F.col("_e"))), "_pm": F.when(mapping, mapping_candidates(F.col("_p"))),
        "_ew": F.when(worker, worker_ids(F.col("_e"))), "_pw": F.when(worker, worker_ids(F.col("_p"))),
    })
    objects = F.col("_e").startswith("{") & F.col("_p").startswith("{")
    em, pm, ew, pw = (F.col(c) for c in ("_em", "_pm", "_ew", "_pw"))
    f1 = F.col("word_f1")

    def found(own: Column, other: Column, first: int) -> Column:
        both = F.coalesce((F.size(own) > 0) & (F.size(other) > 0), F.lit(False))
        return F.when(both, F.array_contains(F.slice(other, 1, first), own[0]).cast("double")).otherwise(f1)

    return scored.select(
        *key, task,
        exact_match(F.col(expected), F.col(predicted)).alias("exact_match"),
        F.when(t.isin(*JSON_TASKS), F.col("_p").isNotNull().cast("double")).alias("json_valid"),
        F.when(t == "intake_parse", F.when(F.coalesce(objects, F.lit(False)), parse_accuracy(F.col("_e"), F.col("_p"))).otherwise(f1)).alias("parse_accuracy"),
        F.when(mapping, found(em, pm, 1)).alias("mapping_top1"),
        F.when(mapping, found(em, pm, 3)).alias("mapping_top3"),
        F.when(worker, found(ew, pw, 3)).alias("worker_selection_accuracy"),
        F.when(t.isin(*CHAT_TASKS), f1).alias("grounded_response_score"),
    )
