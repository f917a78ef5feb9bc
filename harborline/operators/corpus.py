"""Examples drawn from run logs, deduplicated and split.

Each extractor turns one log table into rows (record_id, task_type, source_type, industry, category,
worker_id, system, user, assistant, labels). Nothing is gathered across log rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.scalars import canonical_hash
from harborline.operators.joins import first_per_key
from harborline.operators.sampling import split_assign

EXAMPLE_COLUMNS = ["task_type", "source_type", "industry", "category", "worker_id", "system", "user", "assistant", "labels"]
# What an answer source or a low parse confidence leads to.
DEFAULT_SOURCE = "benchmark_default"
WEAK_CONFIDENCE = 0.5


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))


def _lines(**parts: Column) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k.replace('_', ' ').capitalize()}: "), v) for k, v in parts.items()])


def _examples(df: DataFrame, task: str, source: str, system: str, user: Column, assistant: Column, labels: Column, worker: Column | None = None) -> DataFrame:
    made = df.select(
        F.lit(task).alias("task_type"), F.lit(source).alias("source_type"), F.col("industry"), F.col("category"),
        (worker if worker is not None else F.lit(None).cast("string")).alias("worker_id"),
        F.lit(system).alias("system"), user.alias("user"), assistant.alias("assistant"), F.to_json(labels).alias("labels"),
    )
    return made.withColumn("record_id", record_id())


def record_id() -> Column:
    """24 hex digits over the example's fields, each preceded by its length."""
    parts = [F.concat(F.length(F.coalesce(F.col(c), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c in EXAMPLE_COLUMNS]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 24)


def intake_examples(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers(conv_id, question_id, answer_raw, normalized, source, confidence, industry, category) with questions(conv_id, question_id, question, hint).

    Every answer is a parsing example; weak or defaulted ones are a follow-up example as well.
    """
    both = answers.join(questions, ["conv_id", "question_id"], "left")
    conf = F.coalesce("confidence", F.lit(0.0))
    ask = _lines(industry=_text("industry"), question=_text("question"), hint=_text("hint"), answer=_text("answer_raw"))
    parsed = F.to_json(F.struct(F.col("normalized").alias("normalized_answer"), F.round(conf, 4).alias("parse_confidence"), _text("source").alias("answer_source")))
    labels = F.struct(F.round(conf, 4).alias("parse_confidence"), _text("source").alias("answer_source"))
    parse = _examples(both, "intake_parse", "intake_log", "Turn the answer into a field value as strict JSON.", ask, parsed, labels)
    weak = both.filter((F.col("source") == DEFAULT_SOURCE) | (conf < WEAK_CONFIDENCE))
    action = F.when(F.col("source") == DEFAULT_SOURCE, "apply_default").otherwise("ask_again")
    follow = _examples(
        weak, "intake_reframe", "intake_log", "Ask again clearly, or apply the default openly.", ask,
        F.when(F.col("source") == DEFAULT_SOURCE, "The usual value is used here; you can change it.").otherwise(F.concat(F.lit("Could you put it as one value? "), _text("question"))),
        F.struct(action.alias("expected_action")),
    )
    return parse.unionByName(follow)


def routing_examples(routes: DataFrame) -> DataFrame:
    """routes(industry, category, decision, score, columns)."""
    out = F.to_json(F.struct("decision", F.col("category").alias("top_category"), F.round("score", 4).alias("match_score")))
    return _examples(routes, "routing_decision", "routing_log", "Route the columns to a category as strict JSON.", _lines(industry=_text("industry"), columns=_text("columns")), out, F.struct("decision"))


def alias_examples(events: DataFrame) -> DataFrame:
    """events(event_type, industry, category, alias, canonical_column, status, confidence)."""
    seen = events.filter(F.col("event_type") == "alias_inference")
    out = F.to_json(F.struct("canonical_column", F.round("confidence", 4).alias("confidence"), "status"))
    return _examples(seen, "alias_mapping", "alias_log", "Map the column name to its canonical name.", _lines(category=_text("category"), alias=_text("alias")), out, F.struct("status"))


def semantic_examples(events: DataFrame) -> DataFrame:
    """events(industry, category, target_column, meaning, confidence)."""
    stated = events.filter(_text("meaning") != "")
    out = F.to_json(F.struct("meaning", F.round("confidence", 4).alias("confidence")))
    return _examples(stated, "target_semantics", "semantics_log", "State what the target column measures.", _lines(category=_text("category"), target=_text("target_column")), out, F.struct("meaning"))


def report_examples(reports: DataFrame) -> DataFrame:
    """reports(industry, category, worker_id, summary, prediction_mean)."""
    out = F.to_json(F.struct("summary", F.round("prediction_mean", 4).alias("prediction_mean")))
    return _examples(reports, "report_synthesis", "report_log", "Summarise the worker results as strict JSON.", _lines(category=_text("category"), worker=_text("worker_id")), out, F.struct("worker_id"), _text("worker_id"))


def chat_examples(pairs: DataFrame) -> DataFrame:
    """pairs(industry, category, text, reply, guarded): a user turn and the assistant turn after it."""
    guarded = F.coalesce("guarded", F.lit(False))
    system = "Answer from the report's facts only."
    grounded = _examples(pairs.filter(~guarded), "chat_grounded_response", "chat_log", system, _text("text"), _text("reply"), F.struct(F.lit(False).alias("guarded")))
    stopped = _examples(pairs.filter(guarded), "chat_guardrail", "chat_log", "Keep to operations topics.", _text("text"), _text("reply"), F.struct(F.lit(True).alias("guarded")))
    return grounded.unionByName(stopped)


def bootstrap_examples(manifest: DataFrame) -> DataFrame:
    """manifest(industry, category, worker_id, columns): one routing example per known worker."""
    out = F.to_json(F.struct(F.col("category").alias("top_category"), "worker_id"))
    return _examples(manifest, "worker_selection", "manifest", "Choose the worker that fits the columns.", _lines(industry=_text("industry"), columns=_text("columns")), out, F.struct("worker_id"), _text("worker_id"))


def build_corpus(parts: Sequence[DataFrame], seed: int | str = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """All examples, one per distinct content, with their split. Write with write_jsonl_by_split."""
    union = reduce(lambda a, b: a.unionByName(b), parts)
    content = ["task_type", "industry", "category", "system", "user", "assistant"]
    keyed = union.withColumn("_content", canonical_hash(content))
    # Copies meet in each map task first; of the rest one row per content is shuffled.
    unique = first_per_key(keyed, ["_content"], ["record_id"]).drop("_content")
    return split_assign(unique, "record_id", seed, train, val)
