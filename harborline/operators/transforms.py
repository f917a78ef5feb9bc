"""The extension point: author-supplied functions from DataFrame to DataFrame."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def apply_transform(df: DataFrame, fn: Callable[..., DataFrame], context: dict[str, Any] | None = None) -> DataFrame:
    """Call fn(df, context) or fn(df), by what it takes; a result that is empty or no DataFrame gives back the input."""
    takes = [p for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD, p.VAR_POSITIONAL)]
    two = len(takes) >= 2 or any(p.kind is p.VAR_POSITIONAL for p in takes)
    out = fn(df, context or {}) if two else fn(df)
    if not isinstance(out, DataFrame) or not out.columns or out.isEmpty():
        return df
    return out


# ---- user functions in Python: rows out of a row, and batches of values ---------------------------


FIELD_TYPES = {"bigint": (LongType, int), "long": (LongType, int), "double": (DoubleType, float), "string": (StringType, str), "boolean": (BooleanType, bool)}


@udtf
class json_fields:
    """json_fields(text, 'name type, ...'): one row per text, with the named fields of a JSON object in the types asked for.

    The result's columns follow from the second argument, a constant. A text that is no object, a missing field and a
    value of another type give null.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType()
        for field in fields.value.split(","):
            name, kind = field.split()
            schema = schema.add(name, FIELD_TYPES[kind.lower()][0]())
        return AnalyzeResult(schema)

    def eval(self, text: str, fields: str):
        try:
            held = json.loads(text) if text else {}
        except ValueError:
            held = {}
        held = held if isinstance(held, dict) else {}
        out = []
        for field in fields.split(","):
            name, kind = field.split()
            want, value = FIELD_TYPES[kind.lower()][1], held.get(name)
            if want is float and type(value) is int:
                value = float(value)
            out.append(value if type(value) is want else None)
        yield tuple(out)


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, and how many of them stand in another order."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken: list[int] = []
    matched = []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == c and j not in taken), None)
        if at is not None:
            matched.append(c)
            taken.append(at)
    m = len(matched)
    if not m:
        return 0.0
    crossed = sum(x != b[j] for x, j in zip(matched, sorted(taken)))
    return (m / len(a) + m / len(b) + (m - crossed // 2) / m) / 3


@pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity in Arrow batches, each distinct pair of a batch once; null where a side is null."""
    pairs = pd.DataFrame({"a": a, "b": b})
    known = pairs.dropna().drop_duplicates()
    known["s"] = [jaro(x, y) for x, y in zip(known["a"], known["b"])]
    return pairs.merge(known, "left", ["a", "b"])["s"]
