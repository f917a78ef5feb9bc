"""Lines that many documents share stay only in the first of them.

Lines are exploded with their position, keyed by a hash of their normal form, and counted per hash with map-side
combining, so a line in a third of all documents is one row per task. What is shuffled is hashes and positions; the
texts move once, to meet the positions to drop, and are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import SPACES, fresh, key128, lower_ascii, whole
from harborline.session import materialize

MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of `docs`, the text without its repeated lines, plus `n_lines` and `n_dropped`.

    A key of at least `min_chars` characters found under two ids or more keeps its lines under the smallest id only.
    Null or empty text: one empty line. Null id: one document that sorts before all others. Rows that repeat an id are
    the same document, and lines repeated inside one document stay. A text all of whose lines go becomes empty.
    Existing columns of the result's names are replaced.
    """
    doc, hashed, at, dropped, lines, kept, low = fresh(docs, "doc", "hashed", "at", "dropped", "lines", "kept", "low")
    first = F.lit(-(2**63)) if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.lit("")
    base = docs.withColumns({doc: F.coalesce(F.col(id_col), first), hashed: F.xxhash64(whole(text_col)), lines: F.split(whole(text_col), "\n", -1)})
    key = line_key(F.col("line"))
    a, b = key128(F.col("k"))
    rows = (
        base.select(doc, hashed, F.posexplode(lines).alias(at, "line"))
        .select(doc, hashed, at, key.alias("k"))
        .filter(F.char_length("k") >= min_chars)
        .select(doc, hashed, at, a.alias("ka"), b.alias("kb"))
    )
    # Written, so that the join below is planned on its own and a key with very many lines can be split.
    shared = materialize(rows.groupBy("ka", "kb").agg(F.min(doc).alias(low), F.max(doc).alias("_top")).filter(F.col("_top") > F.col(low)).drop("_top"))
    # A document's own positions only: the set is bounded by its number of lines.
    drops = rows.join(shared, ["ka", "kb"]).filter(F.col(doc) > F.col(low)).groupBy(doc, hashed).agg(F.collect_set(at).alias(dropped))
    joined = base.join(drops, [doc, hashed], "left")
    last = F.size(lines) - 1
    stays = F.array_except(F.sequence(F.lit(0), last), F.coalesce(F.col(dropped), F.array().cast("array<int>")))
    text = F.array_join(F.transform(F.col(kept), lambda i: F.get(F.col(lines), i)), "\n")
    return (
        joined.withColumn(kept, stays)
        .withColumns({text_col: F.when(F.col(dropped).isNull(), whole(text_col)).otherwise(text), "n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(kept)).cast("long")})
        .select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
    )
