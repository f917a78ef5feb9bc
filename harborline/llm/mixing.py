"""Training order of documents from several sources, whose weights change over time.

Each source has a schedule of weights over training time, 0 to 1, straight between its knots. Integrated, it gives the
source's share of all words, and how many of its words are due by any time. A source's documents stand in a fixed random
order, repeated as often as its words are asked for; the word at which a copy begins is due at one time, found by
inverting the integral, and that time is the copy's training position. Sorting by position mixes the sources.

Built-in functions only. Running word counts go through blocks where a source is large, and only sizes and what the
caller asks to carry are moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import fresh, whole
from harborline.operators.ordering import POS, positions, running_sum
from harborline.session import materialize

MAX_REPEATS = 3
# Weights over time of the first, second and third source, and so on around. They integrate to 5, 2 and 1: the first kind
# leads at the start, the second grows, the third comes in for the second half.
SCHEDULES = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 1.0), (1.0, 3.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
)
# Documents of one source that one task numbers; larger sources are cut in blocks.
SOURCE_ROWS = 16_384
WORD = r"[^\x20\x09-\x0D]+"
KNOT = "struct<t:double,w:double,due:double,slope:double>"

Schedule = Sequence[tuple[float, float]]


def integrated(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(time, weight, integral up to there, slope onwards) of every knot; the last entry holds the whole integral."""
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule rises in time from 0 to 1 and has no negative weight")
    out, due = [], 0.0
    for (t, w), (u, v) in zip(schedule, schedule[1:]):
        out.append((float(t), float(w), due, (v - w) / (u - t)))
        due += (w + v) / 2 * (u - t)
    if due <= 0:
        raise ValueError("a schedule needs some weight")
    return [*out, (1.0, float(schedule[-1][1]), due, 0.0)]


def source_targets(totals: DataFrame, source: str, size: str, schedules: Sequence[Schedule] = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of `totals` (source, size): adds `weight`, `target` (words) and `knots` (its integrated schedule).

    Sources take the schedules in turn, by code point, null last. All sizes are shared out by weight; a target stops at
    `max_repeats` times its source's size and the rest is shared out again among the others, until none is above. That
    is one level of water: by size allowed per weight, a first part of the sources is full, and the level of the others
    follows from sums over the sources before and after.
    """
    curves = [integrated(s) for s in schedules]
    null_last, turn, cap, ratio, caps, weights = fresh(totals, "null_last", "turn", "cap", "ratio", "caps", "weights")
    ordered = positions(totals.withColumn(null_last, F.col(source).isNull()), [null_last, source])
    knots = F.array(*[F.array(*[F.struct(*map(F.lit, k)).cast(KNOT) for k in c]) for c in curves])
    weight = F.array(*[F.lit(c[-1][2]) for c in curves])
    nth = (F.col(POS) % len(curves)).cast("int")
    told = ordered.withColumns({"weight": F.get(weight, nth), "knots": F.get(knots, nth), turn: F.col(POS), cap: F.col(size) * max_repeats})
    told = materialize(told.withColumn(ratio, F.col(cap) / F.col("weight")).drop(POS, null_last))
    whole_, all_weight = told.agg(F.sum(size), F.sum("weight")).first()
    filled = running_sum(told, [], [ratio, turn], {caps: F.col(cap), weights: F.col("weight")})
    left = F.lit(whole_ or 0) - (F.col(caps) - F.col(cap))
    others = F.lit(all_weight or 0.0) - (F.col(weights) - F.col("weight"))
    # Full: the level that this source and those after it would have is not below what it can hold.
    full = left.cast("double") * F.col("weight") >= F.col(cap).cast("double") * others
    filled = materialize(filled.withColumn("full", full).drop(caps, weights, ratio, turn))
    spent, share = filled.agg(F.sum(F.when(F.col("full"), F.col(cap))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    level = F.lit((whole_ or 0) - (spent or 0)).cast("double") * F.col("weight") / F.lit(share or 1.0)
    return filled.withColumn("target", F.when(F.col("full"), F.col(cap).cast("double")).otherwise(level)).drop("full", cap)


def time_due(knots: Column, part: Column) -> Column:
    """The time by which `part` (0 to 1) of the integral is due."""
    due = part * F.element_at(knots, -1)["due"]
    piece = F.element_at(F.filter(knots, lambda k: k["due"] <= due), -1)
    rest = due - piece["due"]
    step = 2 * rest / (piece["w"] + F.sqrt(F.greatest(F.lit(0.0), piece["w"] * piece["w"] + 2 * piece["slope"] * rest)))
    return F.least(F.lit(1.0), piece["t"] + F.when(rest > 0, step).otherwise(0.0))


def shuffle_key(id_col: str) -> Column:
    """60 bits of the id's md5: the fixed random order of a source's documents."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] | None = None,
    source_rows: int = SOURCE_ROWS,
) -> DataFrame:
    """Every row of `docs`, sorted by training position: the columns `carry` (by default all) and
    `size` (words), `source_size`, `target` (its source's words, double), `taken` (words the mix takes of the row, repeats
    counted), `copies` (array of copy from 0, position, taken) and `position` (of the first copy; null if none is taken).

    A source's documents follow each other by a hash of their id. Its target, rounded to whole words, is cut from that
    order, gone through again up to `max_repeats` times; so a row is taken at most that often, and the copy at which
    the target ends only in its first words. Equal rows get the same set of answers in any run. Null or empty text: size
    0, never taken. Null source: one source that comes last. Null ids sort as an empty id. Untaken rows stand last.
    Existing columns of the result's names are replaced. Rows of equal id and size are interchangeable.
    """
    made = ["size", "source_size", "target", "taken", "copies", "position"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in made]
    src, key, tie, upto = "src", "key", "tie", "upto"
    counted = F.regexp_count(whole(text_col), F.lit(WORD)).cast("long")
    # What is carried travels in one column, so that its names meet no others.
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("row")
    sized = materialize(docs.select(row, F.col(source_col).alias(src), shuffle_key(id_col).alias(key), F.col(id_col).cast("string").alias(tie), counted.alias("size")))
    totals = materialize(sized.groupBy(F.col(src).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    biggest = totals.agg(F.max("rows")).first()[0] or 0
    sources = materialize(source_targets(totals.drop("rows"), "source", "source_size", schedules, max_repeats).withColumn("goal", F.floor(F.col("target") + 0.5)))
    placed = running_sum(sized, [src], [key, tie, "size"], {upto: F.col("size")}, source_rows, biggest)
    told = placed.join(sources, F.col(src).eqNullSafe(F.col("source")))
    begins = lambda n: F.lit(n) * F.col("source_size") + F.col(upto) - F.col("size")
    takes = lambda n: F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - begins(n)))
    at = lambda n: time_due(F.col("knots"), begins(n).cast("double") / F.col("goal"))
    copies = F.array_compact(F.array(*[F.when(takes(n) > 0, F.struct(F.lit(n).alias("copy"), at(n).alias("position"), takes(n).alias("taken"))) for n in range(max_repeats)]))
    mixed = told.withColumn("copies", copies).withColumns(
        {"taken": F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["taken"]), "position": F.get("copies", F.lit(0))["position"]}
    )
    order = [F.col("position").asc_nulls_last(), F.col(key), F.col(tie), F.col("size")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"row.`{c}`") for c in carried], *made)


def training_sequence(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The copies of mix_sources' rows (which must carry the text) as they are read in training, one row each, range-sorted
    by `position`; the text of a copy taken in part ends after its words `taken`."""
    rest = [c for c in mixed.columns if c not in ("copies", "taken", "position", text_col)]
    rows = mixed.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("text_"), F.explode("copies").alias("c"))
    pieces = F.regexp_extract_all("text_", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    begun = F.array_join(F.slice(pieces, F.lit(1), F.col("c.taken").cast("int")), "")
    text = F.when(F.col("c.taken") < F.col("size"), begun).otherwise(F.col("text_"))
    out = rows.select(*[F.col(f"`{c}`") for c in rest], "c.copy", "c.position", "c.taken", text.alias(text_col))
    order = ["position", "copy", *[c for c in rest if c not in ("size", "source_size", "target")]]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
