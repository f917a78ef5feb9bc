"""Schema matching: column overlap, blended decisions, semantic routing and fuzzy names."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions import scalars as S
from harborline.operators.ordering import running_sum, small_side, top_per_group
from harborline.session import materialize


def manifest_tokens(manifest: DataFrame) -> DataFrame:
    """(category, worker, token) of manifest(category, worker, column_name), one row per worker and token."""
    tokens = manifest.select("category", "worker", S.normalize_token(F.col("column_name")).alias("token")).filter(F.col("token") != "")
    return tokens.distinct()


def _marked_names(manifest: DataFrame, provided: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """The marked tokens with the first of each worker's column names for them, written.

    Names are made distinct before they are normalised and joined, and by their hashes: the least name of a group is
    found by sorting, so that is left to manifests with names that aren't their own tokens.
    """
    names = manifest.select("category", "worker", F.trim("column_name").alias("column_name")).distinct()
    marked = mark_provided(names.withColumn("token", S.normalize_token(F.col("column_name"))), provided, aliases)
    # A token is written where it isn't the name itself. Empty ones are dropped from what was written: a filter before
    # would normalise every name of the manifest.
    written = materialize(marked.withColumn("token", F.when(F.col("token") != F.col("column_name"), F.col("token"))))
    odd = not written.filter(F.col("token").isNotNull()).isEmpty()
    whole = written.withColumn("token", F.coalesce("token", "column_name")).filter(F.col("token") != "")
    return materialize(whole.groupBy("category", "worker", "token", "hit").agg(F.min("column_name").alias("column_name"))) if odd else whole


def mark_provided(tokens: DataFrame, provided: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds `hit`: the token is provided, or is the canonical of an alias that is (within its category)."""
    given = provided.select(S.normalize_token(F.col(provided.columns[0])).alias("token")).filter(F.col("token") != "").distinct().withColumn("_given", F.lit(1))
    given = small_side(given)
    out = tokens.join(given, "token", "left").withColumn("hit", F.col("_given").isNotNull())
    if aliases is not None:
        mapped = (
            aliases.select("category", S.normalize_token(F.col("alias")).alias("_alias"), S.normalize_token(F.col("canonical")).alias("token"))
            .join(given.withColumnRenamed("token", "_alias"), "_alias", "left_semi").select("category", "token").distinct().withColumn("_mapped", F.lit(1))
        )
        out = out.join(small_side(mapped), ["category", "token"], "left").withColumn("hit", F.col("hit") | F.col("_mapped").isNotNull()).drop("_mapped")
    return out.drop("_given")


def worker_scores(marked: DataFrame, cap: int | None = None) -> DataFrame:
    """Share of its columns that match, per worker; with `cap`, at most so many columns are asked of one."""
    n = marked.groupBy("category", "worker").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("matched"))
    limit = F.col("n") if cap is None else F.least(F.lit(cap), F.col("n"))
    return n.withColumn("score", F.least("matched", limit) / limit)


def column_overlap_match(manifest: DataFrame, provided: DataFrame, aliases: DataFrame | None = None, representative: int | None = None, cap: int | None = None) -> DataFrame:
    """Per category: share of its columns that match, best worker, the better of both.

    `representative` looks only at a category's most recurring columns, `cap` is that of worker_scores.
    """
    marked = materialize(mark_provided(manifest_tokens(manifest), provided, aliases))
    top = marked.groupBy("category", "token").agg(F.count(F.lit(1)).alias("n"), F.bool_or("hit").alias("hit"))
    if representative is not None:
        top = top_per_group(top, ["category"], [F.desc("n"), F.col("token")], representative)
    by_category = top.groupBy("category").agg((F.count_if("hit") / F.count(F.lit(1))).alias("category_score"))
    best = worker_scores(marked, cap).groupBy("category").agg(F.max("score").alias("best_worker_score"))
    both = by_category.join(best, "category")
    return both.select(
        "category", F.round("category_score", 4).alias("category_score"), F.round("best_worker_score", 4).alias("best_worker_score"),
        F.round(F.greatest("category_score", "best_worker_score"), 4).alias("score"),
    )


def top_workers(manifest: DataFrame, provided: DataFrame, aliases: DataFrame | None = None, k: int = 5, cap: int | None = None) -> DataFrame:
    """The k best workers of each category by the share of their columns that match."""
    return _best_workers(mark_provided(manifest_tokens(manifest), provided, aliases), k, cap)


def _best_workers(marked: DataFrame, k: int, cap: int | None) -> DataFrame:
    scored = worker_scores(marked, cap).filter(F.col("score") > 0)
    return top_per_group(scored.withColumn("score", F.round("score", 4)), ["category"], [F.desc("score"), F.col("worker")], k)


def missing_columns(manifest: DataFrame, provided: DataFrame, aliases: DataFrame | None = None, shown: int | None = None, cap: int | None = None) -> DataFrame:
    """Columns each category's best worker still lacks, numbered by name, or the first `shown` of them.

    Where no worker matches at all, or the best lacks nothing, the category's own columns are listed, most recurring
    first, without a worker.
    """
    marked = _marked_names(manifest, provided, aliases)
    # One row a category, and the columns of one worker each: written, so that their sizes are known to the joins.
    best = materialize(_best_workers(marked, 1, cap).select("category", "worker"))
    lacking = materialize(marked.join(best, ["category", "worker"], "left_semi").filter(~F.col("hit")).select("category", "worker", "column_name", F.lit(0).cast("long").alias("n"), "token"))
    own = marked.join(lacking.select("category").distinct(), "category", "left_anti").groupBy("category", "token", "column_name").agg(F.count(F.lit(1)).alias("n"))
    rest = own.groupBy("category", "token").agg(F.min("column_name").alias("column_name"), F.sum("n").alias("n"))
    every = lacking.unionByName(rest.withColumn("worker", F.lit(None).cast(marked.schema["worker"].dataType)))
    ranked = _ranked(every.withColumn("_turn", -F.col("n")), "category", ["_turn", "token"])
    return (ranked if shown is None else ranked.filter(F.col("rank") <= shown)).select("category", "worker", "column_name", "rank")


ACCEPT, PARTIAL = 0.80, 0.20


def blend_and_decide(scores: DataFrame, semantic: DataFrame, top: int | None = None) -> DataFrame:
    """scores(industry, category, score) with semantic(category, confidence): blended, ranked, decided.

    The decision looks at the deterministic score of the candidate; the first rank is the answer. `top` keeps the first few.
    """
    conf = semantic.groupBy("category").agg(F.max(S.clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0)).alias("semantic_score"))
    both = scores.join(conf, "category", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    exact = lambda c: F.col(c).cast("decimal(18,9)")  # noqa: E731  (so that halves round alike everywhere)
    blend = exact("score") * F.lit(Decimal("0.85")) + exact("semantic_score") * F.lit(Decimal("0.15"))
    blended = both.withColumn("blended_score", F.round(blend, 4).cast("double"))
    decided = blended.withColumn("decision", F.when(F.col("score") >= ACCEPT, "ACCEPT").when(F.col("score") >= PARTIAL, "PARTIAL_ACCEPT").otherwise("REJECT"))
    order = [F.desc("blended_score"), F.desc("score"), F.col("category")]
    if top is not None:
        return top_per_group(decided, ["industry"], order, top)
    turns = {"_blended": -F.col("blended_score"), "_score": -F.col("score")}
    return _ranked(decided.withColumns(turns), "industry", [*turns, "category"]).drop(*turns)


def _ranked(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds the row's number in its group; large groups are numbered in blocks."""
    return running_sum(materialize(df), [group], order, {"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("int"))


def semantic_route(manifest: DataFrame, provided: DataFrame, context: str, keywords: dict[str, Sequence[str]], cap: int | None = None) -> DataFrame:
    """0.80 * best worker overlap (over `cap` columns at most, if given) + at most 0.20 for words of the context, capped at 1."""
    marked = mark_provided(manifest_tokens(manifest), provided)
    n = marked.groupBy("category", "worker").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("m"))
    overlap = n.groupBy("category").agg(F.max(F.col("m") / (F.col("n") if cap is None else F.least(F.lit(cap), F.col("n")))).alias("overlap"))
    low = context.lower()
    score = F.lit(0.0)
    for category, words in keywords.items():
        points = (0.4 if category.replace("_", " ").lower() in low else 0.0) + 0.1 * sum(w.lower() in low for w in words)
        score = F.when(F.col("category") == category, F.lit(min(0.20, points))).otherwise(score)
    total = F.least(F.lit(1.0), F.col("overlap") * 0.80 + (score if context else F.lit(0.0)))
    return overlap.withColumn("confidence", F.round(total, 4)).filter(F.col("confidence") > 0).select("category", "confidence")


# ---- fuzzy names -----------------------------------------------------------------------------


def _grams(token) -> Column:
    """Letter pairs of the padded token, each with its occurrence number, so that a set holds repeats."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))
    return F.transform(pairs, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")))


def _letters(token) -> Column:
    return F.array_distinct(F.transform(F.split(token, ""), lambda c: F.concat(F.lit("1:"), c)))


def sequence_ratio(a: Column, b: Column, floor: float) -> Column:
    """difflib's ratio of two texts, or 0 where the letters in common already keep it under the floor."""

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        letters = {t: Counter(t) for t in set(left) | set(right)}

        def one(x: str, y: str) -> float:
            shared = sum((letters[x] & letters[y]).values())
            if 2.0 * shared < floor * (len(x) + len(y)):
                return 0.0
            return difflib.SequenceMatcher(a=x, b=y).ratio()

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return ratio(a, b)


def kept_letters(together: Column, floor: float) -> Column:
    """Letters that two texts must have in common, in order, for a ratio of `floor`; `together` is the sum of their lengths."""
    # A hair is taken off so that a bound that is a whole number isn't lost to rounding.
    return F.ceil(together * (floor / 2) - 1e-9).cast("int")


# Texts up to this length are met by the letters they keep: at a floor of 0.75, 495 ways at most to keep them.
SHORT_NAME = 12


def subsequence_pairs(left: DataFrame, right: DataFrame, floor: float, longest: int = SHORT_NAME) -> DataFrame:
    """(l, r) pairs of texts of up to `longest` letters that have as many letters in common, in order, as `floor` asks for.

    Two lengths fix that number. For every partner length a text is written down with each choice of letters kept, so
    the two texts of a pair have one writing in common: the join is on (both lengths, writing), and only such pairs meet.
    """

    def written(df: DataFrame, own: str, name: str) -> DataFrame:
        n, m = F.length("t"), F.col("m")
        # A partner is no shorter or longer than a full match of the shorter one allows.
        low, high = F.ceil(n * (floor / (2 - floor)) - 1e-9), F.floor(n * ((2 - floor) / floor) + 1e-9)
        lengths = df.filter(n <= longest).select("t", F.explode(F.sequence(F.greatest(F.lit(1), low).cast("int"), F.least(F.lit(longest), high.cast("int")))).alias("m"))
        rounds = lengths.withColumn("gone", n - kept_letters(n + m, floor)).filter(F.col("gone") >= 0)
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        once = lambda words, _: F.array_distinct(F.flatten(F.transform(words, cut)))
        turns = F.when(F.col("gone") > 0, F.sequence(F.lit(1), F.col("gone"))).otherwise(F.array().cast("array<int>"))
        writings = F.aggregate(turns, F.array("t"), once)
        ln, rn = (n, m) if own == "l" else (m, n)
        return rounds.select(ln.alias("ln"), rn.alias("rn"), F.explode(writings).alias("w"), F.col("t").alias(name))

    return written(left, "l", "l").join(written(right, "r", "r"), ["ln", "rn", "w"]).select("l", "r").distinct()


def segment_pairs(left: DataFrame, right: DataFrame, share: float, both: bool, longer_than: int = 0) -> DataFrame:
    """(l, r) token pairs that may be turned into each other by few edits; no pair that can be is missed.

    Edits are at most `share` times the longer length, or with `both` what a ratio of 1 - `share` leaves of the two
    lengths together. The longer text (of more than `longer_than` letters) is cut into one piece more than edits allowed,
    so one piece is met unchanged in the shorter, moved by no more places than there are edits: the join is on (longer
    length, piece number, piece).
    """
    n, m = F.col("n"), F.length("t")
    left_over = lambda together: together - 2 * kept_letters(together, 1.0 - share)
    # A hair is added so that a bound that is a whole number isn't lost to rounding.
    edits = lambda long, short: left_over(long + short) if both else F.floor(long * share + 1e-9).cast("int")
    # With `both`, a partner shorter by one may allow one edit more; still shorter ones don't.
    number = lambda long: (F.greatest(edits(long, long), edits(long, long - 1)) if both else edits(long, long)) + 1
    start = lambda long, i: F.floor(i * long / number(long)).cast("int")

    def as_long(df: DataFrame) -> DataFrame:
        i = F.col("i")
        rows = df.select("t", m.alias("n")).filter(n > longer_than).select("t", "n", F.explode(F.sequence(F.lit(0), F.least(number(n), n) - 1)).alias("i"))
        return rows.select("n", "i", F.substring("t", start(n, i) + 1, start(n, i + 1) - start(n, i)).alias("piece"), "t")

    def as_short(df: DataFrame) -> DataFrame:
        # The longer of a pair within the bound is no longer than this.
        top = F.floor(m * ((1 + share) / (1 - share) if both else 1 / (1 - share)) + 1e-9).cast("int")
        lengths = df.filter(m > 0).select("t", F.explode(F.sequence(m, top)).alias("n")).filter(n > longer_than)
        rows = lengths.select("t", "n", F.explode(F.sequence(F.lit(0), F.least(number(n), n) - 1)).alias("i"))
        i, size = F.col("i"), start(n, F.col("i") + 1) - start(n, F.col("i"))
        low, high = F.greatest(F.lit(0), start(n, i) - edits(n, m)), F.least(m - size, start(n, i) + edits(n, m))
        placed = rows.filter(low <= high).select("t", "n", "i", F.explode(F.sequence(low, high)).alias("p"))
        return placed.select("n", "i", F.substring("t", F.col("p") + 1, size).alias("piece"), "t").distinct()

    def meet(long: DataFrame, short: DataFrame, l: str, r: str) -> DataFrame:
        return as_long(long).join(as_short(short).withColumnRenamed("t", "s"), ["n", "i", "piece"]).select(F.col("t").alias(l), F.col("s").alias(r))

    every = meet(left, right, "l", "r").unionByName(meet(right, left, "r", "l"))
    return every.distinct()


def levenshtein_match(left: DataFrame, right: DataFrame, min_score: float = 0.78) -> DataFrame:
    """(name, match, score) of each left token's best right token by 1 - distance / longer length; ties to the first."""
    tokens = lambda df: df.select(S.unicode_token(F.col(df.columns[0])).alias("t")).filter(F.col("t") != "").distinct()
    pairs = segment_pairs(tokens(left), tokens(right), 1.0 - min_score, both=False)
    scored = pairs.withColumn("score", levenshtein_similarity(F.col("l"), F.col("r"))).filter(F.col("score") >= min_score)
    best = scored.groupBy("l").agg(F.min_by(F.struct("r", "score"), F.struct(-F.col("score"), "r")).alias("b"))
    return best.select(F.col("l").alias("name"), F.col("b.r").alias("match"), F.round("b.score", 4).alias("score"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(l, r) token pairs that can be equal, contained, or similar at the floor; no pair that can is missed.

    A ratio of t means that t/2 of all letters match in order. Short texts meet by the letters kept (subsequence_pairs).
    With a longer one, inserting and deleting the other letters turns one text into the other: segment_pairs finds
    these, and as two texts with ratio >= t share at least |a|+|b| times (1.5t - 1) minus one letter pairs, that thins
    them out. A contained text shares all its own pairs, so its single rarest inner pair is enough.
    """
    if floor < 0.75:
        raise ValueError("the candidate bound holds for floors of 0.75 and above")
    toks = lambda df: df.select(F.explode(F.concat(_grams(F.col("t")), _letters(F.col("t")))).alias("g"), "t")
    l_all, r_all = toks(left), toks(right)
    length = F.length("l") + F.length("r")
    needed = F.greatest(F.lit(1), F.ceil(length * (1.5 * floor - 1.0) - 1.0).cast("int"))
    short = subsequence_pairs(left, right, floor)
    near = short.unionByName(
        segment_pairs(left, right, 1.0 - floor, both=True, longer_than=SHORT_NAME)
        .filter(2.0 * F.least(F.length("l"), F.length("r")) >= floor * length)
        .filter(F.size(F.array_intersect(_grams(F.col("l")), _grams(F.col("r")))) >= needed)
    )

    def inner_rarest(own: DataFrame, other: DataFrame) -> DataFrame:
        seen = other.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        inner = own.filter(F.when(F.length("t") > 1, ~F.col("g").startswith("1:") & ~F.col("g").startswith("^") & ~F.col("g").contains("$#")).otherwise(F.col("g").startswith("1:")))
        return inner.join(seen, "g").groupBy("t").agg(F.min_by("g", F.struct("n", "g")).alias("g"))

    held = lambda own, other: inner_rarest(own, other).withColumnRenamed("t", "small").join(other.withColumnRenamed("t", "big"), "g").filter(F.col("big").contains(F.col("small")))
    in_right = held(l_all, r_all).select(F.col("small").alias("l"), F.col("big").alias("r"))
    in_left = held(r_all, l_all).select(F.col("big").alias("l"), F.col("small").alias("r"))
    return near.unionByName(in_right).unionByName(in_left).distinct()


def fuzzy_match(left: DataFrame, right: DataFrame, min_score: float = 0.82, contained: float = 0.90, skip_exact: bool = False, top: int | None = None) -> DataFrame:
    """Best right name for each left name: (name, match, score, reason).

    Equal tokens score 1, containment a fixed score, else the sequence ratio; ties go to the first
    name in order. Names are reduced to distinct tokens first.
    """
    tokens = lambda df: df.select(S.unicode_token(F.col(df.columns[0])).alias("t"), F.trim(df.columns[0]).alias("name")).filter(F.col("t") != "").groupBy("t").agg(F.min("name").alias("name"))
    lt, rt = tokens(left), tokens(right)
    pairs = fuzzy_candidates(lt.select("t"), rt.select("t"), min_score)
    equal, inside = F.col("l") == F.col("r"), F.col("r").contains(F.col("l")) | F.col("l").contains(F.col("r"))
    fixed = pairs.filter(equal | inside).withColumn("score", F.when(equal, 1.0).otherwise(contained)).withColumn("reason", F.when(equal, "exact_token_match").otherwise("substring_match"))
    ratios = pairs.filter(~(equal | inside)).withColumn("score", sequence_ratio(F.col("l"), F.col("r"), min_score)).withColumn("reason", F.lit("token_similarity"))
    scored = fixed.unionByName(ratios).filter(F.col("score") >= min_score)
    named = scored.join(lt.select(F.col("t").alias("l"), F.col("name").alias("name")), "l").join(rt.select(F.col("t").alias("r"), F.col("name").alias("match")), "r")
    negative = F.struct((-F.col("score")).alias("s"), "match")
    first = named.groupBy("name").agg(F.min_by(F.struct("match", F.round("score", 4).alias("score"), "reason"), negative).alias("b"))
    out = first.select("name", "b.*")
    if skip_exact:
        out = out.filter(F.col("reason") != "exact_token_match")
    return out.orderBy(F.desc("score"), "name").limit(top) if top else out


def levenshtein_similarity(a, b) -> Column:
    """1 - distance / longer length: a built-in score, not equal to the sequence ratio."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
