"""Rule-table functions over text: categories, families, meanings, answers, anchors, JSON and currency."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions import rules as K
from harborline.functions import scalars as S
from harborline.session import fan_out

# ---- keyword scores ----------------------------------------------------------------------------


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words], F.lit(0))


def keyword_scores(text: Column, categories: dict[str, list[str]]) -> Column:
    """array<struct<category, score>> in table order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[F.struct(F.lit(c).alias("category"), hits(low, words).alias("score")) for c, words in categories.items()])


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value worked out once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def keyword_categories(text: Column, categories: dict[str, list[str]] = K.CATEGORY_KEYWORDS, default: str = K.DEFAULT_CATEGORY) -> Column:
    """Categories scoring at least 80 % of the best (and at least 1)."""

    def near(scores: Column, best: Column) -> Column:
        floor = F.greatest(F.lit(1), F.floor(best * 0.8).cast("int"))
        kept = F.transform(F.filter(scores, lambda s: s["score"] >= floor), lambda s: s["category"])
        return F.when(best > 0, kept).otherwise(F.array(F.lit(default)))

    return bind(keyword_scores(text, categories), lambda s: bind(F.array_max(F.transform(s, lambda x: x["score"])), lambda b: near(s, b)))


def best_category(text: Column, categories: dict[str, list[str]] = K.CATEGORY_KEYWORDS, default: str = K.DEFAULT_CATEGORY) -> Column:
    """struct<category, score, confidence>: first best category, its score, and how sure the lead makes it."""

    def pick(scores: Column, ordered: Column) -> Column:
        best = ordered[0]
        first = F.filter(scores, lambda s: s["score"] == best)[0]["category"]
        lead = best - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0))
        return F.struct(
            F.when(best > 0, first).otherwise(default).alias("category"), best.alias("score"),
            F.when(best <= 0, "low").when((best >= 3) & (lead >= 1), "high").otherwise("medium").alias("confidence"),
        )

    return bind(keyword_scores(text, categories), lambda s: bind(F.sort_array(F.transform(s, lambda x: x["score"]), asc=False), lambda o: pick(s, o)))


def deficit_first(ranked: Column, deficits: dict[str, int]) -> Column:
    """Of several near-best categories, the one furthest below its target; else the first."""
    table = F.create_map(*[F.lit(x) for kv in deficits.items() for x in kv]) if deficits else F.create_map().cast("map<string,int>")

    def pick(names: Column) -> Column:
        short = F.transform(names, lambda c, i: F.struct(F.greatest(F.lit(0), F.coalesce(table[c], F.lit(0))).alias("d"), (-i).alias("i"), c.alias("c")))
        return bind(F.array_max(short), lambda top: F.when((F.size(names) > 1) & (top["d"] > 0), top["c"]).otherwise(names[0]))

    return bind(ranked, pick)


def intent_scores(df: DataFrame, text: str, key: Sequence[str], categories: dict[str, list[str]], top_k: int | None = None) -> DataFrame:
    """(key, category, score, rank): 4 for the category's phrase, 1.5 per keyword, and for categories
    without either 0.8 per phrase word that some text word resembles (ratio 0.86); over 8, at most 1.

    Resemblance is worked out once per distinct word, not per row.
    """
    low = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    phrase = {c: c.replace("_", " ").strip().lower() for c in categories}
    base = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("category"), (F.when(low.contains(phrase[c]), 4.0).otherwise(0.0) + 1.5 * hits(low, [w.lower() for w in words])).alias("base"))
            for i, (c, words) in enumerate(categories.items())
        ]
    )
    df = fan_out(df)
    scored = df.filter(low != "").select(*key, F.explode(base).alias("s")).select(*key, "s.*")
    words = df.select(*key, F.explode(F.array_distinct(F.split(F.regexp_replace(low, "[/-]", " "), r"\s+"))).alias("word")).filter(F.col("word") != "")
    targets = sorted({w for p in phrase.values() for w in p.split()})
    alike = words.select("word").distinct().select("word", F.explode(similar_words(F.col("word"), targets, 0.86)).alias("target"))
    owners = [(c, w) for c, p in phrase.items() for w in p.split()]
    pairs = df.sparkSession.createDataFrame(owners, "category string, target string")
    fuzzy = words.join(alike, "word").join(F.broadcast(pairs), "target").groupBy(*key, "category").agg((0.8 * F.count_distinct("target")).alias("fuzzy"))
    both = scored.join(fuzzy, [*key, "category"], "left")
    raw = F.when(F.col("base") > 0, F.col("base")).otherwise(F.coalesce("fuzzy", F.lit(0.0)))
    ranked = both.withColumn("_raw", raw).filter(F.col("_raw") > 0)
    # At most one row per category and key.
    w = Window.partitionBy(*key).orderBy(F.desc("_raw"), "ordinal")
    numbered = ranked.withColumn("rank", F.row_number().over(w))
    return (numbered if top_k is None else numbered.filter(F.col("rank") <= top_k)).select(
        *key, "category", F.round(F.least(F.lit(1.0), F.col("_raw") / 8.0), 4).alias("score"), "rank"
    )


def intent_best(text: Column, categories: dict[str, list[str]]) -> Column:
    """The single best category: 5 for its phrase, 2 per keyword; null without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = F.array(
        *[
            F.struct((F.when(low.contains(c.replace("_", " ")), 5).otherwise(0) + 2 * hits(low, [w.lower() for w in words])).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
            for i, (c, words) in enumerate(categories.items())
        ]
    )
    top = F.array_max(scores)
    return F.when(top["s"] > 0, top["c"])


def similar_words(word: Column, targets: Sequence[str], floor: float) -> Column:
    """Targets whose difflib ratio with the word reaches the floor."""
    import difflib

    fixed = list(targets)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def match(words: pd.Series) -> pd.Series:
        def one(w: str) -> list[str]:
            out = []
            for t in fixed:
                if 2.0 * min(len(t), len(w)) < floor * (len(t) + len(w)):
                    continue
                m = difflib.SequenceMatcher(a=t, b=w)
                if m.quick_ratio() >= floor and m.ratio() >= floor:
                    out.append(t)
            return out

        return words.map(one)

    return match(word)


def keyword_score(text: Column, ident: Column, allow: Sequence, exclude: Sequence[str], include: Sequence[str]) -> Column:
    """5 for an allowed id, -10 for any excluded word, else the included words found."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(ident.isin(*allow), 5).when(hits(low, exclude) > 0, -10).otherwise(hits(low, include))


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str, prefix: bool = False) -> Column:
    """Category of the first rule with a keyword in the text (or a prefix of it)."""
    out = F.lit(default)
    for name, words in reversed(list(rules)):
        test = F.lit(False)
        for w in words:
            test = test | (text.startswith(w) if prefix else text.contains(w))
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def title_hint(text: Column) -> Column:
    return first_rule(F.lower(F.coalesce(text, F.lit(""))), K.TITLE_HINTS, K.TITLE_HINT_DEFAULT)


def code_hint(code: Column) -> Column:
    return first_rule(code, K.CODE_HINTS, K.CODE_HINT_DEFAULT, prefix=True)


# ---- target families and meanings ---------------------------------------------------------------------


def target_family(category: Column, target: Column, task: Column, vocab: Sequence[tuple[str, str, str, Sequence[str]]] = ()) -> Column:
    """Family of a target: exact vocabulary (category, family, task, names), then substring rules,
    then the only family of that task, else unknown:<target>."""
    t = S.normalize_token(F.coalesce(target, F.lit("")))
    k = S.normalize_token(F.coalesce(task, F.lit("")))
    fits = [
        F.when((category == c) & ((k == "") | F.lit(norm_name(task_name) == "") | (k == norm_name(task_name))), F.struct(F.lit(f).alias("f"), t.isin(*[norm_name(n) for n in names]).alias("exact")))
        for c, f, task_name, names in vocab
    ]
    none = F.array().cast("array<struct<f:string,exact:boolean>>")
    possible = F.array_compact(F.array(*fits)) if fits else none
    exact = F.filter(possible, lambda x: x["exact"] & (t != ""))
    shown = F.when(t == "", "none").otherwise(t)
    ruled = F.lit(None).cast("string")
    for c, rules in K.TARGET_FAMILIES.items():
        inner = F.lit(None).cast("string")
        for words, family in reversed(rules):
            inner = F.when(hits(t, words) > 0, family).otherwise(inner) if words else F.lit(family)
        ruled = F.when(category == c, inner).otherwise(ruled)
    return F.coalesce(
        F.when(F.size(exact) == 1, exact[0]["f"]),
        F.when(F.size(exact) > 1, F.concat(F.lit("ambiguous:"), shown)),
        F.when(t != "", ruled),
        F.when(F.size(possible) == 1, possible[0]["f"]),
        F.concat(F.lit("unknown:"), shown),
    )


def norm_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", (name or "").strip().lower())


def meaning_votes(target: Column, names: Column, hints: Column, task: Column, runs: Column) -> Column:
    """struct<meaning, confidence> of a target from its name, related names, value hints and history."""
    words = F.array_distinct(F.flatten(F.concat(F.array(S.split_tokens(target)), F.transform(names, S.split_tokens))))
    known = F.struct(S.unicode_token(F.coalesce(target, F.lit(""))).alias("t"), words.alias("words"))
    return bind(known, lambda k: _count_votes(k["t"], k["words"], hints, task, runs))


def _count_votes(t: Column, tokens: Column, hints: Column, task: Column, runs: Column) -> Column:
    votes: list[Column] = []

    def vote(label: str, weight: Column, test: Column) -> None:
        votes.append(F.when(test, F.struct(F.lit(label).alias("label"), weight.alias("w"), F.lit(len(votes)).alias("at"))))

    for label, weight, exact, parts in K.MEANING_NAME_VOTES:
        test = t.isin(*exact) if exact else F.lit(False)
        for p in parts:
            test = test | t.contains(p)
        vote(label, F.lit(weight), test)
    for label, bag in K.MEANING_BAGS.items():
        n = F.size(F.array_intersect(tokens, F.array(*map(F.lit, bag))))
        vote(label, F.least(F.lit(0.45), 0.12 * n), n > 0)
    for hint, label, weight in K.MEANING_HINT_VOTES:
        vote(label, F.lit(weight), F.array_contains(hints, hint))
    vote("classification label", F.lit(0.15), F.lower(task) == "classification")
    vote("operational target metric", F.lit(0.08), runs >= 5)

    def count(cast: Column) -> Column:
        labels = F.array_distinct(F.transform(cast, lambda v: v["label"]))
        sums = F.transform(
            labels,
            lambda n, i: F.struct(
                F.aggregate(F.filter(cast, lambda v: v["label"] == n), F.lit(0.0), lambda a, v: a + v["w"]).alias("s"), (-i).alias("i"), n.alias("label")
            ),
        )
        return bind(
            F.array_max(sums),
            lambda top: F.struct(
                F.coalesce(top["label"], F.lit(K.MEANING_FALLBACK[0])).alias("meaning"),
                F.when(F.size(cast) > 0, F.round(S.clamp(top["s"], 0.35, 0.97), 4)).otherwise(K.MEANING_FALLBACK[1]).alias("confidence"),
            ),
        )

    return bind(F.array_compact(F.array(*votes)), count)


# ---- dates and answers -----------------------------------------------------------------------------------------


def parse_lookback(text: Column, as_of: Column, days: Column | None = None, start: Column | None = None) -> Column:
    """Days to look back, 30-730: a start date, explicit days, "past N units", "since month [year]", else 365."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    span = r"(?:past|last|for)\s+(\d+)\s*(day|week|month|year)s?"
    units = F.create_map(*[F.lit(x) for kv in K.UNIT_DAYS.items() for x in kv])
    count = F.regexp_extract(low, span, 1).try_cast("double")
    by_span = F.when(count.isNotNull(), count * F.try_element_at(units, F.regexp_extract(low, span, 2)))
    since = r"since\s+([a-z]{3,9})(?:\s+(\d{4}))?"
    months = F.create_map(*[F.lit(x) for kv in K.MONTHS.items() for x in kv])
    month = F.try_element_at(months, F.regexp_extract(low, since, 1))
    year = F.coalesce(F.regexp_extract(low, since, 2).try_cast("int"), F.year(as_of))
    anchor = F.make_date(year, month, F.lit(1))
    anchor = F.when(anchor > as_of, F.make_date(year - 1, month, F.lit(1))).otherwise(anchor)
    by_month = F.when(month.isNotNull(), F.greatest(F.lit(30), F.date_diff(as_of, anchor)).cast("double"))
    explicit = F.lit(None).cast("double") if days is None else F.floor(days.try_cast("double")).cast("double")
    if start is not None:
        back = F.date_diff(as_of, S.parse_datetime(start).cast("date"))
        explicit = F.coalesce(F.when(back > 0, back.cast("double")), explicit)
    return S.clamp(F.coalesce(explicit, by_span, by_month, F.lit(365.0)), 30, 730).cast("int")


def lookback_days(text: Column, default: int = 180) -> Column:
    """First span of days, else weeks, months, years anywhere in the text, 7-730."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tries = [F.regexp_extract(low, rf"(\d+)\s*{unit}", 1).try_cast("double") * mult for unit, mult in K.UNIT_DAYS.items()]
    found = F.coalesce(*tries)
    return F.when(found.isNotNull(), S.clamp(found, 7, 730)).otherwise(float(default)).cast("int")


def parse_answer(kind: str, raw: Column, low: float = 0.0, high: float = 1_000_000.0) -> Column:
    """Number in an answer: percentage to a share in [0, 1], integer or float within bounds; null if none."""
    v = F.regexp_replace(F.trim(raw), r"[^\d.\-]", "").try_cast("double")
    if kind == "percentage":
        share = F.when(v > 1.0, v / 100.0).otherwise(v)
        return F.when(v.isNotNull(), F.round(S.clamp(share, 0.0, 1.0), 4))
    if kind == "integer":
        return F.when(v.isNotNull(), S.clamp(F.bround(v), low, high).cast("long"))
    if kind == "float":
        return F.when(v.isNotNull(), F.round(S.clamp(v, low, high), 4))
    raise ValueError(f"unknown answer kind: {kind}")


def closest_option(raw: Column, options: Sequence[str], floor: float = 0.5) -> Column:
    """The option most like the answer when its ratio reaches the floor, else the answer itself."""
    import difflib

    norm = [("".join(ch for ch in o.lower() if ch.isalnum()), o) for o in options]

    @F.pandas_udf(T.StringType())
    def pick(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            text = v.strip()
            token = "".join(ch for ch in text.lower() if ch.isalnum())
            ranked = [(difflib.SequenceMatcher(a=token, b=n).ratio(), -i, o) for i, (n, o) in enumerate(norm)]
            score, _, option = max(ranked)
            return option if score >= floor else text

        return values.map(one)

    return pick(raw)


# ---- numbers in context -----------------------------------------------------------------------------------------

NUMBER = r"-?\d+(?:\.\d+)?[kmb]?"


def context_anchors(
    df: DataFrame, key: Sequence[str], text: str,
    labels_by_words: Sequence[tuple[str, Sequence[Sequence[str]]]] = tuple(K.ANCHOR_LABELS), percent: Sequence[str] = tuple(K.ANCHOR_PERCENT_LABELS),
) -> DataFrame:
    """(key, label, value): each label's first number with one of its words within 40 characters."""
    low = fan_out(df).select(*key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    cut = low.select(*key, "_t", F.split("_t", NUMBER).alias("_gaps"), F.regexp_extract_all("_t", F.lit(NUMBER), F.lit(0)).alias("_nums"))
    cut = cut.filter(F.size("_nums") > 0)
    # Each number with the text around it, before rows are made: a piece has a character at least, so as many pieces
    # as characters reach far enough, and only a bounded span per number leaves the text.
    reach, n = K.ANCHOR_REACH, F.size("_nums")
    ahead = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get("_gaps", i), F.get("_nums", i)))
    behind = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get("_nums", i), F.get("_gaps", i + 1)))
    pieces = cut.withColumns({"_ahead": ahead, "_behind": behind})

    def around(i: Column) -> Column:
        before = F.concat(F.array_join(F.slice("_ahead", F.greatest(F.lit(1), i + 1 - reach), F.least(i, F.lit(reach))), ""), F.get("_gaps", i))
        after = F.concat(F.get("_gaps", i + 1), F.array_join(F.slice("_behind", i + 2, F.lit(reach)), ""))
        return F.struct(i.alias("i"), F.get("_nums", i).alias("num"), F.concat(F.right(before, F.lit(reach)), F.get("_nums", i), F.left(after, F.lit(reach))).alias("span"))

    spans = pieces.select(*key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), around)).alias("z"))
    span = spans.select(*key, F.col("z.i").alias("_i"), F.col("z.num").alias("_num"), F.col("z.span").alias("_span"))
    unit = F.substring("_num", -1, 1)
    value = F.regexp_replace("_num", "[kmb]$", "").cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    labels = []
    for name, groups in labels_by_words:
        test = F.lit(True)
        for words in groups:
            test = test & (hits(F.col("_span"), words) > 0)
        labels.append(F.when(test, F.lit(name)))
    rows = span.select(*key, "_i", value.alias("_v"), F.explode(F.array_compact(F.array(*labels))).alias("label"))
    first = rows.groupBy(*key, "label").agg(F.min_by("_v", "_i").alias("value"))
    share = F.col("label").isin(*percent)
    return first.withColumn(
        "value", F.when(share & (F.col("value") <= 1), F.round(F.col("value") * 100, 4)).when(share, F.round("value", 4)).otherwise(F.col("value"))
    )


# ---- JSON -------------------------------------------------------------------------------------------------------------


def json_repair_extract(text: Column) -> Column:
    """The first reading of the text that parses as JSON: itself, without fences, its outer {…}, its outer […]."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(t, r"(?is)^```(?:json)?\s*|\s*```$", ""))
    tries = [t, bare, F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in tries])


@F.pandas_udf(T.StringType())
def flatten_text(payloads: pd.Series) -> pd.Series:
    """Keys and leaf texts of JSON of any shape, noisy keys left out."""

    def leaves(v) -> Iterator[str]:
        if isinstance(v, dict):
            for k, inner in v.items():
                if k.strip() not in K.NOISY_KEYS:
                    yield k
                    yield from leaves(inner)
        elif isinstance(v, list):
            for inner in v:
                yield from leaves(inner)
        elif isinstance(v, str):
            if v.strip():
                yield v.strip()
        elif v is not None:
            yield str(v)

    def one(text: str | None) -> str | None:
        try:
            return " ".join(leaves(json.loads(text)))
        except (TypeError, ValueError):
            return None

    return payloads.map(one)


# ---- answers compared with references ----------------------------------------------------------------------------------


def normalize_answer(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\p{L}\p{N}_\s.\-:%/]", " "), r"(?U)\s+", " "))


def exact_match(a: Column, b: Column) -> Column:
    return (normalize_answer(a) == normalize_answer(b)).cast("double")


def word_f1(df: DataFrame, key: Sequence[str], predicted: str, expected: str) -> DataFrame:
    """(key, word_f1): F1 of the two texts' words as multisets."""
    words = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != "")
    sides = df.select(
        *key,
        F.explode_outer(
            F.concat(
                F.transform(words(predicted), lambda w: F.struct(w.alias("w"), F.lit(1).alias("p"), F.lit(0).alias("t"))),
                F.transform(words(expected), lambda w: F.struct(w.alias("w"), F.lit(0).alias("p"), F.lit(1).alias("t"))),
            )
        ).alias("s"),
    )
    counts = sides.groupBy(*key, "s.w").agg(F.sum("s.p").alias("p"), F.sum("s.t").alias("t"))
    total = counts.groupBy(*key).agg(F.sum(F.least("p", "t")).alias("o"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    f1 = 2.0 * F.col("o") / (F.col("p") + F.col("t"))
    return total.select(*key, F.when(F.coalesce(F.col("o"), F.lit(0)) > 0, f1).otherwise(0.0).alias("word_f1"))


# ---- currency ------------------------------------------------------------------------------------------------------------

# A number is read whole, with or without thousands marks.
AMOUNT = r"(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)([kKmMbB]?)"


def _money_marks() -> tuple[dict[str, str], str]:
    """Currency code of every mark, and a pattern of the marks, longest first."""
    names = {n: code for code, ns in {"usd": ["us$", "us dollars", "us dollar", "usd", "dollars", "dollar", "$"], **K.CURRENCY_NAMES}.items() for n in ns}
    ordered = sorted(names, key=lambda n: (-len(n), n))
    edge = lambda n: rf"\b{re.escape(n)}" + (r"\b\.?" if n == "rs" else r"\b" if n[-1].isalnum() else "")
    return names, "|".join(edge(n) if n[0].isascii() and n[0].isalpha() else re.escape(n) for n in ordered)


def fx_to_usd(text: Column) -> Column:
    """Every amount with a currency's name or sign beside it, written in dollars ("$… USD"); all else as it was."""
    _, mark = _money_marks()
    pattern = rf"(?i)(?:{mark})\s*{AMOUNT}(?:\s*usd\b)?|{AMOUNT}\s*(?:{mark})"
    # Each amount is worked out once, then written.
    found = F.transform(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: fx_amount(m)["usd"]), S.format_usd)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("money"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["money"], F.lit("")))), "")


def fx_amount(text: Column) -> dict[str, Column]:
    """First amount named with a currency, in USD, with its code; what fx_to_usd writes out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names, mark = _money_marks()
    before, after = rf"({mark})\s*{AMOUNT}", rf"{AMOUNT}\s*({mark})"
    codes = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rates = F.create_map(*[F.lit(x) for kv in K.FX_TO_USD.items() for x in kv])
    has = F.regexp_extract(low, before, 1) != ""
    name = F.rtrim(F.when(has, F.regexp_extract(low, before, 1)).otherwise(F.regexp_extract(low, after, 3)), F.lit("."))
    number = F.when(has, F.regexp_extract(low, before, 2)).otherwise(F.regexp_extract(low, after, 1))
    suffix = F.when(has, F.regexp_extract(low, before, 3)).otherwise(F.regexp_extract(low, after, 2))
    scale = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    code = F.try_element_at(codes, name)
    amount = F.regexp_replace(number, ",", "").try_cast("double") * scale
    return {"currency": code, "amount": amount, "usd": amount * F.try_element_at(rates, code)}
