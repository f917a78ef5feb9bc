"""Secrets in texts, found with built-in functions alone.

Three fixed patterns give the base spans. Over longer strings of key-like characters a window of fixed width slides:
character counts are kept up to date by one character in and one out, and with them the sum of c*log2(c), from which
the window's Shannon entropy follows. Windows above their class's bound are reported unless they touch an allowed part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import fresh, whole
from harborline.llm.fingerprints import let


def _any_case(word: str) -> str:
    # Both cases spelled out: only A-Z fold, on every engine.
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The patterns of the base kinds.
ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# Bits of a 20-character window: random hexadecimal text has about 3.4, random base-64 text about 4.0.
HEX_BITS, BASE64_BITS = 3.0, 3.75
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# What says of itself that it is an example is no secret: a part of a string, between separators, that holds such a word
# silences the windows that touch it.
ALLOW = "(?i:example|sample|dummy|placeholder|changeme|abcdefghij|0123456789)"
SEPARATORS = "[/=_+-]"
# Strings that are no secrets as a whole: uuids.
NEVER = "(?i:^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$)"
# Counts stand twelve to a long, five bits each: a window of 20 fits, and a step changes two numbers.
PER_LONG = 12
LONGS = -(-len(ALPHABET) // PER_LONG)
# Windows that are gone through together, and what marks a character of an allowed part.
STRETCH = 64
MUTE = 128

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches, positions in code points: lengths of the pieces between matches are added up."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(found, lambda m: F.char_length(m)).alias("n"), F.transform(pieces, lambda p: F.char_length(p)).alias("gap"), found.alias("v"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, p):
        start = acc["at"] + p["gap"]
        return F.struct((start + p["n"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["v"].alias("value"))).alias("out"))

    # There is one piece more than matches; the last pair has no match.
    return F.aggregate(F.filter(pairs, lambda p: p["v"].isNotNull()), empty, step, lambda acc: acc["out"])


def _base(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    found = _matches(text, pattern)
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        found = F.transform(F.filter(F.arrays_zip(found.alias("m"), values.alias("g")), lambda x: F.char_length(x["g"]) >= least), lambda x: x["m"])
    else:
        found = F.filter(found, lambda m: m["end"] - m["start"] >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _bits(c: Column) -> Column:
    """c * log2(c) of a count, looked up."""
    return F.get(F.array(*[F.lit(n * math.log2(n) if n > 1 else 0.0) for n in range(WINDOW + 1)]), c)


def _marks(value: Column, allow: str) -> Column:
    """array<int>, one per character: its number in the alphabet, and MUTE more within a part that holds an allowed word
    (its separator included)."""
    parts = F.split(value, SEPARATORS, -1)
    mute = F.flatten(F.transform(parts, lambda p: F.array_repeat(F.when(p.rlike(allow), MUTE).otherwise(0), F.char_length(p) + 1)))
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.slice(F.zip_with(codes, mute, lambda c, m: c + m), F.lit(1), F.char_length(value))


def _dense(value: Column, bound: Column, allow: str = ALLOW) -> Column:
    """struct<first,last> of the windows of `value` whose entropy reaches `bound` and that no allowed word silences
    (first null if none).

    Characters become numbers once. They are gone through in stretches of bounded length, each with the window before
    it, so that a step costs the same wherever it is: time grows with the length.
    """
    # Entropy of w characters is log2(w) - s / w, s the sum of c*log2(c): the bound is put on s.
    most = (F.lit(math.log2(WINDOW)) - bound) * WINDOW + 1e-9
    steps = F.greatest(F.lit(0), F.ceil((F.char_length(value) - WINDOW + 1) / STRETCH).cast("int"))
    nth = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    found = let(_marks(value, allow), lambda marks: F.transform(nth, lambda b: _stretch(F.slice(marks, b * STRETCH + 1, F.lit(STRETCH + WINDOW - 1)), most, b * STRETCH)))
    return let(found, lambda f: F.struct(F.array_min(F.transform(f, lambda x: x["first"])).alias("first"), F.array_max(F.transform(f, lambda x: x["last"])).alias("last")))


def _stretch(marks: Column, most: Column, before: Column) -> Column:
    """The dense windows that end in one stretch; places count from the string's start."""
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("quiet"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        marks.alias("marks"), most.alias("most"),
    )
    place = lambda code: F.floor(code / PER_LONG).cast("int")
    number = lambda counts, code: F.call_function("shiftright", F.get(counts, place(code)), (code % PER_LONG) * 5).bitwiseAND(F.lit(31)).cast("int")
    moved = lambda counts, code, by: F.transform(counts, lambda c, k: F.when(k == place(code), c + F.call_function("shiftleft", F.lit(by).cast("long"), (code % PER_LONG) * 5)).otherwise(c))

    def shift(acc, mark, by):
        """One character more (by = 1) or less (by = -1)."""
        code = mark % MUTE
        had = number(acc["counts"], code)
        return F.struct(
            moved(acc["counts"], code, by).alias("counts"), (acc["s"] - _bits(had) + _bits(had + by)).alias("s"), (acc["quiet"] + by * F.floor(mark / MUTE).cast("int")).alias("quiet"),
            acc["first"].alias("first"), acc["last"].alias("last"), acc["marks"].alias("marks"), acc["most"].alias("most"),
        )

    def noted(b, i):
        hit = (i >= WINDOW) & (b["quiet"] == 0) & (b["s"] <= b["most"])
        return F.struct(
            b["counts"].alias("counts"), b["s"].alias("s"), b["quiet"].alias("quiet"), F.coalesce(b["first"], F.when(hit, i - WINDOW)).alias("first"), F.when(hit, i).otherwise(b["last"]).alias("last"),
            b["marks"].alias("marks"), b["most"].alias("most"),
        )

    def step(acc, i):
        less = F.when(i > WINDOW, shift(acc, F.get(acc["marks"], i - WINDOW - 1), -1)).otherwise(acc)
        return let(less, lambda a: let(shift(a, F.get(a["marks"], i - 1), 1), lambda b: noted(b, i)))

    ends = lambda acc: F.struct((acc["first"] + before).alias("first"), (acc["last"] + before).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.size(marks)), start, step, ends)


def _entropy(text: Column, allow: str) -> Column:
    """Spans of dense windows; a string that holds only letters or only digits is a word or a number, never a key."""
    mixed = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(NEVER)
    some = F.filter(_matches(text, CANDIDATE), mixed)
    is_hex = lambda m: m["value"].rlike("^([0-9a-f]+|[0-9A-F]+)$")
    rated = F.transform(some, lambda m: F.struct(m["start"].alias("at"), F.when(is_hex(m), F.lit(4)).otherwise(F.lit(5)).alias("rank"), _dense(m["value"], F.when(is_hex(m), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS)), allow).alias("w")))
    hits = F.filter(rated, lambda r: r["w"]["first"].isNotNull())
    return F.transform(
        hits,
        lambda r: F.struct((r["at"] + r["w"]["first"]).alias("start"), r["rank"].alias("rank"), (r["at"] + r["w"]["last"]).alias("end"), F.when(r["rank"] == 4, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64")).alias("kind")),
    )


def scan_secrets(df: DataFrame, text_col: str = "text", allow: str = ALLOW) -> DataFrame:
    """Add `spans`, an array of (start, rank, end, kind) by start and kind; positions in code points, end exclusive.

    Base spans come first in rank (assign, access, hex) and are never suppressed. Dense windows inside a base span say
    nothing new and are left out. Null or empty text: no spans. An existing column `spans` is replaced. Rows are judged
    one by one, so repeated rows and any key skew change nothing.
    """
    text = whole(text_col)
    none = F.array().cast(SPAN)
    # A plain search decides whether positions are worked out at all.
    base = [F.when(text.rlike(p if g else f"{p[:-1]}{{{n - 4 if kind == 'access' else n},}}"), _base(text, i + 1, kind, p, g, n)).otherwise(none).cast(SPAN) for i, (kind, p, g, n) in enumerate(BASE)]
    found, more = fresh(df, "found", "more")
    rated = df.withColumns({found: F.concat(*base), more: F.when(text.rlike(CANDIDATE), _entropy(text, allow)).otherwise(none).cast(SPAN)})
    new = F.filter(F.col(more), lambda m: ~F.exists(F.col(found), lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    return rated.withColumn("spans", F.array_sort(F.concat(F.col(found), new))).drop(found, more)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with every span (overlapping ones as one) replaced by `mark`; needs `spans`. Texts without spans are unchanged."""
    text = whole(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("spans"), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text) - acc["at"])))
    return df.withColumn(text_col, F.when(F.size("spans") > 0, done).otherwise(F.col(text_col)))
