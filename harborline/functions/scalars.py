"""Scalar functions over columns. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- null, NaN and cast conventions ---------------------------------------------------------


def distinct_with_null(c: str | Column) -> Column:
    """Distinct count where null is one more value."""
    col = F.col(c) if isinstance(c, str) else c
    return F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))


def sum0(c: Column) -> Column:
    """Sum that is 0 for a group holding only nulls."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def finite_or_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# ---- names and text ---------------------------------------------------------------------------


def normalize_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def unicode_token(c: Column) -> Column:
    """Keeps letters and digits of any script."""
    return F.lower(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}]+", ""))


def slug(c: Column, default: str = "dataset") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def split_tokens(c: Column) -> Column:
    stepped = F.regexp_replace(F.trim(c), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(stepped), "[^a-z0-9]+"), lambda x: x != "")


def combine_str(cols: Sequence[Column], sep: str) -> Column:
    """Joins values with nulls as empty text; concat_ws would skip them."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(*parts)


def truncate_text(c: Column, limit: int = 4000) -> Column:
    keep = max(0, limit - 3)
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, keep), F.lit("...")))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def canonical_hash(cols: Sequence[str]) -> Column:
    """sha256 over the row's values in column-name order; nulls and separators stay distinct.

    Length-prefixed parts replace JSON text: the same rows are equal, and no formatting rule of a
    JSON writer enters the digest.
    """
    parts = []
    for name in sorted(cols):
        v = F.col(name).cast("string")
        parts.append(
            F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")), F.lit(";"))
        )
    return F.sha2(F.concat(*parts), 256)


def hash_bucket(c: Column, mod: int = 256) -> Column:
    digest = F.sha2(c.cast("string"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(mod)).cast("double")


def unit_hash(c: Column, seed: int | str) -> Column:
    """First 48 bits of sha256("seed:value") as a number in [0, 1]; 48 bits are exact in a double."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12 - 1))


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 from two nested digests (RFC 2104), so no Python runs per row."""
    import hashlib

    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = bytearray(b ^ 0x36 for b in key)
    outer = bytearray(b ^ 0x5C for b in key)
    digest = F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def agent_bucket(c: Column) -> Column:
    """Browser family; chrome is tested first, so an agent naming both chrome and edge is chrome."""
    ua = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit("other")
    for name in reversed(["chrome", "safari", "firefox", "edge"]):
        out = F.when(ua.contains(name), name).otherwise(out)
    return out


def stable_identity(secret: str, ip: Column, agent: Column) -> Column:
    return hmac_sha256(secret, F.concat_ws("|", ip, agent_bucket(agent), F.lit("stable")))


def hour_epoch(ts: Column, hours: int = 1) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(hours * 3600))


def epoch_identity(secret: str, ip: Column, agent: Column, ts: Column, hours: int = 1) -> Column:
    return hmac_sha256(secret, F.concat_ws("|", ip, agent_bucket(agent), hour_epoch(ts, hours).cast("string")))


# ---- numbers ------------------------------------------------------------------------------------


def parse_number(c: Column) -> Column:
    """Number from text in US, EU or decimal-comma form; null when it cannot be read."""
    s = F.regexp_replace(c.cast("string"), "[^0-9,.\\-]", "")
    no_dots_comma_point = F.regexp_replace(F.regexp_replace(s, "\\.", ""), ",", ".")
    is_eu = s.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$")
    is_us = s.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
    is_decimal_comma = ~s.contains(".") & s.rlike(r"^-?\d+,\d{1,6}$")
    text = (
        F.when(is_eu, no_dots_comma_point)
        .when(is_decimal_comma & ~is_us, F.regexp_replace(s, ",", "."))
        .otherwise(F.regexp_replace(s, ",", ""))
    )
    return text.try_cast("double")


def strip_to_double(c: Column) -> Column:
    """Simple form: drop commas and symbols, then cast."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def hhmm_split(c: Column) -> tuple[Column, Column]:
    v = F.coalesce(c.try_cast("long"), F.lit(0))
    hour = F.least(F.greatest(F.floor(v / 100), F.lit(0)), F.lit(23))
    minute = F.least(F.greatest(F.pmod(v, F.lit(100)), F.lit(0)), F.lit(59))
    return hour.cast("int"), minute.cast("int")


def cyclic(c: Column, period: float, fill_null: bool = True) -> tuple[Column, Column]:
    v = F.coalesce(c.cast("double"), F.lit(0.0)) if fill_null else c.cast("double")
    angle = v * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(safe_double(lat1)), F.radians(safe_double(lat2))
    half_lat = F.radians(safe_double(lat2) - safe_double(lat1)) / 2
    half_lon = F.radians(safe_double(lon2) - safe_double(lon1)) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def binary_flag(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.cast("string").isin(*values), F.lit(False)).cast("int")


def ratio(n: Column, d: Column) -> Column:
    """n / d with a zero denominator read as 1."""
    return n / F.when(d == 0, F.lit(1)).otherwise(d)


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n, d))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def calibrate(score: Column) -> Column:
    s = clamp(F.coalesce(score.try_cast("double"), F.lit(0.0)), 0.0, 1.0)
    return F.round(clamp(F.lit(0.80) + s * 0.05, 0.80, 0.85), 4)


def format_usd(x: Column) -> Column:
    a = F.abs(x)

    def shown(scale: float, digits: int, unit: str) -> Column:
        # The sign follows the dollar mark: $-5.00 USD.
        return F.concat(F.lit("$"), F.format_number(x / F.lit(scale), digits), F.lit(f"{unit} USD"))

    return (
        F.when(a >= 1e9, shown(1e9, 1, "B"))
        .when(a >= 1e6, shown(1e6, 1, "M"))
        .when(a >= 1e4, shown(1e3, 0, "k"))
        .otherwise(shown(1.0, 2, ""))
    )


# ---- dates -----------------------------------------------------------------------------------------

# Text date forms tried in this order.
DATETIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
]


def parse_datetime(c: Column) -> Column:
    s = c.cast("string")
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in DATETIME_FORMATS]
    return F.coalesce(*tries, s.try_cast("timestamp"))


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 with fractions, for zoned and zoneless timestamps (sessions run in UTC)."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def iso_weekday(c: Column) -> Column:
    """Monday 1 … Sunday 7."""
    return F.weekday(c) + 1


def date_parts(name: str) -> dict[str, Column]:
    c = F.col(name)
    month, hour = F.month(c), F.hour(c)
    return {
        f"{name}_year": F.year(c),
        f"{name}_month": month,
        f"{name}_day": F.dayofmonth(c),
        f"{name}_weekday": iso_weekday(c),
        f"{name}_hour": hour,
        f"{name}_is_weekend": (iso_weekday(c) >= 6).cast("int"),
        f"{name}_is_winter": month.isin(12, 1, 2).cast("int"),
        f"{name}_is_summer": month.isin(6, 7, 8).cast("int"),
        f"{name}_time_of_day": F.when(c.isNull(), F.lit(3)).otherwise(F.floor(hour / 6)).cast("int"),
    }


def date_dim(c: Column) -> dict[str, Column]:
    return {
        "date_month": F.month(c),
        "date_day_of_week": iso_weekday(c),
        "is_weekend": iso_weekday(c).isin(6, 7).cast("int"),
    }


# ---- domain flags ------------------------------------------------------------------------------------

# Airports scored as hubs.
HUB_AIRPORTS = ["ATL", "DFW", "DEN", "ORD", "LAX", "CLT", "LAS", "PHX", "MCO", "SEA"]


def delay_flags(c: Column) -> dict[str, Column]:
    return {
        "is_delayed": (c > 0).cast("int"),
        "is_late_15": (c > 15).cast("int"),
        "is_late_60": (c > 60).cast("int"),
    }


def hub_flag(c: Column, hubs: Sequence[str] = tuple(HUB_AIRPORTS)) -> Column:
    return c.isin(*hubs).cast("int")


def route(origin: Column, dest: Column) -> Column:
    """origin_dest; null when either end is null."""
    return F.concat(origin, F.lit("_"), dest)


def word_set_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))
