"""One-permutation MinHash of word shingles, densified and packed, with built-in functions alone.

Every shingle is hashed once. The top bits of the hash choose a bin and the bin keeps its smallest hash: after sorting
the hashes, that is the first of each bin's run. An empty bin copies the bin that a sequence of hashes of (bin, attempt)
meets first, so it draws from the non-empty ones alike. Of every bin the low-order byte is stored, eight to a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import fresh, whole
from harborline.session import materialize

BINS = 128
BIN_BITS = 7
WORDS = 5
# Attempts to densify by hashing; with one full bin of 128, 1 in 10**7 empty ones is left for the fallback.
ATTEMPTS = 2048


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Sorted hashes of all word shingles; a shorter text is one shingle, one without words none."""
    found = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: _shingles(h, words))


def _shingles(h: Column, words: int) -> Column:
    n = F.size(h)
    # Neighbours side by side: every entry names itself and the words after it.
    pieces = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
    return F.sort_array(F.when(n >= words, pieces).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>")))


def _bin(h: Column) -> Column:
    # Sorted as signed numbers, so the bins come in one run each.
    return F.shiftright(h, 64 - BIN_BITS) + BINS // 2


def packed(hashes: Column) -> Column:
    """array<long> of the bins' low bytes; empty where there is no shingle. `hashes` is sorted."""
    none = F.array().cast("array<long>")
    return let(hashes, lambda h: F.when(F.size(h) > 0, let(_heads(h), _filled)).otherwise(none))


def _heads(hashes: Column) -> Column:
    """The smallest hash of every bin that has one: the first of its run."""
    high = 64 - BIN_BITS
    return F.filter(hashes, lambda h, i: (i == 0) | (F.shiftright(h, high) != F.shiftright(F.get(hashes, i - 1), high)))


def _filled(heads: Column) -> Column:
    """All bins in order, the empty ones filled, packed."""
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))
    place = lambda present: F.transform(numbers, lambda b: F.get(heads, F.array_position(present, b.cast("long")).cast("int") - 1))
    spread = let(F.transform(heads, _bin), place)
    full = let(spread, lambda s: F.transform(s, lambda v, b: F.coalesce(v, _borrowed(s, b))))
    return let(F.transform(full, lambda v: v.bitwiseAND(F.lit(255))), _pack)


def _borrowed(s: Column, b: Column) -> Column:
    probe = lambda a: F.get(s, F.pmod(F.xxhash64(b, a), F.lit(BINS)).cast("int"))
    tries = F.sequence(F.lit(1), F.lit(16))
    early = F.get(F.filter(F.transform(tries, probe), lambda v: v.isNotNull()), F.lit(0))
    late = F.get(F.filter(F.transform(F.sequence(F.lit(17), F.lit(ATTEMPTS)), probe), lambda v: v.isNotNull()), F.lit(0))
    # The last resort walks on from the bin itself, so every bin is filled.
    walk = F.get(F.filter(F.concat(F.slice(s, b + 1, F.lit(BINS)), s), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(early, late, walk)


def _pack(low: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda j: _word(low, j))


def _word(low: Column, j: Column) -> Column:
    out = F.get(low, j * 8)
    for k in range(1, 8):
        out = F.shiftleft(out, 8).bitwiseOR(F.get(low, j * 8 + k))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 where one has no shingle and 1 where neither has.

    Bytes agree by chance once in 256, which is taken off.
    """
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 4))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    match = 1 - off / F.lit(float(BINS))
    chance = 1 / 256
    fair = F.greatest(F.lit(0.0), (match - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(fair)


def fingerprint_text(p: Column) -> Column:
    """Hexadecimal, 16 digits a long; empty for a text without words."""
    return F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the packed fingerprint (array<long>) of every text; replaces a column of that name. Null text: empty array."""
    return df.withColumn(out, packed(shingle_hashes(whole(text_col))))


def with_next(df: DataFrame, id_col: str, columns: list[str], buckets: int | None = None, tie_by: str | None = None) -> DataFrame:
    """Add `next_<column>` of the row that follows by descending id; the last row's is the first.

    Rows are dealt to id ranges of like size, whose ends come from a sketch over all ids. Every range also gets the
    first row of the range behind it, so each is worked on alone and no task sees more than its own part. Equal ids
    follow each other by a hash of `tie_by` (else of all `columns`); null ids come last.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket, homes, copy, tie = fresh(df, "bucket", "homes", "copy", "tie")
    ends = sorted(set(df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 100 * n)).first()[0] or [])) if n > 1 else []
    least = F.lit(-(2**63))
    ident = F.coalesce(F.col(id_col).cast("long"), least)
    keyed = df.withColumn(tie, F.xxhash64(*([tie_by] if tie_by else columns))).withColumn(bucket, F.lit(len(ends)) - _ends_below(ident, ends))
    # The first row of every range: one small row per range.
    heads = {r[0]: (r[1], r[2]) for r in keyed.groupBy(bucket).agg(F.max(F.struct(ident.alias("i"), F.col(tie).alias("t"))).alias("m")).select(bucket, "m.i", "m.t").collect()}
    if not heads:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns})
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    look = lambda values: F.element_at(F.create_map(*[F.lit(x) for b in order for x in (b, values[b])]), F.col(bucket))
    is_head = (ident == look({b: h[0] for b, h in heads.items()})) & (F.col(tie) == look({b: h[1] for b, h in heads.items()}))
    home = lambda b, c: F.struct(b.alias("b"), F.lit(c).alias("c"))
    own = home(F.col(bucket), 0)
    dealt = (
        keyed.withColumn(homes, F.explode(F.when(is_head, F.array(own, home(look(before), 1))).otherwise(F.array(own))))
        .withColumns({bucket: F.col(f"{homes}.b"), copy: F.col(f"{homes}.c")})
        .drop(homes)
    )
    w = Window.partitionBy(bucket).orderBy(copy, ident.desc(), F.col(tie).desc())
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return out.filter(F.col(copy) == 0).drop(bucket, copy, tie)


def _ends_below(ident: Column, ends: list[int]) -> Column:
    """How many of the sorted `ends` are smaller, by bisection."""
    if not ends:
        return F.lit(0)
    sorted_ends = F.array(*[F.lit(e).cast("long") for e in ends])

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        less = open_ & (F.get(sorted_ends, mid) < ident)
        return F.struct(F.when(less, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1)), start, halve, lambda acc: acc["lo"])
