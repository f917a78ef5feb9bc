"""Word sequences that occur twice anywhere are cut out of every document that has them.

Recompression names: in each round every symbol falls by its hash into one of two classes, and a symbol of the first
class followed by one of the second becomes one new symbol. The name of the new symbol is a hash of its two parts, so
all tasks name alike and equal substrings get equal interior symbols, wherever they stand; only what lies within
2**rounds - 1 words of an end can differ. Equal symbols never pair, so a run of one word is named the same from every
place in it. Of every window the symbol with the least hash among those safely inside is its anchor. Anchors named by
the words around them are counted over the corpus; only windows whose anchor occurs twice are then counted themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import fresh, hash_words, key128, mix, rolling, split_words, text_slices, whole
from harborline.session import materialize

WINDOW = 35
ROUNDS = 2


def compress(symbols: np.ndarray, at: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their first words after so many rounds; `first` marks words that begin a document."""
    for r in range(rounds):
        left = (mix(symbols + np.uint64(r + 1)) & np.uint64(1)) == 0
        pair = left[:-1] & ~left[1:] & ~first[at[1:]]
        named = symbols.copy()
        named[:-1][pair] = mix(symbols[:-1][pair] * np.uint64(3) + mix(symbols[1:][pair]))
        stay = np.ones(len(symbols), bool)
        stay[1:] = ~pair
        symbols, at = named[stay], at[stay]
    return symbols, at


def anchors(h: np.ndarray, bounds: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For every full window its first word and the first word of its anchor. `bounds`: where documents begin and end."""
    loss, longest = (1 << rounds) - 1, 1 << rounds
    width = window - 2 * loss - longest + 1
    if width < longest:
        raise ValueError("the window is too short for so many rounds")
    n = len(h)
    counts = np.diff(bounds)
    windows = np.maximum(counts - window + 1, 0)
    starts = np.repeat(bounds[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    if len(starts) == 0:
        return starts, starts
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    symbols, at = compress(h, np.arange(n), first, rounds)
    bits = np.uint64(max(1, n.bit_length()))
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    least[at] = ((mix(symbols + np.uint64(99)) >> (bits + np.uint64(1))) << bits) | at.astype(np.uint64)
    # Minimum over `width` words from each word on, by doubling.
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        least[:-step] = np.minimum(least[:-step], least[step:])
        reach += step
    return starts, (least[starts + loss] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _first_words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = split_words(data, offsets)
    return starts, ends, bounds, hash_words(data, starts, ends, lower=False)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """sha256 of the words joined by single spaces."""
    if len(starts) == 0:
        return hashlib.sha256(b"").hexdigest()
    sizes = ends - starts + 1
    total = int(sizes.sum())
    out_at = np.cumsum(sizes) - sizes
    index = np.repeat(starts - out_at, sizes) + np.arange(total)
    text = data[np.minimum(index, len(data) - 1)]
    text[out_at + sizes - 1] = 32
    return hashlib.sha256(text[:-1].tobytes()).hexdigest()


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _scan(window: int, rounds: int):
    loss, longest = (1 << rounds) - 1, 1 << rounds
    around = 2 * loss + longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys = b.column("ka").to_numpy()
            n_words, shas, sizes, names, places = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, _, data, offsets in text_slices(b.column("text")):
                starts, ends, bounds, h = _first_words(data, offsets)
                at, anchor = anchors(h, bounds, window, rounds)
                picked = np.unique(anchor)
                named = rolling(h, around)[picked - loss] if len(picked) else np.zeros(0, np.uint64)
                cuts = np.searchsorted(picked, bounds)
                for i in range(len(bounds) - 1):
                    lo, hi = bounds[i], bounds[i + 1]
                    n_words.append(hi - lo)
                    shas.append(_joined(data, starts[lo:hi], ends[lo:hi]))
                    # Equal texts name their anchors once a task.
                    key = keys[row + i]
                    new = key not in seen
                    seen.add(key)
                    sizes.append(cuts[i + 1] - cuts[i] if new else 0)
                    if new:
                        names.append(named[cuts[i] : cuts[i + 1]])
                        places.append(picked[cuts[i] : cuts[i + 1]] - lo)
            ends_ = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("ka"), b.column("kb"), pa.array(np.array(n_words, np.int64)), pa.array(shas, pa.string()),
                 pa.ListArray.from_arrays(ends_, _long(np.concatenate(names))), pa.ListArray.from_arrays(ends_, pa.array(np.concatenate(places).astype(np.int32)))],
                ["id", "ka", "kb", "n_words", "sha", "names", "places"],
            )

    return run


def _windows(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, t, copies = b.column("places"), b.column("t").to_numpy(), b.column("copies").to_numpy()
            for row, _, data, offsets in text_slices(b.column("text")):
                _, _, bounds, h = _first_words(data, offsets)
                at, anchor = anchors(h, bounds, window, rounds)
                hashed = rolling(h, window)
                cuts = np.searchsorted(at, bounds)
                for i in range(len(bounds) - 1):
                    own, marks = at[cuts[i] : cuts[i + 1]], anchor[cuts[i] : cuts[i + 1]]
                    if places[row + i].is_valid:
                        own = own[np.isin(marks - bounds[i], places[row + i].values.to_numpy())]
                    if len(own):
                        k = row + i
                        yield pa.RecordBatch.from_arrays(
                            [_long(hashed[own]), pa.array(np.full(len(own), t[k])), pa.array((own - bounds[i]).astype(np.int32)), pa.array(np.full(len(own), copies[k]))],
                            ["w", "t", "at", "copies"],
                        )

    return run


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words that lie in a window beginning at one of `starts`."""
    turn = np.zeros(n + window + 1, np.int64)
    np.add.at(turn, starts, 1)
    np.add.at(turn, starts + window, -1)
    return np.cumsum(turn)[:n] > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column("hits")
            removed, shas, texts = [], [], []
            for row, _, data, offsets in text_slices(b.column("text")):
                starts, ends, bounds = split_words(data, offsets)
                for i in range(len(bounds) - 1):
                    lo, hi = bounds[i], bounds[i + 1]
                    gone = covered(hits[row + i].values.to_numpy().astype(np.int64), hi - lo, window)
                    removed.append(int(gone.sum()))
                    shas.append(_joined(data, starts[lo:hi][~gone], ends[lo:hi][~gone]))
            yield pa.RecordBatch.from_arrays([b.column("ka"), b.column("kb"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["ka", "kb", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: `id`, `n_words`, `n_removed`, `kept_sha256` of the kept words joined by one space.

    Words are parted by ASCII white space. A word goes if a window of `window` words over it also begins anywhere else,
    in the same document or another. Null and empty texts have no words; texts shorter than a window keep theirs. Rows
    that repeat a text count as places of their own, so such texts go whole. Ids may be null or repeat.
    """
    ka, kb = key128(F.col("text"))
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumns({"ka": ka, "kb": kb})
    kind = dict(base.dtypes)["id"]
    scanned = materialize(base.mapInArrow(_scan(window, rounds), f"id {kind}, ka long, kb long, n_words long, sha string, names array<long>, places array<int>"))
    contents = scanned.filter(F.col("n_words") >= window).groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"))
    named = scanned.filter(F.size("names") > 0).select("ka", F.explode(F.arrays_zip("names", "places")).alias("x")).select("ka", F.col("x.names").alias("name"), F.col("x.places").alias("place"))
    # Written, as `again` below, so that the joins are planned on their own and frequent names can be split.
    twice = materialize(named.groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("name"))
    places = named.join(twice, "name", "left_semi").groupBy("ka").agg(F.collect_set("place").alias("places"))
    # Texts that occur several times: every window counts, whatever its anchor.
    wanted = contents.join(places, "ka", "left").filter((F.col("copies") > 1) | F.col("places").isNotNull()).withColumn("places", F.when(F.col("copies") == 1, F.col("places")))
    same = (F.col("x.ka") == F.col("y.ka")) & (F.col("x.kb") == F.col("y.kb")) & F.col("x.id").eqNullSafe(F.col("y.id"))
    # Windows name their text by its number, which the written rows keep: less to shuffle than its two hashes.
    texts = materialize(base.alias("x").join(wanted.alias("y"), same).select("x.ka", "x.kb", "x.text", "y.copies", "y.places", F.monotonically_increasing_id().alias("t")))
    found = texts.select("t", "text", "copies", "places").mapInArrow(_windows(window, rounds), "w long, t long, at int, copies long")
    again = materialize(found.groupBy("w").agg(F.sum("copies").alias("c")).filter("c > 1").select("w"))
    hits = found.join(again, "w", "left_semi").groupBy("t").agg(F.collect_set("at").alias("hits"))
    cut = texts.select("t", "ka", "kb", "text").join(hits, "t").mapInArrow(_cut(window), "ka long, kb long, n_removed long, kept string").dropDuplicates(["ka", "kb"])
    out = scanned.select("id", "ka", "kb", "n_words", "sha").join(cut, ["ka", "kb"], "left")
    return out.select("id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
