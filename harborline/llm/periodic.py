"""Stretches in which a document goes on repeating the same words.

A run of period q and length L agrees with itself, moved by q, over L - q words. Gram lengths k are chosen so that every
run whose period lies in a class (k / 2, k] agrees over at least k words: k is the least overlap that class guarantees,
and no shorter than its periods. So a run holds two equal k-grams exactly q apart, and as k >= q none nearer. It is enough
to pair each k-gram with its next equal one: pairs grow with the text, not with the square of a word's count. A pair is a
seed on the diagonal of its lag; it is extended both ways word by word, and a table per lag keeps the furthest word
covered, so that no stretch is extended twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS = 24
REPEATS = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def first_gram(least: int, repeats: int) -> int:
    """The longest k such that a run of any period up to k agrees with itself over k words or more."""
    overlap = lambda q: max(least - q, (repeats - 1) * q)
    k = 1
    while min(overlap(q) for q in range(1, k + 2)) >= k + 1:
        k += 1
    return k


def _paired(names: np.ndarray, step: int) -> np.ndarray:
    """Names of twin grams: equal numbers for equal (gram, gram `step` later). Numbers are exact, not hashes."""
    both = names[:-step] * np.int64(names.max() + 1) + names[step:]
    return np.unique(both, return_inverse=True)[1]


def _same_ahead(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on whose word differs from the one `lag` later."""
    width, last = 64, len(ids) - lag
    while at < last:
        end = min(last, at + width)
        differ = ids[at:end] != ids[at + lag : end + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, width = end, width * 2
    return last


def _same_behind(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch before `at` in which every word equals the one `lag` later."""
    width = 64
    while at > 0:
        begin = max(0, at - width)
        differ = ids[begin:at] != ids[begin + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, width = begin, width * 2
    return 0


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; `ids` number the words, equal ones alike."""
    n, k, low, runs = len(ids), first_gram(least, repeats), 0, []
    names, width = ids.astype(np.int64), 1
    while n >= least and repeats * (low + 1) <= n and k < n:
        while width < k:
            if len(np.unique(names)) == len(names):
                return sorted(runs)  # no gram occurs twice, and no longer one will
            step = min(width, k - width)
            names, width = _paired(names, step), width + step
        order = np.argsort(names, kind="stable")
        equal = names[order[:-1]] == names[order[1:]]
        if not equal.any():
            break
        seeds, lags = order[:-1][equal], (order[1:] - order[:-1])[equal]
        inside = (lags > low) & (lags <= k)
        seeds, lags = seeds[inside], lags[inside]
        by_lag = np.lexsort((seeds, lags))
        seeds, lags = seeds[by_lag], lags[by_lag]
        cuts = np.flatnonzero(np.diff(lags)) + 1
        covered: dict[int, int] = {}
        for mine, lag in zip(np.split(seeds, cuts), lags[np.r_[0, cuts]] if len(lags) else []):
            lag, nth = int(lag), 0
            while nth < len(mine):
                end = _same_ahead(ids, int(mine[nth]) + k, lag)
                start = _same_behind(ids, int(mine[nth]), lag)
                covered[lag] = end
                if end - start + lag >= max(least, repeats * lag):
                    runs.append((start, end - start + lag, lag))
                nth = int(np.searchsorted(mine, covered[lag]))
        low, k = k, 2 * k
    return sorted(runs)


def _of_text(text: str | None, least: int, repeats: int):
    words = WORD.findall(text or "")
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    runs = find_runs(ids, least, repeats) if len(seen) < len(words) else []
    if not runs:
        return runs, None, " ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    longest = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return runs, longest, " ".join([words[i] for i in kept])


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """All rows and columns of `docs` with `runs`, `longest_run`, `runs_sha256` and `collapsed`.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of at least `least` words and `repeats` periods that no
    neighbouring word carries on; its period is the smallest one. `runs` lists them by start and period, `longest_run` is
    the one of the greatest length / period (exactly compared; ties: smallest start, then period; null without runs).
    `collapsed` holds, joined by single spaces, the words that no run contains after its first period. `runs_sha256` is
    the digest of a line `start,length,period` for each run. `repeats` is 3 or more.

    Null or empty text: no runs, empty `collapsed`. Every row stands for itself, so repeated rows and ids get equal
    answers. Existing columns of the result's names are replaced (the text itself bears another name). Each text is read whole by one task, in memory
    proportional to it and time near proportional.
    """
    if repeats < 3 or least < 1:
        raise ValueError("repeats must be 3 or more, least 1 or more")
    added = ["runs", "longest_run", "runs_sha256", "collapsed"]
    rest = [c for c in docs.columns if c not in added]
    kept = docs.select(*[f"`{c}`" for c in rest])
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_of_text(t, least, repeats) for t in b.column(rest.index(text_col)).to_pylist()]
            digests = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest() for runs, _, _ in found]
            columns = [
                pa.array([[as_row(r) for r in runs] for runs, _, _ in found], pa.list_(run_type)),
                pa.array([as_row(longest) for _, longest, _ in found], run_type),
                pa.array(digests, pa.string()),
                pa.array([text for _, _, text in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*rest, *added])

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(work, f"{schema}, runs array<{RUN}>, longest_run {RUN}, runs_sha256 string, collapsed string")
