"""Best-fit packing of token sequences, planned on lengths and carried out by rank.

Only how often each length occurs decides the plan, and there are no more lengths than tokens in a sequence. Pieces
above a third of the capacity are matched greedily, two to a sequence at most, the longest with the longest that still
fits; shorter ones, longest first, go to the smallest gap that holds them. The plan is a list of recipes, each with
the number of sequences built after it, so its size is bounded by the capacity and not by the corpus. Pieces are ranked
within their length by a distributed sort, and the rank says which sequence and place is theirs.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import text_slices, whole
from harborline.llm.tokens import Memory, tokenizer_path
from harborline.operators.ordering import POS, positions
from harborline.session import materialize

CAPACITY = 4096
# Fixed value: the id that ends every document.
END_ID = 1


class LibraryCodec:
    """The installed library's encoder with a bounded memory of words, one per worker and vocabulary file."""

    _open: dict[str, "LibraryCodec"] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.tok, self.model = tok, tok.model
        # White space parts words for this vocabulary, so texts between white spaces are encoded one by one.
        self.memory = Memory(self._encode)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Plain ASCII words need no normalizing and no cutting: the library's model takes them as they are."""
        out: list = [[t.id for t in self.model.tokenize(x.lower())] if x.isascii() and x.isalpha() else None for x in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.tok.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    @classmethod
    def of(cls, path: str) -> "LibraryCodec":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, crc of the ids and, if asked for, the ids."""
    fields = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = LibraryCodec.of(path).memory
        for b in batches:
            for row, end, data, offsets in text_slices(b.column("text")):
                ids, at = memory.ids(data, offsets)
                rows, piece, start, length, crc, parts = [], [], [], [], [], []
                for i in range(end - row):
                    own = np.append(ids[at[i] : at[i + 1]], END_ID).astype("<u4")
                    for p, lo in enumerate(range(0, len(own), capacity)):
                        part = own[lo : lo + capacity]
                        rows.append(row + i)
                        piece.append(p)
                        start.append(lo)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                cols = [b.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(parts, pa.list_(pa.int32()))] if with_ids else [])], fields)

    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = dict(base.dtypes)["id"]
    return base.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Recipes as (number of sequences, ((length, how many), ...)) that use up the counts exactly."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []

    def add(gap: int, number: int, content: tuple) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((number, content))

    while large:
        n = large[-1]
        k = bisect.bisect_right(large, min(n, capacity - n)) - 1
        # One left of the only partner length can't be its own partner.
        if k >= 0 and large[k] == n and left[n] < 2:
            k -= 1
        if k < 0:
            add(capacity - n, left.pop(n), ((n, 1),))
            large.pop()
            continue
        m = large[k]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        add(capacity - n - m, pairs, ((n, 2),) if m == n else ((n, 1), (m, 1)))
        for x in (n, m):
            left[x] -= pairs
        for x in {n, m}:
            if not left[x]:
                del left[x]
                large.remove(x)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            k = bisect.bisect_left(order, s)
            if k < len(order):
                gap = order[k]
                number, content = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
            else:
                gap, number, content = capacity, -(-n // (capacity // s)), ()
            each = gap // s
            full = min(number, n // each)
            if full:
                add(gap - each * s, full, (*content, (s, each)))
                number -= full
                n -= full * each
            if number and n:  # fewer are left than one gap holds
                add(gap - n * s, 1, (*content, (s, n)))
                number -= 1
                n = 0
            if number:
                add(gap, number, content)
    return [(number, content) for groups in gaps.values() for number, content in groups]


def _table(recipes) -> tuple[np.ndarray, ...]:
    """Per (length, first rank): first sequence, pieces a sequence, first offset. Sorted, for searching."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for number, content in recipes:
        offset = 0
        for length, times in content:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            used[length] = rank + number * times
            offset += length * times
        sequence += number
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with `length` from 1 to `capacity`. Sequences have no gaps between pieces.

    Pieces of like length change places freely, so ties are settled by the other columns and, for rows alike in all of
    them, by where the sort left them.
    """
    written = materialize(pieces)
    counts = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    if not counts:
        return written.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = _table(plan(counts, capacity))
    begin = np.zeros(capacity + 2, np.int64)
    for n, c in counts.items():
        begin[n + 1] = c
    begin = np.cumsum(begin)
    shared = written.sparkSession.sparkContext.broadcast((table, begin))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (length, rank, sequence, times, offset), first = shared.value
        keys = length * (1 << 40) + rank
        for b in batches:
            own = b.column("length").to_numpy()
            r = b.column(POS).to_numpy() - first[own]
            k = np.searchsorted(keys, own * (1 << 40) + r, side="right") - 1
            turn, slot = np.divmod(r - rank[k], times[k])
            cols = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[k] + turn), pa.array(offset[k] + slot * own)], [*names, "sequence_id", "offset"])

    names = written.columns
    tie = [c for c in ("id", "piece", "start", "ids_crc32") if c in names]
    ranked = positions(written, ["length", *tie], table_rows=0)
    schema = ", ".join(f"`{c}` {t}" for c, t in written.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, POS).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with the sequence and offset they go to, and their ids if asked for.

    A document is its ids and END_ID; only one longer than `capacity` is cut, into full pieces and a rest. Null or
    empty text: END_ID alone. Ids may be null or repeat; every row gives pieces of its own. Empty table: no rows.
    """
    return pack(token_pieces(docs, id_col, text_col, capacity, path or tokenizer_path(), with_ids), capacity)
