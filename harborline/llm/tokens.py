"""Byte-pair encoding by longest matches with backtracking, and decoding from an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token at every place of a word. Tokens are taken
greedily; two neighbours are right if undoing their merges, latest first, never shows a pair across their border that
would have merged earlier. Else the next shorter token is tried, and with none left the last token is taken back; places
that proved dead are marked, so each is met once and the work is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import hash_words, split_words, text_slices, whole

# Pieces that a worker remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
# What the vocabulary file's own description calls white space and pieces of a word.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{SPACE}\\p{{L}}\\p{{N}}]+"
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Encoder:
    """Exact merges of a vocabulary file with word ends."""

    _LAST = 0x1000  # a word's last letter is a symbol of its own

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.piece = regex.compile(PIECE)
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        # Ranks: single letters first, then merges in their order.
        self.rank = {t: 0 for t in vocab}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        order = {i: 0 for i in vocab.values()}
        for r, pair in enumerate(merges, 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[a + b]
            self.halves[token], self.joins[(vocab[a], vocab[b])], order[token] = (vocab[a], vocab[b]), token, r
        self.order = order
        letters = byte_letters()
        self.inner = {b: letters[b] for b in range(256)}
        self.final = {b: chr(ord(letters[b]) + self._LAST) for b in range(256)}
        by_symbols = {self._symbols(t): i for t, i in vocab.items()}
        self.size = {i: len(s) for s, i in by_symbols.items()}
        self.shorter = {}
        for s, i in by_symbols.items():
            self.shorter[i] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), None)
        self.automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self._fit: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: str) -> str:
        if not token.endswith(END):
            return token
        body = token[: -len(END)]
        return body[:-1] + chr(ord(body[-1]) + self._LAST)

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side."""
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) > 1_000_000:
                self._fit.clear()
            known = self._fit[(a, b)] = self._stand(a, b)
        return known

    def _stand(self, a: int, b: int) -> bool:
        before = len(self.order) + 1  # a pair across the border would have had to merge earlier than this
        order = self.order
        while True:
            m = self.joins.get((a, b))
            if m is not None and order[m] < before:
                return False
            if order[a] == 0 and order[b] == 0:
                return True
            if order[a] > order[b]:
                before, a = order[a], self.halves[a][1]
            else:
                # Of equal merges the left one goes first, so the border may win a tie here.
                before, b = order[b] + 1, self.halves[b][0]

    def word(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        s = "".join([self.inner[c] for c in data[:-1]]) + self.final[data[-1]]
        n = len(s)
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, (size, token) in self.automaton.iter(s):
            at = end - size + 1
            if size > reach[at]:
                reach[at], longest[at] = size, token
        alive, out, at, token = [True] * (n + 1), [], 0, longest[0]
        while True:
            end = at + self.size[token]
            if alive[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            if self.shorter[token] is not None:
                token = self.shorter[token]
                continue
            # Nothing begins here: this place is dead, the last token must be shorter.
            alive[at] = False
            token = out.pop()
            at -= self.size[token]

    def chunk(self, text: str) -> list[int]:
        """Ids of a text between two white spaces."""
        if "<" in text and self.added_at.search(text):
            out = []
            for part in self.added_at.split(text):
                out += [self.added[part]] if part in self.added else self.chunk(part) if part else []
            return out
        if not text.isascii():
            # Lower case letter by letter, as no letter looks at its neighbours here.
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        else:
            text = text.lower()
        return [i for p in self.piece.findall(text) for i in self.word(p.encode())]

    def chunks(self, texts: list[str]) -> list[list[int]]:
        return [self.chunk(t) for t in texts]


def _cut_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        # An apostrophe may belong to the letters after it, and these three make up special tokens.
        out[b] = 1 if c.isalpha() else 2 if c.isdigit() else 0 if c in "'<|>" else 3
    return out


_CUT = _cut_classes()


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as split_words gives them, also cut between ASCII letters, digits and signs, where the vocabulary cuts anyway."""
    starts, ends, bounds = split_words(data, offsets)
    kind = _CUT[data]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    # A cut at a document's border is a word's border already.
    cut = cut[~np.isin(cut, offsets)] if len(cut) else cut
    at = np.searchsorted(starts, cut)
    return np.insert(starts, at, cut), np.insert(ends, at - 1, cut), bounds + np.searchsorted(cut, offsets)


# A-Z to lower case, and the bytes in whose company case may matter: special tokens begin with '<', and letters beyond
# ASCII are composed before they are lowered.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TELLS_CASE = np.zeros(256, bool)
_TELLS_CASE[[ord("<"), *range(128, 256)]] = True


def fold_plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lowered, but not in pieces that hold '<' or anything beyond ASCII."""
    folded = _LOWER[data]
    odd = np.unique(np.searchsorted(starts, np.flatnonzero(_TELLS_CASE[data]), side="right") - 1)
    sizes = ends[odd] - starts[odd]
    at = np.repeat(starts[odd] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    folded[at] = data[at]
    return folded


class Memory:
    """Ids of the pieces met so far, by the pieces' hashes; bounded, and kept in flat arrays as each worker has its own."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bound: int = REMEMBERED):
        self.encode, self.bound = encode, bound
        self.clear()

    def clear(self) -> None:
        # Sorted hashes and the number of each one's piece; the ids of piece k are flat[upto[k] : upto[k + 1]].
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.upto = array("i"), array("q", [0])

    def _numbers(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is or belongs among those kept, and its piece's number, -1 if unknown."""
        at = np.searchsorted(self.hashes, found)
        number = np.full(len(found), -1, np.int32)
        inside = np.flatnonzero(at < len(self.hashes))
        known = inside[self.hashes[at[inside]] == found[inside]]
        number[known] = self.number[at[known]]
        return at, number

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one behind the other, and where each text's ids begin."""
        starts, ends, bounds = split_pieces(data, offsets)
        if len(self.hashes) > self.bound:
            self.clear()
        codes, found = pd.factorize(hash_words(fold_plain(data, starts, ends), starts, ends, lower=False))
        first = np.zeros(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        at, number = self._numbers(found)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = data.tobytes()
            words = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new].tolist()]
            number[new] = np.arange(len(new)) + (len(self.upto) - 1)
            for ids in self.encode(words):
                self.flat.extend(ids)
                self.upto.append(len(self.flat))
            new = new[np.argsort(found[new])]
            self.hashes, self.number = np.insert(self.hashes, at[new], found[new]), np.insert(self.number, at[new], number[new])
        where = number[codes] if len(codes) else np.zeros(0, np.int32)
        # Views, which are gone before the arrays grow again.
        flat, ends_at = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32), np.frombuffer(self.upto, np.int64)
        begin = ends_at[where]
        sizes = ends_at[where + 1] - begin
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1])]
        return out, upto[bounds]


class OffsetTable:
    """The bytes of every id in one buffer, with the offsets to cut them out."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        if len(ids) == 0:
            return b""
        return self.bytes[np.repeat(self.begin[ids] - (upto - sizes), sizes) + np.arange(upto[-1])].tobytes()


class Codec:
    """An encoder with its memory and its decoding tables, one per worker and vocabulary file."""

    _open: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.memory = Memory(self.encoder.chunks)
        most = max(self.encoder.text_of) + 1
        texts = [self.encoder.text_of.get(i, "") for i in range(most)]
        # The library joins undecoded tokens with spaces.
        self.text = OffsetTable([f"{t} ".encode() for t in texts])
        self.decimal = OffsetTable([f"{i} ".encode() for i in range(most)])

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.text.join(ids)[:-1]

    def decimals(self, ids: np.ndarray) -> bytes:
        return self.decimal.join(ids)[:-1]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """`id` and `ids` (array<int>) of every row. Null or empty text: no ids. Rows are taken one by one, so ids may be null or repeat."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            for row, end, data, offsets in text_slices(b.column("text")):
                ids, at = codec.memory.ids(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(row, end - row), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`id` and `text` of rows with `ids`; no ids: empty text, null ids: null."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            texts = [codec.decode(x.values.to_numpy()).decode() if x.is_valid else None for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {dict(encoded.dtypes)['id']}, text string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """`id`, `n_tokens` and sha256 of the decimal ids and of the decoded text, in one pass over every whole text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            sizes, of_ids, of_text = [], [], []
            for _, _, data, offsets in text_slices(b.column("text")):
                ids, at = codec.memory.ids(data, offsets)
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    sizes.append(hi - lo)
                    of_ids.append(hashlib.sha256(codec.decimals(ids[lo:hi])).hexdigest())
                    of_text.append(hashlib.sha256(codec.decode(ids[lo:hi])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
