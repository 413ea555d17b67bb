"""Byte-pair encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that stands inside no vocabulary entry can never end up inside one token, so a
cut between the two is certain. Each word of the text is cut at such pairs, every fragment is merged on its own,
and the fragments' ids are concatenated. The new words of a batch of texts are cut and merged together: fragments are
rows of a matrix, and each step merges every row's pair of lowest rank. A long fragment has a heap of its pairs
instead, so a word without an end costs n log n. Each worker remembers short words, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import session, table, utf8

#: Words whose ids a worker remembers, and the longest of them in characters.
REMEMBERED, SHORT = 500_000, 64
#: Widths of the matrices of fragments (a longer one is merged by a heap); characters of text that are taken together.
WIDTHS, TOGETHER = (1, 6, 8, 10, 12, 16, 24, 32), 1 << 21
#: White space of Unicode, which the pattern drops (Python's own class has four control characters more).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Letters all, and the only ones of these texts outside ASCII that the fast pattern knows.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


@lru_cache(1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _ranges(category: str) -> str:
    """A regular expression's class of all characters of a Unicode category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == category
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Ranks:
    """Rank and result of each merge by its two ids: a table of keys, probed by steps of one."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.none = len(merges)
        self.results = [m[2] for m in merges]
        self.result = np.array([*self.results, 0], np.int32)
        self.bits = max(8, (4 * len(merges)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, self.none, np.int32)
        self.of: dict[tuple[int, int], int] = {}
        for i, (x, y, _) in enumerate(merges):
            self.of[x, y] = i
            at = (((x << 32 | y) * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> 64 - self.bits
            while self.key[at] not in (-1, x << 32 | y):
                at = at + 1 & len(self.key) - 1
            self.key[at], self.rank[at] = x << 32 | y, i

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of every pair; `none` where it is no merge (as where an id is negative)."""
        key = x.astype(np.int64) << 32 | y
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), self.none, np.int32)
        open_ = np.flatnonzero((x >= 0) & (y >= 0))
        while len(open_):
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = at[open_] + 1 & len(self.key) - 1
        return out


class ForcedBoundaryBpe:
    """A tokenizer file's byte-level BPE with word ends (null decoder: tokens are joined by spaces)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.dtype = np.dtype("<u2" if max(self.tokens) < 1 << 16 else "<u4")
        find = lambda letter, number: re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall
        self.words_of = find(_ranges("L"), _ranges("N"))
        #: the same words, found faster where all letters are Latin
        self.latin = re.compile(f"[\x00-\x7f{LATIN}]*").fullmatch
        self.latin_words_of = find(f"a-z{LATIN}", "0-9")
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        # a symbol is a byte, or 256 and more a byte that ends a word; ids of symbols, and of merges' parts and results
        chars = byte_chars()
        number = {c: i for i, c in enumerate(chars)} | {c + self.end: 256 + i for i, c in enumerate(chars) if self.end}
        part = {t: len(self.ids) + i for i, t in enumerate(number)}
        part |= self.ids
        self.known = len(self.ids) and max(self.ids.values()) + 1
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        for x, y in pairs:
            for t in (x, y, x + y):
                part.setdefault(t, len(part))
        # parts that are no entry of the vocabulary have numbers above it, and give no id
        above = max(part.values()) + 1
        number_of = {t: i if t in self.ids else above + i for t, i in part.items()}
        self.ranks = Ranks([(number_of[x], number_of[y], number_of[x + y]) for x, y in pairs])
        self.symbol_id = np.full(512, -1, np.int64)
        for t, i in number.items():
            self.symbol_id[i] = number_of[t]
        #: pairs of symbols that do stand inside some entry
        self.inside = np.zeros((512, 512), bool)
        for t in self.ids:
            for x, y in pairwise(self._symbols(t)):
                if x in number and y in number:
                    self.inside[number[x], number[y]] = True
        self.memo: dict[str, bytes] = {}

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            core = token[: -len(self.end)]
            return [*core[:-1], core[-1] + self.end]
        return list(token)

    def _merged_rows(self, rows: np.ndarray) -> np.ndarray:
        """Rows of symbol ids (-1: none), each merged again and again at its leftmost pair of lowest rank."""
        none, width = self.ranks.none, rows.shape[1]
        out, live = rows.copy(), np.arange(len(rows))
        rank = self.ranks(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        at = np.arange(width)
        while len(live):
            j = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), j]
            if (low == none).any():
                go = low != none
                out[live[~go]] = rows[~go]
                rows, rank, live, j, low = rows[go], rank[go], live[go], j[go], low[go]
                if not len(live):
                    break
            n = np.arange(len(live))
            rows[n, j] = self.ranks.result[low]
            shifted = np.c_[rows[:, 1:], np.full(len(live), -1)]
            rows = np.where(at > j[:, None], shifted, rows)
            moved = np.c_[rank[:, 1:], np.full(len(live), none)]
            rank = np.where(at[:-1] > j[:, None], moved, rank)
            rank[n, np.minimum(j, width - 2)] = np.where(j < width - 1, self.ranks(rows[n, j], rows[n, np.minimum(j + 1, width - 1)]), none)
            some = np.flatnonzero(j > 0)
            rank[some, j[some] - 1] = self.ranks(rows[some, j[some] - 1], rows[some, j[some]])
        return out

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """One fragment's ids, by a heap of its pairs: (rank, place), pairs that are gone left in it."""
        of, result, n = self.ranks.of, self.ranks.results, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, p in enumerate(pairwise(symbols)) if (r := of.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = (x := heapq.heappop(heap)) >> 32, x & 0xFFFFFFFF
            k = after[i]
            if symbols[i] < 0 or k >= n or of.get((symbols[i], symbols[k])) != r:
                continue
            symbols[i], symbols[k] = result[r], -1
            after[i] = m = after[k]
            if m < n:
                before[m] = i
                if (q := of.get((symbols[i], symbols[m]))) is not None:
                    heapq.heappush(heap, q << 32 | i)
            if (b := before[i]) >= 0 and (q := of.get((symbols[b], symbols[i]))) is not None:
                heapq.heappush(heap, q << 32 | b)
        return [s for s in symbols if s >= 0]

    def _fragments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words in a row; where fragments start (certain cuts and words' starts); words' ends."""
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(x) for x in raw])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        if self.end:
            symbols[ends - 1] += 256
        first = np.ones(len(symbols), bool)
        first[1:] = ~self.inside[symbols[:-1], symbols[1:]]
        first[ends[:-1]] = True
        return symbols, np.flatnonzero(first), ends

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of every word, none of which is empty."""
        if not words:
            return []
        symbols, start, ends = self._fragments(words)
        ids = self.symbol_id[symbols]
        size = np.diff(np.r_[start, len(ids)])
        ids = np.r_[ids, -1]
        for least, width in pairwise(WIDTHS):
            own = np.flatnonzero((size > least) & (size <= width))
            if len(own):
                at = np.arange(width)
                # places beyond a fragment's end point to the last one, which is -1
                place = np.where(at < size[own, None], start[own, None] + at, len(ids) - 1)
                ids[place] = self._merged_rows(ids[place])
        for a, n in zip(start[size > WIDTHS[-1]].tolist(), size[size > WIDTHS[-1]].tolist()):
            got = self._merged_long(ids[a : a + n].tolist())
            ids[a : a + n] = got + [-1] * (n - len(got))
        ids = ids[:-1]
        kept = (ids >= 0) & (ids < self.known)
        till = np.cumsum(kept)[ends - 1] * self.dtype.itemsize
        out = ids[kept].astype(self.dtype).tobytes()
        return [out[a:z] for a, z in zip([0, *till[:-1].tolist()], till.tolist())]

    def _words_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (self.latin_words_of if self.latin(text) else self.words_of)(text)

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list's words; new words of all lists are merged together."""
        memo = self.memo
        distinct = set().union(*lists)
        if len(memo) + len(distinct) > REMEMBERED:
            memo.clear()
        new = [w for w in distinct if w not in memo]
        memo.update(zip(new, self.words(new)))
        out = [b"".join(map(memo.__getitem__, x)) for x in lists]
        for w in new:
            if len(w) > SHORT:
                del memo[w]
        return out

    def encode_many(self, texts: list[str]):
        """Each text's ids as an array. Strings of special tokens in a text are those tokens."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]):
        lists, plan = [], []
        for text in texts:
            special = self.split_special is not None and any(map(text.__contains__, self.special))
            own = []
            for part in self.split_special(text) if special else (text,):
                if special and part in self.special:
                    own.append(np.array([self.special[part]], self.dtype).tobytes())
                else:
                    own.append(len(lists))
                    lists.append(self._words_of(part))
            plan.append(own)
        got = self._ids(lists)
        for own in plan:
            yield np.frombuffer(b"".join(got[x] if isinstance(x, int) else x for x in own), self.dtype)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `ids` array<int>: each whole text's tokens. Null text: no ids. Other columns stay."""
    session(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([x.astype(np.int32) for x in tokenizer(path).encode_many(texts.tolist())], index=texts.index, dtype=object)

    return docs.withColumn("ids", ids(F.coalesce(F.col(text), F.lit(""))))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`: the tokens' strings joined by spaces, specials included. Null ids: empty."""
    session(encoded.sparkSession)

    @F.pandas_udf("string")
    def decoded(lists):
        own = tokenizer(path)
        return lists.map(lambda x: own.decode(x.tolist()))

    return encoded.withColumn("decoded", decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoding, then decoding of the ids, without
    carrying ids between the two. Repeated rows and null keys give a row each."""
    session(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        own = tokenizer(path)
        named = [str(i) for i in range(max(own.tokens) + 1)]
        for b in batches:
            n, a, d = [], [], []
            for ids in map(np.ndarray.tolist, own.encode_many([raw.decode("utf-8") for raw in b.column("text").to_pylist()])):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(named.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield table(schema, b.column("doc_id"), n, a, d)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
