"""Ranked lexical search with bit-sliced Bloom signatures.

Documents are dealt, where they lie, into blocks of similar length. A block has a Bloom signature for every document,
stored by slices: for each bit of the signature a bitmap over the block's documents. A term sets its bits once for each
of its levels (found once, twice, 3 to 4 times, 5 to 8, more often), so that the and of a key's slices says which
documents may hold the term so often: never too few, sometimes too many. The slices of an item's keys, weighted by what
a level can add to a score in the block's shortest document, sum up to upper bounds for all its documents. From the
highest bound downward documents are rescored exactly, until no bound reaches the k-th best exact score; that score is
carried on to the task's other blocks.

Items travel to the index in piles of bounded size; the index stays where it is, and a task returns k rows an item.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import Best, best_rows, in_piles, session, table, utf8, written

#: Letters, digits, and every character outside ASCII, in UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents and text bytes that a task gathers before it makes blocks of them; documents of a block at most, and
#: cells (signature bits by documents) at most, but for a document alone.
GATHER_DOCS, GATHER_BYTES, BLOCK_DOCS, CELLS = 16_384, 24 << 20, 4096, 1 << 24
#: A key's bits, bits of a signature for each key of the document with most of them.
BITS, WIDTH = 3, 8
#: Least count of each level, and its largest (the last has none).
FROM, UPTO = np.array([1, 2, 3, 5, 9]), (1, 2, 4, 8, None)
#: Bytes of items that meet the index at a time.
PILE_BYTES = 4 << 20

INDEX = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()),
    ("width", pa.int64()), ("slices", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])
_INDEX = "doc_ids array<long>, lengths binary, words binary, sizes binary, terms binary, counts binary, width long, slices binary, n_docs long, n_terms long"
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def terms_of(raw: bytes) -> list[bytes]:
    return TERM.findall(raw.lower())


def places(hashes: np.ndarray, levels: np.ndarray, width: int) -> np.ndarray:
    """(keys, BITS): the bits of a signature that a term's hash sets at a level."""
    h = (hashes + levels.astype(np.uint64) * _STEP) * _ODD
    h ^= h >> np.uint64(31)
    h *= _STEP
    step = (h >> np.uint64(33)) | np.uint64(1)
    i = np.arange(BITS, dtype=np.uint64)
    return ((h >> np.uint64(7))[:, None] + i * step[:, None]) % np.uint64(width)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _block(docs: list[tuple[int | None, int, Counter]]) -> tuple:
    """A row of the index of (doc_id, terms, their counts)."""
    words = sorted(set().union(*(c for _, _, c in docs)))
    number = {w: i for i, w in enumerate(words)}
    sizes = np.array([len(c) for _, _, c in docs], np.int64)
    terms, counts = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), np.int64)
    at = 0
    for _, _, c in docs:
        own = np.fromiter(map(number.__getitem__, c), np.int64, len(c))
        by = np.argsort(own)
        terms[at : at + len(c)] = own[by]
        counts[at : at + len(c)] = np.fromiter(c.values(), np.int64, len(c))[by]
        at += len(c)
    row, hashes = np.repeat(np.arange(len(docs)), sizes), hashed(words)
    width = int(WIDTH * np.bincount(row, np.searchsorted(FROM, counts, "right")).max())
    bits = np.zeros((width, len(docs)), bool)
    for level, least in enumerate(FROM):
        has = counts >= least
        for p in places(hashes[terms[has]], np.full(int(has.sum()), level), width).T.astype(np.int64):
            bits[p, row[has]] = True
    lengths = np.array([n for _, n, _ in docs], np.int64)
    return ([d for d, _, _ in docs], lengths.tobytes(), b"\n".join(words), sizes.astype(np.uint32).tobytes(), terms.astype(np.uint32).tobytes(),
            counts.astype(np.uint32).tobytes(), width, np.packbits(bits, axis=1).tobytes(), len(docs), int(lengths.sum()))


def _keys_of(counts: Counter) -> int:
    return int(np.searchsorted(FROM, np.fromiter(counts.values(), np.int64, len(counts)), "right").sum())


def blocks_of(docs: list[tuple[int | None, int, Counter]]):
    """Lists of documents of similar length: within twice the shortest's, and within BLOCK_DOCS and CELLS."""
    own, most = [], 0
    for d in sorted(docs, key=lambda d: d[1]):
        keys = _keys_of(d[2])
        if own and (d[1] > 2 * own[0][1] + 16 or len(own) == BLOCK_DOCS or max(most, keys) * WIDTH * (len(own) + 1) > CELLS):
            yield own
            own, most = [], 0
        own.append(d)
        most = max(most, keys)
    if own:
        yield own


def index(docs: DataFrame) -> DataFrame:
    """The index's blocks, written. docs: doc_id, text. Texts without a term are left out; null texts have none."""
    session(docs.sparkSession)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("bytes").to_pylist()):
                found = terms_of(raw)
                if found:
                    held.append((i, len(found), Counter(found)))
                    size += len(raw)
                if size >= GATHER_BYTES or len(held) >= GATHER_DOCS:
                    for own in blocks_of(held):
                        yield table(INDEX, *([x] for x in _block(own)))
                    held, size = [], 0
        for own in blocks_of(held):
            yield table(INDEX, *([x] for x in _block(own)))

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("bytes")).mapInArrow(run, _INDEX))


class Block:
    """A block as its tasks use it."""

    def __init__(self, row: dict):
        ids = row["doc_ids"]
        self.null = np.array([i is None for i in ids])
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.words = row["words"].split(b"\n")
        self.row, self.width = row, row["width"]
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(self.width, -1)
        self._keys = None

    def found(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the block, -1 if it is in no document."""
        at = [bisect_left(self.words, w) for w in words]
        return np.array([i if i < len(self.words) and self.words[i] == w else -1 for i, w in zip(at, words)], np.int64)

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """(levels, terms, bytes): bitmaps of the documents that may hold a term so often."""
        out = np.empty((len(FROM), len(hashes), self.slices.shape[1]), np.uint8)
        for level in range(len(FROM)):
            p = places(hashes, np.full(len(hashes), level), self.width).astype(np.int64)
            out[level] = np.bitwise_and.reduce(self.slices[p], axis=1)
            if level:
                out[level] &= out[level - 1]
        return out

    def counts(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """(rows, terms): how often a document holds a term, exactly."""
        if self._keys is None:
            sizes = np.frombuffer(self.row["sizes"], np.uint32).astype(np.int64)
            own = np.frombuffer(self.row["terms"], np.uint32).astype(np.int64)
            self._keys = np.repeat(np.arange(len(sizes)), sizes) * len(self.words) + own
            self._counts = np.frombuffer(self.row["counts"], np.uint32).astype(np.int64)
        want = rows[:, None] * len(self.words) + terms
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where(self._keys[at] == want, self._counts[at], 0)


def share(tf, m):
    """A term's part of a score, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def search_block(block: Block, items: list[list[tuple[int, int]]], hashes: np.ndarray, numbers: np.ndarray, n: int, total: int, best: list[Best]) -> int:
    """Adds a block's documents to each item's best; how many were rescored. items: each one's terms by their place in
    hashes and numbers (of the block), with weight times repeats."""
    here = np.flatnonzero(numbers >= 0)
    if not len(here):
        return 0
    place = np.full(len(numbers), -1)
    place[here] = np.arange(len(here))
    maps = block.held(hashes[here])
    m = 75 + 25 * block.lengths * n // total
    upto = [1_000_000 if t is None else int(share(t, int(m.min()))) for t in UPTO]
    step = np.diff([0, *upto]).astype(float)
    docs, rescored = len(block.ids), 0
    for item, top in zip(items, best):
        own = [(place[t], w) for t, w in item if place[t] >= 0]
        if not own:
            continue
        at, w = np.array([x for x, _ in own]), np.array([x for _, x in own], np.int64)
        bound = np.zeros(docs)
        for level in range(len(FROM)):
            bits = maps[level][at]
            some = bits.any(axis=1)
            if not some.any():
                break
            bound += (w[some] * step[level]) @ np.unpackbits(bits[some], axis=1, count=docs).astype(np.float32).astype(float)
        bound = np.floor(bound * (1 + 1e-9)) + 1
        may = np.flatnonzero((bound >= top.least) & (bound > 1))
        may, size = may[np.argsort(-bound[may])], 64
        while len(may):
            rows, may = may[:size], may[size:]
            tf = block.counts(rows, numbers[here][at])
            score = (w * share(tf, m[rows][:, None])).sum(axis=1)
            top.add(score, block.ids[rows], block.null[rows])
            rescored += len(rows)
            may, size = may[bound[may] >= top.least], 2 * size
    return rescored


def _document_counts(blocks: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own = row["words"].split(b"\n")
                n = np.bincount(np.frombuffer(row["terms"], np.uint32), minlength=len(own))
                at = [(w, bisect_left(own, w)) for w in words]
                hit = [(w, int(n[i])) for w, i in at if i < len(own) and own[i] == w]
                yield table(schema, [w for w, _ in hit], [c for _, c in hit])

    return {bytes(r.word): r.n for r in blocks.select("words", "terms").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score, ties to the smaller doc_id.

    docs: doc_id, text; items: item_id, text. Null and empty texts have no terms: such documents count nowhere, such
    items have no rows. Rows of one doc_id are different documents; documents of a null doc_id come after others of
    their score. Rows of one item_id are different items with ranks of their own. Other columns are left alone.
    """
    spark = docs.sparkSession
    blocks = index(docs)
    n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(F.monotonically_increasing_id().alias("item"), "item_id", utf8("text").alias("bytes")).withColumn("size", F.octet_length("bytes") + 64)
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    kind = items.schema["item_id"].dataType
    out = None
    for pile in in_piles(asked, "size", PILE_BYTES):
        counted = [(i, Counter(terms_of(raw))) for i, raw in zip(pile.column("item").to_pylist(), pile.column("bytes").to_pylist())]
        words = sorted(set().union(*(c for _, c in counted)))
        df = _document_counts(blocks, words)
        weight = {w: int(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))) for w in df}
        number = {w: i for i, w in enumerate(words)}
        wanted = [(i, [(number[t], weight[t] * c) for t, c in own.items() if t in weight]) for i, own in counted]
        wanted = [(i, own) for i, own in wanted if own]

        def run(batches, words=words, wanted=wanted):
            hashes, own, best = hashed(words), [t for _, t in wanted], [Best(k, 1) for _ in wanted]
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row)
                    search_block(block, own, hashes, block.found(words), n, total, best)
            for (i, _), top in zip(wanted, best):
                yield table(schema, np.full(len(top.ids), i), pa.array(top.ids, pa.int64(), mask=top.null), top.score)

        rows = blocks.select("doc_ids", "lengths", "words", "sizes", "terms", "counts", "width", "slices").mapInArrow(run, "item long, doc_id long, score long")
        named = spark.createDataFrame(pile.select(["item", "item_id"]))
        rows = best_rows(rows, ["item"], "doc_id", k)
        rows = rows.join(named, "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
