"""Language-model scoring by a weighted backoff automaton over all n-grams of the training texts.

Every word and every word n-gram of the training rows counts, however rare: the contexts seen are the automaton's
states, the n-grams seen its arcs. A state h that was left c(h) times takes its arc for w with probability
(c(hw) + m * p(w | shorter state)) / (c(h) + m); its failure arc leads to the shorter state with weight
m / (c(h) + m). The root has an arc for every word, of the base model's probability. One walk from left to right
carries the state (the longest suffix that is one), follows failure arcs until there is an arc, and adds up log
probabilities. The texts of a block are walked in step, with a state each, so that a step is a few array operations.

The counts grow with the corpus, so no task, and not the driver, ever holds them all. Texts are written in blocks of
bounded size. A block passes on its distinct n-grams, as sorted hashes in buckets; a bucket's task adds them up over
all blocks and sends back only the totals that a block does not know already, those of n-grams that other blocks have
too. A block then builds its own part of the automaton and walks its texts. Words are named by 128 bits of their
hash, longer n-grams by KEY_BITS.

A block never cuts its n-grams into more than 2^FAN_BITS buckets, so that its rows keep hundreds of keys each however
large the corpus is. Where more buckets are needed, blocks form teams: a team's bucket is added up by itself, passes
its distinct n-grams on as a block does, by the next FAN_BITS of their hashes, and deals the totals that come back to
its blocks. Each round more serves 2^FAN_BITS times the text: one up to 34 GB, two up to 280 TB.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import session, table, utf8, written

#: The end of a document, as no word has a space; it also stands before a document's first word.
END = b" "
#: Words of the longest n-gram; mass of the shorter state, by order from 2 on; text bytes of a block and of a bucket.
ORDER, MASS, BLOCK_BYTES, BUCKET_BYTES = 3, (300.0, 100.0), 8 << 20, 4 << 20
#: Tokens that a walk takes at once of a text; a longer text is walked at several places in step.
STRETCH = 64
#: A block's n-grams go to 2^FAN_BITS buckets at most, and so do those of a team's bucket.
FAN_BITS = 13
#: Bits of a longer n-gram's hash: of 10^13 distinct ones, one in 7,000 shares its count with another.
KEY_BITS = 56

_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(raw: bytes) -> list[bytes]:
    """A-Z lowered; runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return raw.lower().split()


def _packed(a: np.ndarray) -> bytes:
    """Ascending or small numbers, by differences and byte planes."""
    d = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeezed(a: np.ndarray) -> bytes:
    """Numbers in no order."""
    return zstandard.compress(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _widened(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where each distinct number starts."""
    return np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1]]) if len(ascending) else np.zeros(0, np.int64)


class Grams:
    """The n-grams of a block of texts: a row of word numbers, each text between two ends, and its keys by order."""

    def __init__(self, texts: list[bytes], train: list[bool], order: int):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[END]
        sizes, parts = [], []
        for raw in texts:
            own = tokens(raw)
            sizes.append(len(own) + 2)
            parts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
        sizes = np.array(sizes, np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.words = np.zeros(int(sizes.sum()), np.int32)
        for at, p in zip(self.start.tolist(), parts):
            self.words[at + 1 : at + 1 + len(p)] = p
        self.place = np.arange(len(self.words)) - np.repeat(self.start, sizes)
        self.learned = np.repeat(np.array(train, bool), sizes)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.high, self.low = digests[:, 0], digests[:, 1]
        self.order = order

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers in the order of their hashes, and each one's training tokens in that order."""
        sorted_ = np.lexsort((self.low, self.high))
        own = np.bincount(self.words[self.learned & (self.place > 0)], minlength=len(self.high))
        return sorted_, own[sorted_]

    def _keys(self):
        """For each order from 2 on: places that end an n-gram, and its key times two."""
        of_word = self.high[self.words]
        key = of_word.copy()
        for n in range(2, self.order + 1):
            key[1:] = key[:-1] * _MIX + of_word[1:] + np.uint64(n)
            key[1:] ^= key[1:] >> np.uint64(29)
            key[1:] *= _MIX
            at = np.flatnonzero(self.place >= n - 1)
            yield at, key[at] >> np.uint64(64 - KEY_BITS) << np.uint64(1)

    def longer(self):
        """For each order from 2 on: the distinct keys, ascending, and their training counts."""
        for at, own in self._keys():
            own |= self.learned[at]
            own.sort()
            key = own >> np.uint64(1)
            first = _starts(key)
            yield key[first], np.add.reduceat((own & np.uint64(1)).astype(np.int64), first) if len(own) else first

    def placed(self):
        """As longer(), with the places that end an n-gram, ascending by key, and where each key starts among them."""
        for at, own in self._keys():
            by = np.argsort(own)
            own, at = own[by], at[by]
            first = _starts(own)
            yield at, first, np.add.reduceat(self.learned[at].astype(np.int64), first) if len(own) else first


class Automaton:
    """A block's part of the automaton: the states and arcs that its texts can reach.

    State 0 is the root; learned words are states, then learned pairs, up to order - 1 words. A state has a failure
    arc, to the state of all its words but the first, and that arc's weight. The root has an arc for every word; other
    arcs are sorted by state and word. Every arc has its whole probability and the state it leads to: the longest
    suffix of state and word that is one.
    """

    def __init__(self, grams: Grams, known: np.ndarray, longer, tokens_: int, distinct: int, mass=MASS):
        """known: training tokens of each word; longer: for each order from 2 on as Grams.placed(), with totals."""
        self.grams, words = grams, grams.words
        base = (known + 0.5) / (tokens_ + 0.5 * (distinct + 1))
        self.root = np.log10(base)
        is_state = (known > 0) & (grams.order > 1)
        self.root_to = np.where(is_state, np.cumsum(is_state), 0).astype(np.int32)
        seen, failure, weight = [np.zeros(1, np.int64), known[is_state]], [np.zeros(1 + int(is_state.sum()), np.int32)], [np.zeros(1)]
        keys, arcs, to = [np.full(1, np.iinfo(np.int64).max)], [np.zeros(1)], [np.zeros(1, np.int32)]
        # of the n-gram of the order before that ends at a place: its state (0: none) and its arc's probability
        state, p = self.root_to[words], base[words]
        for n, (at, first, counts) in enumerate(longer, 2):
            m = mass[min(n - 2, len(mass) - 1)]
            weight.append(np.log10(m / (seen[-1] + m)))
            learned = counts > 0
            end = at[first[learned]]
            source = state[end - 1]
            every_seen = np.concatenate(seen)
            arc = (counts[learned] + m * p[end]) / (every_seen[source] + m)
            keys.append(source.astype(np.int64) * len(known) + words[end])
            arcs.append(np.log10(arc))
            if n == grams.order:
                to.append(state[end])
                break
            own = np.zeros(len(counts), np.int32)
            own[learned] = len(every_seen) + np.arange(len(end))
            to.append(own[learned])
            failure.append(state[end])
            seen.append(counts[learned])
            of_gram = np.zeros(len(counts))
            of_gram[learned] = arc
            times = np.diff(np.r_[first, len(at)])
            state, p = np.zeros(len(words), np.int32), np.zeros(len(words))
            state[at], p[at] = np.repeat(own, times), np.repeat(of_gram, times)
        del state, p
        keys = np.concatenate(keys)
        by = np.argsort(keys)
        self.keys, self.arcs, self.to = keys[by], np.concatenate(arcs)[by], np.concatenate(to)[by]
        self.failure, self.weight = np.concatenate(failure), np.concatenate(weight)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token for each state: failure arcs until there is an arc, then that arc. The states after it, and the
        log10 probabilities on the way."""
        state, to, p = state.copy(), np.empty(len(state), np.int32), np.zeros(len(state))
        left = np.flatnonzero(state)
        while len(left):
            want = state[left].astype(np.int64) * len(self.root) + word[left]
            by = np.argsort(want)  # ascending, since a search then finds the keys it needs in the cache
            left, want = left[by], want[by]
            k = np.searchsorted(self.keys, want)
            hit = self.keys[k] == want
            there, k = left[hit], k[hit]
            p[there] += self.arcs[k]
            to[there] = self.to[k]
            state[there] = -1
            left = left[~hit]
            p[left] += self.weight[state[left]]
            state[left] = self.failure[state[left]]
            left = left[state[left] > 0]
        there = np.flatnonzero(state == 0)
        p[there] += self.root[word[there]]
        to[there] = self.root_to[word[there]]
        return to, p

    def walk(self) -> np.ndarray:
        """log10 probability of each text. Texts are walked in stretches, all of them in step; a stretch reads the
        order - 1 tokens before it without counting them, which leads to the state that the text arrives in."""
        g = self.grams
        stop = np.r_[g.start[1:], len(g.words)]
        pieces = -(-(stop - g.start - 1) // STRETCH)
        text = np.repeat(np.arange(len(g.start)), pieces)
        counted = g.start[text] + 1 + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        begin = np.maximum(g.start[text], counted - max(1, g.order - 1))
        size = np.minimum(counted + STRETCH, stop[text]) - begin
        by = np.argsort(-size, kind="stable")
        begin, counted, size = begin[by], counted[by], size[by]
        state, total = np.zeros(len(by), np.int32), np.zeros(len(by))
        for i in range(int(size[0]) if len(size) else 0):
            n = np.searchsorted(-size, -i)
            at = begin[:n] + i
            state[:n], p = self.step(state[:n], g.words[at])
            total[:n] += np.where(at >= counted[:n], p, 0.0)
        return np.bincount(text[by], total, len(g.start))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, doc_ids, train, sizes, texts (one after another, compressed), n_bytes: rows as they lie, up to
    block_bytes of text together; a longer text is a block of its own."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("n_bytes", pa.int64())])

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, size = ([], [], []), 0

        def block():
            ids, train, texts = held
            return table(schema, [part << 32 | k], [ids], [train], [[len(x) for x in texts]], [zstandard.compress(b"".join(texts), 6)], [sum(map(len, texts))])

        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), b.column("bytes").to_pylist()):
                for c, x in zip(held, row):
                    c.append(x)
                size += len(row[2])
                if size >= block_bytes:
                    yield block()
                    held, size, k = ([], [], []), 0, k + 1
        if held[0]:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("train", F.lit(False)).alias("train"), utf8("text").alias("bytes"))
    return rows.mapInArrow(run, "block long, doc_ids array<long>, train array<boolean>, sizes array<long>, texts binary, n_bytes long")


def _grams(row: dict, order: int) -> Grams:
    text, ends = zstandard.decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
    return Grams([text[a:z] for a, z in zip([0, *ends[:-1]], ends)], row["train"], order)


_PASSED = pa.schema([("order", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
_TOTALS = pa.schema([("block", pa.int64()), ("order", pa.int32()), ("at", pa.binary()), ("totals", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
_PASSED_DDL = "order int, bucket long, block long, first long, keys binary, more binary, counts binary"
_TOTALS_DDL = "block long, order int, at binary, totals binary, tokens long, distinct long"


def _parts(n: int, block: int, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray, bits: int):
    """A block's n-grams of one order, ascending by key, as rows by bucket (a hash's first bits)."""
    bucket = (keys >> np.uint64((64 if n == 1 else KEY_BITS) - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist() if len(keys) else []
    for i in range(0, len(edge) - 1, 512):
        own = list(zip(edge[i : i + 512], edge[i + 1 : i + 513]))
        m = len(own)
        yield table(_PASSED, [n] * m, [int(bucket[a]) for a, _ in own], [block] * m, [a for a, _ in own], [_packed(keys[a:z]) for a, z in own],
                    [None if more is None else more[a:z].tobytes() for a, z in own], [_squeezed(counts[a:z]) for a, z in own])


def _passed_on(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """Every block's distinct n-grams by order and bucket: where the bucket's first stands in the block's order, keys,
    the words' other 64 bits, and training counts."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                g = _grams(row, order)
                by, counts = g.unigrams()
                yield from _parts(1, row["block"], g.high[by], g.low[by], counts, bits)
                for n, (keys, counts) in enumerate(g.longer(), 2):
                    yield from _parts(n, row["block"], keys, None, counts, bits)

    return blocks.select("block", "train", "sizes", "texts").mapInArrow(run, _PASSED_DDL)


class Sums:
    """A bucket's n-grams of one order over all that passed them on: distinct keys, ascending, and their sums."""

    def __init__(self, group: pa.Table):
        self.n = group.column("order")[0].as_py()
        keys = [_unpacked(x) for x in group.column("keys").to_pylist()]
        size = np.array([len(k) for k in keys])
        self.at = np.concatenate([np.arange(a, a + s) for a, s in zip(group.column("first").to_pylist(), size.tolist())])
        self.own = np.concatenate([_widened(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
        self.block = np.repeat(np.asarray(group.column("block")), size)
        key, self.more = np.concatenate(keys), None
        if self.n == 1:
            more = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("more").to_pylist()])
            self.by = np.lexsort((more, key))
            new = np.r_[True, (key[self.by][1:] != key[self.by][:-1]) | (more[self.by][1:] != more[self.by][:-1])]
            self.more = more[self.by[new]]
        else:
            self.by = np.argsort(key, kind="stable")
            new = np.r_[True, key[self.by][1:] != key[self.by][:-1]]
        self.first = np.flatnonzero(new)
        self.keys = key[self.by[self.first]]
        self.total = np.add.reduceat(self.own[self.by], self.first)

    def dealt(self):
        """Rows of _TOTALS: to each that passed n-grams on, the totals that differ from what it knows."""
        every = np.empty(len(self.own), np.int64)
        every[self.by] = np.repeat(self.total, np.diff(np.r_[self.first, len(self.own)]))
        differ = np.flatnonzero(every != self.own)
        differ = differ[np.lexsort((self.at[differ], self.block[differ]))]
        edge = np.flatnonzero(np.r_[True, np.diff(self.block[differ]) != 0, True]).tolist() if len(differ) else []
        return [(int(self.block[differ[a]]), self.n, _packed(self.at[differ[a:z]]), _squeezed(every[differ[a:z]]), None, None) for a, z in zip(edge[:-1], edge[1:])]


def _table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([table(_TOTALS, *zip(*rows))], schema=_TOTALS) if rows else _TOTALS.empty_table()


def _added_up(group: pa.Table) -> pa.Table:
    """A bucket's totals over all blocks; of words also a row without a block, with their tokens and how many were
    learned."""
    sums = Sums(group)
    rows = sums.dealt()
    if sums.n == 1:
        rows.append((None, 1, None, None, int(sums.total.sum()), int((sums.total > 0).sum())))
    return _table_of(rows)


def _dealt_on(group: pa.Table, sent: pa.Table) -> pa.Table:
    """What a team's bucket sends its blocks once the totals over all teams have come back to it."""
    sums = Sums(group)
    for at, t in zip(sent.column("at").to_pylist(), sent.column("totals").to_pylist()):
        sums.total[_unpacked(at).astype(np.int64)] = _widened(t).astype(np.int64)
    return _table_of(sums.dealt())


def _totals(passed: DataFrame, team: Column, bits: int, done: int, fan: int) -> DataFrame:
    """_TOTALS, written, of n-grams passed on by their first `done` of `bits` bits. team: which of the 2^(bits - done)
    teams a row's block belongs to."""
    if done == bits:
        return written(passed.groupBy("order", "bucket").applyInArrow(_added_up, _TOTALS_DDL))
    after = min(bits, done + fan)
    # n-grams of one bucket and team have one unit: team and bucket together
    passed = written(passed.withColumn("unit", F.shiftleft(team, done).bitwiseOR(F.col("bucket"))))

    def run(group: pa.Table) -> pa.Table:
        sums = Sums(group)
        return pa.Table.from_batches(_parts(sums.n, group.column("unit")[0].as_py(), sums.keys, sums.more, sums.total, after), schema=_PASSED)

    above = _totals(passed.groupBy("order", "unit").applyInArrow(run, _PASSED_DDL), F.shiftright("block", after), bits, after, fan)
    sent = above.where("block is not null").select("order", "block", "at", "totals")
    dealt = passed.groupBy("order", "unit").cogroup(sent.groupBy("order", "block")).applyInArrow(_dealt_on, _TOTALS_DDL)
    return written(dealt).unionByName(above.where("block is null"))


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, mass: tuple[float, ...] = MASS, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    docs: doc_id, text, train (boolean: the row's text is learned from; null: it is not). Null texts are empty: one
    end. No training tokens: every word is unknown. Repeated rows count each time. No rows: none.
    """
    session(docs.sparkSession)
    blocks = written(_blocks(docs, block_bytes))
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = max(0, -(-n_bytes // bucket_bytes) - 1).bit_length()
    done = min(bits, fan_bits)
    passed = _passed_on(blocks, order, done)
    totals = _totals(passed, F.pmod(F.xxhash64("block"), F.lit(1 << bits - done)), bits, done, fan_bits)
    n_train, n_distinct = totals.where("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def block_scores(own: pa.Table, sent: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        row = own.to_pylist()[0]
        g = _grams(row, order)
        news: dict[int, list] = {}
        for n, at, t in zip(sent.column("order").to_pylist(), sent.column("at").to_pylist(), sent.column("totals").to_pylist()):
            news.setdefault(n, []).append((_unpacked(at).astype(np.int64), _widened(t).astype(np.int64)))
        by, counts = g.unigrams()
        for at, t in news.pop(1, ()):
            counts[at] = t
        known = np.empty_like(counts)
        known[by] = counts

        def longer():
            for n, (at, first, counts) in enumerate(g.placed(), 2):
                for where, t in news.pop(n, ()):
                    counts[where] = t
                yield at, first, counts

        automaton = Automaton(g, known, longer(), n_train, n_distinct, mass)
        counted = g.place > 0
        n_known = np.add.reduceat(((known[g.words] > 0) & counted).astype(np.int64), g.start)
        base = np.add.reduceat(np.where(counted, automaton.root[g.words], 0.0), g.start)
        n_tokens = np.diff(np.r_[g.start, len(g.words)]) - 1
        return pa.Table.from_batches([table(schema, row["doc_ids"], n_tokens, n_known, np.full(len(n_tokens), n_train), base, automaton.walk())])

    asked = blocks.select("block", "doc_ids", "train", "sizes", "texts")
    sent = totals.where("block is not null").select("block", "order", "at", "totals")
    return asked.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(block_scores, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
