"""Quality rules: measures of a text's words and lines, and bands of perplexity under an n-gram model.

The model is a modified Kneser-Ney model of each language over the bytes of its documents (words, A-Z lowered, one space
between them): ORDER bytes at most, counted by Spark over all rows. An n-gram's key is its language's 24 hash bits and
its bytes, under an invertible mixing, so that keys are spread evenly and no two n-grams of a language share one. Counts
of shorter n-grams are continuation counts; each order has three discounts from its counts of counts, and an n-gram's
probability is interpolated down to the even distribution over bytes; n-grams that were never seen back off. The
model is stored in buckets of a hash's first bits, each with sorted arrays of hashes and log probabilities.

Texts are written in blocks of bounded size with their distinct n-grams. A block asks each bucket for the keys it has
there and gets back probabilities, so nobody holds the model, and what travels is a block's distinct n-grams. The blocks
themselves are written bucketed by their number and stay where they are. A document's perplexity is that of its bytes.
Each language has a band around its median log perplexity, both sides in robust deviations of the documents below and
above it; documents outside are rejected.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm._util import session, shared_dir, table, utf8, written

#: Bytes of the longest n-gram; text bytes of a block; n-grams that a task adds up before it passes them on; n-grams of a
#: bucket; bytes of keys that ask a copy of a bucket.
ORDER, BLOCK_BYTES, PASSED_ON, BUCKET, ASKING = 5, 6 << 20, 2_000_000, 1 << 18, 16 << 20
#: Bounds of the rules: fewest words; largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A band's two sides, in robust deviations; languages with fewer documents than this have the band of all documents;
#: steps of log10 perplexity that medians are exact to.
BELOW, ABOVE, FEWEST, STEP = 6.0, 6.0, 50, 0.001

_ODD, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def mixed(key: np.ndarray) -> np.ndarray:
    """An invertible hash of 64 bits."""
    h = key.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(32))


def plain(h: np.ndarray) -> np.ndarray:
    """The key of a mixed one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_BACK)
    return h ^ (h >> np.uint64(32))


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """How many words lie in windows that occur twice or more. ids: the words' numbers."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, window):  # a pair's number is small again, so no key leaves 64 bits
        key = np.unique(key, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[k : k + n]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measures(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    a = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), int(((a & 0xC0) != 0x80).sum()), int(_SYMBOL[a].sum()), len(lines) - len(set(lines)), repeated_words(ids)


def text_bytes(raw: bytes) -> bytes:
    """What the model reads: ORDER - 1 spaces, the words with one space after each."""
    return b" " * (ORDER - 1) + b" ".join(raw.lower().split()) + b" "


def _keys(read: list[bytes], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all n-grams of ORDER bytes, text by text, and how many each text has. read: text_bytes of the texts."""
    sizes = np.array([len(t) - ORDER + 1 for t in read], np.int64)
    a = np.frombuffer(b"".join(read), np.uint8)
    key = a.astype(np.uint64)
    for k in range(1, ORDER):  # a place's n-gram ends there
        one = a[: len(a) - k].astype(np.uint64)
        one <<= np.uint64(8 * k)
        key[k:] |= one
    # the places of a text that have ORDER bytes up to them
    whole = np.ones(len(a), bool)
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    for k in range(ORDER - 1):
        whole[starts + k] = False
    key = key[whole]
    key |= np.repeat(langs.astype(np.uint64) << np.uint64(40), sizes)
    return key, sizes


def _packed(a: np.ndarray) -> bytes:
    """Ascending numbers, by differences and byte planes."""
    d = np.diff(a, prepend=np.uint64(0))
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


#: Steps of log10 probabilities that travel: a byte's is right to half a step, a text's mean to far less.
FINE = 4096.0

BLOCKS = pa.schema([
    ("block", pa.int64()), ("rows", pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]))),
    ("texts", pa.binary()), ("sizes", pa.list_(pa.int64())), ("langs", pa.list_(pa.int32())), ("keys", pa.binary()), ("counts", pa.binary()),
])
_BLOCKS = "block long, rows array<struct<doc_id: long, lang: string, n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long>>, texts binary, sizes array<long>, langs array<int>, keys binary, counts binary"
_MEASURES = [f.name for f in BLOCKS.field("rows").type.value_type]


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows as they lie, up to block_bytes of text together (a longer text alone): their measures, what the model reads
    of them, distinct keys (ascending) and how often each occurs. Written bucketed by block, so that later steps that
    need the texts don't move them."""

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            texts = [text_bytes(r[2]) for r in held]
            langs = np.array([r[3] for r in held], np.int32)
            every, _ = _keys(texts, langs)
            every.sort()
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            keys, counts = every[first], np.diff(np.r_[first, len(every)])
            rows = [dict(zip(_MEASURES, (r[0], r[1], *measures(r[2])))) for r in held]
            pressed = zstandard.compress(b"".join(texts), 6)
            return table(BLOCKS, [part << 32 | k], [rows], [pressed], [[len(t) for t in texts]], [langs], [_packed(keys)], [zstandard.compress(counts.astype(np.uint32).tobytes(), 1)])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "bytes", "code"))):
                held.append(r)
                size += len(r[2])
                if size >= block_bytes:
                    yield block()
                    held, size, k = [], 0, k + 1
        if held:
            yield block()

    spark = docs.sparkSession
    code = F.shiftrightunsigned(F.xxhash64(F.coalesce("lang", F.lit(""))), 40).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), utf8("text").alias("bytes"), code.alias("code"))
    name = f"quayside_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.mapInArrow(run, _BLOCKS).write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, as they have a path of their own
    return out


def _counts(blocks: DataFrame) -> DataFrame:
    """key (plain), c: how often each n-gram of ORDER bytes occurs in all texts. Tasks add up before they pass on."""
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def added(held):
        keys, counts = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(counts, first)

    def out(keys, counts):
        keys = keys.view(np.int64)
        for i in range(0, len(keys), 100_000):
            yield table(schema, keys[i : i + 100_000], counts[i : i + 100_000])

    def run(batches):
        held = []
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                keys = _unpacked(keys)
                if len(keys):
                    held.append((keys, np.frombuffer(zstandard.decompress(counts), np.uint32).astype(np.int64)))
                if len(held) > 1:
                    held = [added(held)]
                if held and len(held[0][0]) >= PASSED_ON:
                    yield from out(*held.pop())
        for own in held:
            yield from out(*own)

    return blocks.select("keys", "counts").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _low(column, n_bytes: int):
    """A key with its language and its last n_bytes bytes."""
    lang = F.shiftleft(F.shiftrightunsigned(column, 40), 40)
    return lang.bitwiseOR(column.bitwiseAND(F.lit((1 << 8 * n_bytes) - 1)))


def _context(column):
    """A key without its last byte."""
    lang = F.shiftleft(F.shiftrightunsigned(column, 40), 40)
    return lang.bitwiseOR(F.shiftrightunsigned(column.bitwiseAND(F.lit((1 << 40) - 1)), 8))


def _discount(i: int):
    """The discount of count i (3: and more) from counts of counts, within 0 and i; half of i where they can't tell."""
    n = [F.col(f"n{j}").cast("double") for j in range(1, 5)]
    d = i - (i + 1) * n[0] / (n[0] + 2 * n[1]) * n[i] / n[i - 1]
    sane = (n[0] > 0) & (n[1] > 0) & (n[i - 1] > 0)
    return F.coalesce(F.when(sane, F.least(F.greatest(d, F.lit(0.0)), F.lit(float(i)))), F.lit(i / 2.0))


def probabilities(grams: DataFrame) -> list[DataFrame]:
    """By order from 0 (no byte) on: key, p (interpolated probability of the last byte after the others), and gamma (the shorter
    context's weight after this n-gram as context; null where nothing ever follows; p is null where nothing ever precedes). grams: key, c of the longest."""
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different bytes before an n-gram
        counts[k] = written(counts[k + 1].groupBy(_low(F.col("key"), k).alias("key")).agg(F.count("*").alias("c")))
    lang = F.shiftrightunsigned("key", 40)
    out: list[DataFrame] = []
    gammas: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        c = F.col("c")
        own = counts[k].groupBy(lang.alias("lang")).agg(*[F.count_if(c == j).alias(f"n{j}") for j in range(1, 5)])
        cut = own.select("lang", *[_discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        after = counts[k].groupBy(_context(F.col("key")).alias("context")).agg(F.sum("c").alias("s"), F.count_if(c == 1).alias("a1"), F.count_if(c == 2).alias("a2"), F.count_if(c > 2).alias("a3"))
        after = after.withColumn("lang", F.shiftrightunsigned("context", 40)).join(cut, "lang")
        gamma = (F.col("d1") * F.col("a1") + F.col("d2") * F.col("a2") + F.col("d3") * F.col("a3")) / F.col("s")
        after = written(after.select("context", "s", "d1", "d2", "d3", gamma.alias("gamma")))
        gammas.append(after.select(F.col("context").alias("key"), "gamma"))
        rows = counts[k].withColumn("context", _context(F.col("key"))).join(after, "context")
        d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("key", ((c - d) / F.col("s")).alias("main"), "gamma")
        if k == 1:
            rows = rows.select("key", (F.col("main") + F.col("gamma") / 256).alias("p"))
        else:
            lower = out[-1].select(F.col("key").alias("low"), F.col("p").alias("q"))
            rows = rows.withColumn("low", _low(F.col("key"), k - 1)).join(lower, "low").select("key", (F.col("main") + F.col("gamma") * F.col("q")).alias("p"))
        out.append(written(rows))
    none = gammas[0].select("key", F.lit(1 / 256).alias("p"), "gamma")
    return [none, *[rows.join(gammas[k], "key", "full") for k, rows in enumerate(out[:-1], 1)], out[-1].withColumn("gamma", F.lit(None).cast("double"))]


def backed_off(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """key, p of n-grams of ORDER bytes that the model may not have: of the longest ending that it has, times the weights
    of the longer contexts."""
    out = keys.select("key").distinct().withColumn("p", F.lit(1 / 256))
    for k in range(1, ORDER + 1):
        own = levels[k].select(F.col("key").alias("gram"), F.col("p").alias("seen"))
        before = levels[k - 1].select(F.col("key").alias("context"), "gamma")
        out = out.withColumns({"gram": _low(F.col("key"), k)}).withColumn("context", _context(F.col("gram")))
        out = out.join(own, "gram", "left").join(before, "context", "left")
        out = written(out.select("key", F.coalesce("seen", F.col("p") * F.coalesce("gamma", F.lit(1.0))).alias("p")))
    return out


MODEL = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("p", pa.binary())])


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def stored(grams: DataFrame) -> tuple[DataFrame, int]:
    """Probabilities (key, p) in buckets of sorted hash arrays with log10 p, and the bits of a bucket's number."""
    bits = max(0, -(-grams.count() // BUCKET) - 1).bit_length()
    schema = pa.schema([("bucket", pa.int64()), ("hash", pa.int64()), ("p", pa.float32())])

    def hashed(batches):
        for b in batches:
            h = mixed(np.asarray(b.column("key")).view(np.uint64))
            yield table(schema, _bucket(h, bits), h.view(np.int64), b.column("p"))

    def build(group: pa.Table) -> pa.Table:
        h = np.asarray(group.column("hash")).view(np.uint64)
        by = np.argsort(h)
        return pa.Table.from_batches([table(MODEL, [group.column("bucket")[0].as_py()], [h[by].tobytes()], [np.asarray(group.column("p"))[by].tobytes()])])

    dealt = grams.select("key", F.log10("p").cast("float").alias("p")).mapInArrow(hashed, "bucket long, hash long, p float")
    return written(dealt.groupBy("bucket").applyInArrow(build, "bucket long, hashes binary, p binary")), bits


_ASKED = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("p", pa.binary())])


def perplexities(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, lang, the measures, and log_perplexity (log10, by byte) of every row of the blocks. grams: key, p of all
    their n-grams."""
    arrays, bits = stored(grams)
    # blocks ask copies of the buckets, as many as keep what asks one of them in bounds
    n_bytes = blocks.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0]
    parts = max(1, -(-n_bytes // (ASKING << bits)))

    def ask(batches):
        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("keys").to_pylist()):
                keys = _unpacked(packed)
                bucket = _bucket(mixed(keys), bits)
                part = int(mixed(np.array([block]))[0] % np.uint64(parts))
                for i in np.unique(bucket).tolist():
                    yield table(_ASKED, [i], [part], [block], [_packed(keys[bucket == i])])

    def tell(held: pa.Table, asks: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return _TOLD.empty_table()
        row = held.to_pylist()[0]
        known, p = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["p"], np.float32)
        told = []
        for a in asks.to_pylist():
            steps = np.minimum(np.round(-p[np.searchsorted(known, mixed(_unpacked(a["keys"])))] * FINE), 65535)
            told.append((a["block"], a["bucket"], zstandard.compress(steps.astype(np.uint16).tobytes(), 1)))
        return pa.Table.from_batches([table(_TOLD, *zip(*told))])

    asks = blocks.select("block", "keys").mapInArrow(ask, "bucket long, part int, block long, keys binary")
    copies = arrays.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    told = copies.groupBy("bucket", "part").cogroup(asks.groupBy("bucket", "part")).applyInArrow(tell, "block long, bucket long, p binary")
    fields = [(f.name, f.type) for f in BLOCKS.field("rows").type.value_type]
    schema = pa.schema([*fields, ("log_perplexity", pa.float64())])

    def apply(own: pa.Table, sent: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        row = own.to_pylist()[0]
        distinct = _unpacked(row["keys"])
        bucket, steps = _bucket(mixed(distinct), bits), np.zeros(len(distinct))
        for i, p in zip(sent.column("bucket").to_pylist(), sent.column("p").to_pylist()):
            steps[bucket == i] = np.frombuffer(zstandard.decompress(p), np.uint16)
        text, ends = zstandard.decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
        keys, sizes = _keys([text[a:z] for a, z in zip([0, *ends[:-1]], ends)], np.array(row["langs"]))
        ends = np.cumsum(sizes)
        mean = np.array([steps[np.searchsorted(distinct, keys[z - n : z])].sum() for z, n in zip(ends.tolist(), sizes.tolist())]) / sizes / FINE
        rows = row["rows"]
        return pa.Table.from_batches([table(schema, *[[r[c] for r in rows] for c in _MEASURES], mean)])

    asked = blocks.select("block", "rows", "texts", "sizes", "langs", "keys")
    return asked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(apply, ", ".join(f"{c} {'string' if c == 'lang' else 'long'}" for c in _MEASURES) + ", log_perplexity double")


def learn(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The model of docs (text, lang), by order."""
    session(docs.sparkSession)
    return probabilities(written(_counts(_blocks(docs.withColumn("doc_id", F.lit(None).cast("long")), block_bytes))))


def score(docs: DataFrame, levels: list[DataFrame], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, the measures and log_perplexity of texts under a model that was learned from any others."""
    session(docs.sparkSession)
    blocks = _blocks(docs, block_bytes)
    return perplexities(blocks, backed_off(_counts(blocks), levels))


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE, fewest: int = FEWEST) -> DataFrame:
    """lang (null counts as a language), low, high: the language's median log perplexity less `below`, and more `above`,
    robust deviations of its documents under and over the median (1.4826 medians of distances, at least 10 steps).
    scored: lang, log_perplexity."""
    rows = scored.select(F.struct(F.lit(False).alias("every"), "lang").alias("by"), F.round(F.col("log_perplexity") / STEP).cast("long").alias("x"))
    rows = rows.groupBy("by", "x").agg(F.count("*").alias("k"))
    every = rows.groupBy("x").agg(F.sum("k").alias("k")).select(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")).alias("by"), "x", "k")
    rows = written(rows.unionByName(every))

    def middle(of: DataFrame) -> DataFrame:
        w = Window.partitionBy("by").orderBy("x")
        at = of.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(Window.partitionBy("by")))
        return at.where(2 * F.col("upto") >= F.col("all")).groupBy("by").agg(F.min("x").alias("middle"), F.max("all").alias("n"))

    centre = middle(rows)
    off = rows.join(centre, "by")
    side = lambda keep: middle(off.where(keep).select("by", F.abs(F.col("x") - F.col("middle")).alias("x"), "k")).select("by", F.greatest(1.4826 * F.col("middle"), F.lit(10.0)).alias("spread"))
    lower, upper = side("x <= middle").withColumnRenamed("spread", "down"), side("x >= middle").withColumnRenamed("spread", "up")
    out = centre.join(lower, "by").join(upper, "by")
    out = out.select("by.every", "by.lang", "n", ((F.col("middle") - below * F.col("down")) * STEP).alias("low"), ((F.col("middle") + above * F.col("up")) * STEP).alias("high"))
    out = written(out)
    whole = out.where("every").select(F.col("low").alias("all_low"), F.col("high").alias("all_high"))  # one row
    few = F.col("n") < fewest
    return out.where("not every").crossJoin(F.broadcast(whole)).select("lang", F.when(few, F.col("all_low")).otherwise(F.col("low")).alias("low"), F.when(few, F.col("all_high")).otherwise(F.col("high")).alias("high"))


def judge(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log_perplexity, low, high.

    docs: doc_id, text, lang. Null texts have no words and fail; a null lang is a language of its own. Every row is
    judged by its own text, repeated doc_ids and null ones included. All rows count for the model, those that the rules
    leave count for the bands. Other columns are left alone. No rows: none.
    """
    session(docs.sparkSession)
    blocks = _blocks(docs, block_bytes)
    # the model has all their n-grams, as it was learned from these texts
    scored = written(perplexities(blocks, probabilities(written(_counts(blocks)))[ORDER].select("key", "p")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = scored.withColumn("base_failed", failed)
    # NULL = NULL is unknown: languages are joined by a text that no language has in place of null
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    band = bands(rows.where(~F.col("base_failed"))).select(key.alias("__lang"), "low", "high")
    out = rows.withColumn("__lang", key).join(band, "__lang", "left").drop("__lang")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "low", "high")
