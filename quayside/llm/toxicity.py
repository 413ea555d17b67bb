"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding maps homoglyphs, accented and full-width letters to plain ones, digits and signs inside words to the letters
they stand for, and everything else to spaces. The lexicon has whole words and word beginnings; each entry's weight
is the log ratio of the shares of toxic and of clean training documents that have it. Exception phrases in which an
entry is harmless are matched by the same automaton and cancel it. A document's features are its matches' weights,
summed, at most, and by length; a logistic function of these, fitted on training rows, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import session, table, utf8, written

#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһӏтмкнвгαοενικρτυχβηω", "aeopcyxijsdqwhltmkhbraoevikptuxbnw"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "class clown car", "white trash bag", "scum line", "pond scum")
#: Letters of the shortest and longest word beginning in the lexicon (whole words have any length); toxic training
#: documents that an entry must be in at least; least weight; evidence beyond chance; rows (the least by hash) that the
#: logistic function is fitted on; bits of the filter for clean documents' entries; bytes of a lexicon that is sent to
#: all tasks.
SHORTEST, LONGEST, LEAST_DOCUMENTS, LEAST_WEIGHT, SURE, FIT_ROWS, FILTER_BITS, LEXICON_BYTES = 4, 8, 3, 2.0, 4.0, 20_000, 1 << 25, 128 << 20


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = HOMOGLYPHS.get(c) or DIGITS.get(c)
        if out is None:
            plain = unicodedata.normalize("NFKD", c)[:1].lower()
            out = HOMOGLYPHS.get(plain, plain) if plain.isalnum() else ("" if unicodedata.category(c) in ("Mn", "Cf") else " ")
            out = DIGITS.get(out, out)
        self[code] = out
        return out


_FOLD = _Fold()
_BETWEEN = re.compile(r"(?<=[^\W_])[" + re.escape("".join(SIGNS)) + r"](?=[^\W_])")


def fold(text: str) -> str:
    """Folded words, with a space before and after each."""
    if not _BETWEEN.search(text):
        return f" {text.lower().translate(_FOLD)} "
    return f" {_BETWEEN.sub(lambda m: SIGNS[m[0]], text).lower().translate(_FOLD)} "


def entries(folded: str) -> set[str]:
    """Candidates of a text: ' word ' for whole words, ' beg' for beginnings."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


@lru_cache(4)
def automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for entry, weight in lexicon:
        a.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        a.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if len(a):
        a.make_automaton()
    return a


def matches(folded: str, a: ahocorasick.Automaton) -> list[float]:
    """The weight of each matched word: its best entry, unless an exception phrase covers it."""
    if not len(a):
        return []
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if not spared:
        return list(best.values())
    # phrases in the order of their starts; the furthest end of those that start up to a place
    spared.sort()
    starts, ends = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
    covered = lambda at: (i := bisect_right(starts, at)) and at < ends[i - 1]
    return [w for at, w in best.items() if not covered(at)]


def features(text: str, a: ahocorasick.Automaton) -> tuple[float, float, float, float]:
    """Sum of weights (as a logarithm), largest weight, weight by length, strong matches."""
    folded = fold(text)
    found = matches(folded, a)
    if not found:
        return 0.0, 0.0, 0.0, 0.0
    words = folded.count(" ") + 1
    total = sum(found)
    return math.log1p(total), max(found), total / math.sqrt(words), math.log1p(sum(w > 4 for w in found))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression, intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counts(rows: DataFrame, wanted: bytes | None = None) -> DataFrame:
    """entry, n: rows that have it; counted in each task first. wanted: a filter (`_filter`): what it lacks is left out."""
    schema = pa.schema([("entry", pa.string()), ("n", pa.int64())])

    def passed(counts: Counter):
        names, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        if wanted is not None:
            at = np.fromiter((xxhash.xxh64_intdigest(e.encode(), 42) for e in names), np.uint64, len(names)) & np.uint64(FILTER_BITS - 1)
            bits = np.frombuffer(wanted, np.uint8)
            kept = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            names, n = [names[i] for i in kept.tolist()], n[kept]
        return table(schema, names, n)

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for raw in b.column("text").to_pylist():
                counts.update(entries(fold(raw.decode("utf-8"))))
                if len(counts) > 500_000:
                    yield passed(counts)
                    counts.clear()
        if counts:
            yield passed(counts)

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _filter(candidates: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS in which every candidate's bit is set: of one size, however many there are. More of them let
    more of the others through, which a join then leaves out."""
    bit = F.xxhash64("entry").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = candidates.select(F.floor(bit / 32768).alias("part"), (bit % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


def _lexicon(train: DataFrame, n_toxic: int, n_clean: int) -> tuple[tuple[str, float], ...]:
    """Entries of at least LEAST_DOCUMENTS toxic rows with a weight of LEAST_WEIGHT and evidence beyond chance, less those
    that a beginning of theirs makes needless: a match counts by its best entry. ValueError where they are more than what
    can be sent to all tasks."""
    candidates = written(_counts(train.where("toxic = 1")).where(F.col("n") >= LEAST_DOCUMENTS))
    others = _counts(train.where("toxic = 0"), _filter(candidates)).withColumnRenamed("n", "c")
    k, c = F.col("n").cast("double"), F.coalesce("c", F.lit(0)).cast("double")
    weight = F.log((k + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    # of very many candidates some look toxic by chance: an entry counts if its likelihood ratio outdoes their number
    share, least = n_toxic / (n_toxic + n_clean), 2 * math.log(candidates.count() + 1) + SURE
    evidence = 2 * (k * F.log(k / (k + c) / share) + F.when(c > 0, c * F.log(c / (k + c) / (1 - share))).otherwise(0.0))
    sure = candidates.join(others, "entry", "left").select("entry", F.round(weight, 6).alias("weight"), evidence.alias("evidence"))
    sure = written(sure.where((F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= least)).select("entry", "weight"))
    beginnings = F.filter(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.substring("entry", 1, n + 1)), lambda e: e != F.col("entry"))
    shorter = sure.select(F.col("entry").alias("beginning"), F.col("weight").alias("its"))
    needless = sure.select("entry", "weight", F.explode(F.array_distinct(beginnings)).alias("beginning")).join(shorter, "beginning").where("its >= weight").select("entry").distinct()
    kept = written(sure.join(needless, "entry", "left_anti"))
    n_bytes = kept.agg(F.coalesce(F.sum(F.octet_length("entry") + 64), F.lit(0))).first()[0]
    if n_bytes > LEXICON_BYTES:
        raise ValueError(f"a lexicon of {n_bytes} bytes can't be sent to all tasks (LEXICON_BYTES)")
    return tuple(sorted((r.entry, r.weight) for r in kept.collect()))


class Model:
    """lexicon: (entry, weight) pairs; exceptions: phrases; weights: of the logistic function, intercept last."""

    def __init__(self, lexicon, exceptions, weights):
        self.lexicon, self.exceptions, self.weights = tuple(lexicon), tuple(exceptions), tuple(weights)


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, fit_rows: int = FIT_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic): all labelled rows count for the lexicon; the
    logistic function is fitted on at most fit_rows rows, the least by hash. Null labels are left out; of several labels of
    a doc_id the largest counts, and all rows of that doc_id have it. One class only: a constant score."""
    session(docs.sparkSession)
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    # labels grow with the documents: both sides are dealt by key at every size, never broadcast
    train = written(rows.join(own.hint("merge"), "doc_id").select("doc_id", "text", "toxic"))
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model((), exceptions, (0, 0, 0, 0, 9.0 if n_toxic else -9.0))
    lexicon = _lexicon(train, n_toxic, n_clean)
    # the least hashes: a share that leaves a tenth to spare is taken in place, and only features meet to be cut to fit_rows
    below = int(min(1.0, 1.1 * fit_rows / (n_toxic + n_clean)) * 2**32)
    hashed = F.xxhash64("doc_id")
    sample = train.where(F.shiftrightunsigned(hashed, 32) < below).withColumn("row", hashed.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("toxic")))
    drawn = _featured(sample, lexicon, exceptions, "row").orderBy("row", "f").limit(fit_rows)
    got = drawn.select(F.col("row").bitwiseAND(F.lit(1)).alias("toxic"), "f").toPandas()
    return Model(lexicon, exceptions, _logistic(np.array(got.f.tolist()), got.toxic.to_numpy(float)))


def _featured(rows: DataFrame, lexicon, exceptions, keep: str) -> DataFrame:
    schema = pa.schema([(keep, pa.int64()), ("f", pa.list_(pa.float64()))])

    def run(batches):
        a = automaton(lexicon, exceptions)
        for b in batches:
            yield table(schema, b.column(keep), [features(raw.decode("utf-8"), a) for raw in b.column("text").to_pylist()])

    return rows.select(F.col(keep).cast("long").alias(keep), "text").mapInArrow(run, f"{keep} long, f array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0..1 for every row. Null and empty texts are scored as texts without matches."""
    session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    f, w = _featured(rows, model.lexicon, model.exceptions, "doc_id"), [float(x) for x in model.weights]
    z = F.lit(w[-1])
    for i, x in enumerate(w[:-1]):
        z = z + F.lit(x) * F.get("f", F.lit(i))
    return f.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the text's score, in a column `name`, beside every row, repeated rows and null doc_ids included.
    ValueError if docs has a column of that name."""
    if name in docs.columns:
        raise ValueError(f"a column {name} is there already")
    session(docs.sparkSession)
    own = "__features"
    while own in docs.columns:
        own += "_"
    schema = docs.withColumn(own, F.array(F.lit(0.0))).schema
    place = docs.columns.index("text")

    def run(batches):
        a = automaton(model.lexicon, model.exceptions)
        for b in batches:
            f = [features((raw or b"").decode("utf-8", "replace"), a) for raw in b.column(place).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f, pa.list_(pa.float64()))], names=[*b.schema.names, own])

    z = F.lit(float(model.weights[-1]))
    for i, x in enumerate(model.weights[:-1]):
        z = z + F.lit(float(x)) * F.get(own, F.lit(i))
    return docs.mapInArrow(run, schema).select(*docs.columns, (1 / (1 + F.exp(-z))).alias(name))
