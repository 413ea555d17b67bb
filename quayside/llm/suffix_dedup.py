"""Removal of repeated passages, judged by a suffix array of the places that can repeat.

Every 100-byte string contains a K-byte string of smallest hash, its anchor; equal strings have equal anchors at
equal places. Consecutive strings of a document with one anchor form an atom, so a repeated string lies in two atoms
of one anchor hash. Atoms are dealt by anchor hash. Equal atoms: all but the first are repeated whole. Different
atoms of one hash are compared by content: their texts right and left of the anchor are concatenated as strings of
chunk ranks, the suffix array of these orders them, and neighbours' common lengths say which strings of 100 bytes are
equal; all but the first are repeated. Anchor hashes with very many different atoms are taken apart into single
strings, which are dealt by their own hash instead. Repeats inside one task are settled there, so a passage in a
third of all documents sends one row per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.llm._util import runs, session, table, utf8, written
from quayside.llm.suffix_array import suffix_array

#: Bytes of the anchor.
K = 32
#: Bytes of a chunk of the parse.
CHUNK = 34
#: Different atoms of one anchor hash that are compared together; more are taken apart.
TOGETHER = 2000
#: Atoms after which a task settles what it has, and atoms that one suffix array covers.
HELD, AT_ONCE = 1_000_000, 20_000

ATOMS = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("start", pa.int32()), ("strings", pa.int32()), ("anchor", pa.int32()), ("sure", pa.bool_())])
ATOMS_DDL = "key long, same long, doc_id long, copy long, start int, strings int, anchor int, sure boolean"


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window."""
    k = 1
    while k * 2 <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def atoms(raw: bytes, length: int = 100) -> tuple[np.ndarray, ...]:
    """start, number of strings, anchor place and anchor hash of each atom."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 4
    h = (np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step = 1
    while step < K:
        h = h[:-step] * np.uint32(0x85EBCA77) + h[step:]
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE3D)
        step *= 2
    h ^= h >> np.uint32(16)
    place = (_slide(h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), length - K + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return start, np.diff(np.r_[start, len(place)]), place[start], h[place[start]].astype(np.int64)


def _settled(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Of equal atoms the first stays open; the others are surely repeated (and dealt out by document)."""
    key, same, doc, copy, start, strings, anchor, sure = (np.concatenate(x) for x in zip(*rows))
    by = np.lexsort((start, copy, doc, same, key))
    k, s = key[by], same[by]
    equal = np.r_[False, (k[1:] == k[:-1]) & (s[1:] == s[:-1])]
    stays = np.r_[False, (doc[by][1:] == doc[by][:-1]) & (copy[by][1:] == copy[by][:-1]) & (start[by][1:] == start[by][:-1])]
    sure[by[equal & ~stays]] = True
    out = np.ones(len(key), bool)
    out[by[equal & stays]] = False  # the same row of the input once more
    key = np.where(sure, doc * 0x9E3779B9 ^ start, key)
    return table(ATOMS, key, same, doc, copy, start.astype(np.int32), strings.astype(np.int32), anchor.astype(np.int32), sure).filter(pa.array(out))


def _first_of_task(batches, of_batch):
    rows, n = [], 0
    for b in batches:
        for r in of_batch(b):
            rows.append(r)
            n += len(r[0])
            if n >= HELD:
                yield _settled(rows)
                rows, n = [], 0
    if n:
        yield _settled(rows)


def find_atoms(docs: DataFrame, length: int) -> DataFrame:
    def of_batch(b):
        for doc, copy, raw in zip(b.column("doc_id").to_pylist(), b.column("copy").to_pylist(), b.column("bytes").to_pylist()):
            start, strings, anchor, h = atoms(raw, length)
            n = len(start)
            if not n:
                continue
            digest = xxhash.xxh3_64_intdigest
            same = np.array([digest(raw[x:y]) for x, y in zip(start.tolist(), (start + strings + length - 1).tolist())], dtype=np.uint64).view(np.int64)
            yield h, same, np.full(n, doc), np.full(n, copy), start, strings, anchor, np.zeros(n, bool)

    return docs.mapInArrow(lambda batches: _first_of_task(batches, of_batch), ATOMS_DDL)


def first_of_all(found: DataFrame) -> DataFrame:
    """Atoms with `sure`: repeated whole; the others of the result share their key with a different atom."""

    def classify(batches):
        key_before = same_before = at_before = waiting = None  # waiting: a key's first atom, till the next atom tells
        for b in batches:
            sure = b.column("sure").to_numpy(zero_copy_only=False)
            if sure.any():
                yield b.filter(pa.array(sure))
                b = b.filter(pa.array(~sure))
            if not b.num_rows:
                continue
            key, same = b.column("key").to_numpy(), b.column("same").to_numpy()
            at = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "copy", "start")], axis=1)
            new_key = np.r_[key_before is None or key[0] != key_before, key[1:] != key[:-1]]
            new = new_key | np.r_[same_before is None or same[0] != same_before, same[1:] != same[:-1]]
            moved = np.r_[at_before is None or (at[0] != at_before).any(), (at[1:] != at[:-1]).any(axis=1)]
            if (again := ~new & moved).any():
                found = b.filter(pa.array(again))
                yield table(ATOMS, *found.columns[:-1], np.ones(found.num_rows, bool))
            if len(first := np.flatnonzero(new)):
                opens = new_key[first]
                if waiting is not None and not opens[0]:
                    yield waiting
                shared = ~opens
                shared[:-1] |= ~opens[1:]
                waiting = b.slice(int(first[-1]), 1) if opens[-1] else None
                yield b.take(pa.array(first[shared]))
            key_before, same_before, at_before = key[-1], same[-1], at[-1]

    return found.repartition("key").sortWithinPartitions("key", "same", "doc_id", "copy", "start").mapInArrow(classify, ATOMS_DDL)


def _common(sorted_rows: np.ndarray) -> np.ndarray:
    """Bytes that each row (of a two-dimensional array) shares with the row before."""
    if len(sorted_rows) < 2:
        return np.zeros(len(sorted_rows), np.int64)
    differ = sorted_rows[1:] != sorted_rows[:-1]
    return np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), sorted_rows.shape[1])]


def _orders(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each two-dimensional array of bytes, its rows' order, by one suffix array over all rows' chunks."""
    parses = []
    for rows in texts:
        wide = -(-rows.shape[1] // CHUNK) * CHUNK
        padded = np.zeros((len(rows), wide), np.uint8)
        padded[:, : rows.shape[1]] = rows
        parses.append(np.ascontiguousarray(padded).reshape(len(rows), wide // CHUNK, CHUNK).view(f"S{CHUNK}")[:, :, 0])
    _, rank = np.unique(np.concatenate([p.ravel() for p in parses]), return_inverse=True)
    pieces, starts, at, used = [], [], 0, 0
    for p in parses:
        own = rank[used : used + p.size].reshape(p.shape) + 2
        used += p.size
        line = np.concatenate([own, np.ones((len(own), 1), own.dtype)], axis=1)
        starts.append(at + np.arange(len(own)) * line.shape[1])
        at += line.size
        pieces.append(line.ravel())
    order = np.array(suffix_array([*np.concatenate(pieces).tolist(), 0]))
    out = []
    for own in starts:
        row = np.full(at + 1, -1)
        row[own] = np.arange(len(own))
        got = row[order]
        out.append(got[got >= 0])
    return out


def _repeats(key, doc, copy, start, strings, anchor, texts, length):
    """(index of an atom, first and last string) of repeated strings among different atoms, by runs of `key`."""
    n = len(key)
    reach = length - K
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    back = anchor - start  # the first string begins so far before the anchor
    for i, raw in enumerate(texts):
        b = np.frombuffer(raw, np.uint8)
        right[i, : len(b) - back[i]] = b[back[i] : back[i] + length]
        left[i, : back[i]] = b[: back[i]][::-1]
    least = back - strings + 1  # and the last one so far
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    side = []
    for rows, order in zip((right, left), _orders([right, left])):
        by = order[np.argsort(run[order], kind="stable")]
        common = _common(rows[by])
        common[np.r_[True, run[by][1:] != run[by][:-1]]] = -1
        side.append((by, common))
    first = np.lexsort((start, copy, doc))
    seniority = np.empty(n, np.int64)
    seniority[first] = np.arange(n)
    hits = []
    for o in range(reach + 1):
        can = (least <= o) & (o <= back)
        if can.sum() < 2:
            continue
        classes = []
        for (by, common), depth in zip(side, (length - o, o)):
            c = np.empty(n, np.int64)
            c[by] = np.cumsum(common < depth)
            classes.append(c[can])
        who = np.flatnonzero(can)
        who = who[np.argsort(seniority[who], kind="stable")]
        full = np.zeros(n, np.int64)
        full[can] = classes[0] * (n + 1) + classes[1]
        _, firsts = np.unique(full[who], return_index=True)
        later = np.ones(len(who), bool)
        later[firsts] = False
        if later.any():
            hits.append((who[later], start[who[later]] + back[who[later]] - o))
    return hits


SPANS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("start", pa.int32()), ("strings", pa.int32())])
SPANS_DDL = "doc_id long, copy long, start int, strings int"


def _spans(doc, copy, at) -> pa.RecordBatch:
    by = np.lexsort((at, copy, doc))
    doc, copy, at = doc[by], copy[by], at[by]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (at[1:] != at[:-1] + 1)])
    return table(SPANS, doc[new], copy[new], at[new].astype(np.int32), np.diff(np.r_[new, len(at)]).astype(np.int32))


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, copy, start, strings: runs of `length`-byte strings that also start earlier.

    docs: doc_id long, copy long (tells rows of one doc_id apart), bytes. Earlier: by doc_id, copy, place.
    """
    found = written(first_of_all(find_atoms(docs, length)))
    sure = found.where("sure").select("doc_id", "copy", "start", "strings")
    doubt = found.where("not sure")
    many = doubt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("key", F.lit(True).alias("apart"))
    asked = doubt.join(many, "key", "left").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("key", "start", "strings", "anchor", F.coalesce("apart", F.lit(False)).alias("apart"))).alias("asked"))
    cut = F.transform("asked", lambda x: F.struct(x.key.alias("key"), x.start.alias("start"), x.strings.alias("strings"), x.anchor.alias("anchor"), x.apart.alias("apart"), F.substring(F.col("bytes"), x.start + 1, x.strings + (length - 1)).alias("text")))
    texts = written(docs.join(asked, ["doc_id", "copy"]).select("doc_id", "copy", F.explode(cut).alias("x")).select("doc_id", "copy", "x.*"))

    def compare(batches):
        def settle(tables):
            t = pa.concat_tables(tables)
            place = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "copy", "start")], axis=1)
            t = t.take(pa.array(np.sort(np.unique(place, axis=0, return_index=True)[1])))  # repeated rows once
            key, doc, copy, start, strings, anchor = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "copy", "start", "strings", "anchor"))
            hits = _repeats(key, doc, copy, start, strings, anchor, t.column("text").to_pylist(), length)
            if hits:
                who, at = (np.concatenate(x) for x in zip(*hits))
                yield _spans(doc[who], copy[who], at)

        tables, n = [], 0
        for t in runs(batches, "key"):
            tables.append(t)
            n += t.num_rows
            if n >= AT_ONCE:
                yield from settle(tables)
                tables, n = [], 0
        if n:
            yield from settle(tables)

    near = texts.where("not apart").drop("apart").repartition("key").sortWithinPartitions("key").mapInArrow(compare, SPANS_DDL)

    def strings_of(b):
        for doc, copy, start, strings, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "start", "strings", "text"))):
            h = np.array([xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(strings)], dtype=np.uint64).view(np.int64)
            s = np.array([xxhash.xxh3_64_intdigest(raw[i : i + length], 1) for i in range(strings)], dtype=np.uint64).view(np.int64)
            at = start + np.arange(strings)
            yield h, s, np.full(strings, doc), np.full(strings, copy), at, np.ones(strings, np.int64), at, np.zeros(strings, bool)

    single = texts.where("apart").mapInArrow(lambda x: _first_of_task(x, strings_of), ATOMS_DDL)
    far = first_of_all(single).where("sure").select("doc_id", "copy", "start", "strings")
    return sure.union(near).union(far)


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, copy, bytes: copy tells texts of the same doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8("text")).alias("copy"), utf8("text").alias("bytes"), *carry)


def deduplicate(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes) and kept_text of every row (the bytes' text; a
    character that a passage's edge cuts in two is left out of it).

    Every byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or same document and
    earlier start) goes; strings are judged on the input. Null texts are empty; texts under `length` bytes stay
    whole; no documents give no rows. Different texts of one doc_id rank by their hash; rows that repeat doc_id and
    text are one document, returned each time with the same result. Rows of null doc_id stay as they are. carry: columns of docs that stand
    beside the row's result; ValueError for one of a result's name.
    """
    session(docs.sparkSession)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    if clash := {"doc_id", "copy", "bytes", "spans", *[c.split()[0] for c in ddl.split(", ")]} & set(carry):
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    rows = keyed(docs, carry)
    spans = repeated_spans(rows.where("doc_id is not null").select("doc_id", "copy", "bytes"), length).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "strings")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_text", pa.string())])

    def remove(batches):
        for b in batches:
            out = [[] for _ in schema]
            for doc, raw, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "bytes", "spans"))):
                kept, removed, runs_, end, at = [], 0, 0, -1, 0
                for s in sorted((x["start"], x["start"] + x["strings"] + length - 1) for x in spans or ()):
                    if s[0] > end:
                        if end >= 0:
                            removed += end - begin
                            runs_ += 1
                            kept.append(raw[at:begin])
                            at = end
                        begin, end = s
                    else:
                        end = max(end, s[1])
                if end >= 0:
                    removed += end - begin
                    runs_ += 1
                    kept.append(raw[at:begin])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                for c, v in zip(out, (doc, len(raw), removed, runs_, left, left.decode("utf-8", "ignore"))):
                    c.append(v)
            own = table(schema, *out)
            yield pa.RecordBatch.from_arrays([*own.columns, *map(b.column, carry)], names=[*schema.names, *carry])

    result = StructType([*StructType.fromDDL(ddl), *docs.select(*carry).schema])
    return rows.join(spans, ["doc_id", "copy"], "left").select("doc_id", "bytes", "spans", *carry).mapInArrow(remove, result)
