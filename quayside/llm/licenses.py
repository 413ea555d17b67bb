"""License scans by an exact set-similarity join, by DataFrame functions only.

A text's blocks, for a template of m words, are the runs of 3/2 m words (wherever lines end) that start at one of the
template's words. A template matches a block that has at least `threshold` of its distinct words.

Words are ordered by how many texts have them, rarest first. If a block has t of a template's n words, then one of them is
among the template's n - t + 1 rarest: its prefix. The prefixes of all templates are one table of words; the texts' places
of such words meet it by an equi-join on the word, which names the templates and the stretches of text where a block may
match. A stretch with fewer than t of the templates' words fails (length filter), as does one in which, after the first word
in common, wherever it stands in the template's order and in the stretch's, fewer than t - 1 words are left (positional
filter). In what is left every block is counted exactly. The plan is the same whatever the number of templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import written
from quayside.llm.license_texts import NOTICES, TEXTS

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (*NOTICES, *TEXTS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(low: Column) -> Column:
    """The words of a text whose A-Z are lowered, in order."""
    return F.array_remove(F.split(low, BREAK), "")


def _words_of(text: str) -> list[str]:
    """The same of a template's ASCII text."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


class Template:
    """A template's label, distinct words, how many of them a block must have, and the length of its blocks."""

    def __init__(self, label: str, text: str, threshold: float):
        own = _words_of(text)
        self.label, self.words = label, sorted(set(own))
        self.least = max(1, -(-len(self.words) * round(threshold * 1000) // 1000))
        self.block = -(-3 * len(own) // 2)


def _texts(row: Column, words_: list[str]) -> Column:
    return F.array_intersect(row, F.array(*map(F.lit, words_)))


def known_words(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def word_counts(texts: DataFrame, templates: list[Template]) -> dict[str, int]:
    """How many texts have each of the templates' words. texts: ws (words in order)."""
    has = texts.select(F.explode(_texts(F.col("ws"), known_words(templates))).alias("w"))
    return {r.w: r.n for r in has.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the templates' words


class Index:
    """The templates in the order of their words: rarest first."""

    def __init__(self, templates: list[Template], counts: dict[str, int]):
        self.templates = templates
        self.order = sorted(known_words(templates), key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.order)}
        self.ordered = [sorted(t.words, key=rank.get) for t in templates]
        self.prefixes = [(w, k, i) for k, (t, own) in enumerate(zip(templates, self.ordered)) for i, w in enumerate(own[: len(own) - t.least + 1])]
        self.prefix_words = sorted({w for w, _, _ in self.prefixes})
        self.least = min((t.least for t in templates), default=1)

    def prefix_table(self, spark) -> DataFrame:
        """w, k (the template's number), place (in the template's order)."""
        return spark.createDataFrame(self.prefixes, "w string, k int, place int")

    def table(self, spark) -> DataFrame:
        """k, label, n (words), t (least in common), block (words of a block), template (words, rarest first)."""
        rows = [(k, t.label, len(t.words), t.least, t.block, own) for k, (t, own) in enumerate(zip(self.templates, self.ordered))]
        return spark.createDataFrame(rows, "k int, label string, n int, t int, block int, template array<string>")


def stretches(rows: DataFrame, index: Index) -> DataFrame:
    """row, k, g, place: the stretches of `block` words (the g-th of the text) in which a prefix word of the template stands,
    and the least place of such a word in the template's order. rows: row, ws."""
    wanted = F.array(*map(F.lit, index.prefix_words))
    at = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(wanted, x["w"]))
    found = rows.select("row", F.explode(at).alias("x")).select("row", "x.i", "x.w")
    met = found.join(index.prefix_table(rows.sparkSession), "w").join(index.table(rows.sparkSession).select("k", "block"), "k")
    return met.groupBy("row", "k", F.floor(F.col("i") / F.col("block")).cast("int").alias("g")).agg(F.min("place").alias("place"))


def candidates(found: DataFrame, rows: DataFrame, index: Index, positional: bool = True) -> DataFrame:
    """The stretches that pass the length and positional filters, with their template and `region`: the words of all blocks
    that have a word of the stretch, which begin at its first `n_starts` places."""
    met = found.join(index.table(rows.sparkSession), "k").join(rows.select("row", "ws"), "row")
    begin = F.greatest(F.col("block") * (F.col("g") - 1) + 1, F.lit(0))
    met = met.withColumn("begin", begin).withColumn("n_starts", F.col("block") * (F.col("g") + 1) - F.col("begin"))
    met = met.withColumn("region", F.slice("ws", F.col("begin") + 1, F.col("n_starts") + F.col("block"))).drop("ws")
    # the region's words that any template has, rarest first
    met = met.withColumn("has", F.array_intersect(F.array(*map(F.lit, index.order)), "region")).where(F.size("has") >= F.col("t"))
    first = F.get(F.array_intersect("template", "has"), F.lit(0))
    met = met.withColumn("first", first).where("first is not null")
    left = F.least(F.col("n") - F.array_position("template", F.col("first")), F.size("has") - F.array_position("has", F.col("first")))
    return met.where(1 + left >= F.col("t")) if positional else met


def template_matches(rows: DataFrame, index: Index) -> DataFrame:
    """row, label, containment: the best containment of every label's templates met in the text. rows: row (tells rows
    apart), ws (words in order)."""
    met = candidates(stretches(rows, index), rows, index)
    starts = F.filter(F.transform(F.slice("region", F.lit(1), F.col("n_starts")), lambda w, i: F.when(F.array_contains("template", w), i)), lambda i: i.isNotNull())
    common = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("region", i + 1, F.col("block")), F.col("template"))))
    met = met.select("row", "label", "n", "t", F.array_max(common).alias("common"))
    return met.where(F.col("common") >= F.col("t")).groupBy("row", "label").agg(F.max(F.col("common") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Null and empty texts have no words, no places and empty labels. score: 1 where a phrase stands, else the best
    containment of a template, else 0. Repeated rows each give a row; no rows: none. The texts are read twice, for the
    statistics of words and for the scan; what is written and read again has the words of those texts only that have a
    prefix word and enough of the templates' words.
    """
    own = [Template(label, text, threshold) for label, text in templates]
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    index = Index(own, word_counts(docs.select(words(low).alias("ws")), own)) if own else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.translate("text", UPPER, LOWER)).withColumn("ws", words(F.col("low")))
    lists = {p: p.split() for p in phrases}

    def places(p: str) -> Column:
        def here(i: Column) -> Column:
            out = F.lit(True)
            for k, w in enumerate(lists[p]):
                out = out & (F.get(F.col("ws"), i + k) == w)
            return F.coalesce(out, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0))), here)

    # as text, so that most rows need no look at single words
    stands = F.col("low").rlike("|".join(BREAK.join(p) for p in lists.values()))
    rows = rows.select("doc_id", "ws", F.size("ws").cast("long").alias("n_words"), *[F.when(stands, places(p)).alias(f"p{k}") for k, p in enumerate(phrases)])
    if index:
        may = (F.size(_texts(F.col("ws"), index.prefix_words)) > 0) & (F.size(_texts(F.col("ws"), index.order)) >= index.least)
    rows = rows.withColumn("ws", F.when(may if index else F.lit(False), F.col("ws"))).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows)
    kept = rows.where("ws is not null").select("row", "ws")
    best = template_matches(kept, index) if index else kept.select("row", F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    best = best.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    nothing = F.array().cast("array<string>")
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(phrases.values())]))
    every = F.flatten(F.array(*[F.coalesce(F.col(f"p{k}"), F.array().cast("array<int>")) for k in range(len(phrases))]))
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    counted = rows.select("row", "doc_id", "n_words", base.alias("base"), every.alias("every"))
    return counted.join(best, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("more", nothing))).alias("labels"),
        F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
