"""Chat formatting from an event log, by DataFrame functions only.

Events of a conversation are put in sequence and folded, left to right, into its final messages:
  message     opens a message of `role` with `text`
  delta       adds `text` to the last message (streaming)
  edit        replaces the text of message number `target` (from 1; null: the last one)
  regenerate  drops message `target` (null: the last one) and all after it, and opens an empty one of its role
Then the messages are rendered. A turn is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed.
Inside roles and texts a backslash becomes \\b, "<|" becomes <\\p, and in roles a line feed becomes \\n, so that
no marker can arise from content and every rendered conversation reads back to its messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Fixed values of the format: what stands for what, in the order of escaping.
ESCAPES = [("\\", "\\b"), ("<|", "<\\p")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "\\n")]

_MESSAGES = "array<struct<role:string,text:string>>"


def _escape(c: Column, pairs=ESCAPES) -> Column:
    for raw, coded in pairs:
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def _unescape(c: Column, pairs=ESCAPES) -> Column:
    for raw, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, messages: events (conv_id, seq, kind, target, role, text) folded in order of seq.

    Null roles and texts are empty. Events of equal seq are taken by kind, target, role and text; null seq first;
    repeated rows count each. A delta, edit or regeneration without a message to work on, or of an unknown kind,
    changes nothing. Null conv_ids are one conversation. No events: no rows.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    logs = events.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "target", role.alias("role"), text.alias("text")))).alias("log"))

    def step(done: Column, e: Column) -> Column:
        n = F.size(done)
        at = F.coalesce(e.target.cast("int"), n)
        fits = (at >= 1) & (at <= n)
        one = lambda r, t: F.array(F.struct(r.alias("role"), t.alias("text")))
        last, aimed = F.get(done, n - 1), F.get(done, at - 1)
        until = F.slice(done, F.lit(1), F.greatest(at - 1, F.lit(0)))
        return (
            F.when(e.kind == "message", F.concat(done, one(e.role, e.text)))
            .when((e.kind == "delta") & (n > 0), F.concat(F.slice(done, F.lit(1), n - 1), one(last.role, F.concat(last.text, e.text))))
            .when((e.kind == "edit") & fits, F.concat(until, one(aimed.role, e.text), F.slice(done, F.greatest(at + 1, F.lit(1)), F.greatest(n - at, F.lit(0)))))
            .when((e.kind == "regenerate") & fits, F.concat(until, one(aimed.role, F.lit(""))))
            .otherwise(done)
        )

    messages = F.aggregate("log", F.lit(None).cast(_MESSAGES), lambda acc, e: step(F.coalesce(acc, F.array().cast(_MESSAGES)), e).cast(_MESSAGES))
    return logs.select("conv_id", F.coalesce(messages, F.array().cast(_MESSAGES)).alias("messages"))


def render(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the string and the (start, length) spans, in characters, of `learn`'s texts."""
    rendered = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(START), _escape(m.role, ROLE_ESCAPES), F.lit("\n")).alias("head"), _escape(m.text).alias("body"), (m.role == learn).alias("learn")
        ),
    )
    parts = conversations.select("conv_id", rendered.alias("p"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walk = F.aggregate(
        "p",
        zero,
        lambda a, x: F.struct(
            (a.at + F.length(x.head) + F.length(x.body) + len(END)).alias("at"),
            F.when(x.learn, F.concat(a.spans, F.array(F.struct((a.at + F.length(x.head)).alias("start"), F.length(x.body).alias("length"))))).otherwise(a.spans).alias("spans"),
        ),
    )
    line = F.transform("p", lambda x: F.concat(x.head, x.body, F.lit(END)))
    return parts.select("conv_id", F.array_join(line, "").alias("formatted"), walk.spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The messages of a rendered string, as an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            _unescape(F.substring_index(t, "\n", 1), ROLE_ESCAPES).alias("role"),
            _unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t) - F.locate("\n", t) - len(END))).alias("text"),
        ),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: _unescape(F.substring(formatted, s.start + 1, s.length)))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations."""
    read = conversations.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
