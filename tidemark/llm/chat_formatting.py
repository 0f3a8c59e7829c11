"""Chat formatting by event sourcing: logs become final messages, messages become one formatted text.

Events carry (conv_id, message, seq, kind, role, text). ``message`` orders and names a message within its
conversation. Kinds: ``open`` starts a message (role, first text), ``delta`` appends, ``edit`` replaces the text,
``regenerate`` discards it (deltas that follow build the new one), ``delete`` removes the message.

Folding is by message, so a conversation of very many events is spread over tasks; only the few final messages
of a conversation meet, where its one text is written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\])"
"""First characters of control strings: this template's and those of common others."""


def escape(text: Column) -> Column:
    """Doubles each backslash and puts one behind the first character of each control string."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({CONTROL})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text). Events apply by seq; equal seqs by kind, role and text; nulls first.

    Exactly repeated events count once, as a log delivered twice. A message without a role keeps null; the last
    role given counts. A message whose last open, delta, edit or regenerate comes before a delete is gone.
    """
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(F.struct("seq", "kind", "role", "text"))).alias("log"))
    starts = F.transform("log", lambda e, i: F.when(e["kind"].isin("open", "edit", "regenerate", "delete"), i + 1).otherwise(F.lit(0)))
    at = F.greatest(F.array_max(starts), F.lit(1))
    tail = F.filter(F.slice("log", F.col("at"), F.size("log")), lambda e: e["kind"] != "delete")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    found = log.withColumn("at", at).withColumns({"tail": tail, "roles": roles}).where(F.size("tail") > 0)
    return found.select("conv_id", "message", F.when(F.size("roles") > 0, F.element_at("roles", -1)).alias("role"), F.array_join(F.transform("tail", lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (code point ranges [start, end) of ``formatted``)."""
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + size(t)).alias("at"),
            F.when(t["role"] == loss_role, F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("a"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("b"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def format_rows(conversations: DataFrame) -> DataFrame:
    """Events of a table of finished turns (conv_id, turn, role, text): one ``open`` with the role, one ``delta`` with the text.

    Turns are ordered by turn, then role and text; nulls first. A null turn, role or text is kept (empty text);
    rows that repeat are turns of their own. Extra columns aren't read.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    steps = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("open").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text")),
    )
    return rows.select("conv_id", "message", F.explode(steps).alias("e")).select("conv_id", "message", "e.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of ``render``'s output, from the formatted text alone: see the query's columns."""
    turn = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns, whole, loss, chars, at = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                for m in turn.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv}: stray text at {at}")
                    turns, at = turns + 1, m.end()
                    whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv}: stray text at {at}")
                for span in spans:
                    part = unescape(text[span["a"] : span["b"]])
                    chars += len(part)
                    loss.update(part.encode())
                rows.append((conv, turns, whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col("conv_id").cast("long"), "formatted", "loss_spans").mapInArrow(read, schema)
