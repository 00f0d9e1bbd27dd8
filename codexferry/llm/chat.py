"""Preference pairs: one prompt, two masked completions; DataFrame functions only.

Chosen and rejected conversations of a pair are compared turn by turn. The longest common prefix
of turns becomes the prompt and is rendered once; what follows on either side is that side's
completion. In a completion only the assistant's own words, with the mark that ends them, are to
be learned: ``*_spans`` are their character ranges (start, end), all else is masked.

The prefix ends at the smallest turn whose messages differ, found by aggregation; no conversation
is sorted or collected as a whole. Rendered text comes in rows of at most ``TURNS`` turn numbers:
an ordinary conversation is one row (chunk 0), one of any length is several, in order of chunk.

Defined results: turns are told apart by their number, null numbers come first, and gaps do not
matter. Repeated rows of a turn count once, different ones stand in order of role and text. Null
roles and texts are empty. A pair with one side only has an empty prompt and that side's
completion; equal sides are all prompt. A null pair id is a pair like any other; all its messages of
one turn number are one turn's, so a table of null ids and null turns is one list of its different
messages. Only the named columns are read, so other columns do no harm.

Texts are rendered as they are: one that holds a mark (``<|end|>``, ``<|assistant|>``) reads like a
turn to whoever parses the result. The spans come from the messages themselves and are not misled;
texts of untrusted origin should lose such marks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 256
FIRST = -(2**62)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _spans(messages: Column) -> Column:
    """Character ranges of the assistant's words and their end marks in the rendered messages."""
    kind = "array<struct<start:int,end:int>>"

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + F.length(m["role"]) + 5
        end = start + F.length(m["text"]) + 7
        own = F.when(m["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(kind))
        return F.struct(F.concat(a["spans"], own).alias("spans"), (end + 1).alias("at"))

    start = F.struct(F.array().cast(kind).alias("spans"), F.lit(0).alias("at"))
    return F.aggregate(messages, start, step, lambda a: a["spans"])


def preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(pair, chunk, prompt, chosen, rejected, spans and numbers of turns of each)."""
    empty = F.lit("")

    def side(df: DataFrame, name: str) -> DataFrame:
        message = F.struct(F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
        return df.select(F.col(pair).alias("pair"), F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("turn"), F.lit(name).alias("side"), message.alias("m"))

    both = side(chosen, "c").unionByName(side(rejected, "r"))
    own = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("m"))))
    turns = both.groupBy("pair", "turn").agg(own("c").alias("c"), own("r").alias("r"))
    ends = turns.where("c != r").groupBy(F.col("pair").alias("p")).agg(F.min("turn").alias("end"))
    turns = turns.join(ends, F.col("pair").eqNullSafe(F.col("p")), "left")
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    part = F.struct(
        "turn",
        F.when(common, F.col("c")).otherwise(none).alias("prompt"),
        F.when(common, none).otherwise(F.col("c")).alias("chosen"),
        F.when(common, none).otherwise(F.col("r")).alias("rejected"),
    )
    chunk = F.when(F.col("turn") == FIRST, F.lit(0)).otherwise(F.floor(F.col("turn") / TURNS)).cast("long")
    rows = turns.groupBy("pair", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    names = ("prompt", "chosen", "rejected")
    lists = [F.flatten(F.col(f"parts.{name}")).alias(f"m_{name}") for name in names]
    rows = rows.select("pair", "chunk", *lists)
    texts = [F.array_join(F.transform(f"m_{n}", lambda m: rendered(m["role"], m["text"])), "").alias(n) for n in names]
    spans = [_spans(F.col(f"m_{n}")).alias(f"{n}_spans") for n in names[1:]]
    counts = [F.size(f"m_{n}").alias(f"{n}_turns") for n in names]
    return rows.select(F.col("pair").alias(pair), "chunk", *texts, *spans, *counts)
