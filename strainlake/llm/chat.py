"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into one
block by array aggregation, and blocks are concatenated:

    <|im_start|>role
    first text<|im_turn|>next text of the same role<|im_end|>

Control strings begin with ``<|``; in texts and roles that becomes ``<\\|`` and a backslash is doubled (a line break in
a role has a sequence of its own), so nothing in a text can read as a mark and everything can be read back exactly.
The loss mask is an array of (start, length) spans, in code points of the formatted string: one for each text of an
assistant turn, without the marks around it.

Defined cases: null text and null role count as empty; turns of equal number are ordered by role, then text; null
turn numbers come first; repeated rows are turns of their own; conversations with a null id form one; other columns
are not read.  A conversation is one row of the result, so it has to fit into a task, as its formatted string does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlake.llm.arrays import bound, cut, sums_before

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>"
ASSISTANT = "assistant"
#: A line break inside a role; no escaped text holds it, as its backslashes come in pairs or stand between < and |.
LINE = "<\\n|"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (string), loss (array of start and length) of every conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    raw = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("raw"))
    shown = F.transform("raw", lambda t: F.struct(F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)).alias("role"), escaped(t["text"]).alias("text")))
    sorted_turns = raw.select("conv_id", shown.alias("turns"))
    # a block starts where the role changes; its texts run to the next start
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    blocks = F.transform(
        "starts",
        lambda a, k: F.struct(
            F.get("turns", a)["role"].alias("role"),
            F.transform(F.slice("turns", a + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - a), lambda t: t["text"]).alias("texts"),
        ),
    )
    made = sorted_turns.withColumn("starts", starts).select("conv_id", blocks.alias("blocks"))
    strings = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], TURN), F.lit(END)))
    made = made.withColumn("strings", strings)
    # where each text starts: marks of its block, then the sum of what stands before it
    width = lambda b, t, k: F.when(k == 0, len(START) + 1 + F.length(b["role"])).otherwise(0) + F.length(t) + F.when(k == F.size(b["texts"]) - 1, len(END)).otherwise(len(TURN))
    part = lambda b, t, k: F.struct(
        (b["role"] == ASSISTANT).alias("loss"), F.when(k == 0, len(START) + 1 + F.length(b["role"])).otherwise(0).cast("bigint").alias("lead"), F.length(t).cast("bigint").alias("length"), width(b, t, k).cast("bigint").alias("width")
    )
    parts = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, k: part(b, t, k))))
    placed = lambda ps: F.zip_with(ps, sums_before(F.transform(ps, lambda p: p["width"])), lambda p, at: F.struct(p["loss"].alias("loss"), (at + p["lead"]).alias("start"), p["length"].alias("length")))
    spans = F.transform(F.filter(bound(parts, placed), lambda p: p["loss"]), lambda p: F.struct(p["start"], p["length"]))
    return made.select("conv_id", F.array_join("strings", "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, in order."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    blocks = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - len(END)), r"<\|im_turn\|>", -1),
                lambda t: F.struct(unescaped(F.replace(F.substr(b, F.lit(1), F.instr(b, "\n") - 1), F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    made = format_chats(turns).withColumn("turns", read_turns(F.col("formatted")))
    masked = cut(F.col("formatted"), F.transform("loss", lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["length"]).alias("end"))))
    made = made.withColumn("loss_text", F.array_join(F.transform(masked, unescaped), ""))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
