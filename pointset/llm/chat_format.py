"""Chat formatting by prefix-target expansion, in DataFrame functions.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.  A
conversation that does not end with an assistant turn gets one more example with nothing trainable, so the output holds
every turn.  Turns are marked with control strings; inside roles and texts a backslash is doubled and the opening of a control
string is broken up by one, which ``read_back`` undoes, so that no text can pass for markup.

Defined cases: a null text is empty; a null role is an empty role, which is not the assistant; turns with equal numbers come
in the order of role and text, a null number first; rows that repeat a turn are turns of their own; rows with a null
conversation id are one conversation.  Examples are as many as a conversation has assistant turns, each with its whole
context: that output is quadratic in a conversation's turns by its nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example, n_turns, formatted, loss_start and loss_length (characters of ``formatted`` that are trainable)."""
    c = lambda x: F.col(f"`{x}`")
    turn = F.struct(c(turn_col).alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    turns = conversations.select(c(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    drawn = turns.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == target).alias("trained"), F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(END)).alias("drawn"), F.char_length(escaped(t["text"])).alias("n"))).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(F.col("turns"), i)["trained"] | (i == n))
    each = drawn.select("conv_id", "turns", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    formatted = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end")), lambda t: t["drawn"]), "")
    out = each.select("conv_id", "example", F.col("end").alias("n_turns"), formatted.alias("formatted"), last["trained"].alias("trained"), last["n"].alias("n"))
    tail = F.char_length("formatted") - len(END) - F.col("n")
    return out.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("trained"), tail).otherwise(0).alias("loss_start"), F.when(F.col("trained"), F.col("n")).otherwise(0).alias("loss_length"), "trained")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p)))
    return F.transform(body, lambda p: F.struct(unescaped(F.substring_index(p, MIDDLE, 1)).alias("role"), unescaped(F.substring_index(p, MIDDLE, -1)).alias("text")))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescaped(F.substring(formatted, start + 1, length))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, trainable texts, sizes."""
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))))).alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    read = by.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars", "n_examples")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
