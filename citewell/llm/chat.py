"""Prefix-target expansion of conversations, from built-in functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is trainable.
A turn is written ``<|role:R|>\\n`` + text + ``<|end|>\\n``. Control strings inside roles and texts get one more ``!``
after their first character, which unescaping takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed: what may not stand unescaped in a text. ``!`` runs count, so that escaped strings can be escaped again.
CONTROL = r"([<\[])(!*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)"
CONTROL_ESCAPED = r"([<\[])!(!*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)"
ROLE_END, ROLE_END_ESCAPED = r"\|(!*)>", r"\|!(!*)>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1!$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ROLE_END, "|!$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, ROLE_END_ESCAPED, "|$1>"))


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, text, loss_start, loss_chars, trainable``.

    ``text`` is the formatted conversation up to and with the reply; ``loss_start`` (from 0) and ``loss_chars`` span the
    escaped reply in code points. Turns after the last reply, or of a conversation without one, end in one more example
    that is not trainable, so that no turn is lost. Turns are sorted by turn, role and text, nulls first; a null role or
    text counts as empty; repeated rows are repeated turns; a null conv_id is a conversation. Other columns are ignored.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("reply"),
                F.concat(F.lit("<|role:"), escape_role(t["role"]), F.lit("|>\n")).alias("mark"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["mark"], t["body"], F.lit("<|end|>\n"))), ""))
    # Where each turn ends: one pass over the lengths.
    ends = F.aggregate(
        "turns",
        F.array().cast("array<struct<reply:boolean,start:int,chars:int,stop:int>>"),
        lambda done, t: F.concat(
            done,
            F.array(
                F.struct(
                    t["reply"].alias("reply"),
                    (F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(0)) + F.char_length(t["mark"])).cast("int").alias("start"),
                    F.char_length(t["body"]).cast("int").alias("chars"),
                    (F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(0)) + F.char_length(t["mark"]) + F.char_length(t["body"]) + F.lit(8)).cast("int").alias("stop"),
                )
            ),
        ),
    )
    whole = whole.select("conv_id", "formatted", ends.alias("ends"), F.size("turns").alias("n"))
    targets = F.transform("ends", lambda e, i: F.struct((i + 1).alias("example"), e["reply"].alias("trainable"), e["start"].alias("start"), e["chars"].alias("chars"), e["stop"].alias("stop")))
    kept = F.filter(targets, lambda e: e["trainable"] | (e["example"] == F.col("n")))
    return whole.select("conv_id", "formatted", F.explode(kept).alias("e")).select(
        "conv_id",
        F.col("e.example").cast("long").alias("example"),
        F.substring("formatted", F.lit(1), F.col("e.stop")).alias("text"),
        F.when(F.col("e.trainable"), F.col("e.start")).otherwise(F.col("e.stop")).cast("long").alias("loss_start"),
        F.when(F.col("e.trainable"), F.col("e.chars")).otherwise(0).cast("long").alias("loss_chars"),
        F.col("e.trainable").alias("trainable"),
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    parts = F.filter(F.split(text, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring(p, F.lit(8), F.instr(p, "|>\n") - 8)).alias("role"),
            unescape(F.substring(p, F.instr(p, "|>\n") + 3, F.char_length(p))).alias("text"),
        ),
    )


def digest_examples(examples: DataFrame) -> DataFrame:
    """Read examples back: per conversation its turns (from the longest example) and what is trained on, as digests."""
    loss = F.when(F.col("trainable"), unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))).otherwise("")
    read = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    )
    turns = parse_turns(F.col("longest"))
    return read.select("conv_id", turns.alias("turns"), "loss", "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
