"""Operator 6: chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it are the text, and only its reply
is under the loss mask, given as a span (loss_start, loss_chars) in code points. Turns after the last
assistant turn become one example without a trainable span, so that no turn is lost.

Template, one turn after the other::

    <s>ROLE[INST]TEXT[/INST]</s>

Inside roles and texts a control string gets a backslash after its first character (one more if it has
some there already), which is undone by taking one away: any text comes back exactly.

Defined results: turns go by turn number, then role, then text (nulls first, counted as empty in the
output); rows repeated exactly are turns of their own; a null conv_id is a conversation like any other;
extra columns are ignored; an empty table gives an empty result. A conversation's examples grow with the
square of its turns, which is what the format asks for; its turns are gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A control string behind its first character; group 2 holds escaping backslashes.
_TAIL = r"(/?s>|/?INST\])"
TURN, TEXT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*){_TAIL}", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*){_TAIL}", r"$1$2$3")


def expand(turns: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, example (0, 1, ...), text, loss_start, loss_chars (0: nothing is trainable), from conv_id, turn, role, text."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    head = F.concat(F.lit(TURN), escape(blank("role")), F.lit(TEXT))
    body = escape(blank("text"))
    one = F.struct(
        F.col("turn"),
        F.col("role").alias("raw_role"),
        F.col("text").alias("raw_text"),
        F.concat(head, body, F.lit(CLOSE + END)).alias("formatted"),
        F.length(head).alias("head"),
        F.length(body).alias("body"),
        (blank("role") == trainable_role).alias("trainable"),
    )
    whole = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Positions (from 1) at which an example ends: each trainable turn, and the last turn.
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda k: F.element_at("ts", k)["trainable"] | (k == F.size("ts")))
    exploded = whole.select("conv_id", "ts", F.posexplode(ends).alias("example", "k"))
    context = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("k") - 1), lambda t: t["formatted"]), "")
    last = F.element_at("ts", F.col("k"))
    return exploded.select("conv_id", "example", context.alias("context"), last.alias("last")).select(
        "conv_id",
        "example",
        F.concat("context", "last.formatted").alias("text"),
        F.when(F.col("last.trainable"), F.length("context") + F.col("last.head")).otherwise(0).alias("loss_start"),
        F.when(F.col("last.trainable"), F.col("last.body")).otherwise(0).alias("loss_chars"),
    )


def parse(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text: nothing inside turns equals a control string unescaped."""
    turns = F.split(text, END, -1)
    opened = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(
        opened,
        lambda t: F.struct(
            unescape(F.substring_index(t.substr(F.lit(len(TURN) + 1), F.length(t)), TEXT, 1)).alias("role"),
            unescape(
                F.substring_index(t, TEXT, -1).substr(F.lit(1), F.length(F.substring_index(t, TEXT, -1)) - len(CLOSE))
            ).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples' texts and spans; the longest example holds all turns."""
    loss = F.when(F.col("loss_chars") > 0, unescape(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_chars")))).otherwise("")
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    turns = per.withColumn("turns", parse(F.col("longest")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
