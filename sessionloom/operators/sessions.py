"""Session history: every feature of a turn looks only at earlier turns. One window, one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import text as T


def with_action_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("action_type", T.action_label("prompt_text", "agent_response", "has_generated_code", "has_tool_use", "code_block_count", "generated_code"))


def with_session_features(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Adds session_id, session_turn_count, turns_before, prev_* and session_code_rate_before.

    turn_index is numbered by the ingest order only where the column is missing.
    """
    out = df.withColumn("session_id", T.session_id())
    if "turn_index" not in df.columns:
        out = out.withColumn("turn_index", F.row_number().over(W.partitionBy("session_id").orderBy(order)))
    w = W.partitionBy("session_id").orderBy("turn_index", *([order] if order in df.columns else []))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    new = {
        "session_turn_count": F.max("turn_index").over(W.partitionBy("session_id")),
        "turns_before": F.col("turn_index") - 1,
        "prev_turn_had_code": F.coalesce(F.lag(flag("has_generated_code")).over(w), F.lit(False)),
        "prev_turn_had_tools": F.coalesce(F.lag(flag("has_tool_use")).over(w), F.lit(False)),
        "session_code_rate_before": F.coalesce(F.avg(flag("has_generated_code").cast("double")).over(before), F.lit(0.0)),
    }
    if "action_type" in df.columns:
        new["prev_action_type"] = F.coalesce(F.lag("action_type").over(w), F.lit(""))
    return out.withColumns(new)


def enriched(df: DataFrame, order: str = "row_id") -> DataFrame:
    return with_session_features(with_action_labels(df), order)


def file_turn_count(df: DataFrame) -> DataFrame:
    """The other session_turn_count: per bare file name, greatest index plus one."""
    return df.withColumn("file_turn_count", F.max("turn_index").over(W.partitionBy("source_file")) + 1)


def prior_turns_text(df: DataFrame, n: int, order: str = "row_id", most: int = 300) -> DataFrame:
    """Adds context_text: up to n earlier prompts, oldest first, cut to most characters, then the current one."""
    if n <= 0:
        return df.withColumn("context_text", F.col("prompt_text"))
    with_id = df if "session_id" in df.columns else df.withColumn("session_id", T.session_id())
    w = W.partitionBy("session_id").orderBy("turn_index", order)
    past = F.collect_list(F.substring(T.text("prompt_text"), 1, most)).over(w.rowsBetween(-n, -1))
    lines = F.transform(past, lambda x, i: F.concat(F.lit("[turn -"), (F.size(past) - i).cast("string"), F.lit("] "), x))
    current = F.concat(F.lit("[current] "), T.text("prompt_text"))
    return with_id.withColumn("context_text", F.array_join(F.concat(lines, F.array(current)), "\n"))

