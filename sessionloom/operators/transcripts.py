"""Transcripts (path, content) to turn pairs, with window functions over lines.

Lines are exploded once and dealt by path; the windows and groupings that follow all keep that dealing, so
there is one shuffle. A file is the unit of work, bounded by the reader's size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions import vocab as V

PAIR_COLUMNS = ["prompt_text", "agent_response", "agent_model", "generated_code", "code_block_count", "code_languages", "has_generated_code", "has_tool_use"]


def _lines(files: DataFrame) -> DataFrame:
    split = files.select("path", F.posexplode(F.split(T.text("content"), r"\R|[\x1C-\x1E]", -1)).alias("n", "line"))
    return split.withColumn("role", T.speaker_role("line"))


def turns(files: DataFrame) -> DataFrame:
    """path, turn (1, 2, ...), role, model, body, n_lines, tool: what stands between speaker lines."""
    order = W.partitionBy("path").orderBy("n")
    numbered = _lines(files).withColumn("turn", F.sum(F.col("role").isNotNull().cast("int")).over(order)).where(F.col("turn") > 0)
    inline = T.inline_after_role("line")
    body = F.when(F.col("role").isNull(), F.col("line")).otherwise(F.nullif(inline, F.lit("")))
    grouped = numbered.groupBy("path", "turn").agg(
        F.max("role").alias("role"),
        F.max(F.when(F.col("role").isNotNull(), T.speaker_model("line"))).alias("model"),
        F.transform(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("n", body.alias("text"))))), lambda x: x["text"]).alias("lines"),
    )
    text = F.array_join("lines", "\n")
    return grouped.select("path", "turn", "role", "model", text.alias("body"), F.size("lines").alias("n_lines"), T.has_tool_block(text).alias("tool"))


def _with_code(df: DataFrame) -> DataFrame:
    blocks = df.withColumn("_blocks", T.code_blocks("agent_response"))
    langs = F.array_join(F.array_sort(F.array_distinct(F.transform("_blocks", lambda x: x["lang"]))), ", ")
    return blocks.withColumns({
        "generated_code": F.array_join(F.transform("_blocks", lambda x: x["code"]), V.CODE_JOINER),
        "code_block_count": F.size("_blocks"), "code_languages": langs, "has_generated_code": F.size("_blocks") > 0,
    }).drop("_blocks")


def _spoken(files: DataFrame) -> DataFrame:
    agent = F.col("role").isin(V.ASSISTANT_ROLES)
    island = F.sum((~agent).cast("int")).over(W.partitionBy("path").orderBy("turn"))
    t = turns(files).withColumn("island", island)
    said = F.array_sort(F.collect_list(F.when(agent, F.struct("turn", "body", "n_lines", "model"))))
    merged = t.groupBy("path", "island").agg(
        F.max(F.when(F.col("role").isin(V.USER_ROLES), F.struct("turn", "body"))).alias("user"), said.alias("said"),
        F.coalesce(F.max(F.when(agent, F.col("tool"))), F.lit(False)).alias("has_tool_use"),
    ).where(F.col("user").isNotNull())
    response = F.array_join(F.transform(F.filter("said", lambda x: x["n_lines"] > 0), lambda x: x["body"]), "\n\n")
    model = F.coalesce(F.get(F.filter(F.transform("said", lambda x: x["model"]), lambda m: F.length(m) > 0), F.lit(0)), F.lit(""))
    pairs = merged.select(
        "path", F.col("user.turn").alias("turn"), T.sanitize("user.body").alias("prompt_text"),
        T.sanitize(T.summarize_tools(response)).alias("agent_response"), model.alias("agent_model"), "has_tool_use",
    ).where(F.length("prompt_text") > 0)
    again = F.row_number().over(W.partitionBy("path", "prompt_text").orderBy("turn"))
    return _with_code(pairs.withColumn("_again", again).where("_again = 1").drop("_again"))


def _fields(files: DataFrame) -> DataFrame:
    """Prompt fields of files without any speaker line."""
    seen = F.max(F.col("role").isNotNull()).over(W.partitionBy("path"))
    prompt = T.normalise_newlines(F.regexp_extract("line", f"(?iU){V.PROMPT_FIELD}", 2))
    rows = _lines(files).withColumn("_seen", seen).where(~F.col("_seen")).select("path", F.col("n").alias("turn"), prompt.alias("prompt_text"))
    blank = {"agent_response": "", "agent_model": "", "generated_code": "", "code_languages": ""}
    return rows.where(F.length("prompt_text") > 0).withColumns(
        {k: F.lit(v) for k, v in blank.items()} | {"code_block_count": F.lit(0), "has_generated_code": F.lit(False), "has_tool_use": F.lit(False)}
    )


def turn_pairs(files: DataFrame) -> DataFrame:
    """path, turn_index (from 1, in file order) and the columns of a pair."""
    pairs = _spoken(files).unionByName(_fields(files))
    index = F.row_number().over(W.partitionBy("path").orderBy("turn"))
    return pairs.withColumn("turn_index", index).select("path", "turn_index", *PAIR_COLUMNS)


def prompts(files: DataFrame) -> DataFrame:
    return turn_pairs(files).select("path", "turn_index", "prompt_text")


def turn_records(files: DataFrame, repos: DataFrame | None = None, filter_noise: bool = True) -> DataFrame:
    """The flat table of turns; indexes are given before noise goes. repos: path, full_name, repo_url."""
    p = turn_pairs(files)
    if filter_noise:
        p = p.where(T.noise_reason("prompt_text").isNull())
    if repos is not None:
        p = p.join(repos, "path")
    else:
        p = p.withColumns({"full_name": F.regexp_extract("path", r"([^/]+/[^/]+)/[^/]*$", 1), "repo_url": F.lit("")})
    return p.select(
        "full_name", "repo_url", F.col("path").alias("source_file"), "turn_index", F.lit("session_turn_pair").alias("artifact_type"), "prompt_text",
        F.length("prompt_text").alias("prompt_length"), T.word_count("prompt_text").alias("prompt_word_count"), "agent_response",
        F.length("agent_response").alias("agent_response_length"), "agent_model", "generated_code", F.length("generated_code").alias("generated_code_length"),
        "code_block_count", "code_languages", "has_generated_code", "has_tool_use",
    )


def extraction_actions(turn_table: DataFrame) -> DataFrame:
    """action_type, n of labelled turns."""
    return turn_table.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


def extraction_summary(turn_table: DataFrame) -> DataFrame:
    return turn_table.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("full_name").alias("repos"), F.countDistinct("source_file").alias("files"),
        F.countDistinct(T.session_id()).alias("sessions"), F.count_if("has_generated_code").alias("with_code"), F.count_if("has_tool_use").alias("with_tools"),
    )
