"""Views over the driver's tables that stand in for transcripts; the same expressions build them in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (phrase, whether it could stand alone): prompts open with the phrase of doc_id % 12; the whole text follows.
SEEDS = [
    ("Fix the bug in the login module: ", False), ("Ok, continue.", True), ("/fix now", True), ("Add unit tests for the login component. ", False),
    ("Why does this crash? ", False), ("Explain what does the error mean: ", False), ("Please review and check the README. ", False), ("ok, use PyQt6 and continue with ", False),
    ("Refactor the SQL query and the database schema ", False), ("./src/app.tsx", True), ("here is the context you should return ", False), ("", False),
]

_PHRASE = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(SEEDS)) + " ELSE '' END"
PROMPTS = [
    "doc_id AS row_id", "source AS full_name", "concat('h', CAST(doc_id % 3 AS STRING), '.md') AS source_file",
    "CAST(row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) AS INT) AS turn_index", f"concat({_PHRASE}, coalesce(text, '')) AS prompt_text",
    "doc_id % 7 < 3 AS has_generated_code", "doc_id % 5 = 0 AS has_tool_use", "CAST(CASE WHEN doc_id % 7 < 3 THEN 1 + doc_id % 2 ELSE 0 END AS INT) AS code_block_count",
    "CASE WHEN doc_id % 7 < 3 THEN coalesce(text, '') ELSE '' END AS generated_code", "coalesce(text, '') AS agent_response",
]

#: DuckDB's spelling of the library's white space, and of characters outside ASCII that are no word characters.
WHITE_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WIDE_WHITE, _WIDE_OTHER = r"[\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"[^\x00-\x7F\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"


def ascii_twin(c: str) -> str:
    """SQL for c with each character outside ASCII as an ASCII one of its class: blank, chr(1) or underscore.

    DuckDB's \\b, \\w and \\s know ASCII only; on the twin they decide as Unicode ones do on c, place by place.
    """
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '{_WIDE_WHITE}', ' ', 'g'), '{_WIDE_OTHER}', chr(1), 'g'), '[^\\x00-\\x7F]', '_', 'g')"


#: For DuckDB, as the body of a WITH entry.
PROMPTS_SQL = f"SELECT *, {ascii_twin('prompt_text')} AS plain FROM (SELECT {', '.join(PROMPTS)} FROM documents)"
HITS = [
    "o_custkey AS full_name", "o_orderkey AS hit", "o_orderpriority AS detection_query", "o_orderstatus AS discovery_source", "o_totalprice AS stars",
    "CAST(o_orderkey % 40 AS DOUBLE) AS age_months", "o_orderkey % 300 AS size_kb", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS language",
]
HITS_SQL = f"SELECT {', '.join(HITS)} FROM orders"
CONTEXT = [
    "s_suppkey AS row_id", "concat('src', CAST(s_suppkey % 25 AS STRING)) AS full_name", "n_name AS repo_language", "CAST(s_acctbal AS DOUBLE) AS repo_stars",
]
CONTEXT_SQL = f"SELECT {', '.join(CONTEXT)} FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, full_name, source_file, turn_index, prompt_text, flags, code and response of every document, with its whole text."""
    return table(spark, sf_dir, "documents").selectExpr(*PROMPTS)


whole_prompts = prompts


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*HITS)


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).selectExpr(*CONTEXT)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: each conversation as a marked-up file."""
    from pyspark.sql import functions as F

    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "_**User**_").when(F.col("role") == "assistant", "_**Agent (m1)**_").otherwise("_**System**_")
    block = F.concat(role, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n---\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n")
    return c.groupBy("conv_id").agg(joined.alias("content")).select(F.concat(F.lit("r/"), F.col("conv_id").cast("string"), F.lit("/h.md")).alias("path"), "content")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)
