"""Sources: landed API pages, transcript files, CSV datasets, Parquet caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import text as X

#: Derived columns that are dropped at load, so that they are computed anew, and defaults of missing ones.
STALE = [
    "cluster", "umap_x", "umap_y", "char_len", "word_len", "line_count", "has_question", "has_code_mention", "starts_imperative",
    "intent_debug_fix", "intent_implement", "intent_refactor", "intent_explain", "intent_test", "intent_documentation", "intent_review", "intent_configure",
    "intent_ui_frontend", "intent_data_sql", "intent_count", "primary_intent", "agent_len", "code_to_text_ratio",
]
DEFAULTS = {
    "agent_response": "", "generated_code": "", "agent_model": "", "code_languages": "", "code_block_count": 0, "has_generated_code": False, "has_tool_use": False,
}
MOST_BYTES = 25_000_000

REPO = T.StructType([
    T.StructField(n, t)
    for n, t in [
        ("full_name", T.StringType()), ("html_url", T.StringType()), ("description", T.StringType()), ("language", T.StringType()),
        ("stargazers_count", T.LongType()), ("forks_count", T.LongType()), ("open_issues_count", T.LongType()), ("size", T.LongType()),
        ("created_at", T.StringType()), ("pushed_at", T.StringType()), ("updated_at", T.StringType()), ("topics", T.ArrayType(T.StringType())),
    ]
])
PAGE = T.StructType([T.StructField("total_count", T.LongType()), T.StructField("items", T.ArrayType(REPO))])
CODE_ITEM = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("html_url", T.StringType()), T.StructField("repository", REPO)
])
CODE_PAGE = T.StructType([T.StructField("total_count", T.LongType()), T.StructField("items", T.ArrayType(CODE_ITEM))])


def search_pages(spark: SparkSession, path: str, query: str, most: int = 1000) -> DataFrame:
    """Hits of a repository search from landed JSON pages, in page order, most at most (the API's own limit)."""
    pages = spark.read.schema(PAGE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("_page"), "items")
    hits = pages.select("_page", F.posexplode("items").alias("_pos", "r")).orderBy("_page", "_pos").limit(most)
    return hits.select("r.*").withColumns({"detection_query": F.lit(query), "discovery_source": F.lit("repo_search")})


def code_pages(spark: SparkSession, path: str, query: str, details: DataFrame, most: int = 1000) -> DataFrame:
    """Hits of a code search, with their repository's details; a hit without details keeps what the hit says."""
    pages = spark.read.schema(CODE_PAGE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("_page"), "items")
    hits = pages.select("_page", F.posexplode("items").alias("_pos", "i")).orderBy("_page", "_pos").limit(most)
    found = hits.select("i.repository.full_name", F.col("i.path").alias("matched_path"), F.col("i.name").alias("matched_file"), F.col("i.html_url").alias("match_url"), F.col("i.repository").alias("_own"))
    d = details.select(*[f.name for f in REPO.fields]).dropDuplicates(["full_name"])
    joined = found.join(d, "full_name", "left")
    kept = [F.coalesce(F.col(f.name), F.col("_own")[f.name]).alias(f.name) for f in REPO.fields if f.name != "full_name"]
    return joined.select("full_name", *kept, "matched_path", "matched_file", "match_url").withColumns({"detection_query": F.lit(query), "discovery_source": F.lit("code_search")})


def is_history_file(path: str | Column, root: str, fragment: str) -> Column:
    p = F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/")))
    return p.contains(fragment) | (p.contains(root) & p.endswith(".md"))


def transcripts(spark: SparkSession, path: str, root: str = "", fragment: str = "", depth: int = 5) -> DataFrame:
    """path, content of the transcript files below path, decoded as UTF-8, newlines normalised.

    Files over MOST_BYTES, or deeper than depth folders below path, are left out, as is what the path
    predicate rejects (no predicate: every .md file).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    below = F.size(F.split(F.element_at(F.split("path", F.lit(path.rstrip("/").split("://")[-1].replace(".", r"\."))), -1), "/")) - 2
    kept = files.where((F.col("length") <= MOST_BYTES) & (below <= depth))
    if root or fragment:
        kept = kept.where(is_history_file("path", root, fragment))
    return kept.select("path", X.normalise_newlines(F.decode("content", "UTF-8")).alias("content"))


def decoded(payloads: DataFrame, column: str = "content") -> DataFrame:
    """Adds text: base64 file contents of an API payload, decoded; empty where that fails."""
    raw = F.try_to_binary(F.replace(X.text(column), F.lit("\n"), F.lit("")), F.lit("base64"))
    return payloads.withColumn("text", F.coalesce(X.normalise_newlines(F.decode(raw, "UTF-8")), F.lit("")))


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A header CSV with quoted multi-line fields; without a schema all columns are strings (nothing is scanned to infer types)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def latest(spark: SparkSession, folder: str, pattern: str) -> str:
    """The lexicographically last path in a folder that fits a glob; an error if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = where.getFileSystem(conf).globStatus(where)
    paths = sorted(str(f.getPath()) for f in (found or []))
    if not paths:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return paths[-1]


def with_defaults(df: DataFrame) -> DataFrame:
    """Without stale columns, with missing ones defaulted."""
    out = df.drop(*[c for c in STALE if c in df.columns])
    return out.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in df.columns})


def prompts(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return with_defaults(csv(spark, path, schema))


def labelled(df: DataFrame, preferred: list[str] = ("llm_action_type", "action_type")) -> tuple[DataFrame, str]:
    """Rows with a label, and which column holds it: the first preferred one with any non-empty value."""
    for name in preferred:
        if name in df.columns:
            some = df.where(F.col(name).isNotNull() & (F.col(name) != ""))
            if not some.isEmpty():
                return some, name
    raise ValueError(f"none of {list(preferred)} holds a label")


def fetch_missing(names: DataFrame, cache: DataFrame, fetch, schema: str) -> DataFrame:
    """The cache and what fetch(batches of names) returns for distinct names that it lacks; failed rows (_error) aren't kept."""
    todo = names.select("full_name").distinct().join(cache.where("_error IS NULL").select("full_name"), "full_name", "left_anti")
    new = todo.mapInPandas(fetch, schema)
    good = cache.where("_error IS NULL")
    return good.unionByName(new, allowMissingColumns=True)



def query_catalogue(spark: SparkSession, repo_queries: list[tuple[str, str]], code_queries: list[tuple[str, str]]) -> DataFrame:
    rows = [("repo_search", *q) for q in repo_queries] + [("code_search", *q) for q in code_queries]
    return spark.createDataFrame(rows, "source string, signal string, query string")
