"""Repository discovery over landed search hits: normalise, aggregate signals, keep the best row, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as T


def age_months(created: str | Column, today: Column) -> Column:
    """Whole days / 30 to one decimal."""
    return F.round(F.datediff(today, F.to_timestamp(created)) / 30, 1)


def normalised(hits: DataFrame, today: Column | None = None) -> DataFrame:
    """Search results (full_name, html_url, description, ..., created_at, pushed_at, updated_at, topics array) as candidate rows."""
    today = today if today is not None else F.current_timestamp()
    when = F.coalesce("created_at", "pushed_at", "updated_at")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return hits.select(
        "full_name", F.col("html_url").alias("url"), F.substring(T.text("description"), 1, 120).alias("description"), "language",
        zero("stargazers_count").alias("stars"), zero("forks_count").alias("forks"), zero("open_issues_count").alias("open_issues"), zero("size").alias("size_kb"),
        when.alias("created_at"), "updated_at", age_months(when, today).alias("age_months"), F.array_join("topics", ", ").alias("topics"),
        *[c for c in ("detection_query", "discovery_source", "matched_path", "matched_file", "match_url") if c in hits.columns],
    )


def commits(raw: DataFrame, *keep: str) -> DataFrame:
    """sha, date, message (first line, 75 characters) and ai_flag of raw (sha, date, message), behind the columns to keep."""
    return raw.select(
        *keep, F.substring("sha", 1, 7).alias("sha"), F.substring("date", 1, 10).alias("date"),
        F.substring(F.element_at(F.split(T.text("message"), "\n"), 1), 1, 75).alias("message"), T.commit_flag("message").alias("ai_flag"),
    )


def signals(hits: DataFrame) -> DataFrame:
    """Per repository: sorted distinct joins of its signals, and their numbers (empty strings don't count)."""
    def joined(c: str) -> Column:
        return F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit(""))))

    found = {"detected_by": "detection_query", "discovery_sources": "discovery_source", "matched_paths": "matched_path", "matched_files": "matched_file", "match_urls": "match_url"}
    sets = {new: joined(old) for new, old in found.items() if old in hits.columns}
    out = hits.groupBy("full_name").agg(*[v.alias(k) for k, v in sets.items()])
    counts = [F.size("detected_by").alias("signal_count"), F.size("discovery_sources").alias("source_count")]
    return out.select("full_name", *[F.array_join(k, ", ").alias(k) for k in sets], *counts)


def best_rows(hits: DataFrame, tie: str = "url") -> DataFrame:
    """The hit with most stars of each repository; ties by the smallest tie column (null first)."""
    place = F.struct((-F.coalesce(F.col("stars"), F.lit(-1))).alias("a"), F.col(tie).alias("b"))
    one = hits.groupBy("full_name").agg(F.min_by(F.struct(*hits.columns), place).alias("r"))
    return one.select("r.*")


def strict(df: DataFrame) -> DataFrame:
    return df.where((F.col("stars") >= 5) & (F.col("age_months") >= 3) & (F.col("size_kb") >= 50) & F.col("language").isNotNull())


def candidates(hits: DataFrame, tie: str = "url", relaxed: bool = True) -> DataFrame:
    """Best rows with their signals, ranked: signal_count, then stars, then name."""
    drop = [c for c in ("detection_query", "discovery_source", "matched_path", "matched_file", "match_url") if c in hits.columns]
    out = best_rows(hits, tie).drop(*drop).join(signals(hits), "full_name")
    return (out if relaxed else strict(out)).orderBy(F.desc("signal_count"), F.desc("stars"), "full_name")


def summary(cands: DataFrame) -> DataFrame:
    return cands.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("signal_count") > 1).alias("multi_signal"))
