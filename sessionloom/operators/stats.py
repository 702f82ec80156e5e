"""Corpus statistics: per-repository figures, concentration, prevalence, missing values, leakage.

Percentages are unrounded here; reports round them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions import vocab as V


def rate(c: str | Column) -> Column:
    """Mean of a flag; null counts as false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def percent(c: str | Column) -> Column:
    return 100 * rate(c)


def repo_stats(df: DataFrame, repo: str = "full_name") -> DataFrame:
    words = T.word_count("prompt_text")
    return df.groupBy(repo).agg(
        F.count(F.lit(1)).alias("prompts"),
        F.sum(F.coalesce(F.col("has_generated_code"), F.lit(False)).cast("long")).alias("with_code"),
        F.median(words).alias("median_words"),
        rate("has_generated_code").alias("code_rate"),
        rate("has_tool_use").alias("tool_rate"),
    )


def with_train_repo_stats(df: DataFrame, is_train: Column, repo: str = "full_name") -> DataFrame:
    """Adds train-only repo_*_train columns; repositories unseen in training get the training means.

    The median of words of unseen repositories is over all rows, as in the definition that this follows.
    """
    rows = df.withColumn("_w", T.word_count("prompt_text"))
    train = rows.where(is_train)
    stats = train.groupBy(repo).agg(
        F.count(F.lit(1)).alias("repo_prompt_count_train"), F.median("_w").alias("repo_median_words_train"),
        rate("has_generated_code").alias("repo_code_rate_train"), rate("has_tool_use").alias("repo_tool_rate_train"),
    )
    means = train.agg(rate("has_generated_code").alias("_code"), rate("has_tool_use").alias("_tool"))
    medians = rows.agg(F.median("_w").alias("_median"))
    out = rows.join(stats, repo, "left").crossJoin(F.broadcast(means)).crossJoin(F.broadcast(medians))  # one row each
    fills = {
        "repo_prompt_count_train": F.lit(1), "repo_median_words_train": F.col("_median"),
        "repo_code_rate_train": F.col("_code"), "repo_tool_rate_train": F.col("_tool"),
    }
    return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in fills.items()}).drop("_w", "_code", "_tool", "_median")


def with_repo_stats(df: DataFrame, repo: str = "full_name") -> DataFrame:
    """Adds repo_prompt_count, repo_median_words, repo_code_rate, repo_tool_rate over all rows."""
    s = repo_stats(df, repo).select(
        repo, F.col("prompts").alias("repo_prompt_count"), F.col("median_words").alias("repo_median_words"),
        F.col("code_rate").alias("repo_code_rate"), F.col("tool_rate").alias("repo_tool_rate"),
    )
    return df.join(s, repo, "left")


def intent_behaviour(df: DataFrame) -> DataFrame:
    return df.groupBy("primary_intent").agg(
        F.count(F.lit(1)).alias("n"), percent("has_generated_code").alias("pct_code"), percent("has_tool_use").alias("pct_tool"),
        F.median(F.length(T.text("agent_response"))).alias("median_response_chars"),
    )


def linguistic_summary(df: DataFrame) -> DataFrame:
    x = T.linguistics("prompt_text")
    return df.agg(
        F.median(x["char_len"]).alias("median_chars"), F.median(x["word_len"]).alias("median_words"), F.median(x["line_count"]).alias("median_lines"),
        percent(x["has_question"]).alias("pct_questions"), percent(x["starts_imperative"]).alias("pct_imperative_open"),
        percent(x["has_code_mention"]).alias("pct_mention_code"), percent(x["line_count"] > 3).alias("pct_multiline_gt3"),
    )


def intent_prevalence(df: DataFrame) -> DataFrame:
    """intent, pct: one pass, then one row an intent."""
    one = df.agg(*[percent(T.has("prompt_text", p)).alias(k) for k, p in V.INTENTS.items()])
    return one.unpivot([], list(V.INTENTS), "intent", "pct")


def code_stats(df: DataFrame) -> DataFrame:
    chars = F.length(T.text("agent_response"))
    return df.agg(
        F.count(F.lit(1)).alias("n"), percent("has_generated_code").alias("pct_code"), percent("has_tool_use").alias("pct_tool"),
        F.median(chars).alias("median_response_chars"), F.median(F.length(T.text("generated_code"))).alias("median_code_chars"),
        F.avg(T.code_to_text_ratio("generated_code", "agent_response")).alias("mean_code_ratio"),
    )


def _sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("x"))


def gini(sizes: DataFrame, x: str = "x") -> DataFrame:
    """One row: the Gini coefficient of column x; 0 for no rows or a zero sum.

    Ranks come from counts of equal values, so the ordered part holds distinct values only: a running
    total over them replaces a global rank of all rows.
    """
    per = sizes.groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy("v"))
    ranked = per.withColumn("rank_sum", F.col("c") * (2 * upto - F.col("c") + 1) / 2)
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    g = 2 * F.sum(F.col("rank_sum") * F.col("v")) / (n * total) - (n + 1) / n
    return ranked.agg(F.coalesce(F.when(total > 0, g), F.lit(0.0)).alias("gini"))


def diversity(df: DataFrame, repo: str = "full_name", file: str = "source_file") -> DataFrame:
    """One row: Gini of repositories and files, share of the 10 largest, Herfindahl index, effective number."""
    sizes = _sizes(df, repo)
    total = sizes.agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"), F.count(F.lit(1)).alias("repos"))
    top = sizes.orderBy(F.desc("x"), repo).limit(10).agg(F.sum("x").alias("top10"))
    hhi = F.col("squares") / (F.col("total") * F.col("total"))
    # One row each.
    joined = total.crossJoin(top).crossJoin(gini(sizes).withColumnRenamed("gini", "repo_gini")).crossJoin(gini(_sizes(df, file)).withColumnRenamed("gini", "file_gini"))
    return joined.select("repos", "repo_gini", "file_gini", (100 * F.col("top10") / F.col("total")).alias("top10_pct"), hhi.alias("hhi"), (1 / hhi).alias("effective_n"))


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "column", "missing").select("column", "missing", (100 * F.col("missing") / F.col("_n")).alias("pct"))


def distribution(df: DataFrame, label: str, name: str | None = None) -> DataFrame:
    """label, class, n, pct; nulls are left out."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(name or label).alias("label"), "class", "n", (100 * F.col("n") / F.sum("n").over(W.partitionBy())).alias("pct"))


def label_audit(df: DataFrame, row_id: str = "row_id", *keep: str) -> DataFrame:
    """row_id, full_name, flags, audit_category and a preview of 200 characters on one line, behind it the columns to keep."""
    return df.select(
        row_id, "full_name", T.audit_flags("prompt_text").alias("flags"), T.audit_category("prompt_text", "has_generated_code").alias("audit_category"),
        F.translate(F.substring(T.text("prompt_text"), 1, 200), "\n", " ").alias("prompt_preview"), *keep,
    )


def label_audit_top(audit: DataFrame, most: int = 50, row_id: str = "row_id") -> DataFrame:
    """The first inconsistent rows, a report of most rows."""
    return audit.where("audit_category <> 'consistent'").orderBy(row_id).limit(most)


def imbalance(df: DataFrame, label: str, few: int = 30) -> DataFrame:
    """One row: classes, majority share, classes of fewer than few rows, entropy."""
    p = F.col("pct") / 100
    return distribution(df, label).agg(
        F.count(F.lit(1)).alias("classes"), (F.max("pct") / 100).alias("majority_share"), F.count_if(F.col("n") < few).alias("minority_classes"),
        F.sum(-p * F.log(p + 1e-12)).alias("entropy"),
    )


def duplicate_counts(df: DataFrame, text: str = "prompt_text") -> DataFrame:
    """One row: rows beyond the first of equal texts, exactly and lower-cased and stripped."""
    count = lambda key: df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    a = count(F.col(text)).withColumnRenamed("n", "exact_duplicates")
    return a.crossJoin(count(F.lower(T.strip(text))).withColumnRenamed("n", "normalised_duplicates"))  # one row each


def leakage_stats(df: DataFrame, repo: str = "full_name", file: str = "source_file", text: str = "prompt_text") -> DataFrame:
    """One row: distinct repositories, files and sessions, and texts found in more than one repository."""
    spread = df.groupBy(text).agg(F.min(repo).alias("lo"), F.max(repo).alias("hi")).agg(F.count_if(F.col("lo") < F.col("hi")).alias("texts_in_many_repos"))
    one = df.agg(F.countDistinct(repo).alias("repos"), F.countDistinct(file).alias("files"), F.countDistinct(T.session_id(repo, file)).alias("sessions"))
    return one.crossJoin(spread)  # one row each


def label_summary(df: DataFrame, label: str = "action_type") -> DataFrame:
    return distribution(df, label).select(F.col("class").alias(label), "n", "pct")


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Frequency, descending, ties by value; most: a top-k report."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(most) if most else out
