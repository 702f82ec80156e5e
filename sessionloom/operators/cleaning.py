"""Cleaning: sanitise, drop noise, keep the first of equal prompts, cap repositories by stratum.

row_id is the order of ingest; every keep-first choice follows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions.text import CleaningConfig


@dataclass(frozen=True)
class Cleaned:
    kept: DataFrame
    dropped: DataFrame
    report: DataFrame
    reasons: DataFrame


def with_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt_length": F.length(T.text("prompt_text")), "prompt_word_count": T.word_count("prompt_text")})


def judged(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """prompt_text sanitised, with _drop_reason."""
    clean = df.withColumn("prompt_text", T.sanitize("prompt_text"))
    return clean.withColumn("_drop_reason", T.noise_reason("prompt_text", config))


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; one min a key, so rows are combined before the shuffle.

    A row is known by its order columns, which must be unique. Texts are compared by their SHA-256, so that
    32 bytes a key are shuffled and not the texts; nulls equal each other.
    """
    place = F.struct(*order)
    key = lambda c: F.unhex(F.sha2(F.col(c), 256)) if df.schema[c].dataType.typeName() == "string" else F.col(c)
    firsts = df.groupBy(*[key(c).alias(f"_key{i}") for i, c in enumerate(keys)]).agg(F.min(place).alias("_first"))
    return df.withColumn("_place", place).join(firsts.select("_first"), F.col("_place") == F.col("_first"), "left_semi").drop("_place")


def strata(df: DataFrame) -> Column:
    """action_type or primary_intent where they exist, else code and tool flags; null is a stratum of its own."""
    for name in ("action_type", "primary_intent"):
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int") if c in df.columns else F.lit(0)
    return F.concat_ws("_", flag("has_generated_code"), flag("has_tool_use"))


def allocation(df: DataFrame, cap: int, repo: str = "full_name", stratum: str = "stratum") -> DataFrame:
    """repo, stratum, n, alloc: cap rows a repository over the cap, by largest remainders; ties by stratum."""
    n = df.groupBy(repo, stratum).agg(F.count(F.lit(1)).alias("n"))
    per = W.partitionBy(repo)
    share = cap * F.col("n") / F.col("total")
    sized = n.withColumn("total", F.sum("n").over(per)).withColumn("base", F.floor(share)).withColumn("part", F.round(share - F.col("base"), 9))
    left = (F.lit(cap) - F.sum("base").over(per)).cast("int")
    # A stratum has room for one more unless its floor is already its size.
    room = sized.withColumn("room", F.col("base") < F.col("n")).withColumn("left", left)
    place = F.row_number().over(per.orderBy(F.desc("room"), F.desc("part"), stratum))
    extra = (place <= F.col("left")) & F.col("room")
    alloc = F.when(F.col("total") <= cap, F.col("n")).otherwise(F.col("base") + extra.cast("int"))
    return room.select(repo, stratum, "n", alloc.cast("long").alias("alloc"))


def repo_cap(df: DataFrame, cap: int, repo: str = "full_name", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """At most cap rows a repository, spread over its strata; the choice within one follows a seeded hash.

    Only ids are ranked; ranking is within (repository, stratum).
    """
    named = df.select(repo, row_id, strata(df).alias("stratum"))
    quota = allocation(named, cap, repo)
    order = W.partitionBy(repo, "stratum").orderBy(F.xxhash64(F.lit(seed), row_id), row_id)
    chosen = named.withColumn("k", F.row_number().over(order)).join(quota, [repo, "stratum"]).where(F.col("k") <= F.col("alloc"))
    return df.join(chosen.select(row_id), row_id, "left_semi")


def clean(df: DataFrame, config: CleaningConfig = CleaningConfig(), row_id: str = "row_id", folder: str | None = None) -> Cleaned:
    """The whole cleaning: kept rows with text metrics, dropped rows with reasons, a one-row report.

    With a folder, judged rows are written there once and every result reads them; without, each judges anew.
    """
    all_rows = judged(df, config)
    if folder:
        all_rows.write.mode("overwrite").parquet(folder)
        all_rows = df.sparkSession.read.schema(all_rows.schema).parquet(folder)
    dropped = all_rows.where(F.col("_drop_reason").isNotNull())
    passed = all_rows.where(F.col("_drop_reason").isNull()).drop("_drop_reason")
    distinct = keep_first(passed, list(config.dedupe_columns), [row_id]) if config.drop_duplicates else passed
    capped = repo_cap(distinct, config.max_prompts_per_repo, config.repo_column, row_id, config.seed) if config.max_prompts_per_repo else distinct
    kept = with_metrics(capped)
    one = all_rows.agg(
        F.count(F.lit(1)).alias("rows_in"),
        *[F.count_if(F.col("_drop_reason") == r).alias(f"dropped_{n}") for n, r in (("empty", "empty"), ("ack", "acknowledgment"), ("too_short", "too_short"), ("too_long", "too_long"))],
        F.count_if(F.col("_drop_reason").isNotNull() & ~F.col("_drop_reason").isin("empty", "acknowledgment", "too_short", "too_long")).alias("dropped_noise"),
        F.count_if(F.col("_drop_reason").isNull()).alias("_passed"),
    )
    counts = distinct.agg(F.count(F.lit(1)).alias("_distinct")).crossJoin(capped.agg(F.count(F.lit(1)).alias("rows_out")))  # one row each
    report = one.crossJoin(counts).select(
        "*", (F.col("_passed") - F.col("_distinct")).alias("dropped_duplicates"), (F.col("_distinct") - F.col("rows_out")).alias("dropped_repo_cap")
    )
    reasons = dropped.groupBy(F.col("_drop_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return Cleaned(kept, dropped, report.drop("_passed", "_distinct"), reasons)
