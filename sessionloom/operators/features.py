"""Feature columns for models. Assemblers name their input columns; nothing is positional."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions import vocab as V
from sessionloom.operators import stats

#: Column names of the feature groups.
METADATA = ["char_len", "word_len", "line_count", "intent_count", "repo_prompt_count", "repo_median_words"]
HISTORY = ["turns_before", "prev_turn_had_code", "prev_turn_had_tools", "session_code_rate_before"]
CONTEXT = ["repo_stars", "repo_forks", "repo_size_kb", "repo_open_issues", "repo_age_months"]


def numeric(df: DataFrame, c: str) -> Column:
    """Flags as 0/1, other types cast to double, 0 where that fails or the column is missing."""
    if c not in df.columns:
        return F.lit(0.0)
    col = F.col(c)
    kind = dict(df.dtypes)[c]
    return F.coalesce(col.cast("int").cast("double") if kind == "boolean" else col.try_cast("double"), F.lit(0.0))


def metadata_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: numeric(df, c) for c in columns})


def derived(df: DataFrame, stars: str = "stars") -> DataFrame:
    """Linguistics, intents, prompt type, code ratio, file_turn_count, repository statistics and log stars."""
    base = df.withColumns(T.linguistics("prompt_text") | T.intents("prompt_text"))
    base = base.withColumns({"prompt_type": T.prompt_type("prompt_text"), "code_to_text_ratio": T.code_to_text_ratio("generated_code", "agent_response")})
    if {"source_file", "turn_index"} <= set(df.columns):
        base = base.withColumn("file_turn_count", F.max("turn_index").over(W.partitionBy("source_file")) + 1)
    out = stats.with_repo_stats(base)
    return out.withColumn("repo_stars_log", F.log1p(numeric(out, stars)))


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """Fixed columns in the given order; other values set none of them."""
    c = T.text(column)
    return df.withColumns({f"{prefix}_{v or 'none'}": (c == v).cast("double") for v in values})


def previous_action(df: DataFrame) -> DataFrame:
    return one_hot(df, "prev_action_type", [*V.ACTIONS, ""], "prev")


def history(df: DataFrame) -> DataFrame:
    return previous_action(metadata_columns(df, HISTORY))


def keep_last(context: DataFrame, key: str = "full_name", order: str = "row_id") -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    return context.groupBy(key).agg(F.max_by(F.struct(*context.columns), order).alias("_r")).select("_r.*")


def with_repo_context(df: DataFrame, context: DataFrame, order: str = "row_id") -> DataFrame:
    right = keep_last(context, "full_name", order).select("full_name", *[c for c in context.columns if c.startswith("repo_")])
    return df.join(right, "full_name", "left")


def top_languages(df: DataFrame, most: int = 12, column: str = "repo_language") -> list[str]:
    """The most frequent languages; null counts as unknown."""
    known = df.select(F.coalesce(column, F.lit("unknown")).alias(column))
    return [r[0] for r in stats.value_counts(known, column, most).collect()]


def language_buckets(df: DataFrame, languages: list[str], column: str = "repo_language") -> DataFrame:
    known = F.coalesce(column, F.lit("unknown"))
    bucket = F.when(known.isin(languages), known).otherwise("other")
    return one_hot(df.withColumn("language_bucket", bucket), "language_bucket", [*languages, "other"], "lang")


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """One vector of numeric and vector columns; nulls become NaN. A vector's length is that of the first row."""
    for c in [c for c in columns if df.schema[c].dataType.typeName() == "vectorudt"]:
        row = df.where(F.col(c).isNotNull()).select(c).first()
        df = VectorSizeHint(inputCol=c, size=row[0].size if row else 0, handleInvalid="optimistic").transform(df)
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def terms(df: DataFrame, text: str, row_id: str, ngrams: int = 1, stop: list[str] | None = None) -> DataFrame:
    """row_id, term, tf: words of two characters or more in lower case, and their n-grams."""
    words = F.regexp_extract_all(F.lower(T.text(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    rows = df.select(F.col(row_id), words.alias("w"))
    parts = [F.col("w")]
    for n in range(2, ngrams + 1):
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i, n=n: F.array_join(F.slice("w", i, n), " "))
        parts.append(F.when(F.size("w") >= n, runs).otherwise(F.array().cast("array<string>")))
    return rows.select(row_id, F.explode(F.concat(*parts)).alias("term")).groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_fit(train_terms: DataFrame, n_docs: int, min_df: int = 2, most: int = 2000) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1 of the most frequent terms (a vocabulary of bounded size)."""
    per = train_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    vocabulary = per.orderBy(F.desc("total"), "term").limit(most)
    return vocabulary.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"))


def tfidf(term_counts: DataFrame, model: DataFrame, row_id: str, sublinear: bool = True) -> DataFrame:
    """row_id, term, weight, of unit length per row. The vocabulary is bounded, so Spark may broadcast it."""
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    w = term_counts.join(model, "term").select(row_id, "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(row_id)))
    return w.select(row_id, "term", (F.col("w") / norm).alias("weight"))


def sparse_vectors(weights: DataFrame, model: DataFrame, row_id: str, out: str = "tfidf") -> DataFrame:
    """One SparseVector a row that has a term, over the vocabulary in term order.

    Terms are numbered in one task, for the vocabulary is bounded by tfidf_fit. Built-in functions make dense
    vectors only, so the last step is a Python function of the row's own entries.
    """
    size = model.count()
    numbered = model.select("term", (F.row_number().over(W.orderBy("term")) - 1).alias("i"))
    entries = F.array_sort(F.collect_list(F.struct("i", "weight")))
    made = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    pairs = weights.join(numbered, "term").groupBy(row_id).agg(entries.alias("e"))
    return pairs.select(row_id, made("e.i", "e.weight").alias(out))


def with_tfidf(df: DataFrame, text: str, row_id: str, out: str = "tfidf", is_train: str = "NOT is_test", ngrams: int = 2, min_df: int = 2, most: int = 2000, stop: list[str] | None = None) -> DataFrame:
    """df with a SparseVector of sublinear TF-IDF weights, fitted on the training rows; without terms it is empty."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    counts = terms(df, text, row_id, ngrams, stop)
    train = df.where(is_train).select(row_id)
    model = tfidf_fit(counts.join(train, row_id, "left_semi"), train.count(), min_df, most)
    size = model.count()
    found = sparse_vectors(tfidf(counts, model, row_id), model, row_id, "_found")
    filled = F.udf(lambda v: v if v is not None else Vectors.sparse(size, [], []), VectorUDT())
    return df.join(found, row_id, "left").withColumn(out, filled("_found")).drop("_found")


def cluster_terms(term_weights: DataFrame, clusters: DataFrame, row_id: str, most: int = 8) -> DataFrame:
    """cluster, rank, term, score: the terms of greatest mean weight in each cluster (a top-k report)."""
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    s = term_weights.join(clusters.select(row_id, "cluster"), row_id).groupBy("cluster", "term").agg(F.sum("weight").alias("s")).join(n, "cluster")
    score = s.select("cluster", "term", F.round(F.col("s") / F.col("n"), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "term"))
    return score.withColumn("rank", rank).where(F.col("rank") <= most).select("cluster", "rank", "term", "score")


def cluster_profile(df: DataFrame, total: Column | None = None) -> DataFrame:
    """Per cluster: size, share, dominant intent (ties: the first), share with code, median words."""
    per = df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), stats.percent("has_generated_code").alias("pct_code"), F.median(T.word_count("prompt_text")).alias("median_words")
    )
    by = df.groupBy("cluster", "primary_intent").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster")
    top = by.agg(F.min(F.struct((-F.col("c")).alias("m"), "primary_intent")).alias("t")).select("cluster", F.col("t.primary_intent").alias("dominant_intent"))
    return per.join(top, "cluster").withColumn("pct", 100 * F.col("size") / F.sum("size").over(W.partitionBy()))
