"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage but the last returns the columns of its input; the last adds the columns named in it. Stages
work on all rows that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import language_id, line_dedup, setsketch_dedup, source_mix
from sessionloom.llm import sentencepiece_codec as codec
from sessionloom.llm._shared import columns_of, drop_written, unused, written
from sessionloom.llm.queries import tokenizer

#: Documents whose predicted language holds a smaller share of their letters are rejected.
LEAST_SCORE = 0.5
SHINGLE_WORDS, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in which no language holds LEAST_SCORE of the letters.

    So null, empty and letterless texts go. Kept documents whose lang is null get the predicted one; other
    columns stay as they are, whatever their names. Repeated rows are judged alike; an empty table stays empty.
    """
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    lang, score = unused(docs.columns, "lang_pred", "score")
    judged = language_id.predicted(docs, model, names=(lang, score))
    kept = judged.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*columns_of(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; documents of which nothing visible is left go.

    Documents without removals stay as they are, null and empty texts included. n_chars, if there, becomes the
    length of a changed text; other columns stay as they are, whatever their names.
    """
    removed, lines = unused(docs.columns, "n_removed", "n_lines")
    out = line_dedup.deduplicated(docs, counts=(lines, removed))
    left = out.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (left if text is None else left.withColumn("n_chars", text.cast(docs.schema["n_chars"].dataType))).select(*columns_of(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id.

    A document is judged by its doc_id and text together, so of two texts under one doc_id each stays or goes
    by its own group. Of rows that share both, one stays: all columns of one row, the first by the hash of its other
    columns. Documents without words, and those with a null doc_id, are linked with nothing and stay.
    """
    return setsketch_dedup.representatives(docs, SHINGLE_WORDS, PERCENT).select(*columns_of(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole (0 to 3 times); documents that it doesn't take go.

    Null, empty and wordless texts have size 0 and go; a null source is one of its own. Other columns pass through.
    """
    return source_mix.repeated(docs).select(*columns_of(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (with the end id; a null or empty text has it alone) and n_tokens behind the other columns.

    Columns of the input with these two names are replaced.
    """
    out = codec.encode_documents(docs.drop("n_tokens"), tokenizer("piece_bpe_32k.model"), replace=True)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("source_mix", mix_stage),
    ("sentencepiece", token_stage),
]

#: Learned scores, register banding and merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
