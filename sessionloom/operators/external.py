"""Hooks for models that live elsewhere: encoders, translators, labellers. Deterministic stand-ins work offline.

Each hook is a function of a list of texts, wrapped in an Arrow-batched UDF. Caches are tables keyed by a
content hash: only texts that the cache lacks reach the hook, once each.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.functions import text as T
from sessionloom.functions import vocab as V

Encoder = Callable[[list[str]], list[list[float]]]
Translator = Callable[[list[str]], list[str]]
Labeller = Callable[[list[str]], list[str]]


def hashed_encoder(dim: int = 64) -> Encoder:
    """Signed hashing of lower-cased words, of unit length: a stand-in for a sentence encoder."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def embedded(df: DataFrame, text: str = "prompt_text", encoder: Encoder | None = None, batch: int = 64, out: str = "embedding", optional: bool = False) -> DataFrame:
    """Adds out, array<float>. With optional, as for a second encoder that knows code, a hook that fails leaves null."""
    encode = encoder or hashed_encoder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows: list[list[float]] = []
            texts = s.fillna("").tolist()
            for k in range(0, len(texts), batch):
                try:
                    rows += encode(texts[k : k + batch])
                except Exception:  # noqa: BLE001
                    if not optional:
                        raise
                    rows += [None] * len(texts[k : k + batch])
            yield pd.Series(rows)

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(text))


def embedded_cached(df: DataFrame, cache: DataFrame, text: str = "prompt_text", encoder: Encoder | None = None, out: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(df with out, new rows for the cache): cache is (hash, vector), and only distinct texts that it lacks are encoded."""
    keyed = df.withColumn("_hash", T.text_hash(text))
    lacking = missing_from_cache(keyed.select(F.col("_hash").alias("hash"), F.col(text).alias("_text")).dropDuplicates(["hash"]), cache, "hash")
    new = embedded(lacking, "_text", encoder, out="vector").select("hash", "vector")
    every = extended_cache(cache.select("hash", "vector").dropDuplicates(["hash"]), new)
    return keyed.join(every.select(F.col("hash").alias("_hash"), F.col("vector").alias(out)), "_hash", "left").drop("_hash"), new


def load_cache(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """The rows of a cache table that have this version; empty where the table is missing or has another schema."""
    wanted = StructType.fromDDL(schema)
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], wanted)
    if not {(f.name, f.dataType) for f in wanted.fields} <= {(f.name, f.dataType) for f in found.schema.fields} or "version" not in found.columns:
        return spark.createDataFrame([], wanted)
    return found.where(F.col("version") == version).select(*wanted.names)


def save_cache(new: DataFrame, path: str, version: str) -> None:
    """Appends rows under their version; readers take one row a key."""
    new.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


def missing_from_cache(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return df.join(cache.select(key).distinct(), key, "left_anti")


def with_cache(df: DataFrame, cache: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the cache's columns, null where it has none; of repeated keys the cache's greatest row counts."""
    one = cache.groupBy(key).agg(F.max(F.struct(*columns)).alias("_c")).select(key, "_c.*")
    return df.join(one, key, "left")


def extended_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    return cache.unionByName(new, allowMissingColumns=True)


def split_code(c: str) -> Column:
    """array<struct<is_code, part>>: fences and what stands between them, in order."""
    parts = F.regexp_extract_all(T.text(c), F.lit(r"(?s)```.*?```|(?:(?!```.*?```).)+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.startswith("```").alias("is_code"), p.alias("part")))


def translations(df: DataFrame, columns: list[str], translator: Translator | None = None, cache: DataFrame | None = None) -> DataFrame:
    """hash, english of the distinct parts outside code fences that need it: from the cache, else from the hook.

    A hook that fails leaves the text, and no row here, so that nothing wrong is kept in a cache.
    """
    hook = translator or (lambda texts: texts)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            try:
                yield pd.Series(hook(s.tolist()), dtype=object)
            except Exception:  # noqa: BLE001  one failing batch must not end the job
                yield pd.Series([None] * len(s), dtype=object)

    each = [df.select(F.explode(split_code(c)).alias("p")).where(~F.col("p.is_code")).select(F.col("p.part").alias("part")) for c in columns]
    parts = each[0]
    for p in each[1:]:
        parts = parts.unionByName(p)
    keyed = parts.where(T.needs_translation("part")).withColumn("hash", T.text_hash("part")).dropDuplicates(["hash"])
    todo, known = keyed, None
    if cache is not None:
        todo = missing_from_cache(keyed, cache, "hash")
        known = with_cache(keyed, cache, "hash", ["english"]).where("english IS NOT NULL").select("hash", "english")
    fresh = todo.select("hash", F.pandas_udf(run, "string")("part").alias("english")).where("english IS NOT NULL")
    return fresh if known is None else known.unionByName(fresh)


def translated(df: DataFrame, columns: list[str], translator: Translator | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Adds <column>_en and any_translated. Code fences pass through untouched; a hook that fails leaves the text.

    Distinct parts that need it are translated once: exploded, hashed, looked up in the cache, sent to the
    hook, and joined back.
    """
    done = translations(df, columns, translator, cache)
    out = df
    for c in columns:
        parts = out.select(T.text_hash(c).alias("_key"), c).dropDuplicates(["_key"]).select("_key", F.posexplode(split_code(c)).alias("i", "p"))
        joined = parts.withColumn("hash", F.when(~F.col("p.is_code"), T.text_hash("p.part"))).join(done, "hash", "left")
        whole = joined.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("english", "p.part").alias("t")))).alias("ts"))
        whole = whole.select("_key", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias(f"{c}_en"))
        out = out.withColumn("_key", T.text_hash(c)).join(whole, "_key", "left").drop("_key").withColumn(f"{c}_en", F.coalesce(f"{c}_en", T.text(c)))
    changed = T.any_of([F.col(f"{c}_en") != T.text(c) for c in columns])
    return out.withColumn("any_translated", changed)


def changed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, changed, rows: how many values of each translated column differ from their source."""
    total = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"{c}_en") != T.text(c)).alias(c) for c in columns])
    return total.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns])).alias("x")).select("x.column", "x.changed", "rows")


PROMPT_VERSION, TRANSLATION_VERSION = "v1", "v1"


def label_prompt(exemplars: list[dict] | None = None, most_prompt: int = 4000, most_response: int = 20_000) -> Column:
    """The request text for a turn."""
    shots = "\n".join(f"Prompt: {e['prompt_text']!r}\nResponse: {e['agent_response']!r}\n-> {e['action_type']}" for e in exemplars or [])
    head = f"Classify the agent's action as one of: {', '.join(V.ACTIONS)}.\n{shots}\n" if shots else f"Classify the agent's action as one of: {', '.join(V.ACTIONS)}.\n"
    return F.concat(F.lit(head + "Prompt: "), T.truncate("prompt_text", most_prompt), F.lit("\nResponse: "), T.truncate("agent_response", most_response))


def rule_labeller() -> Labeller:
    """A stand-in that answers JSON by the first vocabulary word it finds in the prompt line."""
    import re

    rules = [("debug", V.DEBUG), ("implement", V.IMPLEMENT), ("review", V.REVIEW), ("explain", V.EXPLAIN)]

    def label(requests: list[str]) -> list[str]:
        out = []
        for r in requests:
            prompt = r.rpartition("Prompt: ")[2].partition("\nResponse: ")[0]
            kind = next((k for k, p in rules if re.search(p, prompt, re.I)), "other")
            out.append(json.dumps({"action_type": kind, "confidence": 0.9, "rationale": "keyword rule"}))
        return out

    return label


# Failed rows in a row, and words of an error, after which calling on is pointless.
MOST_FAILURES = 10
QUOTA_WORDS = ("per day", "tpd", "daily")


def label_cache(labelled: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """hash, action_type, confidence, rationale of the rows that were labelled without an error and that the cache lacks."""
    done = labelled.where("llm_error IS NULL AND llm_action_type IS NOT NULL").select("hash", *[F.col(f"llm_{c}").alias(c) for c in ("action_type", "confidence", "rationale")])
    done = done.dropDuplicates(["hash"])
    return done if cache is None else missing_from_cache(done, cache, "hash")


def labelled(df: DataFrame, labeller: Labeller | None = None, cache: DataFrame | None = None, workers: int = 4, interval: float = 0.0, retries: int = 3) -> DataFrame:
    """Adds llm_action_type, llm_confidence, llm_rationale, llm_error and the row's hash.

    workers bounds how many tasks call the hook at once; each waits interval * workers seconds between calls,
    so that interval holds over all of them. A call that keeps failing leaves the type blank and its error in the row.
    A task stops calling after a reply that names an exhausted quota, or after MOST_FAILURES failed rows in a row; its
    rows left are marked as skipped. Rows found in the cache (hash, action_type, confidence, rationale) never reach the hook.
    """
    hook = labeller or rule_labeller()
    keyed = df.withColumn("hash", T.row_hash(PROMPT_VERSION, "prompt_text", "agent_response")).withColumn("_request", label_prompt())
    todo = keyed.select("hash", "_request").dropDuplicates(["hash"])
    if cache is not None:
        todo = missing_from_cache(todo, cache, "hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped, failures = False, 0
        for b in batches:
            replies, errors = [], []
            for request in b["_request"]:
                reply, error = "", "skipped_after_quota_exhausted" if stopped else None
                for attempt in range(0 if stopped else retries):
                    try:
                        reply, error = hook([request])[0], None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"call_failed:{e}"
                        if any(w in str(e).lower() for w in QUOTA_WORDS):
                            error, stopped = "quota_exhausted", True
                            break
                        time.sleep(interval * 2**attempt)
                if not stopped:
                    time.sleep(interval * workers)
                    failures = failures + 1 if error else 0
                    stopped = failures >= MOST_FAILURES
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({"hash": b["hash"].array, "raw": replies, "failed": errors})

    answers = todo.coalesce(workers).mapInPandas(run, "hash string, raw string, failed string").withColumn("p", T.parse_label("raw"))
    kind = F.when(F.col("failed").isNull(), F.col("p.action_type")).otherwise("")
    fresh = answers.select("hash", kind.alias("action_type"), "p.confidence", "p.rationale", F.coalesce("failed", "p.error").alias("error"))
    every = fresh
    if cache is not None:
        every = cache.select("hash", "action_type", "confidence", "rationale", F.lit(None).cast("string").alias("error")).dropDuplicates(["hash"]).unionByName(fresh)
    renamed = every.select("hash", *[F.col(c).alias(f"llm_{c}") for c in ("action_type", "confidence", "rationale", "error")])
    return keyed.drop("_request").join(renamed, "hash", "left")


def review_sheet(df: DataFrame, per_class: int = 10, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Rows for a human: at most per_class a model label (a sampling operator), with two blank columns."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("llm_action_type").orderBy(F.xxhash64(F.lit(seed), row_id), row_id))
    some = df.withColumn("_k", k).where(F.col("_k") <= per_class)
    return some.select(
        "full_name", "prompt_text", "agent_response", "action_type", "llm_action_type", "llm_confidence", "llm_rationale", F.lit("").alias("human_label"), F.lit("").alias("human_notes")
    )
