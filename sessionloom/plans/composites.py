"""Whole analyses: lazy compositions of the operators. Each returns its tables; writing them is the caller's choice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions.text import CleaningConfig
from sessionloom.operators import cleaning, discovery, external, features, metrics, ml, sessions, splits, stats, transcripts
from sessionloom.sources import exports


@dataclass(frozen=True)
class Discovery:
    hits: DataFrame
    candidates: DataFrame
    query_summary: DataFrame
    summary: DataFrame


def discover(hits: DataFrame, tie: str = "url", relaxed: bool = True) -> Discovery:
    found = discovery.candidates(hits, tie, relaxed)
    per_query = hits.groupBy("discovery_source", "detection_query").agg(F.count(F.lit(1)).alias("fetched"))
    return Discovery(hits, found, per_query, discovery.summary(found))


def extract(files: DataFrame, repos: DataFrame | None = None, enrich: bool = True, max_repos: int | None = None) -> DataFrame:
    """Turns of transcripts; with max_repos, an option of the caller, of the first repositories by name only."""
    if max_repos is not None and repos is not None:
        repos = repos.dropDuplicates(["full_name"]).orderBy("full_name").limit(max_repos)
    table = transcripts.turn_records(files, repos).withColumn("row_id", F.xxhash64("full_name", "source_file", "turn_index"))
    return sessions.enriched(table) if enrich else table


@dataclass
class AnalysisConfig:
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    min_clusters: int = 4
    max_clusters: int = 20
    encoder: external.Encoder | None = None
    translator: external.Translator | None = None
    translate: bool = False
    row_id: str = "row_id"
    #: Where judged rows are written, so that cleaning runs once for all tables.
    folder: str | None = None


def analyse(df: DataFrame, config: AnalysisConfig | None = None) -> dict[str, DataFrame]:
    """Clean, embed, cluster and describe prompts."""
    config = config or AnalysisConfig()
    done = cleaning.clean(df, config.cleaning, config.row_id, config.folder)
    rows = done.kept
    if config.translate:
        rows = external.translated(rows, ["prompt_text"], config.translator)
        rows = rows.withColumn("prompt_text", F.col("prompt_text_en"))
    rows = ml.vectors(external.embedded(rows, "prompt_text", config.encoder))
    clustered, search = ml.kmeans_search(rows, range(config.min_clusters, config.max_clusters + 1))
    clustered = ml.pca_2d(clustered).drop("features", "embedding")
    full = clustered.withColumns(T.linguistics("prompt_text") | T.intents("prompt_text"))
    full = full.withColumn("code_to_text_ratio", T.code_to_text_ratio("generated_code", "agent_response"))
    counts = features.terms(full, "prompt_text", config.row_id)
    weights = features.tfidf(counts, features.tfidf_fit(counts, full.count(), 1, 2000), config.row_id, sublinear=False)
    return {
        "cleaned": done.kept, "dropped": done.dropped, "cleaning_report": done.report, "drop_reasons": done.reasons, "cluster_search": search, "clustered": full,
        "linguistics": stats.linguistic_summary(full), "intents": stats.intent_prevalence(full), "code_stats": stats.code_stats(full), "repo_stats": stats.repo_stats(full),
        "diversity": stats.diversity(full), "intent_behaviour": stats.intent_behaviour(full), "cluster_profile": features.cluster_profile(full),
        "cluster_terms": features.cluster_terms(weights, full, config.row_id),
    }


def predict_actions(
    df: DataFrame, context: DataFrame | None = None, label: str = "action_type", folds: int = 3, models: list[str] | None = None, encoder: external.Encoder | None = None,
    context_turns: int = 2, row_id: str = "row_id", only: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Repository-held-out prediction of the agent's action from prompt, metadata, history, repository and earlier turns.

    Representations: tfidf, the prompt's embedding alone and with metadata, previous action, history, both, and (with
    context) the repository; context_text_n with the n turns before. only limits them by name.
    """
    rows = df.where(F.col(label).isNotNull() & (F.col(label) != ""))
    rows = features.with_repo_context(rows, context) if context is not None else rows
    rows = features.history(features.metadata_columns(rows.withColumns(T.linguistics("prompt_text")), features.CONTEXT))
    rows = splits.group_split(external.embedded(rows, "prompt_text", encoder))
    previous = [c for c in rows.columns if c.startswith("prev_") and c not in ("prev_action_type", "prev_turn_had_code", "prev_turn_had_tools")]
    metadata, past = ["char_len", "word_len", "line_count"], [*features.HISTORY, *previous]
    rows = ml.vectors(features.metadata_columns(rows, metadata), "embedding", "prompt_only")
    sets = {
        "tfidf": None, "prompt_only": [], "prompt+metadata": metadata, "prompt+previous_action": previous, "prompt+history": past, "prompt+metadata+history": [*metadata, *past],
        **({"prompt+metadata+history+repository": [*metadata, *past, *features.CONTEXT]} if context is not None else {}), **{f"context_text_n{n}": None for n in range(1, context_turns + 1)},
    }
    sets = {k: v for k, v in sets.items() if only is None or k in only}
    columns = {}
    for k, (name, extra) in enumerate(sets.items()):
        columns[name] = "prompt_only" if extra == [] else f"set_{k}"
        if name == "tfidf":
            rows = features.with_tfidf(rows, "prompt_text", row_id, columns[name])
        elif name.startswith("context_text_n"):
            turns = sessions.prior_turns_text(rows, int(name.removeprefix("context_text_n")), row_id)
            rows = ml.vectors(external.embedded(turns, "context_text", encoder, out=f"_e{k}"), f"_e{k}", columns[name]).drop(f"_e{k}", "context_text")
        elif extra:
            rows = features.assembled(rows, ["prompt_only", *extra], columns[name])
    rows = rows.cache()
    try:
        results = None
        for name, column in columns.items():
            part = ml.trained(rows, label, column, models).select(F.lit(name).alias("representation"), "*")
            results = part if results is None else results.unionByName(part)
        test = rows.where("is_test")
        base = metrics.majority(test, label).select(F.lit("majority").alias("baseline"), "accuracy")
        rule = metrics.multiclass(test.withColumn("_p", T.prompt_rule("prompt_text")), label, "_p").select(F.lit("keyword_rule").alias("baseline"), "accuracy")
        # One row a model, fold or baseline: settled here, so that the cached rows can go.
        settled = ml.settled
        results, baselines, overlap = settled(results), settled(base.unionByName(rule)), settled(splits.overlap_report(rows))
        cv = settled(ml.cross_validated(splits.group_folds(rows, folds), label, columns, ["logistic_regression"]))
        pairs = [("prompt_only", name) for name in columns if name != "prompt_only"]
        return {
            "results": results, "baselines": baselines, "overlap": overlap, "cross_validation": cv, "cv_summary": metrics.cv_summary(cv),
            "significance": metrics.paired_tests(cv, pairs), "best": results.agg(F.max_by(F.struct("representation", "model", "macro_f1"), "macro_f1").alias("b")).select("b.*"),
        }
    finally:
        rows.unpersist()


def research(df: DataFrame, label: str = "primary_intent", least: int = 5, models: list[str] | None = None) -> dict[str, DataFrame]:
    """Dataset analysis, then the intent, binary and regression tasks on metadata features."""
    rows = splits.group_split(features.derived(df))
    ready = features.assembled(features.metadata_columns(rows, features.METADATA), features.METADATA).cache()
    return {
        "missing": stats.missing_values(rows, df.columns), "imbalance": stats.imbalance(rows, label), "duplicates": stats.duplicate_counts(rows), "leakage": stats.leakage_stats(rows),
        "intent": ml.trained(splits.eligible(ready, label, least), label, "features", models), "code": ml.trained_binary(ready, "has_generated_code"),
        "tools": ml.trained_binary(ready, "has_tool_use"), "length": ml.trained_regression(ready.withColumn("_len", F.length(T.text("agent_response"))), "_len"),
    }


#: Columns that a behaviour model may see: nothing that follows from the reply or from the intent rules.
SAFE_METADATA = ["char_len", "word_len", "line_count", "has_question", "has_code_mention", "starts_imperative", "turn_index"]
TRAIN_ONLY = ["repo_prompt_count_train", "repo_median_words_train", "repo_code_rate_train", "repo_tool_rate_train"]
KEYWORD_RULES = {"has_generated_code": T.keyword_code, "has_tool_use": T.keyword_tool}


def robustness(
    df: DataFrame, row_id: str = "row_id", targets: tuple[str, ...] = ("has_generated_code", "has_tool_use"), models: list[str] | None = None, encoder: external.Encoder | None = None,
    only: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Does the signal survive without keywords, or without the repository? Repository-held-out, for each target.

    Datasets: A_full (embedding; with safe metadata; train-only repository statistics alone; embedding with them; TF-IDF),
    B_keyword_masked (embedding; with safe metadata) and C_semantic_only (the embedding, whose figures are A_full's).
    Baselines (dataset full): the majority class and the keyword rule. only limits representations by "dataset/name".
    results: dataset, representation, model, target, auc, f1, accuracy, coverage; ablation: the best auc and f1 of the first target.
    """
    rows = stats.with_train_repo_stats(splits.group_split(df), ~F.col("is_test"))
    rows = features.metadata_columns(rows.withColumns(T.linguistics("prompt_text")), [*SAFE_METADATA, *TRAIN_ONLY])
    rows = ml.vectors(external.embedded(rows, "prompt_text", encoder, out="_e"), "_e", "prompt").withColumn("_m", T.mask_keywords("prompt_text"))
    rows = ml.vectors(external.embedded(rows, "_m", encoder, out="_em"), "_em", "masked").drop("_e", "_em", "_m")
    sets = {
        "A_full/embedding": ["prompt"], "A_full/embedding+safe_metadata": ["prompt", *SAFE_METADATA], "A_full/repository": TRAIN_ONLY, "A_full/embedding+repository": ["prompt", *TRAIN_ONLY],
        "A_full/tfidf": ["tfidf"], "B_keyword_masked/embedding": ["masked"], "B_keyword_masked/embedding+safe_metadata": ["masked", *SAFE_METADATA], "C_semantic_only/embedding": ["prompt"],
    }
    sets = {k: v for k, v in sets.items() if only is None or k in only}
    if any("tfidf" in v for v in sets.values()):
        rows = features.with_tfidf(rows, "prompt_text", row_id, "tfidf")
    rows = rows.cache()
    try:
        test, out, done = rows.where("is_test"), [], {}
        for target in targets:
            y = test.withColumn("y", F.coalesce(F.col(target), F.lit(False)).cast("int"))
            major = metrics.majority(y, "y").select(F.lit("majority").alias("representation"), F.lit(None).cast("double").alias("f1"), "accuracy", F.lit(1.0).alias("coverage"))
            rule = metrics.keyword_baseline(y.withColumn("rule", KEYWORD_RULES[target]("prompt_text")), "y", "rule")
            base = major.unionByName(rule.select(F.lit("keyword_rule").alias("representation"), "f1", "accuracy", "coverage"))
            out.append(ml.settled(base.select(F.lit("full").alias("dataset"), "representation", F.lit("rule").alias("model"), F.lit(target).alias("target"), F.lit(None).cast("double").alias("auc"), "f1", "accuracy", "coverage")))
            for name, columns in sets.items():
                dataset, representation = name.split("/")
                if (target, *columns) not in done:
                    ready = features.assembled(rows, columns, "set") if len(columns) > 1 else rows.withColumn("set", F.col(columns[0]))
                    done[target, *columns] = ml.trained_binary(ready, target, "set", only=models or ["boosted_trees"])
                r = done[target, *columns]
                out.append(r.select(F.lit(dataset).alias("dataset"), F.lit(representation).alias("representation"), "model", "target", F.col("roc_auc").alias("auc"), "f1", "accuracy", F.lit(1.0).alias("coverage")))
        results = ml.settled(*out)
        audit = stats.label_audit(splits.group_split(df), row_id, "has_generated_code")
        y = test.withColumn("y", F.coalesce(F.col(targets[0]), F.lit(False)).cast("int"))
        return {
            "results": results, "ablation": metrics.best_by(results.where(F.col("target") == targets[0]), ["dataset", "representation"], ["auc", "f1"]),
            "named": metrics.named_model(results, ["dataset", "representation", "target"]), "split": ml.settled(splits.overlap_report(rows)),
            "always_positive": ml.settled(metrics.binary(y.withColumn("_one", F.lit(1)), "y", "_one")), "audit": audit, "audit_summary": stats.distribution(audit, "audit_category"),
        }
    finally:
        rows.unpersist()


def label_with_model(df: DataFrame, labeller: external.Labeller | None = None, cache: DataFrame | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    """Model labels held against the rule labels. With a folder, labelled rows are written there, so that each request is sent once."""
    rows = external.labelled(df, labeller, cache)
    rows = exports.checkpointed(rows, folder) if folder else rows
    return {
        "labelled": rows, "cache": external.label_cache(rows, cache), "kappa": metrics.cohen_kappa(rows.where("llm_error IS NULL"), "action_type", "llm_action_type"),
        "agreement": metrics.agreement_by_class(rows, "action_type", "llm_action_type"), "review": external.review_sheet(rows),
    }

