"""Command line: python -m sessionloom COMMAND --input PATH --output PATH.

Tables are Parquet, or CSV where the path ends in .csv. Each command is one composite and its sinks.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import CleaningConfig
from sessionloom.operators import external, sessions
from sessionloom.plans import composites, reports
from sessionloom.sources import exports, readers

TURN_TYPES = {"turn_index": "int", "code_block_count": "int", "has_generated_code": "boolean", "has_tool_use": "boolean"}


def load(spark: SparkSession, path: str) -> DataFrame:
    """A turn table with defaults, typed columns and a row_id that is stable over reruns of the same rows."""
    df = readers.prompts(spark, path) if path.endswith(".csv") else readers.with_defaults(spark.read.parquet(path))
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in TURN_TYPES.items() if c in df.columns})
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.xxhash64(*[c for c in ("full_name", "source_file", "turn_index", "prompt_text") if c in df.columns]))
    return df


def save(tables: dict[str, DataFrame], title: str, output: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{output}/{name}")
    small = {k: v for k, v in tables.items() if k not in ("cleaned", "dropped", "clustered", "labelled", "audit", "english")}
    reports.write_report(title, small, f"{output}/report")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sessionloom")
    p.add_argument("command", choices=["discover", "extract", "enrich", "analyse", "research", "robustness", "predict", "label", "translate", "reexport"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--context", help="repository context table (predict)")
    p.add_argument("--repo-cap", type=int, help="most prompts a repository (analyse)")
    p.add_argument("--clusters", type=int, nargs=2, default=(4, 20), help="range of k (analyse)")
    p.add_argument("--cache", help="table of earlier translations or labels, extended by this run (translate, label)")
    p.add_argument("--columns", nargs="+", default=["prompt_text", "agent_response"], help="columns to translate")
    p.add_argument("--max-rows", type=int, help="translate the first rows only")
    p.add_argument("--strict", action="store_true", help="strict candidate filter (discover)")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"sessionloom-{a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "discover":
        d = composites.discover(spark.read.parquet(a.input), relaxed=not a.strict)
        save({"candidates": d.candidates, "query_summary": d.query_summary, "summary": d.summary}, "Discovery", a.output)
    elif a.command == "extract":
        composites.extract(readers.transcripts(spark, a.input)).write.mode("overwrite").parquet(a.output)
    elif a.command == "enrich":
        sessions.enriched(load(spark, a.input)).write.mode("overwrite").parquet(a.output)
    elif a.command == "analyse":
        config = composites.AnalysisConfig(CleaningConfig(max_prompts_per_repo=a.repo_cap), *a.clusters, folder=f"{a.output}/judged")
        save(composites.analyse(load(spark, a.input), config), "Analysis", a.output)
    elif a.command == "research":
        rows = load(spark, a.input)
        save(composites.research(rows, "prompt_type"), "Research", a.output)
    elif a.command == "robustness":
        save(composites.robustness(load(spark, a.input)), "Robustness", a.output)
    elif a.command == "predict":
        rows, label = readers.labelled(load(spark, a.input))
        context = spark.read.parquet(a.context) if a.context else None
        save(composites.predict_actions(sessions.with_session_features(rows), context, label), "Action prediction", a.output)
    elif a.command == "label":
        cache = external.load_cache(spark, a.cache, "hash string, action_type string, confidence double, rationale string", external.PROMPT_VERSION) if a.cache else None
        out = composites.label_with_model(sessions.with_action_labels(load(spark, a.input)), cache=cache, folder=f"{a.output}/rows")
        new = out.pop("cache")
        save(out, "Labels", a.output)
        if a.cache:
            external.save_cache(new, a.cache, external.PROMPT_VERSION)
    elif a.command == "translate":
        rows = load(spark, a.input)
        rows = rows if a.max_rows is None else rows.orderBy("row_id").limit(a.max_rows)
        cache = external.load_cache(spark, a.cache, "hash string, english string", external.TRANSLATION_VERSION) if a.cache else None
        # Written first, so that each part is translated once, whatever reads it.
        table = exports.checkpointed(external.translations(rows, a.columns, cache=cache), f"{a.output}/translations")
        if a.cache:
            external.save_cache(external.missing_from_cache(table, cache, "hash"), a.cache, external.TRANSLATION_VERSION)
        view = exports.english_view(external.translated(rows, a.columns, cache=table), a.columns)
        save({"english": exports.checkpointed(view, f"{a.output}/view"), "changed": external.changed_counts(view, a.columns)}, "Translation", a.output)
    else:
        rows = load(spark, a.input)
        exports.write_csv(exports.spreadsheet(rows, f"{a.output}/blobs"), f"{a.output}/spreadsheet")
        exports.write_csv(exports.spreadsheet(rows, "", prompts_only=True), f"{a.output}/prompts_only")
        exports.write_blobs(rows, f"{a.output}/blobs" if "://" in a.output else f"file://{a.output}/blobs")


if __name__ == "__main__":
    main()
