"""The robustness grid, importances, caches, stop rules, translations and masks."""

import re

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from sessionloom.__main__ import main
from sessionloom.functions import text as T
from sessionloom.functions import vocab as V
from sessionloom.operators import cleaning, external, features, metrics, ml, sessions, transcripts
from sessionloom.plans import composites, views
from sessionloom.sources import exports


def test_robustness(spark, sf_dir):
    only = ["A_full/repository", "B_keyword_masked/embedding+safe_metadata"]
    out = composites.robustness(views.prompts(spark, sf_dir), models=["logistic_regression"], encoder=external.hashed_encoder(8), only=only)
    got = {(r["target"], r["dataset"], r["representation"]): r for r in out["results"].collect()}
    names = [("full", "majority"), ("full", "keyword_rule"), *[tuple(n.split("/")) for n in only]]
    assert set(got) == {(t, *n) for t in ("has_generated_code", "has_tool_use") for n in names}
    # Test rows of one class have no ranking.
    assert all(0 <= r["accuracy"] <= 1 and (r["auc"] is None or r["model"] != "rule" and 0 <= r["auc"] <= 1) for r in got.values())
    assert out["ablation"].count() == 4 and out["split"].first()["leakage_free"]
    assert {r["model"] for r in out["named"].collect()} == {"rule", "logistic_regression"}


def test_named_model(spark):
    rows = [("a", "boosted_trees", 1.0), ("a", "x", 2.0), ("b", "z", 3.0), ("b", "y", 4.0)]
    got = metrics.named_model(spark.createDataFrame(rows, "k string, model string, f1 double"), ["k"]).collect()
    assert sorted(map(tuple, got)) == [("a", "boosted_trees", 1.0), ("b", "y", 4.0)]


def test_importances(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2), float(i % 3)) for i in range(60)], "y double, a double, b double")
    model = RandomForestClassifier(labelCol="y", numTrees=5, seed=1).fit(features.assembled(df, ["b", "a"]))
    assert [r["feature"] for r in ml.importances(model, ["b", "a"], 1).collect()] == ["a"]
    assert ml.importances(object(), []) is None


def test_masks_equal_word_by_word_replacement(spark):
    texts = ["Fix the bug, prefix debugger", "préfix fixé FIX", "code/file—test", "ﬁx naïve class日本 日本 class", None, "", "run " * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.mask_keywords("t")).collect()]
    for t, g in zip(texts, got, strict=True):
        for w in V.MASKED:
            t = re.sub(rf"\b{w}\b", V.MASK, t or "", flags=re.I)
        assert g == t


def test_labeller_stops_on_quota_and_on_failures(spark):
    df = spark.createDataFrame([(f"fix {i:02}", "") for i in range(30)], "prompt_text string, agent_response string")

    def exhausted(_):
        raise RuntimeError("limit of requests per day reached")

    errors = [r["llm_error"] for r in external.labelled(df, exhausted, workers=1).collect()]
    assert errors.count("quota_exhausted") == 1 and errors.count("skipped_after_quota_exhausted") == 29

    def down(_):
        raise RuntimeError("down")

    out = external.labelled(df, down, workers=1, retries=1)
    errors = [r["llm_error"] for r in out.collect()]
    assert errors.count("call_failed:down") == external.MOST_FAILURES and errors.count("skipped_after_quota_exhausted") == 20
    assert {r["llm_action_type"] for r in out.collect()} == {""} and external.label_cache(out).isEmpty()


def test_label_cache_holds_successes_that_it_lacks(spark):
    df = spark.createDataFrame([("fix it", ""), ("fix it", ""), ("why?", "")], "prompt_text string, agent_response string")
    first = external.label_cache(external.labelled(df))
    assert first.count() == 2 and external.label_cache(external.labelled(df, cache=first), first).isEmpty()


def test_caches_know_their_version(spark, tmp_path):
    at, schema = f"{tmp_path}/cache", "hash string, english string"
    assert external.load_cache(spark, at, schema, "v1").isEmpty()
    external.save_cache(spark.createDataFrame([("h", "x")], schema), at, "v1")
    assert [tuple(r) for r in external.load_cache(spark, at, schema, "v1").collect()] == [("h", "x")]
    assert external.load_cache(spark, at, schema, "v2").isEmpty()
    assert external.load_cache(spark, at, "hash string, english long", "v1").isEmpty()


def test_embeddings_come_from_the_cache(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "row_id long, prompt_text string")
    cache = df.limit(1).select(T.text_hash("prompt_text").alias("hash"), F.array(F.lit(9.0).cast("float")).alias("vector"))
    rows, new = external.embedded_cached(df, cache, encoder=lambda ts: [[float(len(t))] for t in ts])
    assert {r["row_id"]: r["embedding"] for r in rows.collect()} == {1: [9.0], 2: [9.0], 3: [1.0], 4: [0.0]}
    assert new.count() == 2

    def fails(_):
        raise ValueError

    assert [r["embedding"] for r in external.embedded(df, encoder=fails, optional=True).collect()] == [None] * 4


def test_translations(spark):
    df = spark.createDataFrame([(1, "部分 一\n```py\n部分\n```\n", "plain"), (2, "部分 一\n", None), (3, None, "部分 二")], "row_id long, a string, b string")
    calls = spark.sparkContext.accumulator(0)

    def hook(texts):
        calls.add(len(texts))
        return [t.replace("部分", "part") for t in texts]

    table = external.translations(df, ["a", "b"], hook)
    assert table.count() == 2 and calls.value == 2
    out = external.translated(df, ["a", "b"], None, table).cache()
    got = {r["row_id"]: (r["a_en"], r["b_en"], r["any_translated"]) for r in out.collect()}
    assert got == {1: ("part 一\n```py\n部分\n```\n", "plain", True), 2: ("part 一\n", "", True), 3: ("", "part 二", True)}
    assert {r["column"]: (r["changed"], r["rows"]) for r in external.changed_counts(out, ["a", "b"]).collect()} == {"a": (2, 3), "b": (1, 3)}
    assert [r["row_id"] for r in exports.english_view(out, ["a"], 2).collect()] == [1, 2]

    def fails(_):
        raise RuntimeError

    assert external.translations(df, ["a"], fails).isEmpty()


def test_translate_command(spark, sf_dir, tmp_path):
    views.prompts(spark, sf_dir).limit(20).write.parquet(f"{tmp_path}/turns")
    for _ in range(2):
        main(["translate", "--input", f"{tmp_path}/turns", "--output", f"{tmp_path}/out", "--cache", f"{tmp_path}/cache", "--max-rows", "10"])
    assert spark.read.parquet(f"{tmp_path}/out/english").count() == 10
    assert spark.read.parquet(f"{tmp_path}/out/changed").count() == 2


def test_cleaning_in_a_folder_equals_cleaning_without(spark, sf_dir, tmp_path):
    p = views.prompts(spark, sf_dir)
    a, b = cleaning.clean(p), cleaning.clean(p, folder=f"{tmp_path}/judged")
    for x, y in ((a.kept, b.kept), (a.report, b.report), (a.reasons, b.reasons)):
        assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)


def test_keep_first_takes_nulls_for_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "")], "row_id long, t string")
    assert sorted(r["row_id"] for r in cleaning.keep_first(df, ["t"], ["row_id"]).collect()) == [1, 3, 5]


def test_extraction_actions_and_written_analysis(spark, sf_dir, tmp_path):
    rows = sessions.with_action_labels(views.prompts(spark, sf_dir))
    actions = transcripts.extraction_actions(rows)
    assert sum(r["n"] for r in actions.collect()) == rows.count()
    exports.write_analysis({"actions": actions}, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/summary", wholetext=True).first()[0].count('"n"') == actions.count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/actions").count() == actions.count()
