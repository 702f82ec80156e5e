"""Ties, nulls and null-like texts, folds, reports, streams and the prediction composite."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import discovery, external, features, metrics, sessions, splits
from sessionloom.plans import catalogue, composites, reports, views
from sessionloom.sources import exports
from sessionloom.streaming import incremental


def test_best_rows_breaks_ties_by_text(spark):
    rows = [("a", 5, "u2"), ("a", 9, "u1"), ("a", 9, "u0"), ("b", None, "v1"), ("b", None, "v0")]
    for shuffled in (rows, rows[::-1]):
        hits = spark.createDataFrame(shuffled, "full_name string, stars int, url string")
        assert sorted(r["url"] for r in discovery.best_rows(hits).collect()) == ["u0", "v0"]


def test_only_the_exact_text_nan_is_blank(spark):
    df = spark.createDataFrame([("tell me", x, False, False, 0, "") for x in ("nan", "NaN", " nan ", "")], "p string, r string, c boolean, t boolean, n int, g string")
    assert [r[0] for r in df.select(T.action_label("p", "r", "c", "t", "n", "g")).collect()] == ["other"] * 4
    long = spark.createDataFrame([("tell me", "NaN" + "x" * 5000, False, False, 0, "")], df.schema)
    assert long.select(T.action_label("p", "r", "c", "t", "n", "g")).first()[0] == "explain"


def test_null_languages_are_unknown(spark):
    df = spark.createDataFrame([("py",), (None,), (None,), ("go",)], "repo_language string")
    assert features.top_languages(df, 1) == ["unknown"]
    out = features.language_buckets(df, ["unknown"]).select("language_bucket", "lang_unknown", "lang_other").collect()
    assert [tuple(r) for r in out] == [("other", 0, 1), ("unknown", 1, 0), ("unknown", 1, 0), ("other", 0, 1)]


def test_folds_follow_sizes_with_one_rule(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{i:02}",) for i in range(20) for _ in range(20 - i // 2)] + [(None,)], "full_name string")
    for cell in (100_000, 3):
        monkeypatch.setattr(splits, "GROUPS_PER_CELL", cell)
        out = splits.group_folds(df, 4)
        assert out.count() == df.count() - 1
        assert out.groupBy("full_name").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
        sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 20


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(60)
    assert "50 of 60 rows" in reports.report("t", {"x": df})
    assert "rows;" not in exports.markdown(df)


def test_sparse_vectors_hold_their_terms_only(spark):
    df = spark.createDataFrame([(1, "red fox red", False), (2, "blue fox", False), (3, None, True), (4, "green", True)], "row_id long, t string, is_test boolean")
    out = {r["row_id"]: r["tfidf"] for r in features.with_tfidf(df, "t", "row_id", min_df=1, ngrams=1, stop=[]).collect()}
    assert all(type(v).__name__ == "SparseVector" and v.size == 3 for v in out.values())
    assert {k: len(v.indices) for k, v in out.items()} == {1: 2, 2: 2, 3: 0, 4: 0}
    assert out[1].dot(out[1]) == pytest.approx(1.0)


def test_paired_tests(spark):
    folds = [("a", f, 0.1 * f) for f in range(5)] + [("b", f, 0.1 * f + 0.05 + 0.01 * f) for f in range(5)] + [("c", 0, 0.5)]
    df = spark.createDataFrame([(*r, "logistic_regression") for r in folds], "representation string, fold int, macro_f1 double, model string")
    same, missing = metrics.paired_tests(df, [("a", "b"), ("a", "c")]).collect()
    assert same["n"] == 5 and same["mean_diff"] == pytest.approx(0.07) and same["t_p_value"] < 0.01 and same["wilcoxon_p_value"] == pytest.approx(0.0625)
    assert missing["error"] == "unmatched fold counts (5 vs 1)" and missing["t"] is None


def test_stored_sessions_are_brought_up_to_date(spark, sf_dir, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/out"
    p = views.prompts(spark, sf_dir)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields)
    for part in (0, 1):
        p.where(F.col("row_id") % 2 == part).write.mode("append").parquet(source)
        incremental.append_sessions(incremental.turns(spark, source, schema), table, f"{tmp_path}/cp").awaitTermination(120)
    key = lambda df: sorted(map(str, df.select("row_id", "session_turn_count", "turns_before", "prev_action_type").collect()))
    assert key(incremental.current(spark, table)) == key(sessions.enriched(p))


def test_predict_actions(spark, sf_dir):
    rows = sessions.enriched(views.prompts(spark, sf_dir)).cache()
    out = composites.predict_actions(rows, None, folds=2, models=["logistic_regression"], encoder=external.hashed_encoder(8), only=["prompt_only", "prompt+history"])
    results = out["results"].collect()
    assert {r["representation"] for r in results} == {"prompt_only", "prompt+history"}
    assert all(0 <= r["accuracy"] <= 1 for r in results) and out["overlap"].first()["leakage_free"]
    assert {r["rep_b"] for r in out["significance"].collect()} == {"prompt+history"}


def test_files_whose_only_prompt_is_noise_are_counted(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "ok"), (1, 1, "assistant", "a long answer to it"), (2, 0, "user", "Was or st onwh, is."), (3, 0, "user", "Rename the loader and add a test for it"), (4, 0, "user", ""), (5, 0, "user", None), (6, 0, "assistant", "hello"), (None, 0, "user", "Explain the loader")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(catalogue.ORACLES["extraction_files"]).fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["extraction_files"](spark, str(tmp_path)).collect()] == want == [(3,)]
