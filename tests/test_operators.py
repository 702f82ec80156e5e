"""Operators on small tables with results worked out by hand, and properties that must hold on any table."""

import math

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import cleaning, discovery, external, features, metrics, sessions, splits, stats, transcripts
from sessionloom.plans import views
from sessionloom.sources import exports, readers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


TURNS = "row_id long, full_name string, source_file string, turn_index int, prompt_text string, agent_response string, has_generated_code boolean, has_tool_use boolean, code_block_count int, generated_code string"


def turns(spark, values):
    return spark.createDataFrame([(i, "r", "f", k, p, "", c, False, 0, "") for i, (k, p, c) in enumerate(values)], TURNS)


def test_session_features(spark):
    df = sessions.with_session_features(turns(spark, [(1, "a", True), (3, "b", False), (4, "c", True)]))
    got = rows(df.select("turn_index", "prev_turn_had_code", "session_code_rate_before", "turns_before", "session_turn_count"), "turn_index")
    assert got == [(1, False, 0.0, 0, 4), (3, True, 1.0, 2, 4), (4, False, 0.5, 3, 4)]


def test_prior_turns(spark):
    df = sessions.prior_turns_text(turns(spark, [(1, "a", True), (2, "b", False), (3, "c", True)]), 2)
    assert rows(df.select("turn_index", "context_text"), "turn_index")[2][1] == "[turn -2] a\n[turn -1] b\n[current] c"
    assert rows(sessions.prior_turns_text(df, 0).select("context_text"), "context_text") == [("a",), ("b",), ("c",)]


def test_allocation(spark):
    df = spark.createDataFrame([("r", s) for s, n in (("A", 5), ("B", 3), ("C", 2)) for _ in range(n)], "full_name string, stratum string")
    assert rows(cleaning.allocation(df, 4).select("stratum", "alloc"), "stratum") == [("A", 2), ("B", 1), ("C", 1)]


def test_repo_cap(spark, sf_dir):
    p = views.prompts(spark, sf_dir)
    capped = cleaning.repo_cap(p, 3)
    sizes = {r["full_name"]: r["count"] for r in p.groupBy("full_name").count().collect()}
    after = {r["full_name"]: r["count"] for r in capped.groupBy("full_name").count().collect()}
    assert after == {k: min(3, n) for k, n in sizes.items()}
    assert rows(capped.select("row_id"), "row_id") == rows(cleaning.repo_cap(p.repartition(3), 3).select("row_id"), "row_id")


def test_keep_first_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "row_id long, t string")
    assert rows(cleaning.keep_first(df, ["t"], ["row_id"]).select("row_id"), "row_id") == [(1,), (3,)]


def test_gini_and_diversity(spark):
    assert stats.gini(spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double")).first()[0] == pytest.approx(1 / 6)
    assert stats.gini(spark.createDataFrame([], "x double")).first()[0] == 0.0
    df = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "h"), ("c", "h")], "full_name string, source_file string")
    d = stats.diversity(df).first()
    assert d["hhi"] == pytest.approx(0.375) and d["effective_n"] == pytest.approx(8 / 3)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    m = metrics.multiclass(df, "y", "p").first()
    assert m["accuracy"] == 0.5 and m["macro_f1"] == pytest.approx(0.3889, abs=1e-4)
    k = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert metrics.cohen_kappa(k, "a", "b").first()[0] == pytest.approx(0.5)
    r = metrics.ranking(spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double"), "y", "s").first()
    assert r["roc_auc"] == pytest.approx(0.625) and r["avg_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    one = metrics.ranking(spark.createDataFrame([(1, 0.9)], "y int, s double"), "y", "s").first()
    assert one["roc_auc"] is None and one["avg_precision"] == 1.0


def test_p_values():
    assert metrics.t_p_value(2.776, 4) == pytest.approx(0.05, abs=1e-3)
    assert metrics.wilcoxon_p_value([1, 2, 3, 4, 5]) == pytest.approx(0.0625)
    assert metrics.wilcoxon_p_value([]) == 1.0


def test_splits(spark, sf_dir):
    p = splits.group_split(views.prompts(spark, sf_dir))
    report = splits.overlap_report(p).first()
    assert report["overlap"] == 0 and report["leakage_free"]
    assert report["test_repos"] == math.ceil(0.2 * (report["train_repos"] + report["test_repos"]))
    folds = splits.group_folds(p, 3)
    assert folds.groupBy("full_name").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert folds.select("fold").distinct().count() == 3
    with pytest.raises(ValueError):
        splits.group_folds(p.where("full_name = 'src0'"), 3)


def test_discovery(spark):
    hits = spark.createDataFrame(
        [("a", "q1", "s1", 5, "u2"), ("a", "q2", "s1", 9, "u1"), ("a", "q2", "s2", 9, "u0"), ("b", "", "s1", None, "u3")],
        "full_name string, detection_query string, discovery_source string, stars int, url string",
    )
    got = rows(discovery.candidates(hits).select("full_name", "stars", "detected_by", "signal_count", "source_count"), "full_name")
    assert got == [("a", 9, "q1, q2", 2, 2), ("b", None, "", 0, 1)]


TRANSCRIPT = """_**User**_

Build the parser

---

_**Agent (m1)**_

<tool-use data-tool-name="Edit">patch</tool-use>

---

_**Agent (m1)**_

Done:
```py
x = 1
```
_**User**_

Build the parser
"""


def test_transcripts(spark):
    files = spark.createDataFrame([("a", TRANSCRIPT), ("b", "prompt: do  this\nnothing\nquery: that"), ("c", None), ("d", "## User guide\nhi\nTool: x\nAssistant: y")], "path string, content string")
    got = rows(transcripts.turn_pairs(files), "path", "turn_index")
    assert got[0] == ("a", 1, "Build the parser", "[tool: Edit]\n\nDone:\n```py\nx = 1\n```", "m1", "x = 1", 1, "py", True, True)
    assert [(g[0], g[1], g[2]) for g in got[1:]] == [("b", 1, "do  this"), ("b", 2, "that"), ("d", 1, "hi")]
    assert got[3][3] == ""  # a tool line ends the agent's island


def plain_pairs(text):
    """A line-by-line reading of the same rules, for conversations without code or tools."""
    speaker = {"_**User**_": "user", "_**Agent (m1)**_": "agent", "_**System**_": "system"}
    turns = []
    for line in text.split("\n"):
        if line in speaker:
            turns.append([speaker[line], []])
        elif turns:
            turns[-1][1].append(line)
    clean = lambda ls: "\n".join(x for x in ls if x.strip() != "---").strip()
    out, seen = [], set()
    for k, (role, lines) in enumerate(turns):
        if role != "user" or not clean(lines) or clean(lines) in seen:
            continue
        seen.add(clean(lines))
        answer = []
        for r, ls in turns[k + 1 :]:
            if r != "agent":
                break
            answer.append(clean(ls))
        out.append((clean(lines), "\n\n".join(answer)))
    return out


def test_transcripts_against_plain_reading(spark, sf_dir):
    files = views.transcripts(spark, sf_dir)
    got = {}
    for r in transcripts.turn_pairs(files).orderBy("path", "turn_index").collect():
        got.setdefault(r["path"], []).append((r["prompt_text"], r["agent_response"]))
    want = {r["path"]: plain_pairs(r["content"]) for r in files.collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_external(spark):
    df = spark.createDataFrame([(1, "部分 hello\n```\n部分\n```"), (2, "plain english"), (3, None)], "row_id long, t string")
    got = rows(external.translated(df, ["t"], lambda ts: [t.replace("部分", "part") for t in ts]).select("row_id", "t_en", "any_translated"), "row_id")
    assert got == [(1, "part hello\n```\n部分\n```", True), (2, "plain english", False), (3, "", False)]

    def failing(_):
        raise RuntimeError("down")

    p = turns(spark, [(1, "fix the error", False), (2, "fix the error", False)])
    out = external.labelled(p, failing, retries=2)
    assert {r["llm_error"] for r in out.collect()} == {"call_failed:down"}
    good = external.labelled(p)
    assert {r["llm_action_type"] for r in good.collect()} == {"debug"}
    cache = good.select("hash", F.lit("review").alias("action_type"), F.lit(1.0).alias("confidence"), F.lit("").alias("rationale"))
    assert {r["llm_action_type"] for r in external.labelled(p, failing, cache).collect()} == {"review"}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q",\nb'), (2, "c")], "row_id int, prompt_text string")
    exports.write_csv(df, f"file://{tmp_path}/csv")
    back = readers.csv(spark, f"file://{tmp_path}/csv")
    assert back.columns == ["row_id", "prompt_text"]
    assert rows(back, "row_id") == [("1", 'a "q",\nb'), ("2", "c")]
    folder = tmp_path / "t" / ".log"
    folder.mkdir(parents=True)
    (tmp_path / "t" / "x.md").write_text("User: hi\r\n\r\n\r\n\r\nthere")
    got = rows(readers.transcripts(spark, f"file://{tmp_path}/t"), "path")
    assert [g[1] for g in got] == ["User: hi\n\nthere"]
    assert readers.latest(spark, f"file://{tmp_path}/t", "*.md").endswith("x.md")
    with pytest.raises(FileNotFoundError):
        readers.latest(spark, f"file://{tmp_path}/t", "*.csv")
    wide = readers.with_defaults(df)
    assert "has_tool_use" in wide.columns
    t = turns(spark, [(1, "p", False)]).withColumn("agent_response", F.lit("r" * 50))
    exports.write_blobs(t, f"file://{tmp_path}/blobs", 20)
    name = exports.spreadsheet(t, "x", 20).select("agent_response_blob_path").first()[0].split("/")[-1]
    assert (tmp_path / "blobs" / name).read_text() == "r" * 50
    assert "| row_id |" in exports.markdown(df)


def test_features(spark, sf_dir):
    p = views.prompts(spark, sf_dir)
    d = features.derived(p)
    assert d.count() == p.count() and "repo_median_words" in d.columns
    h = features.history(sessions.enriched(p)).first()
    assert h["prev_none"] + sum(h[f"prev_{a}"] for a in ("implement", "explain", "debug", "review", "tool_only", "other")) == 1.0
    counts = features.terms(p, "prompt_text", "row_id", ngrams=2)
    model = features.tfidf_fit(counts, p.count())
    w = features.tfidf(counts, model, "row_id").groupBy("row_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    assert w.where(F.abs(F.col("n") - 1) > 1e-9).isEmpty()
