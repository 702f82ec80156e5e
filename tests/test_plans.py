"""Composites run end to end; plans push down and prune."""

from sessionloom.operators import sessions
from sessionloom.plans import composites, views
from sessionloom.streaming import incremental


def test_analyse(spark, sf_dir):
    config = composites.AnalysisConfig(min_clusters=2, max_clusters=3)
    out = composites.analyse(views.prompts(spark, sf_dir), config)
    assert out["clustered"].count() == out["cleaned"].count() > 0
    assert out["cluster_search"].count() == 2
    for name in ("cleaning_report", "diversity", "intents", "cluster_profile", "cluster_terms"):
        assert not out[name].isEmpty(), name


def test_discover(spark, sf_dir):
    d = composites.discover(views.hits(spark, sf_dir), "hit")
    assert d.summary.first()["candidates"] == d.candidates.count()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_pushdown_and_single_shuffle(spark, sf_dir):
    p = sessions.enriched(views.prompts(spark, sf_dir)).select("row_id", "prev_action_type", "session_code_rate_before", "session_turn_count")
    text = plan(p)
    # Every document is read, by the columns asked for only.
    assert "lang" not in text and "n_chars" not in text
    # One for the view's turn numbers, one for all session windows.
    assert text.count("Exchange hashpartitioning") + text.count("Exchange\n") <= 6


def test_stream(spark, sf_dir, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/out"
    p = views.prompts(spark, sf_dir)
    p.where("row_id % 2 = 0").write.parquet(f"{source}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields)
    q = incremental.append_sessions(incremental.turns(spark, source, schema), table, f"{tmp_path}/cp")
    q.awaitTermination(120)
    p.where("row_id % 2 = 1").write.mode("append").parquet(source)
    q = incremental.append_sessions(incremental.turns(spark, source, schema), table, f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = spark.read.parquet(table)
    assert got.count() == p.count() and got.select("row_id").distinct().count() == p.count()
