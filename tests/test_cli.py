"""The command line writes its tables and report."""

from sessionloom.__main__ import main
from sessionloom.plans import views


def test_enrich_label_reexport(spark, sf_dir, tmp_path):
    source = f"{tmp_path}/turns"
    views.prompts(spark, sf_dir).limit(60).write.parquet(source)
    main(["enrich", "--input", source, "--output", f"{tmp_path}/enriched"])
    assert "prev_action_type" in spark.read.parquet(f"{tmp_path}/enriched").columns
    main(["label", "--input", source, "--output", f"{tmp_path}/labels"])
    assert "kappa" in spark.read.text(f"{tmp_path}/labels/report", wholetext=True).first()[0]
    main(["reexport", "--input", source, "--output", f"{tmp_path}/csv"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/prompts_only").count() > 0


def test_discover_and_extract(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    views.hits(spark, sf_dir).withColumn("url", F.col("hit").cast("string")).write.parquet(f"{tmp_path}/hits")
    main(["discover", "--input", f"{tmp_path}/hits", "--output", f"{tmp_path}/found"])
    assert spark.read.parquet(f"{tmp_path}/found/candidates").count() > 0
    (tmp_path / "repo" / "x").mkdir(parents=True)
    (tmp_path / "repo" / "x" / "s.md").write_text("User: please write the parser for this format\n\nAgent: done\n")
    main(["extract", "--input", f"file://{tmp_path}/repo", "--output", f"{tmp_path}/turns"])
    r = spark.read.parquet(f"{tmp_path}/turns").first()
    assert r["prompt_text"] == "please write the parser for this format" and r["agent_response"] == "done"
