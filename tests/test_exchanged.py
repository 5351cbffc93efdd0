"""What reaches the scan of results that were written, and reports in file systems with a scheme."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue, exchanged
from tidemark.sinks import writers
from tidemark.sources import files

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark):
    plan = plan_of(exchanged.k02_parquet_results(spark, DATA))
    assert "PartitionFilters: [lang" in plan and "GreaterThanOrEqual(n_chars,200)" in plan
    plan = plan_of(catalogue.queries()["s08_projected_scan"](spark, DATA))
    assert "In(" in plan.split("PushedFilters:")[1].splitlines()[0]


def test_report_at_a_uri_is_never_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/folder/report.json"
    writers.write_json({"a": [1.5, float("nan")]}, path)
    assert spark.read.option("multiLine", True).json(path).first().a == [1.5, None]
    with pytest.raises(FileExistsError):
        writers.write_json({}, path)
    assert [p.name for p in (tmp_path / "folder").iterdir()] == ["report.json"]


def test_another_header_fails(spark, tmp_path):
    rows = spark.range(3).select(F.lit(1).alias("participant"), F.lit("2024-01-01 00:00:00").alias("datetime"), "id")
    folder = exchanged.owned_csv(spark, rows, "header")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_signal_csv(spark, folder, exchanged.SIGNAL, exchanged.OWNER).collect()


def test_names_of_a_depth(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "c.txt").write_text("x")
    assert [files.inventory(spark, str(tmp_path), k).first()["name"] for k in (1, 2, 3)] == ["c.txt", "b/c.txt", "a/b/c.txt"]
