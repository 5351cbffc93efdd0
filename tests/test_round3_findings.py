"""What the third round's findings were about: last digits of quantiles, ties at a boundary, and joins of exploded rows."""

import datetime as dt
import random

import duckdb
import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import encoding, language_id
from tidemark.operators import distribution, evaluation, folds, slopes, splits, suites
from tidemark.plans import catalogue


def test_quantiles_have_the_last_digit_of_sql(spark):
    rng = random.Random(3)
    rows = [(g, round(rng.expovariate(0.02), 2)) for g in range(400) for _ in range(rng.randint(1, 80))] + [(400, float("inf")), (400, 1.0), (400, 2.5)]
    rows += [(401, 0.1)] * 14
    con = duckdb.connect()
    con.execute("CREATE TABLE r (g BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?)", rows)
    want = con.execute("SELECT g, quantile_cont(v, 0.1), quantile_cont(v, 0.25), quantile_cont(v, 0.9) FROM r GROUP BY g").fetchall()
    found = distribution.quantiles(spark.createDataFrame(rows, "g long, v double"), "g", "v", {"a": 0.1, "b": 0.25, "c": 0.9})
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_no_embargo_excludes_no_row_at_the_time_of_a_boundary(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, at + dt.timedelta(minutes=i // 5)) for i in range(20)]
    found = splits.chronological_split(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), "user_id", 0)
    got = {r["event_id"]: r["split"] for r in found.collect()}
    assert [got[i] for i in range(20)] == ["train"] * 12 + ["validation"] * 4 + ["test"] * 4


def test_policies_equal_sql_where_times_are_tied(spark, tmp_path):
    con = duckdb.connect()
    rows = "SELECT event_id + k * 10000000 AS event_id, ts, user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet' CROSS JOIN (SELECT unnest(range(6)) AS k)"
    con.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(catalogue.oracle_sql()["m21_policies"])
    got = catalogue.queries()["m21_policies"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_exploded_rows_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.explode(F.array(*map(F.lit, range(20)))).alias("v"))
    few = distribution.quantiles(rows, "v", "id", {"m": 0.5})
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    old, distribution.FEW = distribution.FEW, 3
    try:
        many = distribution.quantiles(rows, "v", "id", {"m": 0.5})
        plan = many._jdf.queryExecution().executedPlan().toString()
    finally:
        distribution.FEW = old
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) == [(v, 24.5) for v in range(20)]


def test_folds_broadcast_counts_and_not_rows(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2).alias("k"))
    dealt = folds.repeated_folds(rows, "id", "k", 5, 20)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_a_worker_forgets_its_encoders():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encoding.encoder(path).ids("some words, and some more")
    words = encoding.encoder(path).words
    assert words
    encoding.forget()
    assert not words and not encoding._encoders
    assert encoding.encoder(path).ids("some words, and some more") == ids


def test_a_suite_reads_its_rows_once(spark):
    """Whatever the number of steps: the rows of a suite may be an expensive plan."""
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rng = random.Random(5)
    rows = [("m", [rng.gauss(0, 1), None if k % 7 == 0 else float(k % 3)], "abc"[k % 3] if k % 5 else "a", 1.0) for k in range(300)]
    schema = "model string, x array<double>, label string, weight double"
    df = spark.createDataFrame(rows, schema).mapInArrow(counting, schema)
    suite = suites.fitted(df, ["a", "b", "c"])
    assert read.value == 300 and suite.median[0, 1] == 1.0


def test_first_steps_on_some_blocks_change_no_coefficient(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("m", [x := rng.gauss(0, 1)], "ab"[x + rng.gauss(0, 1) > 0], 1.0) for _ in range(3000)]
    df = spark.createDataFrame(rows, "model string, x array<double>, label string, weight double").repartition(4).localCheckpoint()
    monkeypatch.setattr(suites, "BLOCK", 100)
    whole = suites.fitted(df, ["a", "b"])
    monkeypatch.setattr(suites, "BEGIN", 4)
    assert abs(suites.fitted(df, ["a", "b"]).betas - whole.betas).max() < 1e-9


def test_means_of_several_values_share_their_draws(spark):
    rows = [(k, float(k % 7), None if k % 3 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    both = {r["draw"]: r for r in evaluation.bootstrap_means_of(df, "k", ["a", "b"], 20).collect()}
    for name in ("a", "b"):
        own = {r["draw"]: r["mean"] for r in evaluation.bootstrap_means(df, "k", name, 20).collect()}
        assert own.keys() == both.keys() and all(abs(own[d] - both[d][name]) < 1e-12 for d in own)


def test_pairs_of_points_are_not_made_row_by_row(spark):
    rows = [(k, [(i * 10, float(i * k)) for i in range(k)]) for k in range(5)] + [(5, [(7, 1.0), (7, 2.0)]), (6, [(0, None), (5, float("nan")), (9, 1.0)]), (7, None)]
    df = spark.createDataFrame(rows, "k int, seen array<struct<t:long,value:double>>").coalesce(1)
    found = df.select("k", slopes.theil_sen("seen", 10).alias("s"))
    assert "flatten(" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["s"] for r in found.collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 7)] == [None, None, 2.0, 3.0, 4.0, None, None] and got[6] != got[6]


def test_baseline_suite_keeps_nothing_in_memory(spark):
    spark.catalog.clearCache()
    assert catalogue.queries()["m05_baseline_suite"](spark, "/root/testdata/sf0.001").count() == 5
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_counts_of_grams_come_to_the_driver_as_numbers(spark, monkeypatch):
    built, build = [], language_id.build
    monkeypatch.setattr(language_id, "build", lambda table, *names: (built.append(table.dtypes), build(table, *names))[1])
    rows = [(k, "the quick brown fox" if k % 2 else "le renard brun et vif", "en" if k % 2 else "fr") for k in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"] and built and all(d.kind in "iu" for kinds in built for d in kinds)
    assert language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == []
