"""Windows of a stream are those of a batch, wherever it is cut."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditioning
from tidemark.streaming.windows import window_stream

GAP = 12 * 3_600_000_000


@pytest.mark.parametrize("cuts", [["2024-01-15"], ["2024-01-03", "2024-01-04 07:00:00", "2024-01-09", "2024-01-21 13:30:00"]])
def test_windows_of_a_stream(spark, tmp_path, cuts):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("user_id < 25").select("user_id", "event_id", "ts", "value")
    # Some rows stand twice, so steps of zero break spans.
    events = events.unionByName(events.where("event_id % 41 = 0").withColumn("event_id", F.col("event_id") + 1_000_000)).cache()
    bounds, source = ["1970-01-01", *cuts, "2100-01-01"], str(tmp_path / "in")
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        events.where(f"ts >= timestamp_ntz'{a}' AND ts < timestamp_ntz'{b}'").coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    name = f"windows_{len(cuts)}"
    run = window_stream(stream, "user_id", 4, GAP).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(200)
    want = sorted(map(tuple, conditioning.signal_windows(events, "user_id", 4, GAP).collect()))
    got = sorted(spark.table(name).collect())
    assert [tuple(r)[:4] for r in got] == want and len(want) > 50
    # Counts up to a window's end, by hand.
    by = {}
    for r in events.orderBy("ts", "event_id").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect():
        by.setdefault(r["user_id"], []).append(r["t"])
    for r in got:
        own, after = by[r["user_id"]], None
        n = r["n_rows"]
        assert own[n - 1] == r["window_end"]
        steps = [b - a for a, b in zip(own[:n], own[1:n], strict=False)]
        assert (r["n_gaps"], r["n_not_positive"]) == (sum(s > GAP for s in steps), sum(s <= 0 for s in steps)), after
