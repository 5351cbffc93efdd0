"""File sources on small files, and the span stream against the batch operator."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeseries
from tidemark.sources import files
from tidemark.streaming.spans import span_stream


def test_signal_csv(spark, tmp_path):
    (tmp_path / "p01.csv").write_text("ts, value\n2024-01-01 00:00:00,1.5\n2024-01-01 00:00:01,x\n")
    rows = files.read_signal_csv(spark, str(tmp_path), "ts timestamp_ntz, value double").orderBy("ts").collect()
    assert [(r.participant, r.value) for r in rows] == [("p01", 1.5), ("p01", None)]
    (tmp_path / "p01.csv").write_text("ts,other\n2024-01-01 00:00:00,1.5\n")
    with pytest.raises(Exception, match="header|Header"):
        files.read_signal_csv(spark, str(tmp_path), "ts timestamp_ntz, value double").collect()


def test_manifest(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    for name in ("a", "b", "extra"):
        (folder / name).write_bytes(name.encode())
    digest = hashlib.sha256(b"a").hexdigest()
    (tmp_path / "manifest").write_text(f"{digest}  a\n{digest}  b\n\n{digest} gone\nXYZ bad\n{digest} twice\n{digest} twice\n")
    manifest = files.read_manifest(spark, str(tmp_path / "manifest"))
    got = {r.name: r.state for r in files.verify_files(spark, manifest, str(folder)).collect()}
    assert got == {"a": "ok", "b": "differs", "gone": "missing", "extra": "unlisted", "bad": "invalid", "twice": "invalid"}


def test_span_stream(spark, tmp_path):
    gap = 12 * 3_600_000_000
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts")
    middle = "timestamp_ntz'2024-01-15 00:00:00'"
    source = str(tmp_path / "in")
    for part, where in enumerate((f"ts < {middle}", f"ts >= {middle}")):
        events.where(where).coalesce(1).write.mode("append").parquet(f"{source}/part={part}")
    end = events.select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("ts")).limit(1)
    end.select(*[F.col(c).cast(events.schema[c].dataType) for c in events.columns]).coalesce(1).write.parquet(f"{source}/part=2")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{source}/*")
    found = span_stream(stream, "user_id", gap)
    run = found.writeStream.format("memory").queryName("span_rows").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(100)
    columns = ["user_id", "span_start", "span_end", "n_rows"]
    want = timeseries.spans(events, "user_id", gap).select(columns)
    assert sorted(map(tuple, spark.table("span_rows").where("user_id >= 0").select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_span_stream_keeps_keys_together_in_buckets(spark, tmp_path):
    gap, begin, users = 12 * 3_600_000_000, dt.datetime(2024, 1, 1), 6000
    at = lambda hours: begin + dt.timedelta(hours=hours)
    owners = [None, *(2**53 + i for i in range(users))]
    first = [(k, at(0)) for i, k in enumerate(owners) for _ in range(2 if i % 3 == 0 else 1)]
    second = [(k, at(11 if i % 2 else 13)) for i, k in enumerate(owners)] + [(k, at(-0.5)) for k in owners[::5]]  # the last come late
    third = [(k, at(40)) for k in owners[::4]]
    parts = [first, second, third, [(-1, at(24 * 365))]]
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for part, rows in enumerate(parts):
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{source}/part={part}")
        stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(f"{source}/*")
        found = span_stream(stream, "user_id", gap)
        run = found.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert run.awaitTermination(200)
        kept = [o.numRowsTotal for p in run.recentProgress for o in p.stateOperators]
        assert kept and max(kept) <= 4097
    rows, micros = {}, lambda t: round((t - begin) / dt.timedelta(microseconds=1)) + 1_704_067_200_000_000
    for part in parts[:3]:
        for k, t in sorted(part, key=lambda r: r[1]):
            rows.setdefault(k, []).append(micros(t))
    want = []
    for k, seen in rows.items():
        cuts = [0, *(i for i in range(1, len(seen)) if not 0 < seen[i] - seen[i - 1] <= gap), len(seen)]
        want += [(k, seen[a], seen[b - 1], b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got = spark.read.parquet(str(tmp_path / "out")).where("user_id IS NULL OR user_id >= 0").select("user_id", "span_start", "span_end", "n_rows").collect()
    order = lambda r: (r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("kind", ["string", "timestamp", "int"])
def test_span_stream_takes_keys_of_other_kinds(spark, tmp_path, kind):
    key = "timestamp_seconds(k)" if kind == "timestamp" else f"cast(k as {kind})"
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for part, hour in enumerate((0, 11, 30, 9000)):
        rows = spark.range(4).selectExpr("nullif(id, 3) AS k").selectExpr(f"{key} AS owner", f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {hour}, coalesce(k, 3), 0) AS ts")
        rows.coalesce(1).write.parquet(f"{source}/part={part}")
        found = span_stream(spark.readStream.schema(rows.schema).parquet(f"{source}/*"), "owner", 12 * 3_600_000_000, buckets=2)
        run = found.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert run.awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.schema["owner"].dataType == rows.schema["owner"].dataType
    owners = sorted(str(r.owner) for r in rows.select("owner").collect())
    assert sorted((str(r.owner), r.n_rows) for r in got.collect()) == sorted((o, n) for o in owners for n in (1, 2))
