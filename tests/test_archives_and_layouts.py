"""Archives read by range against the zipfile module, and streams read up to cut-offs against a plain filter."""

import hashlib
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sinks.archives import write_archives
from tidemark.sources import archives, files
from tidemark.sources.streams import StreamLayout


def sha(data):
    return hashlib.sha256(data).hexdigest()


def manifest(spark, tmp_path, lines):
    (tmp_path / "manifest").write_text("".join(f"{digest} {name}\n" for name, digest in lines))
    return files.read_manifest(spark, str(tmp_path / "manifest"))


def test_one_archive_is_as_many_tasks_as_members(spark, tmp_path):
    draw, folder = random.Random(5), tmp_path / "zips"
    folder.mkdir()
    want = {}
    with zipfile.ZipFile(folder / "one.zip", "w") as z:
        for i in range(12):
            data = draw.randbytes(100_000) if i % 2 else b"abc" * draw.randrange(400_000)
            z.writestr(zipfile.ZipInfo(f"root/{i}.bin"), data, zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
            want[f"root/{i}.bin"] = (len(data), sha(data))
        z.mkdir("root/folder")
        z.writestr("root/empty", b"")
    want["root/empty"] = (0, sha(b""))
    listed = files.inventory(spark, str(folder))
    found = archives.archive_members(listed, task_bytes=60_000).withColumn("task", F.spark_partition_id()).collect()
    assert {r.member: (r.bytes, r.found) for r in found} == want and all(r.intact and r.safe for r in found)
    assert len({r.task for r in found}) == len(found) == 13
    assert len({r.task for r in archives.archive_members(listed).withColumn("task", F.spark_partition_id()).collect()}) == 1


def test_damaged_members_have_no_digest(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("stored", b"plain bytes")
        z.writestr("packed", b"many bytes " * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("lzma", b"other bytes", zipfile.ZIP_LZMA)
        z.writestr("whole", b"right")
    data = bytearray((folder / "a.zip").read_bytes())
    data[data.index(b"plain bytes")] ^= 1
    at = data.index(b"packed") + len("packed") + 8
    data[at : at + 4] = b"\xff\xff\xff\xff"
    (folder / "a.zip").write_bytes(data)
    found = {r.member: (r.intact, r.found) for r in archives.archive_members(files.inventory(spark, str(folder))).collect()}
    assert found == {"stored": (False, None), "packed": (False, None), "lzma": (False, None), "whole": (True, sha(b"right"))}
    with zipfile.ZipFile(folder / "a.zip", "w"):
        pass
    assert archives.archive_members(files.inventory(spark, str(folder))).count() == 0


def test_members_match_a_manifest(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "one.zip", "w") as z:
        for name in ("root/a.csv", "root/b.csv", "../up.csv", "extra.csv", "root/SHA256SUMS.txt", "x/both.csv", "d.csv", "root/d.csv"):
            z.writestr(name, name.encode())
    right = lambda name: sha(name.encode())
    names = manifest(spark, tmp_path, [("a.csv", right("root/a.csv")), ("root/b.csv", sha(b"x")), ("gone.csv", sha(b"g")), ("x/both.csv", right("x/both.csv")), ("both.csv", right("x/both.csv")), ("d.csv", right("d.csv")), ("bad.csv", "123")])
    members = archives.archive_members(files.inventory(spark, str(folder)))
    got = {(r.name, r.member, r.state) for r in archives.match_members(members, names).where("state <> 'ambiguous'").collect()}
    # Both names of x/both.csv are in the manifest, so it stands for neither.
    assert got == {("a.csv", "root/a.csv", "ok"), ("root/b.csv", "root/b.csv", "differs"), ("gone.csv", None, "missing"), ("both.csv", None, "missing"), ("x/both.csv", None, "missing"),
                   ("bad.csv", None, "invalid"), (None, "extra.csv", "unlisted"), (None, "x/both.csv", "unlisted"), (None, "../up.csv", "unsafe")}
    assert [r.name for r in archives.match_members(members, names).where("state = 'ambiguous'").collect()] == ["d.csv"]
    with pytest.raises(ValueError, match="archives and manifest differ"):
        archives.extract_verified(files.inventory(spark, str(folder)), names, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_extraction_keeps_right_files_alone(spark, tmp_path):
    folder, out = tmp_path / "zips", tmp_path / "out"
    folder.mkdir()
    with zipfile.ZipFile(folder / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("root/sub/a.csv", b"a" * 100_000)
        z.writestr("root/b.csv", b"b")
    names = manifest(spark, tmp_path, [("sub/a.csv", sha(b"a" * 100_000)), ("b.csv", sha(b"other"))])
    listed = files.inventory(spark, str(folder))
    for _ in range(2):  # again over what is there
        got = archives.extract_verified(listed, names, str(out))
        assert {(r.name, r.state) for r in got.collect()} == {("sub/a.csv", "ok"), ("b.csv", "differs")}
        assert [os.path.relpath(os.path.join(p, f), out) for p, _, fs in os.walk(out) for f in fs] == ["sub/a.csv"]
    assert (out / "sub/a.csv").read_bytes() == b"a" * 100_000


def test_lines_of_members(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    long = "x" * 3_000_000
    with zipfile.ZipFile(folder / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("p/a.csv", f"t,v\r\n1,é\n\n{long}\nlast")
        z.writestr("p/b.csv", "t,v\n" + "".join(f"{i},{i}\n" for i in range(30_000)))
        z.writestr("p/c.txt", "no")
    rows = archives.archive_lines(files.inventory(spark, str(folder)), r"\.csv$", rows=1000)
    a = [(r.line_no, r.line) for r in rows.where("member = 'p/a.csv'").orderBy("line_no").collect()]
    assert a == [(0, "t,v"), (1, "1,é"), (2, ""), (3, long), (4, "last")]
    parsed = rows.where("member = 'p/b.csv' AND line_no > 0").select("line_no", F.from_csv("line", "t long, v double").alias("r"))
    assert parsed.where("r.t = line_no - 1").count() == 30_000 == rows.where("member = 'p/b.csv'").count() - 1


def test_written_archives_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text"), ("b", None), ("b", "é" * 50_000), (None, "lost"), ("c/d", "")], "name string, body string")
    written = write_archives(rows, str(tmp_path / "out"), "name", "body", archive_bytes=20_000).collect()
    assert sum(r.members for r in written) == 4 and len(written) > 1
    assert sorted(os.listdir(tmp_path / "out")) == sorted(os.path.basename(r.archive) for r in written)
    got = sorted((r.member, r.found) for r in archives.archive_members(files.inventory(spark, str(tmp_path / "out"))).collect())
    assert got == sorted([("a", sha(b"text")), ("b", sha(b"")), ("b", sha("é".encode() * 50_000)), ("c/d", sha(b""))])
    assert write_archives(rows.limit(0), str(tmp_path / "none"), "name", "body").count() == 0
    assert archives.archive_members(files.inventory(spark, str(tmp_path / "none"))).count() == 0


def scanned(df):
    """Rows that the scan of df put out, by the plan's metrics."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    walk = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while walk:
        node = walk.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            walk.append(node.plan())
        walk += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_rows_behind_the_cut_off_are_not_read(spark, tmp_path, kind):
    hours = 24 * 40
    rows = spark.range(20 * hours).select((F.col("id") % 20).alias("who"), F.timestamp_seconds(1_704_067_200 + F.floor(F.col("id") / 20) * 3600).cast(kind).alias("at"), F.col("id").alias("v"))
    more = spark.createDataFrame([(None, "2024-01-01", 1), (3, None, 2)], "who long, at string, v long").withColumn("at", F.col("at").cast(kind))
    layout, path = StreamLayout("who", "at", bins=4), str(tmp_path / "streams")
    layout.write(rows.unionByName(more), path)
    stop = lambda day: F.timestamp_seconds(1_704_067_200 + F.lit(day) * 86_400).cast(kind).alias("stop_at")
    read = []
    for day in (2, 10, 30):
        stops = spark.range(20).where("id <> 7").select(F.col("id").alias("who"), stop(day))
        stops = stops.unionByName(stops.select("who", stop(1))).unionByName(stops.select(F.lit(7).cast("long").alias("who"), F.lit(None).cast(kind).alias("stop_at")).limit(1))
        got = layout.read_until(spark, path, stops)
        assert got.columns == ["who", "at", "v"] and got.count() == 19 * (24 * day + 1)
        assert got.exceptAll(rows).count() == 0
        read.append(max(scanned(got)))
        text = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(at,", text) and "its_time_slice" in text.split("PartitionFilters:")[1].split("PushedFilters")[0]
    # Rows read: those of the folders up to the cut-off, of 19,200 in all.
    assert all(20 * 24 * d <= r <= 20 * 24 * (d + 1) for d, r in zip((2, 10, 30), read, strict=True))
    assert layout.read_until(spark, path, stops.limit(0)).count() == 0
    with pytest.raises(ValueError, match="columns of the layout"):
        layout.write(rows.withColumn("its_time_slice", F.lit(1)), path + "2")
