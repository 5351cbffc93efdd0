"""Event logs, motion, metadata and sinks on small files."""

import json

import pytest

from tidemark.sinks import writers
from tidemark.sources import files


def test_event_log_keeps_one_kind_and_counts_the_rest(spark, tmp_path):
    head = "Event Type,Timestamp (YYYY-MM-DDThh:mm:ss),Glucose Value (mg/dL)"
    rows = ["EGV,2024-01-01T00:05:00,110", "EGV,2024-01-01T00:00:00,100", "EGV,2024-01-01T00:05:00,110", "EGV,bad,120", "EGV,2024-01-01T00:10:00,bad", "Alert,2024-01-01T00:15:00,1"]
    (tmp_path / "007.csv").write_text("\n".join([head, *rows]) + "\n")
    columns = {"Timestamp (YYYY-MM-DDThh:mm:ss)": "ts timestamp_ntz", "Glucose Value (mg/dL)": "glucose double"}
    clean, counts = files.read_event_log(spark, str(tmp_path), "EGV", columns, "Event Type")
    assert [(r.participant, r.ts.minute, r.glucose) for r in clean.orderBy("ts").collect()] == [("007", 0, 100.0), ("007", 5, 110.0)]
    assert counts.first().asDict() == {"participant": "007", "n": 5, "bad_time": 1, "bad_glucose": 1, "duplicates": 1}
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_event_log(spark, str(tmp_path), "EGV", {"Other": "x string"}, "Event Type")
    audit = files.audited_signal(clean, 60_000_000, "ts", "glucose").first()
    assert (audit.n, audit.n_finite, audit.duplicates, audit.gaps, audit.max_gap) == (2, 2, 0, 1, 300_000_000)


def test_motion_and_metadata(spark, tmp_path):
    (tmp_path / "a.csv").write_text("datetime,acc_x,acc_y,acc_z,more\n2024-01-01 00:00:00,1,2,3,9\n2024-01-01 00:00:01,1,,3,9\n")
    motion = files.read_motion_csv(spark, str(tmp_path / "a.csv"), ["acc_x", "acc_y", "acc_z"])
    assert [(r.participant, r.acc_x, r.acc_y, r.acc_z) for r in motion.collect()] == [("a", 1.0, 2.0, 3.0)]
    windows = spark.createDataFrame([("a",), ("b",)], "participant string")
    assert sorted(files.with_motion(windows, motion, ["participant"], "acc_x").collect()) == [("a", 1.0), ("b", 0.0)]
    (tmp_path / "people.csv").write_text("ID,Gender,Height,Weight,Glucose\n1,Female,160,64,5.2\n2,Male,/,80,/\n3,other,0,70,6\n")
    columns = {"ID": "id int", "Gender": "sex string", "Height": "height_cm double", "Weight": "weight_kg double", "Glucose": "glucose double"}
    got = {r.id: (r.sex_code, r.bmi and round(r.bmi, 3), r.glucose) for r in files.read_metadata(spark, str(tmp_path / "people.csv"), columns).collect()}
    assert got == {1: (0, 25.0, 5.2), 2: (1, None, None), 3: (None, None, 6.0)}


def test_configs_are_mappings(tmp_path):
    (tmp_path / "a.json").write_text('{"x": [1]}')
    (tmp_path / "b.json").write_text("[1]")
    assert files.read_config(str(tmp_path / "a.json")) == {"x": [1]}
    with pytest.raises(ValueError, match="mapping"):
        files.read_config(str(tmp_path / "b.json"))


def test_sinks_do_not_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a|b"), (2, 0.5, None)], "k int, v double, s string")
    for write, name in ((writers.write_parquet, "p"), (writers.write_csv, "c")):
        write(df, str(tmp_path / name))
        with pytest.raises(Exception, match="already exists"):
            write(df, str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "v", "s"]
    writers.write_json({"rows": writers.few(df, 10), "inf": float("inf"), "t": (1, True)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"rows": [{"k": 1, "v": None, "s": "a|b"}, {"k": 2, "v": 0.5, "s": None}], "inf": None, "t": [1, True]}
    writers.write_markdown("Report", {"Text": "All is well.", "Table": df}, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().splitlines()[8:] == ["| k | v | s |", "| - | - | - |", "| 1 | - | a\\|b |", "| 2 | 0.5 | - |"]
    for path in ("r.json", "r.md"):
        with pytest.raises(FileExistsError):
            (writers.write_json if path.endswith("json") else lambda r, p: writers.write_markdown("x", r, p))({}, str(tmp_path / path))
        with pytest.raises(FileExistsError):
            writers.must_be_new(str(tmp_path / path), str(tmp_path / "new"))
    with pytest.raises(ValueError, match="at most"):
        writers.few(df, 1)


def test_restore_if_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path, built = str(tmp_path / "t"), []
    expected = writers.fingerprint(df)
    assert expected == writers.fingerprint(df.repartition(3).select("v", "k")) != writers.fingerprint(df.union(df))

    def build():
        built.append(1)
        return df

    assert writers.restore_if_missing(spark, path, expected, build) and not writers.restore_if_missing(spark, path, expected, build) and built == [1]
    with pytest.raises(ValueError, match="another fingerprint"):
        writers.restore_if_missing(spark, path, "0-0", build)
    with pytest.raises(ValueError, match="another fingerprint"):
        writers.restore_if_missing(spark, path + "2", "0-0", build)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
