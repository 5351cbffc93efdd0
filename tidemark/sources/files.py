"""File sources: signal, event and motion CSV, typed metadata, configs and manifests, and digests of files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeseries as ts

CHUNK = 8 << 20


def read_signal_csv(spark: SparkSession, path: str, schema: str, participant: str = r"([^/]+)\.csv$") -> DataFrame:
    """Rows of CSV files with `participant` taken from each file's name.

    A header that differs from the schema's names (blanks around them apart) fails the read; values that do not parse
    become null.
    """
    options = {"header": True, "enforceSchema": False, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE"}
    rows = spark.read.schema(schema).options(**options).csv(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), participant, 1).alias("participant"), "*")


def audited_signal(rows: DataFrame, max_gap: int, at: str, value: str) -> DataFrame:
    """A row per participant: rows with a time, finite ones, duplicate times, gaps over max_gap microseconds, and the
    longest gap."""
    usable = rows.where(F.col(at).isNotNull())
    lagged = ts.with_lag(usable.withColumn("its_value", F.col(value)), "participant", at, "its_value")
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return lagged.groupBy("participant").agg(
        F.count("*").alias("n"), F.count_if(finite).alias("n_finite"), F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if(F.col("gap") > max_gap).alias("gaps"), F.max("gap").alias("max_gap")
    )


def read_event_log(spark: SparkSession, path: str, kind: str, columns: dict[str, str], kind_column: str, participant: str = r"([^/]+)\.csv$") -> tuple[DataFrame, DataFrame]:
    """(clean rows of one kind of event, counts of what was left out per participant).

    columns: name in the file -> "name type" here, the first being the time. All columns are read as text, so that
    what does not parse is counted and not lost. Of rows of one time the first stays, by its other values.
    """
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    missing = {kind_column, *columns} - set(raw.columns)
    if missing:
        raise ValueError(f"event log lacks columns {sorted(missing)}")
    own = [(old, *new.split(" ", 1)) for old, new in columns.items()]
    typed = raw.where(F.col(f"`{kind_column}`") == kind).select(
        F.regexp_extract(F.col("_metadata.file_path"), participant, 1).alias("participant"), *(F.col(f"`{old}`").try_cast(kind_of).alias(new) for old, new, kind_of in own)
    )
    time, values = own[0][1], [n for _, n, _ in own[1:]]
    whole = F.lit(True)
    for n in values:
        whole = whole & F.col(n).isNotNull()
    first = typed.where(F.col(time).isNotNull() & whole).groupBy("participant", time).agg(F.min(F.struct(*values)).alias("v"), F.count("*").alias("k"))
    counts = typed.groupBy("participant").agg(F.count("*").alias("n"), F.count_if(F.col(time).isNull()).alias("bad_time"), *(F.count_if(F.col(n).isNull()).alias(f"bad_{n}") for n in values))
    again = first.groupBy("participant").agg(F.sum(F.col("k") - 1).alias("duplicates"))
    return first.select("participant", time, "v.*"), counts.join(again, "participant", "left").fillna(0, ["duplicates"])


def read_motion_csv(spark: SparkSession, path: str, axes: list[str], at: str = "datetime", participant: str = r"([^/]+)\.csv$") -> DataFrame:
    """participant, time and axes; rows without one of these go, further columns are not read."""
    raw = spark.read.options(header=True, inferSchema=False, ignoreLeadingWhiteSpace=True).csv(path)
    missing = {at, *axes} - set(raw.columns)
    if missing:
        raise ValueError(f"motion file lacks columns {sorted(missing)}")
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), participant, 1).alias("participant"), F.col(at).try_cast("timestamp_ntz").alias(at), *(F.col(a).try_cast("double").alias(a) for a in axes))
    return rows.dropna()


def with_motion(windows: DataFrame, motion: DataFrame, keys: list[str], value: str) -> DataFrame:
    """windows with the motion of their keys, or 0 where there is none."""
    return windows.join(motion.select(*keys, value), keys, "left").fillna(0.0, [value])


def read_metadata(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table of subjects, exported as CSV: name in the file -> "name type" here. Tokens such as "/" become null; with
    columns height_cm and weight_kg the body mass index is added, with sex its code."""
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    missing = set(columns) - set(raw.columns)
    if missing:
        raise ValueError(f"metadata lacks columns {sorted(missing)}")
    own = [(old, *new.split(" ", 1)) for old, new in columns.items()]
    rows = raw.select(*(F.trim(F.col(f"`{old}`")).try_cast(kind).alias(new) for old, new, kind in own))
    if {"height_cm", "weight_kg"} <= set(rows.columns):
        rows = rows.withColumn("bmi", F.try_divide(F.col("weight_kg"), F.pow(F.col("height_cm") / 100, F.lit(2))))
    if "sex" in rows.columns:
        rows = rows.withColumn("sex_code", F.when(F.lower("sex") == "female", 0).when(F.lower("sex") == "male", 1))
    return rows


def read_config(path: str) -> dict:
    """A YAML or JSON file that holds one mapping. Configs are small and read by the driver."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            found = json.load(f)
        else:
            import yaml

            found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """digest, name, entries and valid of each name in lines of `digest name`; blank lines go.

    Backslashes in names become slashes. valid: the digest is 64 lower-case hex digits and the name is given once.
    """
    parts = F.regexp_extract
    line = spark.read.text(path).where(F.trim("value") != "")
    rows = line.select(parts("value", r"^\s*(\S+)", 1).alias("digest"), F.translate(F.trim(parts("value", r"^\s*\S+\s+(.*)$", 1)), "\\", "/").alias("name"))
    once = rows.groupBy("name").agg(F.min("digest").alias("digest"), F.count("*").alias("entries"))
    return once.withColumn("valid", F.col("digest").rlike("^[0-9a-f]{64}$") & (F.col("entries") == 1) & (F.col("name") != ""))


def opened(path: str):
    """A seekable stream of a file in any of Arrow's file systems."""
    system, inside = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def digest_of(stream) -> str:
    found = hashlib.sha256()
    while part := stream.read(CHUNK):
        found.update(part)
    return found.hexdigest()


def inventory(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    """path, name, bytes of every file; contents are not read. name: the last `depth` parts of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", rf"([^/]+(?:/[^/]+){{{depth - 1}}})$", 1)
    return files.select("path", name.alias("name"), F.col("length").alias("bytes"))


def file_digests(files: DataFrame) -> DataFrame:
    """path, name, found (SHA-256) of an inventory; tasks read files in parts, so their size does not matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                with opened(path) as f:
                    found.append(digest_of(f))
            yield batch.assign(found=found)

    return files.select("path", "name").mapInPandas(run, "path string, name string, found string")


def verify_files(spark: SparkSession, manifest: DataFrame, folder: str, depth: int = 1) -> DataFrame:
    """name, state of every name in the manifest or folder: ok, differs, missing, unlisted or invalid."""
    both = manifest.join(file_digests(inventory(spark, folder, depth)).select("name", "found"), "name", "full")
    state = F.when(F.col("digest").isNull(), "unlisted").when(~F.col("valid"), "invalid").when(F.col("found").isNull(), "missing")
    return both.select("name", state.when(F.col("found") == F.col("digest"), "ok").otherwise("differs").alias("state"))
