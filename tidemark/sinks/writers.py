"""Sinks: Parquet and CSV that never overwrite, small reports as JSON and Markdown, and restored tables held to a digest."""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Fails if there is something at path."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None, partition_by: list[str] | None = None) -> None:
    """With a header, in as many files as the rows have partitions, or in `files`; fails if there is something at path.

    One file means one task: ask for it where the rows are a report's. Columns of partition_by name folders and are not
    in the files.
    """
    writer = (df.coalesce(files) if files else df).write.mode("errorifexists").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def plain(value: Any) -> Any:
    """value as JSON can hold it: numbers that are not finite become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def few(df: DataFrame, most: int) -> list[dict]:
    """The rows of a report, which may not be more than `most`."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    return rows


def write_text(text: str, path: str) -> None:
    """A small file in any of Arrow's file systems, or at a local path; fails if it exists."""
    if ":" not in path.split("/")[0]:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
        return
    system, place = pyarrow.fs.FileSystem.from_uri(path)
    if system.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(f"would overwrite {path}")
    system.create_dir(place.rpartition("/")[0], recursive=True)
    partial = f"{place}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial) as out:
        out.write(text.encode("utf-8"))
    system.move(partial, place)


def write_json(report: dict, path: str) -> None:
    """A report as indented JSON; fails if the file exists."""
    write_text(json.dumps(plain(report), indent=2) + "\n", path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    rows = few(df, most)
    cell = lambda v: "-" if v is None or isinstance(v, float) and not math.isfinite(v) else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *([cell(r[c]) for c in df.columns] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def write_markdown(title: str, sections: dict[str, str | DataFrame], path: str) -> None:
    """A report of sections, each a text or a small table; fails if the file exists."""
    parts = [f"# {title}"]
    for name, content in sections.items():
        parts += [f"## {name}", markdown_table(content) if isinstance(content, DataFrame) else content]
    write_text("\n\n".join(parts) + "\n", path)


def fingerprint(df: DataFrame) -> str:
    """Row count and summed hashes of the rows, whatever their order and files: equal for equal contents."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2))).first()
    return "-".join([str(row["n"]), *(f"{int(row[h] or 0) % (1 << 64):016x}" for h in ("h1", "h2"))])


def restore_if_missing(spark: SparkSession, path: str, expected: str, build: Callable[[], DataFrame]) -> bool:
    """Build the table at path unless one with the expected fingerprint is there; returns whether it was built.

    It is written beside its place, checked, and moved there in one step; a wrong one is removed and fails. A table at
    path with another fingerprint fails too and is left alone.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    if system.exists(place):
        if fingerprint(spark.read.parquet(path)) != expected:
            raise ValueError(f"{path} is there with another fingerprint")
        return False
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}")
    try:
        build().write.parquet(beside.toString())
        if fingerprint(spark.read.parquet(beside.toString())) != expected:
            raise ValueError(f"what was built for {path} has another fingerprint")
        if not system.rename(beside, place):
            raise OSError(f"could not move the table to {path}")
    finally:
        system.delete(beside, True)
    return True


def must_be_new(*paths: str) -> None:
    """Fails if one of these local files or folders exists."""
    there = [p for p in paths if os.path.exists(p)]
    if there:
        raise FileExistsError(f"would overwrite {there}")
