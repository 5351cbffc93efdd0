"""Where intermediate results go: the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode (tests), a new one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", group_bytes: int | None = None) -> DataFrame:
    """df as written to the shared folder: its lineage is cut and a lost executor costs nothing.

    group_bytes bounds Parquet's row groups, for rows that are large. Spark reads up to 4,096 rows of a row group at
    once, so without it a task may hold all that its file has.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write
    if group_bytes:
        for key, value in (("parquet.block.size", group_bytes), ("parquet.block.size.row.check.min", 1), ("parquet.page.size.row.check.min", 1)):
            writer = writer.option(key, value)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that stored() wrote, once all that was made of them has been written itself."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
