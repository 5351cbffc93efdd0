"""ZIP archives as a sink: an archive per task, deflated, members in the order of their names."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_archives(rows: DataFrame, folder: str, member: str, content: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes the text column `content` as members called by the column `member`; returns archive, members.

    Archives hold about archive_bytes of text each, dealt by a hash of name and text. An archive is called by its
    task's number and takes that name once it is whole, so the next attempt of a lost task replaces it. Null contents
    are empty members, rows without a name are left out, repeated names are repeated members; no rows, no archive.
    """
    named = rows.select(F.col(member).cast("string").alias("member"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content")).where("member IS NOT NULL")
    system, top = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(top, recursive=True)
    total = named.agg(F.sum(F.octet_length("content") + 256)).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{top.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.zip"
        partial, n = f"{path}.{uuid.uuid4().hex}.partial", 0
        with system.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for name, text in zip(batch["member"], batch["content"], strict=True):
                    # ZipInfo's own date is fixed, so a task's archive is the same at every attempt.
                    info = zipfile.ZipInfo(name)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    z.writestr(info, text.encode("utf-8", "surrogatepass"))
                    n += 1
        system.move(partial, path)
        yield pd.DataFrame({"archive": [path], "members": [n]})

    spread = named.repartition(int(total // archive_bytes) + 1, F.xxhash64("member", "content")).sortWithinPartitions("member", "content")
    written = spread.mapInPandas(run, "archive string, members long")
    return rows.sparkSession.createDataFrame(written.toPandas(), "archive string, members long")
