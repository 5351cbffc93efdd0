"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned on doc_id, so each file holds one range of ids in ascending order. ORC's stripe and
row-group statistics then bound doc_id tightly, the Bloom filters answer point lookups, and Spark reads stripes in
parallel.

Edge cases: a null text counts as empty and holds the end id alone; texts of any length are one row; rows that share a
doc_id, equal ones too, stay separate rows beside each other; a null doc_id sorts first; an empty table gives no rows;
other columns, of whatever name, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .storage import stored

FILE_SCHEMA = "row_no long, doc_id long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_mb: int = 16) -> None:
    """Encode doc_id, text and write the ids in ascending doc_id order under path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, row = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [enc.ids(t) + end for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
                flat = np.frombuffer(b"".join(rows), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([pa.array(np.arange(row, row + len(rows))), part.column(0), ids], ["row_no", "doc_id", "ids"])
                row += len(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", "2000")
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids; a filter on doc_id prunes files, stripes and row groups by their statistics."""
    return spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "ids")


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, computed from the files' ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype("i8")), pa.array(crc, pa.int64())], ["file", "row_no", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE_SCHEMA).orc(path).select(F.col("_metadata.file_name").alias("file"), "row_no", "doc_id", "ids")
    rows = stored(files.mapInArrow(digest, "file string, row_no long, doc_id long, n_tokens long, ids_crc32 long"), "digest")
    # One row per file: the offsets are as many as the files, never as the documents.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    before = Window.orderBy(F.asc_nulls_first("first"), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "file")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
