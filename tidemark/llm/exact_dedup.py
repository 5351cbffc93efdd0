"""Exact duplicates by a content sort, in DataFrame operations only.

Texts are range-partitioned by sampled splitters and sorted externally, so that equal ones lie beside each other; a
window compares neighbours in full. Splitters are the first bytes of a text and its hash, so that the sample the
driver sees stays small however long the texts are. A group of equal texts may hold a third of all rows, so its rows
carry one of `salts` salts (by doc_id) as a second sort key, more of them the more rows there are: each salted run is
decided by itself, and the runs of one text, at most `salts`, are joined through the text's sha256. Only ids and digests leave the sort, never texts.

Edge cases: a null text counts as empty; equal texts whose largest doc_id repeats keep exactly one of those rows; a
null doc_id is smaller than any other; texts of any length are compared whole; an empty table gives no rows; other
columns, of whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import ids_repeat, one_of_each, only
from .storage import stored

RUN = 5_000_000  # rows of the whole table for each further salt


def exact_duplicates(docs: DataFrame, salts: int | None = None, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    salts = salts or 16 + docs.count() // RUN
    wanted = F.desc_nulls_last("doc_id") if keep == "largest" else F.asc_nulls_last("doc_id")
    best = F.max("run_keep") if keep == "largest" else F.min("run_keep")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("*", F.substring("text", 1, 48).alias("head"), F.xxhash64("text").alias("hash"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    spread = keyed.repartitionByRange("head", "hash", "salt")
    run = Window.partitionBy("head", "hash", "text", "salt")
    runs = spread.select(
        "doc_id",
        "salt",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.row_number().over(run.orderBy(wanted)).alias("place"),
        F.first("doc_id").over(run.orderBy(wanted)).alias("run_keep"),
        F.count(F.lit(1)).over(run).alias("run_size"),
    )
    runs = stored(runs, "runs")
    # One head per run, so at most `salts` rows a text here, however large its group.
    same = Window.partitionBy("text_sha256")
    heads = runs.where("place = 1").select("text_sha256", "salt", best.over(same).alias("keep_id"), F.sum("run_size").over(same).alias("group_size"))
    heads = heads.withColumn("keep_salt", F.pmod(F.xxhash64("keep_id"), F.lit(salts)).cast("int"))
    kept = (F.col("place") == 1) & (F.col("salt") == F.col("keep_salt")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return runs.join(heads, ["text_sha256", "salt"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text, also where a doc_id repeats."""
    if ids_repeat(docs):
        return one_of_each(docs, lambda rows: exact_duplicates(rows, salts).select("doc_id", "keep_id"), largest=True)
    return only(docs, exact_duplicates(docs, salts).where("kept").select("doc_id"))
