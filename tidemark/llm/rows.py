"""Which row of each group stays where doc_id does not tell the rows apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in the one column of kept, null counting as a value."""
    name = fresh(docs, "its_kept_id")
    return docs.join(kept.toDF(name), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def ids_repeat(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], largest: bool) -> DataFrame:
    """One row of each group with all its columns: that of the largest or smallest doc_id, and one of those with it.

    `groups` takes doc_id, text, where doc_id is a number of the row, and gives this number and the group of every row.
    A null doc_id is taken last.
    """
    name, stays_as = fresh(docs, "its_row"), fresh(docs, "its_stays")
    rows = stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    found = groups(rows.select(F.col(name).alias("doc_id"), "text")).toDF("row", "group")
    ids = rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("id"))
    null = F.col("id").isNull()
    best = F.max_by("row", F.struct(~null, "id", "row")) if largest else F.min_by("row", F.struct(null, "id", "row"))
    stays = found.join(ids, "row").groupBy("group").agg(best.alias(stays_as)).select(stays_as)
    return rows.join(stays, F.col(name) == F.col(stays_as), "left_semi").drop(name)
