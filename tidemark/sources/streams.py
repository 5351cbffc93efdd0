"""Streams stored by time, read up to a cut-off of each stream: what lies behind the cut-offs is not read.

Rows lie in folders of (bin of the stream's hash, slice of time), sorted by stream and time within a file. A read with
cut-offs turns them into one bound per bin, which prunes folders when the read is planned, and into the latest cut-off
of all, which the Parquet reader holds against the statistics of row groups; the join with the cut-offs is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..operators.sequences import micros

BIN, SLICE = "its_stream_bin", "its_time_slice"


@dataclass(frozen=True)
class StreamLayout:
    """stream and at: columns of the stream and its time; bins of streams; width of a slice in microseconds.

    A read's predicate has a term for each bin, so `bins` is to stay in the hundreds. Rows and cut-offs have the same
    kind of timestamp.
    """

    stream: str
    at: str
    bins: int = 16
    width: int = 86_400_000_000

    def _bin(self):
        return F.pmod(F.xxhash64(F.col(self.stream)), F.lit(self.bins)).cast("int")

    def write(self, rows: DataFrame, path: str) -> None:
        """Writes rows that have a stream and a time. Tasks hold ranges of (bin, slice, stream, time), so a stream that
        holds most rows of a slice is dealt to many."""
        taken = {BIN, SLICE} & set(rows.columns)
        if taken:
            raise ValueError(f"rows have columns of the layout: {sorted(taken)}")
        order = [BIN, SLICE, self.stream, self.at]
        dealt = rows.dropna(subset=[self.stream, self.at]).withColumns({BIN: self._bin(), SLICE: F.floor(micros(self.at) / self.width)})
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(BIN, SLICE).parquet(path)

    def read_until(self, spark: SparkSession, path: str, stops: DataFrame, stop_at: str = "stop_at") -> DataFrame:
        """Rows of the streams in stops up to their cut-off, itself included; of several cut-offs the latest counts.

        Streams without a cut-off, or with null alone, have no rows. The driver holds one bound per bin.
        """
        own = stops.where(F.col(self.stream).isNotNull()).groupBy(self.stream).agg(F.max(stop_at).alias("its_stop")).where("its_stop IS NOT NULL")
        bounds = own.groupBy(self._bin().alias("b")).agg(F.max("its_stop").cast("string").alias("text"), F.max(F.unix_micros(F.col("its_stop").cast("timestamp"))).alias("stop"), F.max(F.floor(micros("its_stop") / self.width)).alias("slice")).collect()
        rows = spark.read.parquet(path)
        inside = F.lit(False)
        for r in sorted(bounds, key=lambda r: r["b"]):
            inside = inside | ((F.col(BIN) == r["b"]) & (F.col(SLICE) <= r["slice"]))
        rows = rows.where(inside)
        if bounds:
            last = max(bounds, key=lambda r: r["stop"])
            # A literal of the column's own type, so that the comparison reaches the reader.
            zoneless = rows.schema[self.at].dataType == TimestampNTZType()
            rows = rows.where(F.col(self.at) <= (F.lit(last["text"]).cast("timestamp_ntz") if zoneless else F.timestamp_micros(F.lit(last["stop"]))))
        return rows.join(own, self.stream).where(F.col(self.at) <= F.col("its_stop")).drop("its_stop", BIN, SLICE)
