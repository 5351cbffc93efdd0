"""Sequence windows in one carried pass, so that one long key is many tasks.

A key's rows are cut into slices of time, so narrow that none holds more than some 2^20 rows, which a count over all
rows decides. Rows are shuffled once, by slice; windows run inside a slice, each slice gives a row that says what it
passes on, a scan over a key's slices in order works out what each of them is given, and one join brings that to the
rows. However many windows an operator needs, it reads its input twice at most. Trailing ranges take copies of the rows
that reach into the next slice instead. Rows with a null key form one sequence of their own; rows with a null time come
first in it, in a slice of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .tables import stored

SECOND, DAY = 1_000_000, 86_400_000_000
WIDTH = 30 * DAY
ROWS = 1 << 20
SLICE = "its_slice"
_widths: dict[tuple, int] = {}


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp without zone (the session's zone is UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _fullest(counts: DataFrame, key: str, unit: int, width: int) -> int:
    """Rows of the fullest slice of `width`, from counts by slices of `unit`."""
    return counts.groupBy(key, F.floor(F.col("unit") * unit / width)).agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _by(df: DataFrame, key: str, at: Column, unit: int) -> DataFrame:
    return df.groupBy(key, F.floor(at / unit).alias("unit")).agg(F.count("*").alias("n"))


def counted(df: DataFrame, key: str, at: Column, rows: int = ROWS) -> tuple[int, DataFrame, int]:
    """(width, counts, unit): slices of this width hold `rows` rows at most, unless a second holds more, and the rows of
    each (key, unit of time) that show it. Counts combine map-side and are written, as they are read more than once."""
    unit = DAY
    counts = stored(_by(df, key, at, unit), "counts")
    width = WIDTH
    while width > SECOND and (most := _fullest(counts, key, unit, width)) > rows:
        narrow = -(-most // rows)
        width = max(SECOND, width // narrow)
        width = width // DAY * DAY if width >= DAY else width
        if width < unit:
            unit = width
            counts = stored(_by(df, key, at, unit), "counts")
    return width, counts, unit


def width_of(df: DataFrame, key: str, at: Column, rows: int = ROWS) -> int:
    """The width of slices that counted() finds; remembered for the same input, as it decides speed alone."""
    own = (df.sparkSession.sparkContext.applicationId, df.select(key, at.alias("at")).semanticHash(), rows)
    if own not in _widths:
        _widths[own] = counted(df, key, at, rows)[0]
    return _widths[own]


def sliced(df: DataFrame, key: str, at: Column, width: int | None = None) -> DataFrame:
    """Adds the slice: the key and the slice of time that `at` lies in, as one struct, so that null keys meet in joins."""
    width = width or width_of(df, key, at)
    return df.withColumn(SLICE, F.struct(F.col(key).alias("k"), F.floor(at / width).alias("s")))


def inside(order: list[str]) -> WindowSpec:
    """The rows of a slice in order."""
    return Window.partitionBy(SLICE).orderBy(*order)


def upto(order: list[str], last: int = Window.currentRow) -> WindowSpec:
    return inside(order).rowsBetween(Window.unboundedPreceding, last)


def along() -> WindowSpec:
    """Over a row per slice: a key's slices in order."""
    return Window.partitionBy(f"{SLICE}.k").orderBy(f"{SLICE}.s")


def earlier() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def given(rows: DataFrame, per_slice: DataFrame) -> DataFrame:
    """rows with the columns of the one row of their slice."""
    return rows.join(per_slice.withColumnRenamed(SLICE, "given_slice"), F.col(SLICE) == F.col("given_slice")).drop("given_slice")


def with_carry(local: DataFrame, passed: dict[str, Column], scans: list[dict[str, Column]], keep: list[str]) -> DataFrame:
    """local (rows with windows inside their slice) with what their slice is given.

    passed: aggregates of a slice. scans: columns over a key's slices, one dict after the other. keep: those to join.
    """
    per_slice = local.groupBy(SLICE).agg(*(c.alias(n) for n, c in passed.items()))
    for columns in scans:
        per_slice = per_slice.withColumns(columns)
    return given(local, per_slice.select(SLICE, *keep))


def lagged(rows: DataFrame, key: str, order: list[str], new: dict[str, Column]) -> DataFrame:
    """Adds to sliced rows the values that each Column had in the row before of the same key."""
    own = F.struct(*(c.alias(n) for n, c in new.items()))
    local = rows.withColumn("its_own", own).withColumn("its_lag", F.lag("its_own").over(inside(order))).withColumn("its_number", F.row_number().over(inside(order)))
    found = with_carry(local, {"its_end": F.max_by("its_own", "its_number")}, [{"its_given": F.lag("its_end").over(along())}], ["its_given"])
    before = F.when(F.col("its_number") == 1, F.col("its_given")).otherwise(F.col("its_lag"))
    found = found.withColumn("its_before", before)
    return found.withColumns({n: F.col("its_before")[n] for n in new}).drop("its_own", "its_lag", "its_number", "its_given", "its_before")


def following(rows: DataFrame, key: str, order: list[str], name: str, value: Column) -> DataFrame:
    """Adds to sliced rows the first value that is not null in the row itself or after it."""
    later = inside(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = rows.withColumn("its_next", F.first(value, ignorenulls=True).over(later)).withColumn("its_number", F.row_number().over(inside(order)))
    rest = along().rowsBetween(1, Window.unboundedFollowing)
    found = with_carry(local, {"its_first": F.min_by("its_next", "its_number")}, [{"its_given": F.first("its_first", ignorenulls=True).over(rest)}], ["its_given"])
    return found.withColumn(name, F.coalesce("its_next", "its_given")).drop("its_next", "its_number", "its_given")


def placed(df: DataFrame, key: str, at: Column, order: list[str], width: int | None = None, ranks: dict[str, Column] | None = None) -> DataFrame:
    """Adds i, the place of each row in its key, n, the key's rows, and per name of `ranks` (a place as a Column of n)
    the time `at` of the row in this place. Rows are sliced.

    Rows of a slice are counted before anything is shuffled, so a place needs no second look at the rows; for ranks
    only the slices that hold them are looked at again.
    """
    if width:
        rows = sliced(df, key, at, width)
        counts = stored(rows.groupBy(SLICE).agg(F.count("*").alias("its_rows")), "places")
    else:
        width, units, unit = counted(df, key, at)
        rows = sliced(df, key, at, width)
        slice_of = F.struct(F.col(key).alias("k"), F.floor(F.col("unit") * unit / width).alias("s"))
        counts = units.groupBy(slice_of.alias(SLICE)).agg(F.sum("n").alias("its_rows"))
    whole = Window.partitionBy(f"{SLICE}.k")
    begins = counts.withColumns({"its_begin": F.coalesce(F.sum("its_rows").over(earlier()), F.lit(0)), "n": F.sum("its_rows").over(whole)})
    local = rows.withColumn("its_number", F.row_number().over(inside(order)))
    if ranks:
        begins = stored(begins, "begins")
        here = lambda r: (r >= F.col("its_begin")) & (r < F.col("its_begin") + F.col("its_rows"))
        some = F.lit(False)
        for r in ranks.values():
            some = some | here(r)
        met = given(rows.select(SLICE, key, *order, at.alias("its_at")), begins.where(some)).withColumn("its_place", F.row_number().over(inside(order)) - 1 + F.col("its_begin"))
        found = met.groupBy(F.struct(F.col(key).alias("k")).alias("of_key")).agg(*(F.max(F.when(F.col("its_place") == r, F.col("its_at"))).alias(name) for name, r in ranks.items()))
        begins = begins.join(found, F.struct(F.col(f"{SLICE}.k").alias("k")) == F.col("of_key"), "left").drop("of_key")
    out = given(local, begins.drop("its_rows"))
    return out.withColumn("i", F.col("its_number") - 1 + F.col("its_begin")).drop("its_number", "its_begin")


def with_reach(df: DataFrame, at: Column, reach: int, width: int = WIDTH) -> DataFrame:
    """Rows with a slice of time, each once more (with `copy`) in the next slice if it lies within `reach` of it.

    Windows by (key, slice) over a range of up to `reach` back then see all their rows; drop the copies after them.
    """
    width = max(width, reach)
    own = F.floor(at / width)
    slices = F.when((own + 1) * width - at <= reach, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("its_own", own).withColumn(SLICE, F.explode(slices)).withColumn("copy", ~F.col(SLICE).eqNullSafe(F.col("its_own"))).drop("its_own")
