"""Numbers and running sums over ordered rows of a key, whose rows may be too many for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of a row's place within its range.
PLACE_BITS = 33
#: Rows that a task sorts, where the number of rows is known.
ROWS = 500_000


def pieces(rows: int) -> int:
    """Tasks for so many rows; a task's memory doesn't grow with them."""
    return rows // ROWS + 1


def _ranged(df: DataFrame, keys: list[str], order: list[Column], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """df in ranges of (keys, order) with _id, which rises in that order, and _range, written; and its (keys, _range, _first, _n)."""
    key_columns = [F.col(k) for k in keys]
    number = [] if rows is None else [pieces(rows)]
    ordered = df.repartitionByRange(*number, *key_columns, *order).sortWithinPartitions(*key_columns, *order)
    held = written(ordered.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_id", PLACE_BITS))
    return held, held.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on keys (nulls are equal) and the range; ``right`` has one row for each range of a key.

    It is written, so that Spark knows its size before it plans the join: where keys are few, ``left`` isn't shuffled for it.
    """
    named = written(right, "offsets").withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_range"]})
    condition = F.lit(True)
    for k in [*keys, "_range"]:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, condition).drop(*(f"_r_{k}" for k in [*keys, "_range"]))


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str, kind: str = "int", rows: int | None = None) -> DataFrame:
    """df with ``name``: each row's place from 1 among the rows of its key. ``order`` decides between all rows of a key.

    Rows are sorted in ranges; what stands before a range is known from one row for each range of a key, so no
    task holds a whole key. Ranges are drawn from a sample of the rows. ``rows``: how many there are, for as many ranges.
    """
    held, per = _ranged(df, keys, order, rows)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = _same(keys, held, offsets).withColumn(name, (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast(kind))
    return placed.select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows of a key up to each. ``order`` decides between all rows of a key."""
    held, _ = _ranged(df, keys, order)
    per = held.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = held.withColumn("_inside", F.sum(value).over(inside))
    return _same(keys, summed, offsets).withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)
