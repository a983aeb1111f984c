"""Dense row numbers over data of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackwise.sources.workspace import stored

RANGES, SAMPLE_ROWS = 128, 8192


def number_rows(
    df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (), name: str = "row_no", after: DataFrame | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... in ``order_by`` order, starting over in each ``group_by`` group.

    With ``after`` (one row per group: the group columns and ``last``) a group's numbers follow
    its ``last`` instead of starting at 1.

    A plain window would sort each group, or without groups the whole table, in one task. Here group and
    order together are cut into ``ranges`` by fixed bounds, so a group of any size spreads over many
    tasks. A row's place within its range comes from a window over the range; what is added is the
    number of rows of the same group in earlier ranges, a table of one row per group and range.

    The bounds are taken from a sample that depends on the rows alone: those of least hash, merged
    from each task's least. They become constants of the plan, so every evaluation places the rows
    alike, and the rows are written nowhere. ``df`` is read three times, twice only its keys, and must
    give the same rows each time. ``order_by`` must be unique within a group for a repeatable result.
    """
    keys = [*group_by, *order_by]
    ranged = df.withColumn("_range", _range_of(df, keys, _bounds(df, keys, ranges)))
    shifts = ranged.groupBy(*[F.col(c).alias(f"_group_{c}") for c in group_by], "_range").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*[f"_group_{c}" for c in group_by]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = shifts.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if after is not None:
        shifts = shifts.join(after, _same_group(shifts, after, group_by), "left")
        shifts = shifts.withColumn("_shift", F.col("_shift") + F.coalesce("last", F.lit(0)))
    # One row per group and range met. As a table its size is known, and Spark picks the join.
    shifts = stored(shifts.select(*[f"_group_{c}" for c in group_by], F.col("_range").alias("_of_range"), "_shift"), "shifts")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*group_by, "_range").orderBy(*order_by)).cast("bigint"))
    on = (placed["_range"] == shifts["_of_range"]) & _same_group(shifts, placed, group_by)
    return placed.join(shifts, on).select(*[placed[c] for c in df.columns], (F.col("_place") + F.col("_shift")).alias(name))


def _bounds(df: DataFrame, keys: Sequence[str], ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 rows of ``keys``, evenly spaced in a sample of them, in their order; NULL comes first."""
    sample = df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE_ROWS)
    rows = [tuple(row) for row in sample.orderBy(*keys).collect()]
    every = max(1, -(-len(rows) // ranges))
    return list(dict.fromkeys(rows[every::every]))


def _range_of(df: DataFrame, keys: Sequence[str], bounds: list[tuple]) -> Column:
    """The number of bounds that a row's keys reach, by halving: a row meets as many comparisons as the tree is deep."""
    here = F.struct(*keys)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(keys, bounds[middle], strict=True)])
        return F.when(here < bound, search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def _same_group(shifts: DataFrame, other: DataFrame, group_by: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in group_by:
        same &= shifts[f"_group_{c}"].eqNullSafe(other[c])
    return same
