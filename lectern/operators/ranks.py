"""Row numbers and group tops that keep a hot group out of a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Bytes that one split of a table is read in by default, and as few as are worth a task of costly work.
SPLIT_BYTES, WORK_BYTES = 128 << 20, 256 << 10
MOST_TASKS_PER_CORE = 8


def deal_out(rows: DataFrame) -> DataFrame:
    """Rows of a small table on all cores, for work that costs far more than moving them.

    Tasks grow in number with the table, up to some for each core; a table of at least one split per core is left
    where it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * SPLIT_BYTES:
        return rows
    return rows.repartition(min(max(cores, size // WORK_BYTES), cores * MOST_TASKS_PER_CORE))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    out: str,
) -> DataFrame:
    """1-based position of each row in its group, a group spread over many tasks.

    ``slice_by`` must never decrease along ``order`` (the day of a time stamp, say). Rows are
    numbered inside each slice and shifted by the size of the slices before it. There can be as many
    slices as rows, so the shifts are not broadcast, however small Spark takes exploded rows for.
    """
    sliced = df.withColumn("slice_key", slice_by)
    sizes = sliced.groupBy(*keys, "slice_key").agg(F.count(F.lit(1)).alias("slice_rows"))
    before = Window.partitionBy(*keys).orderBy("slice_key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = sizes.select(
        *keys,
        "slice_key",
        F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("shift"),
    )
    inside = Window.partitionBy(*keys, "slice_key").orderBy(*order)
    return (
        sliced.withColumn("place", F.row_number().over(inside))
        .join(shifts.hint("merge"), [*keys, "slice_key"])
        .withColumn(out, F.col("place") + F.col("shift"))
        .drop("slice_key", "place", "shift")
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, out: str
) -> DataFrame:
    """The first ``n`` rows of each group (None: all); the limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn(out, F.row_number().over(w))
    return placed if n is None else placed.filter(F.col(out) <= n)
