"""Pages of a long sorted listing that cost the same wherever they lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.listing import page_count

PART = "listing_part"


class Pages:
    """Rows stored in ranges of a sort order, and how many rows lie before each range.

    Building deals the rows once into ranges, unsorted, and counts them. A page then reads and sorts only the
    ranges that it touches, so page 10,000 costs what page 1 does. The order must end in a unique
    key, or rows of equal keys cannot be parted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, order: Sequence[Column], counts: dict[int, int]):
        self.spark, self.folder, self.schema, self.order = spark, folder, schema, list(order)
        self.before: dict[int, int] = {}
        self.total = 0
        for part in sorted(counts):
            self.before[part] = self.total
            self.total += counts[part]
        self.counts = counts

    @classmethod
    def build(cls, rows: DataFrame, order: Sequence[Column], folder: str, rows_per_part: int = 200_000) -> Pages:
        """Store ``rows`` under a folder of the shared store, about ``rows_per_part`` to a range."""
        spark = rows.sparkSession
        # Stored first: counting, finding the ranges and dealing would each work the rows out again.
        rows.write.parquet(f"{folder}-rows")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}-rows")
        parts = page_count(rows.count(), rows_per_part)
        ranged = rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
        ranged.write.partitionBy(PART).parquet(folder)
        # A number per range.
        found = spark.read.schema(ranged.schema).parquet(folder).groupBy(PART).count().collect()
        return cls(spark, folder, ranged.schema, order, {r[0]: r[1] for r in found})

    def _rows(self, parts: Sequence[int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", self.folder)
        return reader.parquet(*[f"{self.folder}/{PART}={p}" for p in parts])

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """The rows from ``offset`` on, in order, with the number of all rows and each row's place."""
        first, last = max(offset, 0), max(offset, 0) + max(limit, 0)
        touched = [p for p, n in self.before.items() if n < last and n + self.counts[p] > first]
        return self._placed(self._rows(touched)).filter(
            (F.col("place") > first) & (F.col("place") <= last)
        ).withColumn("total_count", F.lit(self.total).cast("bigint")).orderBy("place")

    def page_count(self, size: int = 500) -> int:
        return page_count(self.total, size)

    def numbered(self) -> DataFrame:
        """All rows with their place in the order, each range numbered by itself."""
        return self._placed(self._rows(list(self.counts)))

    def _placed(self, rows: DataFrame) -> DataFrame:
        shift = F.create_map(*[F.lit(x).cast("bigint") for pair in self.before.items() for x in pair]) if self.before else None
        inside = Window.partitionBy(PART).orderBy(*self.order)
        place = F.row_number().over(inside).cast("bigint")
        if shift is not None:
            place = place + F.element_at(shift, F.col(PART).cast("bigint"))
        return rows.withColumn("place", place).drop(PART)
