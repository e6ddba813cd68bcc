"""Stored tables and the catalog roles they play in the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The point in time the registered queries take as now.
AS_OF = "2002-01-01 00:00:00"


class Tables:
    """Reads the tables of one folder; every role is a projection, so scans stay pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- catalog hierarchy: nation > customer > orders > lineitem -------------------------

    def colleges(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("college_id"),
            F.col("n_nationkey").alias("rank"),
            F.col("n_name").alias("college_name"),
            F.col("r_name").alias("region_name"),
        )

    def departments(self) -> DataFrame:
        """A department counts as checked when its balance is not negative."""
        return self.read("customer").select(
            F.col("c_custkey").alias("department_id"),
            F.col("c_nationkey").alias("college_id"),
            F.col("c_name").alias("code"),
            F.col("c_mktsegment").alias("department_name"),
            F.when(F.col("c_acctbal") >= 0, F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00"))).alias(
                "courses_scraped_at"
            ),
        )

    def courses(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("course_id"),
            F.col("o_custkey").alias("department_id"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderdate").alias("scraped_at"),
        )

    def sections(self) -> DataFrame:
        """Line items: sections of an order, each holding one test set."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("course_id"),
            F.col("l_linenumber").alias("position"),
            F.lit(1).alias("test_sets"),
        )

    def course_attempts(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("course_id"),
            (F.col("l_returnflag") == "R").alias("submitted"),
        )

    # -- searchable courses and their vectors ---------------------------------------------

    def parts(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("course_id"),
            F.col("p_brand").alias("course_number"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("college_id"),
        )

    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("course_id"), F.col("label").alias("college_id"), "embedding"
        )

    # -- logs -------------------------------------------------------------------------------

    def ledger(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("usage_id"),
            F.col("user_id").alias("college_id"),
            F.col("event_type").alias("operation"),
            F.col("ts").alias("created_at"),
            F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"),
            F.col("value").cast("decimal(12,6)").alias("cost"),
        )

    def runs(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("run_id"),
            F.col("user_id").alias("college_id"),
            F.col("event_type").alias("kind"),
            F.col("ts").alias("finished_at"),
            F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
            F.col("value").alias("cost"),
            (F.col("event_type") != "error").alias("ok"),
        )

    def attempts(self) -> DataFrame:
        """Events as attempts: one test per user and type, value out of 500 as the score."""
        return self.read("events").select(
            F.col("event_id").alias("attempt_id"),
            F.col("user_id"),
            F.col("event_type").alias("test_set_id"),
            F.col("ts").alias("submitted_at"),
            F.col("value").alias("score"),
            F.lit(500).alias("total_questions"),
            F.lit(500).alias("question_count"),
        )
