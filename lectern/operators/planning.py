"""What to fetch next: freshness, department plans, bulk candidates and daily caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranks import first_rows, number_rows

DATA_DAYS = 30
CATALOG_DAYS = 90
DAILY_CAP = 10


def stale(ts: Column, as_of: Column, days: int = DATA_DAYS) -> Column:
    """Never seen, or seen more than ``days`` ago."""
    return ts.isNull() | (ts < as_of - F.make_dt_interval(F.lit(days)))


def cache_state(checked_at: Column, course_count: Column) -> Column:
    """Stored rows are served at any age; a checked, empty list counts as stored."""
    return (
        F.when(F.coalesce(course_count, F.lit(0)) > 0, "cached")
        .when(checked_at.isNotNull(), "checked_empty")
        .otherwise("needs_fetch")
    )


def fetch_plan(
    departments: DataFrame, stats: DataFrame, as_of: Column, days: int | None, limit: int | None
) -> DataFrame:
    """Departments with the action a retrieval takes: fetch, defer or keep.

    ``departments``: department_id, college_id, code, scraped_at. The whole list is re-read
    (``list_stale``) only when every department of the college is stale.
    """

    def old(c: Column) -> Column:
        return F.lit(False) if days is None else stale(c, as_of, days)

    lists = departments.groupBy("college_id").agg(F.bool_and(old(F.col("scraped_at"))).alias("list_stale"))
    checked = F.coalesce(
        F.col("courses_scraped_at"), F.when(F.col("course_count") > 0, F.col("last_scraped_at"))
    )
    plan = departments.join(
        stats.select("department_id", "course_count", "last_scraped_at", "courses_scraped_at"),
        "department_id",
        "left",
    ).withColumn("checked_at", checked)
    plan = plan.withColumn("needed", F.col("checked_at").isNull() | old(F.col("checked_at")))
    if limit is None:
        action = F.when(F.col("needed"), "fetch").otherwise("keep")
    else:
        first = first_rows(
            plan.filter("needed").select("college_id", "department_id", "code"),
            ["college_id"],
            [F.col("code"), F.col("department_id")],
            limit,
            "fetch_place",
        ).select("department_id", F.lit(True).alias("chosen"))
        plan = plan.join(first, "department_id", "left")
        action = (
            F.when(~F.col("needed"), "keep").when(F.col("chosen"), "fetch").otherwise("defer")
        )
    return plan.join(lists, "college_id").select(
        "college_id", "department_id", "code", "checked_at", action.alias("action"), "list_stale"
    )


def bulk_candidates(
    colleges: DataFrame,
    stats: DataFrame,
    as_of: Column,
    stale_days: int,
    rank_from: int,
    rank_to: int,
    in_region: Column,
    limit: int,
    include_partial: bool = False,
) -> DataFrame:
    """Ranked colleges lacking data, holding old data, or (when asked) partly filled."""
    partial = F.coalesce("departments_sourced", F.lit(0)) < F.coalesce("department_count", F.lit(0))
    wanted = (
        (F.coalesce("course_count", F.lit(0)) == 0)
        | F.col("last_scraped_at").isNull()
        | (F.col("last_scraped_at") < as_of - F.make_dt_interval(F.lit(stale_days)))
        | (partial if include_partial else F.lit(False))
    )
    return (
        colleges.filter(F.col("rank").between(rank_from, rank_to) & in_region)
        .join(stats, "college_id", "left")
        .filter(wanted)
        .select("college_id", "rank", "course_count", "last_scraped_at")
        .orderBy("rank", "college_id")
        .limit(limit)
    )


def freeze_items(candidates: DataFrame, job_id: str) -> DataFrame:
    """Job items with a 0-based position in rank order."""
    numbered = number_rows(
        candidates.withColumn("job_id", F.lit(job_id)),
        ["job_id"],
        [F.col("rank"), F.col("college_id")],
        F.floor(F.col("rank") / 100),
        "position",
    )
    return numbered.select(
        "job_id", "college_id", (F.col("position") - 1).alias("position"), F.lit("pending").alias("status")
    )


def resume_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status").isin("pending", "running"))


def rolling_day_counts(events: DataFrame, user: str, ts: str, key: str, cap: int = DAILY_CAP) -> DataFrame:
    """Creations by the same user in the 24 hours up to each one, and whether the cap was met before it.

    Every row is also sent to the following day, where it only counts; a busy user is thereby
    cut into days and no task sees more than two of them.
    """
    day = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 86400)
    spread = events.select(
        user, ts, key, F.explode(F.array(day, day + 1)).alias("window_day"), day.alias("own_day")
    )
    counted = spread.withColumn(
        "in_day",
        F.expr(
            f"count(*) over (partition by {user}, window_day order by {ts} "
            "range between interval 24 hours preceding and current row)"
        ),
    )
    return counted.filter("window_day = own_day").select(
        user, ts, key, "in_day", (F.col("in_day") - 1 >= cap).alias("over_cap")
    )


def trailing_count(events: DataFrame, user: str, ts: str, as_of: Column) -> DataFrame:
    """Creations of each user in the 24 hours before ``as_of``."""
    recent = (F.col(ts) >= as_of - F.expr("interval 24 hours")) & (F.col(ts) <= as_of)
    return events.filter(recent).groupBy(user).agg(F.count(F.lit(1)).alias("created"))
