"""Course and department lists: duplicates, unique codes, department filters, title repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.courses import broken_title, leading_token
from lectern.functions.text import squash
from lectern.operators.lineage import cut
from lectern.operators.ranks import number_rows


def dedupe_by_number(courses: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per squashed course number: the longest description, the first seen on ties."""
    rest = [c for c in courses.columns if c not in keys]
    kept = (
        courses.withColumn("number_key", F.upper(squash(F.col("course_number"))))
        .groupBy(*keys, "number_key")
        .agg(
            F.max_by(
                F.struct(*rest),
                F.struct(F.coalesce(F.length("description"), F.lit(0)), -F.col(order)),
            ).alias("kept")
        )
    )
    return kept.select(*keys, *[F.col("kept")[c].alias(c) for c in rest])


def combine(lists: Sequence[DataFrame]) -> DataFrame:
    """Lists one after another with the place of each list as ``list``."""
    out = None
    for place, df in enumerate(lists):
        part = df.withColumn("list", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out


def combine_departments(primary: DataFrame, secondary: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Both lists, the first of each code kept, primary rows before secondary ones."""
    return combine([primary, secondary]).groupBy(*scope, "code").agg(
        F.min_by("name", F.struct("list", "n")).alias("name"), F.min("list").alias("list")
    )


def combine_courses(primary: DataFrame, secondary: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Both lists joined end to end, then one row per course number."""
    both = combine([primary, secondary])
    placed = both.withColumn("order", F.col("list").cast("bigint") * (1 << 40) + F.col("n"))
    return dedupe_by_number(placed, scope, "order").drop("order")


def unique_codes(departments: DataFrame, scope: Sequence[str], order: str) -> DataFrame:
    """Codes made unique within their scope, first come first served, 24 characters at most.

    A row whose code is taken by an earlier one tries code2, code3 and so on. Rows settle in rounds:
    every row names its candidate, the earliest holds it, the others move on. A row starts at its
    place among the copies of its code, which no earlier candidate can undercut, so rounds are
    as few as the collisions between different codes.
    """
    numbered = number_rows(
        cut(departments), [*scope, "code"], [F.asc(order)], F.floor(F.col(order) / 10_000), "copy"
    )
    suffix = F.when(F.col("copy") > 1, F.col("copy").cast("string")).otherwise("")
    candidate = F.concat(F.substring("code", F.lit(1), F.lit(24) - F.length(suffix)), suffix)
    turn = F.struct(order, "code", "copy")
    rows = numbered
    while True:
        named = cut(rows.withColumn("candidate", candidate))
        holders = named.groupBy(*scope, "candidate").agg(F.min(turn).alias("holder"), F.count(F.lit(1)).alias("n_rows"))
        contested = holders.filter("n_rows > 1").drop("n_rows")
        if contested.isEmpty():
            return named.withColumn("code", F.col("candidate")).drop("candidate", "copy")
        lost = F.col("holder").isNotNull() & (turn > F.col("holder"))
        rows = (
            named.join(contested, [*scope, "candidate"], "left")
            .withColumn("copy", F.col("copy") + F.when(lost, 1).otherwise(0))
            .select(*numbered.columns)
        )


def departments_from_numbers(courses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distinct leading tokens of course numbers as departments."""
    return (
        courses.select(*scope, leading_token(F.col("course_number")).alias("code"))
        .filter(F.col("code").isNotNull())
        .distinct()
        .withColumn("name", F.col("code"))
    )


# Parts that a scope's courses are dealt into where all of them go to one department.
DEALS = 16


def of_department(courses: DataFrame, departments: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Courses of each department by code prefix; a department without any gets the whole list.

    Codes are at most 24 long, so a course meets departments on its own few prefixes, cut only at the lengths
    that codes have. Courses are never the broadcast side: Spark takes exploded rows for as small as their source.
    """
    number = F.upper("course_number")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(number), F.lit(24)), F.lit(1))),
        lambda i: F.substring(number, F.lit(1), i),
    )
    codes = departments.select(*scope, F.upper("code").alias("code")).distinct()
    # One row, of 24 numbers at most.
    lengths = codes.agg(F.collect_set(F.length("code")).alias("code_lengths"))
    usable = F.filter(prefixes, lambda p: F.array_contains("code_lengths", F.length(p)))
    begun = courses.crossJoin(F.broadcast(lengths)).withColumn("code", F.explode(F.array_distinct(usable)))
    own = begun.drop("code_lengths").hint("merge").join(codes, [*scope, "code"])
    bare = codes.join(own.select(*scope, "code").distinct(), [*scope, "code"], "left_anti")
    # The whole list is the answer for a bare department; it is dealt so that no task copies a large scope alone.
    dealt = bare.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    deal = F.pmod(F.xxhash64("course_number"), F.lit(DEALS)).cast("int")
    return own.unionByName(courses.withColumn("deal", deal).hint("merge").join(dealt, [*scope, "deal"]).drop("deal"))


def broken_rows(courses: DataFrame) -> DataFrame:
    return courses.filter(broken_title(F.col("course_number"), F.col("title")))


def repair_report(courses: DataFrame, sections: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Broken titles per college and department with how many may be removed.

    A row may go when it has no sections and its department's refresh produced rows.
    """
    broken = broken_rows(courses).select("course_id", "department_id", "college_id")
    used = sections.join(broken.select("course_id"), "course_id", "left_semi")
    held = used.select("course_id", F.lit(True).alias("held")).distinct()
    fresh = refreshed.select("department_id", F.lit(True).alias("fresh")).distinct()
    return (
        broken.join(held, "course_id", "left")
        .join(fresh, "department_id", "left")
        .groupBy("college_id", "department_id")
        .agg(
            F.count(F.lit(1)).alias("broken"),
            F.count_if(F.col("held").isNull() & F.col("fresh").isNotNull()).alias("removable"),
        )
    )
