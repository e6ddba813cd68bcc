"""The sortable, searchable, paged course listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.courses import course_level, level_rank, natural_key
from lectern.functions.text import any_contains

# Fixed value: the longest page the site's own listing asks for.
SITE_PAGE = 1000


def at_most(value: int | None, most: int) -> int:
    """A caller's preset for a bounded read: ``value`` within 1 and ``most``; none given: ``most``."""
    return min(max(most if value is None else value, 1), most)


def page_count(rows: int, size: int = 500) -> int:
    return max(1, -(-rows // size))


def optional(column: Column, value: object | None, exclude: bool = False) -> Column:
    """A test that holds for every row when the parameter is not given."""
    if value is None:
        return F.lit(True)
    return column != F.lit(value) if exclude else column == F.lit(value)


def sort_columns(sort: str) -> list[Column]:
    """Sort keys a caller may name; anything else sorts by course number."""
    known = {
        "title": [F.lower("title")],
        "university": [F.lower("college_name")],
        "department": [F.lower("department_code")],
        "level": [level_rank(F.col("level"))],
        "sections": [F.col("section_count")],
        "tests": [F.col("complete_test_sets"), F.col("test_set_count")],
        "taken": [F.col("attempts_taken")],
        "cost": [F.col("cost")],
    }
    return known.get(sort, [F.lower("course_number")])


def course_rows(
    courses: DataFrame,
    counts: DataFrame,
    costs: DataFrame,
    query: str | None = None,
    tested: str = "all",
) -> DataFrame:
    """Listing rows of every course that matches.

    ``courses`` carry course_id, course_number, title, department_code, department_name,
    college_id, college_name, college_short_name, credits and summary.
    """
    needle = (query or "").strip()
    rows = courses
    if needle:
        searched = ["course_number", "title", "department_code", "department_name"]
        searched += ["college_name", "college_short_name"]
        rows = rows.filter(any_contains([F.col(c) for c in searched], needle))
    rows = rows.join(counts, "course_id", "left").join(
        costs.select("course_id", "cost"), "course_id", "left"
    )
    zero = F.lit(0).cast("bigint")
    out = rows.select(
        "course_id",
        "course_number",
        "title",
        "credits",
        course_level(F.col("course_number")).alias("level"),
        "department_code",
        "department_name",
        "college_id",
        F.coalesce("college_short_name", "college_name").alias("college_name"),
        F.coalesce("section_count", zero).alias("section_count"),
        F.coalesce("test_set_count", zero).alias("test_set_count"),
        F.coalesce("complete_test_sets", zero).alias("complete_test_sets"),
        F.coalesce("attempts_taken", zero).alias("attempts_taken"),
        F.coalesce("cost", F.lit(0)).alias("cost"),
        F.col("summary").isNotNull().alias("has_summary"),
    )
    if tested == "tested":
        out = out.filter("test_set_count > 0")
    elif tested == "untested":
        out = out.filter("test_set_count = 0")
    return out


def page(
    rows: DataFrame,
    sort: str = "course",
    descending: bool = False,
    limit: int | None = 500,
    offset: int | None = 0,
) -> DataFrame:
    """One page with the number of matching rows beside it.

    The count is a subquery of its own, so no window pulls every row into one task, and the
    page is a bounded top-k. ``limit=None`` gives all rows from ``offset`` on.
    """
    keys = [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in sort_columns(sort)]
    total = rows.agg(F.count(F.lit(1)).alias("total_count")).scalar()
    skip = max(offset or 0, 0)
    top = rows.orderBy(*keys, F.lower("course_number"), F.col("course_id"))
    if limit is not None:
        top = top.limit(skip + max(limit, 0))
    if skip:
        top = top.orderBy(*keys, F.lower("course_number"), F.col("course_id")).offset(skip)
    return top.withColumn("total_count", total)


def containing(rows: DataFrame, columns: list[str], needle: str | None) -> DataFrame:
    """Rows of which any of the columns holds the typed text, whatever its case; nothing typed: all."""
    wanted = (needle or "").strip()
    return rows.filter(any_contains([F.col(c) for c in columns], wanted)) if wanted else rows


# Compares letters without case and accents, as the site's tables do.
TABLE_COLLATION = "UNICODE_CI_AI"


def empties_last(column: str, descending: bool, text: bool = True) -> Column:
    """Sort key with blanks at the end whichever way the rest runs; texts compare naturally, digits by value."""
    value = F.col(column)
    if text:
        value = F.collate(natural_key(F.nullif(value, F.lit(""))), TABLE_COLLATION)
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def sort_empties_last(df: DataFrame, column: str, descending: bool, unique: str, text: bool = True) -> DataFrame:
    """A table sorted by one column, blanks at the end."""
    return df.orderBy(empties_last(column, descending, text), F.asc(unique))


def table_sort_keys(prefixes: list[str]) -> dict[str, Column]:
    """Composite sort keys of the overview table: list-aware rank, coverage, newest activity."""
    count = F.col("department_count")
    return {
        "rank": F.col("rank") + F.when(F.col("region") == "intl", 1000).otherwise(0),
        "coverage": F.when(count > 0, F.col("departments_sourced") / count + count / 1_000_000),
        "activity": F.greatest(*[F.col(f"{p}_at") for p in prefixes]),
    }
