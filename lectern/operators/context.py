"""Parents of a course, favourites, and the test sets grouped under their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranks import first_rows


def course_context(courses: DataFrame, departments: DataFrame, colleges: DataFrame) -> DataFrame:
    """Each course beside its department and college."""
    return courses.join(departments, "department_id").join(colleges, "college_id")


def set_scope(test_sets: DataFrame, sections: DataFrame, courses: DataFrame, departments: DataFrame) -> DataFrame:
    """Course and college of each test set."""
    return (
        test_sets.join(sections.select("section_id", "course_id"), "section_id")
        .join(courses.select("course_id", "department_id"), "course_id")
        .join(departments.select("department_id", "college_id"), "department_id")
        .select("test_set_id", "course_id", "college_id")
    )


def favorites(
    stars: DataFrame,
    colleges: DataFrame,
    courses: DataFrame,
    departments: DataFrame,
    sections: DataFrame,
) -> DataFrame:
    """Starred colleges and courses in one list.

    A star points at a college or a course; course rows carry their parents and section count.
    """
    named = colleges.select("college_id", "college_name")
    as_college = stars.filter("college_id is not null").join(named, "college_id").select(
        "user_id",
        "created_at",
        F.lit("college").alias("kind"),
        F.col("college_id").cast("string").alias("target_id"),
        F.col("college_name").alias("label"),
        "college_name",
        F.lit(None).cast("bigint").alias("section_count"),
    )
    starred = stars.filter("college_id is null and course_id is not null").select(
        "user_id", "created_at", "course_id"
    )
    counts = (
        sections.join(starred.select("course_id").distinct(), "course_id", "left_semi")
        .groupBy("course_id")
        .agg(F.count(F.lit(1)).alias("section_count"))
    )
    as_course = (
        starred.join(courses.select("course_id", "department_id", "title"), "course_id")
        .join(departments.select("department_id", "college_id"), "department_id")
        .join(named, "college_id")
        .join(counts, "course_id", "left")
        .select(
            "user_id",
            "created_at",
            F.lit("course").alias("kind"),
            F.col("course_id").cast("string").alias("target_id"),
            F.col("title").alias("label"),
            "college_name",
            F.coalesce("section_count", F.lit(0).cast("bigint")).alias("section_count"),
        )
    )
    return as_college.unionByName(as_course)


def merge_outline(outline: DataFrame, syllabus: DataFrame, topics: int | None = None) -> DataFrame:
    """Outline sections with the topics of the syllabus unit in the same place (``topics`` at most)."""
    unit = syllabus.select("course_id", "position", F.col("topics").alias("more"))
    empty = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("topics", empty), F.coalesce("more", empty))
    return outline.join(unit, ["course_id", "position"], "left").select(
        *[c for c in outline.columns if c != "topics"],
        (both if topics is None else F.slice(both, 1, topics)).alias("topics"),
    )


def sets_by_section(sections: DataFrame, test_sets: DataFrame) -> DataFrame:
    """Test sets under their sections in outline order, newest set first; empty sections drop out."""
    return sections.join(test_sets, "section_id").select(
        "course_id", "position", "section_id", "test_set_id", "created_at"
    )


def orphan_sets(test_sets: DataFrame, sections: DataFrame) -> DataFrame:
    return test_sets.join(sections.select("section_id"), "section_id", "left_anti")


def sections_ready(sections: DataFrame, test_sets: DataFrame) -> DataFrame:
    """Sections that already have a complete set."""
    return sections.join(
        test_sets.filter("status = 'complete'").select("section_id"), "section_id", "left_semi"
    )


def sets_to_avoid(wanted: DataFrame, test_sets: DataFrame, n: int = 2) -> DataFrame:
    """The newest other sets of the same section that hold questions.

    Only ``n + 1`` newest sets of a section can matter, so the section is cut to those before
    it meets the requests.
    """
    newest = first_rows(
        test_sets.filter("question_count > 0").select("section_id", "test_set_id", "created_at"),
        ["section_id"],
        [F.desc("created_at"), F.desc("test_set_id")],
        n + 1,
        "recency",
    )
    others = wanted.select("section_id", F.col("test_set_id").alias("for_set")).join(
        newest, "section_id"
    )
    return first_rows(
        others.filter("test_set_id <> for_set"),
        ["for_set"],
        [F.asc("recency")],
        n,
        "place",
    ).select("for_set", "section_id", "test_set_id", "place")


def stems_to_avoid(avoid: DataFrame, questions: DataFrame, limit: int | None = None) -> DataFrame:
    """Earlier stems a new set must not repeat; ``limit`` of each set (300 is the site's preset)."""
    held = avoid.select("for_set", "test_set_id").join(
        questions.select("test_set_id", "position", "question"), "test_set_id"
    )
    if limit is not None:
        held = first_rows(held, ["for_set"], [F.asc("test_set_id"), F.asc("position")], limit, "place")
    return held.select("for_set", "test_set_id", "position", "question")


def primary_textbook(textbooks: DataFrame) -> DataFrame:
    """One textbook per course, required ones first."""
    rest = [c for c in textbooks.columns if c != "course_id"]
    best = textbooks.groupBy("course_id").agg(
        F.min_by(F.struct(*rest), F.struct(~F.col("required"), F.col("textbook_id"))).alias("kept")
    )
    return best.select("course_id", *[F.col("kept")[c].alias(c) for c in rest])
