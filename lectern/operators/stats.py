"""Coverage, run and cost statistics of the catalog hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)


def department_stats(departments: DataFrame, courses: DataFrame) -> DataFrame:
    """Courses and last check of every department, empty ones kept.

    ``departments``: department_id, college_id, courses_scraped_at.
    ``courses``: department_id, scraped_at.
    """
    counted = courses.groupBy("department_id").agg(
        F.count(F.lit(1)).alias("course_count"), F.max("scraped_at").alias("last_scraped_at")
    )
    return departments.join(counted, "department_id", "left").select(
        "department_id",
        _zero("course_count"),
        "last_scraped_at",
        "college_id",
        "courses_scraped_at",
    )


def college_stats(
    colleges: DataFrame,
    departments: DataFrame,
    courses: DataFrame,
    sections: DataFrame,
    attempts: DataFrame,
) -> DataFrame:
    """One row per college of counts over its whole subtree, zero where nothing is held.

    Counts climb the hierarchy one level at a time, so each table is shuffled once on its own
    parent key and no join ever multiplies rows. ``sections`` hold test sets one to one
    (course_id, test_sets); ``attempts`` are (course_id, submitted).
    """
    by_course = sections.groupBy("course_id").agg(F.sum("test_sets").alias("test_set_count"))
    taken = (
        attempts.filter("submitted")
        .groupBy("course_id")
        .agg(F.count(F.lit(1)).alias("attempts_taken"))
    )
    by_department = (
        courses.join(by_course, "course_id", "left")
        .join(taken, "course_id", "left")
        .groupBy("department_id")
        .agg(
            F.count(F.lit(1)).alias("course_count"),
            F.max("scraped_at").alias("last_scraped_at"),
            F.sum("test_set_count").alias("test_set_count"),
            F.sum("attempts_taken").alias("attempts_taken"),
        )
    )
    by_college = (
        departments.join(by_department, "department_id", "left")
        .groupBy("college_id")
        .agg(
            F.count(F.lit(1)).alias("department_count"),
            F.sum("course_count").alias("course_count"),
            F.sum("attempts_taken").alias("attempts_taken"),
            F.sum("test_set_count").alias("test_set_count"),
            F.max("last_scraped_at").alias("last_scraped_at"),
            F.count_if(F.col("course_count") > 0).alias("departments_with_courses"),
            F.count("courses_scraped_at").alias("departments_sourced"),
        )
    )
    return colleges.select("college_id").join(by_college, "college_id", "left").select(
        "college_id",
        _zero("department_count"),
        _zero("course_count"),
        _zero("attempts_taken"),
        _zero("test_set_count"),
        "last_scraped_at",
        _zero("departments_with_courses"),
        _zero("departments_sourced"),
    )


def latest_runs(runs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Latest run of each kind per college, one row per college.

    ``kinds`` maps a run kind to the column prefix it gets. One partial aggregate finds the
    newest run of every kind, so a college holding most of the log costs no more than any other.
    """
    fields = {"finished_at": "at", "cost": "cost", "tokens": "tokens", "ok": "ok"}
    run = F.struct("finished_at", "run_id", "cost", "tokens", "ok")
    newest = runs.filter(F.col("college_id").isNotNull()).groupBy("college_id").agg(
        *[F.max(F.when(F.col("kind") == kind, run)).alias(prefix) for kind, prefix in kinds.items()]
    )
    return newest.select(
        "college_id",
        *[
            F.col(prefix)[field].alias(f"{prefix}_{name}")
            for prefix in kinds.values()
            for field, name in fields.items()
        ],
    )


def course_counts(
    sections: DataFrame, test_sets: DataFrame, attempts: DataFrame
) -> DataFrame:
    """Sections, test sets, complete sets and submitted attempts of each course."""
    per_set = (
        attempts.filter("submitted").groupBy("test_set_id").agg(F.count(F.lit(1)).alias("taken"))
    )
    section_counts = sections.groupBy("course_id").agg(F.count(F.lit(1)).alias("section_count"))
    set_counts = (
        test_sets.join(per_set, "test_set_id", "left")
        .groupBy("course_id")
        .agg(
            F.count(F.lit(1)).alias("test_set_count"),
            F.count_if(F.col("status") == "complete").alias("complete_test_sets"),
            F.coalesce(F.sum("taken"), F.lit(0)).alias("attempts_taken"),
        )
    )
    return section_counts.join(set_counts, "course_id", "full_outer")


def totals(parts: list[DataFrame]) -> DataFrame:
    """One-row aggregates side by side: stacked, then folded into one row."""
    names = [c for df in parts for c in df.columns]
    stacked = None
    for df in parts:
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def row_total(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def job_progress(items: DataFrame) -> DataFrame:
    """Processed, succeeded, failed and cost of each bulk job, worked out from its items."""
    done = F.col("status").isin("succeeded", "failed")
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("processed"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("total_cost"),
    )


def retrieval_outcome(steps: DataFrame) -> DataFrame:
    """Department outcomes of one retrieval per college; ok unless every attempt failed."""

    def of(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    tried = F.col("fetched") + F.col("failed")
    return (
        steps.groupBy("college_id")
        .agg(
            F.count(F.lit(1)).alias("department_count"),
            F.count_if(F.col("outcome").isin("fetched", "empty")).alias("fetched"),
            of("empty").alias("empty"),
            of("in_store").alias("in_store"),
            of("deferred").alias("deferred"),
            of("failed").alias("failed"),
            F.coalesce(F.sum("courses"), F.lit(0)).cast("bigint").alias("courses"),
        )
        .withColumn("ok", ~((F.col("failed") > 0) & (F.col("fetched") == 0) & (tried > 0)))
    )


def region_groups(colleges: DataFrame) -> DataFrame:
    """Colleges and indexed colleges of each region, headed by the best-ranked one's list."""
    return colleges.groupBy("region").agg(
        F.min_by("rank_source", F.coalesce("rank", F.lit(2**31 - 1))).alias("heading"),
        F.count(F.lit(1)).alias("colleges"),
        F.count_if(F.col("course_count") > 0).alias("indexed"),
    )


def overview(
    colleges: DataFrame, stats: DataFrame, costs: DataFrame, runs: DataFrame, prefixes: list[str]
) -> DataFrame:
    """Admin table row per college: stats, cost and a snapshot of the latest run of each kind."""
    joined = (
        colleges.join(stats, "college_id", "left")
        .join(costs, "college_id", "left")
        .join(runs, "college_id", "left")
    )
    counts = [c for c in stats.columns if c.endswith("_count") or c.startswith("departments_")]
    snapshots = []
    for p in prefixes:
        at = F.col(f"{p}_at")
        snapshots += [
            at,
            F.when(at.isNotNull(), F.coalesce(f"{p}_cost", F.lit(0))).alias(f"{p}_cost"),
            F.when(at.isNotNull(), F.coalesce(f"{p}_tokens", F.lit(0))).alias(f"{p}_tokens"),
            F.when(at.isNotNull(), F.col(f"{p}_ok")).alias(f"{p}_ok"),
        ]
    return joined.select(
        *colleges.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("call_count", F.lit(0)).alias("call_count"),
        F.coalesce("cost", F.lit(0)).alias("cost"),
        "last_scraped_at",
        *snapshots,
    )


def tally(df: DataFrame, by: str) -> DataFrame:
    """Rows per value, the most frequent first."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), by)


def question_mix(questions: DataFrame, key: str) -> DataFrame:
    """Mix and defects of each set: types, levels, topics, bad choices and repeated stems.

    Stems are counted per (set, stem) first, so a set with most of the rows is spread by stem.
    """
    choice = F.col("type") == "mcq"
    bad_choice = choice & ~F.coalesce(
        (F.size("options") == 4) & F.array_contains("options", F.col("correct_answer")), F.lit(False)
    )
    stem = F.lower(F.trim("question")).alias("stem")
    counted = questions.groupBy(key, stem, "topic").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("type") == t).alias(t) for t in ("mcq", "true_false", "short_answer")],
        *[F.count_if(F.col("difficulty") == d).alias(d) for d in ("easy", "medium", "hard")],
        F.count_if(bad_choice).alias("bad_choices"),
    )
    sums = ("mcq", "true_false", "short_answer", "easy", "medium", "hard", "bad_choices")
    return counted.groupBy(key).agg(
        F.sum("n").alias("questions"),
        *[F.sum(c).alias(c) for c in sums],
        F.countDistinct("topic").alias("topics"),
        (F.sum("n") - F.countDistinct("stem")).alias("repeated_stems"),
    )
