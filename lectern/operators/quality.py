"""Row validation, owner scoping and constraint audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import not_blank, squash, trim_space

# Topics of a contact message.
CONTACT_TOPICS = (
    "General question",
    "Technical support",
    "Missing or wrong course",
    "Privacy request",
    "Partnerships",
    "Other",
)

Rule = tuple[str, Column]


def first_failure(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that does not hold, null when all do."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return reason


def validate(df: DataFrame, normalise: dict[str, Column], rules: Sequence[Rule]) -> DataFrame:
    """Normalised columns and the first failed rule of each row as ``reject_reason``.

    Rules are read against the normalised columns.
    """
    return df.withColumns(normalise).withColumn("reject_reason", first_failure(rules))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def _size(column: str, low: int, high: int) -> Rule:
    return f"{column} must be {low} to {high} long", F.length(column).between(low, high)


def _at_most(column: str, high: int) -> Rule:
    return f"{column} longer than {high}", F.coalesce(F.length(column) <= high, F.lit(True))


def validate_departments(df: DataFrame) -> DataFrame:
    return validate(
        df,
        {"code": F.upper(trim_space(F.col("code"))), "name": trim_space(F.col("name"))},
        [_size("code", 1, 24), _size("name", 1, 200)],
    )


# Longest text of each optional course column.
COURSE_LIMITS = {
    "description": 8000,
    "credits": 80,
    "prerequisites": 2000,
    "terms_offered": 200,
    "syllabus_url": 1000,
    "source_url": 1000,
}
RAW_CONTENT_LIMIT = 200_000


def validate_courses(df: DataFrame) -> DataFrame:
    optional = [c for c in COURSE_LIMITS if c in df.columns]
    normalise = {c: trim_space(F.col(c)) for c in ["course_number", "title", *optional]}
    rules = [_size("course_number", 1, 40), _size("title", 1, 400)]
    rules += [_at_most(c, COURSE_LIMITS[c]) for c in optional]
    if "instructors" in df.columns:
        normalise["instructors"] = F.transform("instructors", trim_space)
        named = F.forall("instructors", lambda n: F.length(n).between(1, 160))
        rules.append(("instructor must be 1 to 160 long", F.coalesce(named, F.lit(True))))
    if "raw_scraped_content" in df.columns:
        rules.append(_at_most("raw_scraped_content", RAW_CONTENT_LIMIT))
    return validate(df, normalise, rules)


def validate_textbooks(df: DataFrame) -> DataFrame:
    isbn = trim_space(F.col("isbn"))
    return validate(
        df,
        {
            "title": trim_space(F.col("title")),
            "authors": trim_space(F.col("authors")),
            "edition": trim_space(F.col("edition")),
            "required": F.coalesce("required", F.lit(True)),
            "isbn_length": F.length(isbn),
            "isbn": F.nullif(F.regexp_replace(isbn, "[^0-9Xx]", ""), F.lit("")),
        },
        [
            _size("title", 2, 400),
            _at_most("authors", 400),
            _at_most("edition", 80),
            ("isbn longer than 32", F.coalesce(F.col("isbn_length") <= 32, F.lit(True))),
        ],
    ).drop("isbn_length")


def validate_sections(df: DataFrame) -> DataFrame:
    return validate(
        df,
        {"title": trim_space(F.col("title")), "topics": F.transform("topics", trim_space)},
        [
            _size("title", 2, 300),
            ("1 to 20 topics needed", F.size("topics").between(1, 20)),
            ("topic must be 1 to 200 long", F.forall("topics", lambda t: F.length(t).between(1, 200))),
        ],
    )


def validate_questions(df: DataFrame) -> DataFrame:
    """Question rows with normalised text; options are kept for multiple choice only."""
    mcq, boolean = F.col("type") == "mcq", F.col("type") == "true_false"
    low = F.transform("options", lambda o: F.lower(o))
    answer = F.lower("correct_answer")

    def unless(test: Column, holds: Column) -> Column:
        return ~test | F.coalesce(holds, F.lit(False))

    return validate(
        df,
        {
            "question": trim_space(F.col("question")),
            "correct_answer": trim_space(F.col("correct_answer")),
            "explanation": trim_space(F.col("explanation")),
            "topic": trim_space(F.col("topic")),
            "options": F.when(mcq, F.transform("options", trim_space)),
        },
        [
            ("unknown type", F.col("type").isin("mcq", "true_false", "short_answer")),
            ("unknown difficulty", F.col("difficulty").isin("easy", "medium", "hard")),
            _size("question", 10, 1200),
            (
                "option must be 1 to 500 long",
                F.coalesce(F.forall("options", lambda o: F.length(o).between(1, 500)), F.lit(True)),
            ),
            _size("correct_answer", 1, 1200),
            _size("explanation", 5, 1200),
            _size("topic", 1, 200),
            ("exactly 4 options needed", unless(mcq, F.size("options") == 4)),
            ("answer not among options", unless(mcq, F.array_contains(low, answer))),
            ("options not distinct", unless(mcq, F.size(F.array_distinct(low)) == 4)),
            ("answer must be true or false", unless(boolean, answer.isin("true", "false"))),
        ],
    )


def validate_messages(df: DataFrame) -> DataFrame:
    """Contact messages without those that filled the hidden field."""
    people = df.filter(F.coalesce("company", F.lit("")) == "")
    return validate(
        people,
        {c: trim_space(F.col(c)) for c in ("name", "email", "message")},
        [
            _size("name", 1, 120),
            (
                "email not valid",
                F.col("email").rlike(r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$") & (F.length("email") <= 254),
            ),
            ("topic not offered", F.col("topic").isin(*CONTACT_TOPICS)),
            _size("message", 10, 5000),
        ],
    )


def embeddable(number: Column, title: Column, description: Column) -> Column:
    """A course says enough to compare: a description, or a title beyond its number."""
    bare = squash(title)
    return not_blank(description) | ((bare != "") & (bare != squash(number)))


def owned_by(df: DataFrame, owner: str, user: object) -> DataFrame:
    return df.filter(F.col(owner) == F.lit(user))


def owned_through(df: DataFrame, parents: DataFrame, key: str, owner: str, user: object) -> DataFrame:
    """Rows whose parent belongs to the user."""
    return df.join(owned_by(parents, owner, user).select(key), key, "left_semi")


def audit(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row (rule, violations) per check."""
    out = None
    for name, df in checks:
        row = df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("rule"), "violations"
        )
        out = row if out is None else out.unionByName(row)
    return out


def not_in(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is missing; only distinct keys meet the parent table."""
    held = child.filter(F.col(column).isNotNull())
    lost = held.select(column).distinct().join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )
    return held.join(lost, column, "left_semi")


def not_exactly_one(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.filter(filled != 1)


def missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())
