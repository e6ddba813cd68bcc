"""Grading, attempt reports, histories and accuracy breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.display import percentage, round_half_up
from lectern.functions.grading import grade
from lectern.operators.ranks import first_rows, number_rows
from lectern.operators.writes import patch, upsert

# Lengths a test may have, and levels in display order.
TEST_LENGTHS = (10, 25, 40, 70, 100)
DIFFICULTY_ORDER = {"easy": 1, "medium": 2, "hard": 3}
UNTAGGED = "Untagged"


def grade_answers(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Marked answers; answers to unknown questions are dropped.

    ``key``: question_id, test_set_id, type, correct_answer.
    """
    return answers.join(key, "question_id").withColumn(
        "is_correct", grade(F.col("type"), F.col("correct_answer"), F.col("answer"))
    )


def attempt_scores(attempts: DataFrame, graded: DataFrame, key: DataFrame) -> DataFrame:
    """Score of each attempt; the total is the size of the answer key, answered or not."""
    right = graded.groupBy("attempt_id").agg(
        F.count_if("is_correct").alias("score")
    )
    sizes = key.groupBy("test_set_id").agg(F.count(F.lit(1)).alias("total_questions"))
    zero = F.lit(0).cast("bigint")
    return (
        attempts.select("attempt_id", "test_set_id")
        .join(sizes, "test_set_id", "left")
        .join(right, "attempt_id", "left")
        .select(
            "attempt_id",
            "test_set_id",
            F.coalesce("score", zero).alias("score"),
            F.coalesce("total_questions", zero).alias("total_questions"),
        )
    )


def report_rows(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Every question once beside its answer; a missing answer is wrong and unflagged."""
    return questions.join(answers.select(*keys, "answer", "is_correct", "flagged"), keys, "left").withColumns(
        {
            "is_correct": F.coalesce("is_correct", F.lit(False)),
            "flagged": F.coalesce("flagged", F.lit(False)),
        }
    )


def number_from_count(new: DataFrame, held: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Positions of new rows that go on from the number of rows each key already holds."""
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    numbered = number_rows(new, keys, [F.asc(order)], F.floor(F.col(order) / 10_000), "ordinal")
    return numbered.join(counts, keys, "left").select(
        *new.columns, (F.coalesce("held", F.lit(0)) + F.col("ordinal") - 1).alias("position")
    )


def submission_verdicts(submissions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Submissions (attempt_id, user_id, at) with the attempt's test and why one is refused, if it is.

    Of several submissions of one attempt the earliest counts; later ones find it submitted.
    """
    known = attempts.select("attempt_id", F.col("user_id").alias("owner_id"), "test_set_id", "submitted_at")
    mine = F.col("user_id").eqNullSafe(F.col("owner_id"))
    judged = submissions.join(known.withColumn("known", F.lit(True)), "attempt_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("known").isNull(), "unknown attempt").when(~mine, "someone else's attempt").when(F.col("submitted_at").isNotNull(), "already submitted"),
    )
    first = judged.filter("reject_reason IS NULL").groupBy("attempt_id").agg(F.min(F.struct("at", "user_id")).alias("first"))
    again = F.col("reject_reason").isNull() & (F.struct("at", "user_id") != F.col("first"))
    return (
        judged.join(first, "attempt_id", "left")
        .withColumn("reject_reason", F.when(again, "already submitted").otherwise(F.col("reject_reason")))
        .select("attempt_id", "user_id", "at", "test_set_id", "reject_reason")
    )


def submit_attempts(
    attempts: DataFrame, stored: DataFrame, submissions: DataFrame, answers: DataFrame, key: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Grade and write what users hand in: (answers, attempts) as they stand afterwards.

    ``attempts``: attempt_id, user_id, test_set_id, submitted_at, score, total_questions. ``submissions``:
    attempt_id, user_id, at. ``answers``: attempt_id, question_id, answer, flagged. ``key``: question_id,
    test_set_id, type, correct_answer. ``stored``: attempt_id, question_id, answer, is_correct, flagged.

    Only the owner can submit, and only once (``submission_verdicts``). Answers to questions outside the
    attempt's test are dropped; an answer to a question that has one replaces it. The total is the size of the test's
    key, however many answers came; an attempt without any valid answer is submitted with a score of 0.
    """
    taken = submission_verdicts(submissions, attempts).filter("reject_reason IS NULL").dropDuplicates(["attempt_id"])
    own = answers.select("attempt_id", "question_id", "answer", "flagged").join(taken.select("attempt_id", "test_set_id"), "attempt_id")
    graded = own.join(key, ["question_id", "test_set_id"]).select(
        "attempt_id",
        "question_id",
        "answer",
        grade(F.col("type"), F.col("correct_answer"), F.col("answer")).alias("is_correct"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
    )
    kept = upsert(stored, graded, ["attempt_id", "question_id"], ["answer", "is_correct", "flagged"])
    # A question sent twice counts once, as it is stored once.
    right = graded.groupBy("attempt_id", "question_id").agg(F.max(F.struct("answer", "is_correct", "flagged")).alias("row"))
    scores = attempt_scores(taken, right.select("attempt_id", F.col("row.is_correct").alias("is_correct")), key)
    sums = scores.join(taken.select("attempt_id", F.col("at").alias("submitted_at")), "attempt_id")
    return kept, patch(attempts, sums.drop("test_set_id"), ["attempt_id"], ["score", "total_questions", "submitted_at"])


def report_totals(rows: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Stored score and total of an attempt, else those counted from its rows."""
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("is_correct").alias("right"),
        F.count_if(~F.col("is_correct")).alias("incorrect"),
        F.count_if("flagged").alias("flagged"),
    )
    return counted.join(attempts.select(key, "score", "total_questions"), key, "left").select(
        key,
        F.coalesce("score", "right").alias("score"),
        F.coalesce(F.nullif(F.col("total_questions"), F.lit(0)), "questions").alias("total"),
        "questions",
        "incorrect",
        "flagged",
    )


def report_filter(rows: DataFrame, show: str) -> DataFrame:
    tests = {"incorrect": ~F.col("is_correct"), "flagged": F.col("flagged")}
    return rows.filter(tests[show]) if show in tests else rows


def accuracy(rows: DataFrame, by: str) -> DataFrame:
    """Right and total per value with the rounded share."""
    return rows.groupBy(F.col(by)).agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    ).withColumn("percent", F.when(F.col("total") == 0, F.lit(0)).otherwise(percentage(F.col("correct"), F.col("total"))))


def topic_accuracy(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Accuracy per topic, the most asked first; ``top`` of them (12 is the site's preset)."""
    tagged = rows.withColumn("topic", F.coalesce("topic", F.lit(UNTAGGED)))
    rows = accuracy(tagged, "topic").orderBy(F.desc("total"), "topic")
    return rows if top is None else rows.limit(top)


def difficulty_accuracy(rows: DataFrame) -> DataFrame:
    place = F.create_map(*[F.lit(v) for kv in DIFFICULTY_ORDER.items() for v in kv])
    known = rows.filter(F.col("difficulty").isin(list(DIFFICULTY_ORDER)))
    return (
        accuracy(known, "difficulty")
        .withColumn("incorrect", F.col("total") - F.col("correct"))
        .withColumn("place", place[F.col("difficulty")])
        .orderBy("place")
    )


def scored_attempts(attempts: DataFrame) -> DataFrame:
    """Submitted attempts with a total above zero and their rounded percentage.

    The total falls back to the set's question count.
    """
    total = F.coalesce(F.nullif(F.col("total_questions"), F.lit(0)), F.col("question_count"), F.lit(0))
    return (
        attempts.filter(F.col("submitted_at").isNotNull())
        .withColumn("total", total)
        .filter("total > 0")
        .withColumn("percent", percentage(F.col("score"), F.col("total")))
    )


def history(scored: DataFrame, keys: list[str]) -> DataFrame:
    """First, latest, best and improvement of each group, by partial aggregates alone."""
    when = F.struct("submitted_at", "attempt_id")
    return (
        scored.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.min_by("percent", when).alias("first_percent"),
            F.max_by("percent", when).alias("latest_percent"),
            F.max("percent").alias("best_percent"),
        )
        .withColumn("improvement", F.col("latest_percent") - F.col("first_percent"))
    )


def history_totals(scored: DataFrame, user: str, test: str) -> DataFrame:
    """Totals per user, with a trend only once there are four attempts.

    The mean is over the rounded percentages; the trend compares the last three with the
    first three.
    """
    per_test = scored.groupBy(user, test).agg(
        F.count(F.lit(1)).alias("n"), F.sum("percent").alias("sum"), F.max("percent").alias("best")
    )
    base = per_test.groupBy(user).agg(
        F.sum("n").alias("attempts_taken"),
        round_half_up(F.sum("sum") / F.sum("n")).alias("average_percent"),
        F.max("best").alias("best_percent"),
        F.count(F.lit(1)).alias("distinct_tests"),
    )
    columns = [user, "submitted_at", "attempt_id", "percent"]
    first = first_rows(
        scored.select(*columns), [user], [F.asc("submitted_at"), F.asc("attempt_id")], 3, "place"
    )
    last = first_rows(
        scored.select(*columns), [user], [F.desc("submitted_at"), F.desc("attempt_id")], 3, "place"
    )
    first_mean = first.groupBy(user).agg(F.avg("percent").alias("first_mean"))
    last_mean = last.groupBy(user).agg(F.avg("percent").alias("last_mean"))
    return (
        base.join(first_mean, user)
        .join(last_mean, user)
        .withColumn(
            "trend",
            F.when(
                F.col("attempts_taken") >= 4, round_half_up(F.col("last_mean") - F.col("first_mean"))
            ),
        )
        .drop("first_mean", "last_mean")
    )


def numbered_attempts(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts numbered from the oldest, a busy group spread by day."""
    return number_rows(
        scored,
        keys,
        [F.asc("submitted_at"), F.asc("attempt_id")],
        F.to_date("submitted_at"),
        "attempt_number",
    )


def result_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Latest, best, mean and change of one test; no change with a single attempt."""
    when = F.struct("submitted_at", "attempt_id")
    latest, first = F.max_by("percent", when), F.min_by("percent", when)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        latest.alias("latest_percent"),
        F.max("percent").alias("best_percent"),
        round_half_up(F.avg("percent")).alias("average_percent"),
        F.when(F.count(F.lit(1)) > 1, latest - first).alias("change"),
    )


def chosen_attempt(attempts: DataFrame, keys: list[str], requested: Column) -> DataFrame:
    """The requested attempt of each group, else the newest submitted one."""
    rest = [c for c in attempts.columns if c not in keys]
    picked = (
        attempts.filter(F.col("submitted_at").isNotNull())
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct(*rest),
                F.struct(F.coalesce(requested, F.lit(False)), F.col("submitted_at"), F.col("attempt_id")),
            ).alias("kept")
        )
    )
    return picked.select(*keys, *[F.col("kept")[c].alias(c) for c in rest])


def timeline(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Each point with its group's overall mean, joined from an aggregate."""
    means = numbered.groupBy(*keys).agg(round_half_up(F.avg("percent")).alias("overall_mean"))
    return numbered.join(means, keys)


def named_favorites(favorites: DataFrame, colleges: DataFrame, courses: DataFrame) -> DataFrame:
    """Favourites with the names to show: a college's, or a course's number and title; rows of neither keep nulls.

    ``favorites``: user_id, college_id, course_id; ``colleges``: college_id, college_name; ``courses``:
    course_id, course_number, title.
    """
    course = courses.select("course_id", F.concat_ws(" ", "course_number", "title").alias("course_name"))
    named = favorites.join(colleges.select("college_id", "college_name"), "college_id", "left").join(course, "course_id", "left")
    return named.select("user_id", "college_name", "course_name")


# What a user's row shows of each of the newest results.
RESULT_FIELDS = ("attempt_id", "course_number", "section_title", "score", "total_questions", "submitted_at")


def user_rollup(
    users: DataFrame,
    favorites: DataFrame,
    test_sets: DataFrame,
    attempts: DataFrame,
    costs: DataFrame,
    recent: int = 5,
    names: int | None = None,
) -> DataFrame:
    """Activity of each user: counts, mean and best of unrounded percentages, cost, favourites, newest results.

    ``favorites`` carry ``college_name`` and ``course_name`` (``named_favorites``), which are listed in
    alphabetical order, all of them unless ``names`` bounds the lists. ``recent_results`` holds the fields of
    ``RESULT_FIELDS`` that the attempts have, newest first. Results and bounded names are cut to their number inside
    every task before anything is gathered.
    """
    share = F.when(
        F.col("submitted_at").isNotNull() & (F.col("total_questions") > 0) & F.col("score").isNotNull(),
        F.col("score") / F.col("total_questions") * 100,
    )
    taken = attempts.groupBy("user_id").agg(
        F.count("submitted_at").alias("attempts_taken"),
        round_half_up(F.avg(share)).alias("average_score"),
        round_half_up(F.max(share)).alias("best_score"),
    )
    made = test_sets.groupBy("user_id").agg(F.count(F.lit(1)).alias("sets_created"))
    starred = favorites.groupBy("user_id").agg(F.count(F.lit(1)).alias("favorites"))
    lists = {}
    for name, out in (("college_name", "favorite_colleges"), ("course_name", "favorite_courses")):
        if name in favorites.columns:
            shown = favorites.filter(F.col(name).isNotNull()).select("user_id", name)
            if names is not None:
                shown = first_rows(shown, ["user_id"], [F.asc(name)], names, "place")
            lists[out] = shown.groupBy("user_id").agg(F.sort_array(F.collect_list(name)).alias(out))
    fields = [c for c in RESULT_FIELDS if c in attempts.columns]
    newest = (
        recent_results(attempts, "user_id", recent)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("row")))).alias("rows"))
        .select("user_id", F.col("rows.row").alias("recent_results"))
    )
    joined = users.select("user_id")
    for part in (taken, made, starred, costs, newest, *lists.values()):
        joined = joined.join(part, "user_id", "left")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return joined.select(
        "user_id",
        F.coalesce("attempts_taken", zero).alias("attempts_taken"),
        "average_score",
        "best_score",
        F.coalesce("sets_created", zero).alias("sets_created"),
        F.coalesce("favorites", zero).alias("favorites"),
        F.coalesce("call_count", zero).alias("call_count"),
        F.coalesce("total_tokens", zero).alias("total_tokens"),
        F.coalesce("cost", F.lit(0)).alias("cost"),
        *[F.coalesce(F.col(c), none).alias(c) for c in lists],
        F.coalesce("recent_results", F.array().cast(newest.schema["recent_results"].dataType)).alias("recent_results"),
    )


def recent_results(attempts: DataFrame, user: str, n: int = 5) -> DataFrame:
    """The newest submitted attempts of each user."""
    return first_rows(
        attempts.filter(F.col("submitted_at").isNotNull()),
        [user],
        [F.desc("submitted_at"), F.desc("attempt_id")],
        n,
        "place",
    )


# Questions in a piece of an exported document.
EXPORT_PIECE = 10_000


def export_pieces(sets: DataFrame, questions: DataFrame, key: str, fields: list[str], per_piece: int = EXPORT_PIECE) -> DataFrame:
    """JSON documents of the complete sets in pieces (key, piece, pieces, text): in order, end to end, they are the text.

    Questions stand in order, positions from 1. A piece holds ``per_piece`` places of a set, so a set of any
    size is written by many tasks and none holds more than a piece. Positions are whole numbers from 0; places
    without a question are skipped. A set without questions is left out.
    """
    place = F.floor(F.col("position") / per_piece)
    listed = questions.groupBy(key, place.alias("range")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("position") + 1).alias("position"), *fields))).alias("questions")
    )
    ends = listed.groupBy(key).agg(F.min("range").alias("first"), F.max("range").alias("last"), F.count(F.lit(1)).alias("pieces"))
    body = [F.col(c) for c in sets.columns if c != key]
    head = F.to_json(F.struct(F.col(key), *body))
    opened = sets.filter("status = 'complete'").select(key, head.alias("head"))
    inner = F.to_json("questions")
    inner = F.substring(inner, F.lit(2), F.length(inner) - 2)
    start = F.concat(F.substring(F.col("head"), F.lit(1), F.length("head") - 1), F.lit(',"questions":['))
    return (
        listed.join(opened.join(ends, key), key)
        .select(
            key,
            "range",
            "pieces",
            F.concat(
                F.when(F.col("range") == F.col("first"), start).otherwise(","),
                inner,
                F.when(F.col("range") == F.col("last"), "]}").otherwise(""),
            ).alias("text"),
        )
        .withColumnRenamed("range", "piece")
    )


def write_sets(pieces: DataFrame, key: str, folder: str) -> None:
    """Write each document as a file of its own, a piece to a line, streaming through in order.

    A line break between questions is blank space to JSON. One task holds one piece at a time.
    """
    ordered = pieces.repartition(key).sortWithinPartitions(key, "piece")
    ordered.select(key, "text").write.partitionBy(key).text(folder)


def export_sets(sets: DataFrame, questions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One JSON document per complete set with its questions in order: for sets that fit a row (``export_pieces`` else)."""
    pieces = export_pieces(sets, questions, key, fields)
    return pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("all")).select(
        key, F.array_join("all.text", "").alias("document")
    )


def attempt_requests(requests: DataFrame, test_sets: DataFrame) -> DataFrame:
    """Reject reasons of requests to start an attempt."""
    return requests.join(test_sets.select("test_set_id", "question_count"), "test_set_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("question_count").isNull(), "unknown test")
        .when(F.col("question_count") <= 0, "no questions yet"),
    )


def test_set_requests(requests: DataFrame, sections: DataFrame, recent: DataFrame, cap: int = 10) -> DataFrame:
    """Reject reasons of requests to create a test set."""
    known = sections.select("section_id", F.lit(True).alias("known")).distinct()
    return (
        requests.join(known, "section_id", "left")
        .join(recent.select("user_id", "created"), "user_id", "left")
        .withColumn(
            "reject_reason",
            F.when(~F.col("length").isin(*TEST_LENGTHS), "length not offered")
            .when(F.col("known").isNull(), "unknown section")
            .when(F.col("created") >= cap, "daily limit reached"),
        )
        .drop("known")
    )


def owner_deletes(requests: DataFrame, test_sets: DataFrame) -> DataFrame:
    """Delete requests made by the owner of the set."""
    return requests.join(test_sets.select("test_set_id", "user_id"), ["test_set_id", "user_id"], "left_semi")


