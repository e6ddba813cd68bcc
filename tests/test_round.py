"""Grading write, user roll-up, document pieces and robots rules against plain loops."""

import collections
import datetime
import json
import random
import re

from pyspark.sql import functions as F

from lectern.operators import assessment, crawl

DAY = datetime.datetime(2024, 1, 1)


def test_submitting_follows_the_answer_key(spark):
    attempts = spark.createDataFrame(
        [(1, 10, 100, None), (2, 20, 100, None), (3, 10, 200, DAY), (4, 30, 200, None), (5, 40, 300, None), (6, None, 100, None)],
        "attempt_id long, user_id long, test_set_id long, submitted_at timestamp_ntz",
    ).withColumns({c: F.lit(None).cast("bigint") for c in ("score", "total_questions")})
    key = spark.createDataFrame(
        [(f"q{i}", 100, "mcq", f"a{i}") for i in range(4)] + [("z1", 200, "true_false", "true"), ("z2", 200, "mcq", "b")],
        "question_id string, test_set_id long, type string, correct_answer string",
    )
    stored = spark.createDataFrame([(1, "q0", "old", False, False), (3, "z1", "kept", False, True)], "attempt_id long, question_id string, answer string, is_correct boolean, flagged boolean")
    hour = datetime.timedelta(hours=1)
    submissions = spark.createDataFrame(
        [(1, 10, DAY + hour), (1, 10, DAY + 2 * hour), (2, 99, DAY), (3, 10, DAY), (4, 30, DAY), (5, 40, DAY), (6, 10, DAY), (77, 1, DAY)],
        "attempt_id long, user_id long, at timestamp_ntz",
    )
    answers = spark.createDataFrame(
        [(1, "q0", " A0 ", True), (1, "q1", "wrong", None), (1, "z1", "true", False), (1, "nowhere", "x", False), (2, "q0", "a0", False), (3, "z1", "true", False), (5, "q0", "a0", True), (1, "q2", None, True)],
        "attempt_id long, question_id string, answer string, flagged boolean",
    )
    verdicts = collections.Counter((r.attempt_id, r.reject_reason) for r in assessment.submission_verdicts(submissions, attempts).collect())
    assert verdicts == {
        (1, None): 1, (1, "already submitted"): 1, (2, "someone else's attempt"): 1, (3, "already submitted"): 1, (4, None): 1, (5, None): 1,
        (6, "someone else's attempt"): 1, (77, "unknown attempt"): 1,
    }
    kept, after = assessment.submit_attempts(attempts, stored, submissions, answers, key)
    assert sorted(map(tuple, kept.collect())) == [
        (1, "q0", " A0 ", True, True), (1, "q1", "wrong", False, False), (1, "q2", None, False, True), (3, "z1", "kept", False, True),
    ]
    rows = {r.attempt_id: (r.submitted_at, r.score, r.total_questions) for r in after.collect()}
    assert rows == {1: (DAY + hour, 1, 4), 2: (None, None, None), 3: (DAY, None, None), 4: (DAY, 0, 2), 5: (DAY, 0, 0), 6: (None, None, None)}


def test_rollup_lists_names_and_newest_results(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    stars = spark.createDataFrame([(1, 7, None), (1, None, 70), (1, 8, None), (2, 99, None), (1, None, 71)], "user_id long, college_id long, course_id long")
    colleges = spark.createDataFrame([(7, "Yale"), (8, "Brown")], "college_id long, college_name string")
    courses = spark.createDataFrame([(70, "CS 1", "Intro"), (71, "AB 2", "More")], "course_id long, course_number string, title string")
    made = [(1, n, "S", 5, 10, DAY + datetime.timedelta(days=n % 9, hours=n)) for n in range(30)] + [(2, 100, "T", None, 10, None)]
    attempts = spark.createDataFrame(made, "user_id long, attempt_id long, section_title string, score long, total_questions long, submitted_at timestamp_ntz")
    costs = spark.createDataFrame([], "user_id long, call_count long, total_tokens long, cost double")
    named = assessment.named_favorites(stars, colleges, courses)
    got = {r.user_id: r for r in assessment.user_rollup(users, named, users.limit(0), attempts, costs).collect()}
    assert got[1].favorite_colleges == ["Brown", "Yale"] and got[1].favorite_courses == ["AB 2 More", "CS 1 Intro"] and got[1].favorites == 4
    newest = sorted((r for r in made if r[0] == 1), key=lambda r: (r[5], r[1]), reverse=True)[:5]
    assert [r.attempt_id for r in got[1].recent_results] == [r[1] for r in newest]
    assert got[1].recent_results[0].section_title == "S" and got[1].average_score == 50
    assert got[2].recent_results == [] and got[2].favorite_colleges == [] and got[2].favorites == 1 and got[3].recent_results == []
    few = {r.user_id: r for r in assessment.user_rollup(users, named, users.limit(0), attempts, costs, recent=2, names=1).collect()}
    assert few[1].favorite_colleges == ["Brown"] and len(few[1].recent_results) == 2


def test_documents_in_pieces(spark, tmp_path):
    sets = spark.createDataFrame([(1, 'a "b"', "complete"), (2, None, "complete"), (3, "c", "generating"), (4, "empty", "complete")], "id long, title string, status string")
    questions = spark.range(25_000).selectExpr("1L as id", "int(id) as position", "concat('q ', id) as question")
    questions = questions.unionByName(spark.createDataFrame([(2, 0, None), (2, 9, "late"), (3, 0, "no")], "id long, position int, question string"))
    whole = {r.id: r.document for r in assessment.export_sets(sets, questions, "id", ["question"]).collect()}
    assert set(whole) == {1, 2}
    assert json.loads(whole[1]) == {"id": 1, "title": 'a "b"', "status": "complete", "questions": [{"position": i + 1, "question": f"q {i}"} for i in range(25_000)]}
    assert json.loads(whole[2])["questions"] == [{"position": 1}, {"position": 10, "question": "late"}]
    pieces = assessment.export_pieces(sets, questions, "id", ["question"], per_piece=100)
    rows = pieces.collect()
    assert max(len(r.text) for r in rows) < 6000 and {r.pieces for r in rows if r.id == 1} == {250}
    assert "".join(r.text for r in sorted((r for r in rows if r.id == 1), key=lambda r: r.piece)) == whole[1]
    assessment.write_sets(pieces, "id", str(tmp_path / "out"))
    for i in (1, 2):
        (file,) = (tmp_path / "out" / f"id={i}").glob("*.txt")
        assert file.read_text().replace("\n", "") == whole[i] and json.loads(file.read_text())


def holds(path, rule):
    if rule == "/":
        return True
    pattern = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m.group(0), rule).replace("*", ".*")
    pattern = re.sub(r"\\\$$", "$", pattern)
    try:
        return re.match(pattern, path) is not None
    except re.error:
        return path.startswith(rule)


def test_robots_rules_meet_by_their_beginning(spark):
    rng = random.Random(2)
    signs = ["a", "b", "/", "*", "$", ".", "ab", "/a", "?"]
    rules = [(f"https://s{k}.edu", rng.random() < 0.5, "/" + "".join(rng.choice(signs[: 9 if k else 8]) for _ in range(rng.randint(0, 5)))) for k in (0, 1) for _ in range(60)]
    rules = [r for r in rules if "??" not in r[2] and "*?" not in r[2]]
    rules += [("https://many.edu", i % 2 == 0, f"/catalog/{i}") for i in range(3000)]
    urls = [f"https://s{k}.edu/" + "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 8))) for k in (0, 1, 2) for _ in range(200)]
    urls += [f"https://many.edu/catalog/{i}/x" for i in range(0, 3000, 7)] + ["nonsense", None]
    of = collections.defaultdict(list)
    for origin, allow, rule in rules:
        of[origin].append((len(rule), allow, rule))

    def want(url):
        found = re.match(r"(https://[^/]+)(.*)", url or "")
        if not found:
            return False
        met = [(n, allow) for n, allow, rule in of[found[1]] if holds(found[2], rule)]
        return max(met)[1] if met else True

    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string").repartition(3)
    got = crawl.robots_verdicts(table, spark.createDataFrame(rules, "origin string, allow boolean, rule string"))
    assert got.columns == ["id", "url", "allowed"]
    assert {r.id: r.allowed for r in got.collect()} == {i: want(u) for i, u in enumerate(urls)}
