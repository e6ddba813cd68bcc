"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import courses as c
from lectern.functions import display, grading, text, web
from lectern.operators import search


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


HEADINGS = [
    ("6.1000 Introduction to Programming", "6.1000", "Introduction to Programming", None),
    ("CS 100   Computer Science Orientation   credit: 1 Hour.", "CS 100", "Computer Science Orientation", "1 Hour"),
    ("CS 229 Machine Learning (3)", "CS 229", "Machine Learning", "3"),
    ("ENGL 1010. Composition I. 3 Credit Hours.", "ENGL 1010", "Composition I", "3 Credit Hours"),
    ("21A.100 Introduction to Anthropology", "21A.100", "Introduction to Anthropology", None),
    ("ACCT:1300 First-Year Seminar 1 s.h.", "ACCT:1300", "First-Year Seminar", "1 s.h"),
    ("ACCT:2100 Introduction to Financial Accounting 3 s.h.", "ACCT:2100", "Introduction to Financial Accounting", "3 s.h"),
    ("1.63[J] Advanced Fluid Dynamics", "1.63[J]", "Advanced Fluid Dynamics", None),
    ("6.7700[J] Fundamentals of Probability", "6.7700[J]", "Fundamentals of Probability", None),
]


def test_split_heading(spark):
    got = values(spark, [(h[0],) for h in HEADINGS], "raw string", c.split_heading(F.col("raw")))
    assert [tuple(g) for g in got] == [h[1:] for h in HEADINGS]


def test_parse_heading(spark):
    rows = [
        ("CPSC 201a, Introduction to Computer Science  Jane Doe and John Roe", "CPSC"),
        ("* ANTH 1171a   / ARCG 1171a, Great Civilizations  Pat Heng", "ARCG"),
        ("AEC LDEA, LOWER DIVISION ED ABROAD", "AEC"),
        ("AEC 122,  +INTRO TO CLIMATE,  3 Credits", "AEC"),
        ("CS 100   Orientation   credit: 1 Hour.", ""),
    ]
    got = values(spark, rows, "raw string, dept string", c.parse_heading(F.col("raw"), F.col("dept")))
    assert tuple(got[0]) == ("CPSC 201a", "Introduction to Computer Science", None, ["Jane Doe", "John Roe"])
    assert got[1][0] == "ARCG 1171a" and got[1][3] == ["Pat Heng"]
    assert got[2] is None
    assert tuple(got[3]) == ("AEC 122", "INTRO TO CLIMATE", "3 Credits", None)
    assert tuple(got[4]) == ("CS 100", "Orientation", "1 Hour", None)


def test_prerequisites(spark):
    rows = [
        ("Prerequisite: MATH 101. Enrollment is limited to majors.",),
        ("Prereq: None. Offered every fall.",),
        ("A survey of modern algebra.",),
    ]
    assert values(spark, rows, "p string", c.prerequisites(F.col("p"))) == ["MATH 101", None, None]


def test_course_level(spark):
    cases = {
        "CS 106A": "Introductory", "CS 229": "Undergraduate", "CS 5840": "Graduate", "6.1010": "Introductory",
        "6.5840": "Graduate", "AFRICAAM10": "Introductory", "MUSIC 72": "Undergraduate", "SEMINAR": "Unspecified",
    }
    got = values(spark, [(k,) for k in cases], "n string", c.course_level(F.col("n")))
    assert got == list(cases.values())


SORTED = "Binary search requires sorted input because it discards half the range each step."


def test_grading(spark):
    rows = [
        ("mcq", "Dynamic array", "  dynamic   array ", True),
        ("mcq", "Dynamic array", "Linked list", False),
        ("mcq", "Dynamic array", None, False),
        ("mcq", "Dynamic array", "   ", False),
        ("true_false", "True", "true", True),
        ("true_false", "True", "False", False),
        ("short_answer", SORTED, "It requires sorted input since each step discards half the range.", True),
        ("short_answer", SORTED, "Because computers are fast.", False),
        ("short_answer", "a b c", "a b c", False),
    ]
    got = values(spark, rows, "t string, k string, g string, w boolean", grading.grade(F.col("t"), F.col("k"), F.col("g")))
    assert got == [r[3] for r in rows]


def test_similarity(spark):
    rows = [
        ("Introduction to Psychology", "Introduction to Africology", 0.5882),
        ("Linear Algebra for Data Science", "linear algebra", 0.4688),
        ("word", "two words", 0.363636),
        ("", "", 0.0),
    ]
    got = values(spark, rows, "a string, b string, w double", text.similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([r[2] for r in rows], abs=5e-5)
    got = values(spark, rows[2:3], "a string, b string, w double", text.word_similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([0.8])


def test_typed_queries_match_columns(spark):
    texts = ["Red  widgets 101", "Éa-b_c 6.1010", "intro to the lab", "a", "--"]
    rows = [(t,) for t in texts]
    grams = values(spark, rows, "t string", text.trigrams(F.col("t")))
    words = values(spark, rows, "t string", text.content_words(F.col("t")))
    for t, g, w in zip(texts, grams, words):
        assert sorted(g) == sorted(search._python_trigrams(t))
        assert sorted(w) == sorted(search._python_content_words(t))


def test_jaccard(spark):
    a, b = text.stem_tokens(F.col("a")), text.stem_tokens(F.col("b"))
    rows = [("The dynamic programming table", "dynamic programming table!"), ("the", "of")]
    assert values(spark, rows, "a string, b string", text.token_jaccard(a, b)) == [1.0, 0.0]


def test_coverage(spark):
    rows = [("data structures", "Data Structure Design"), ("introduction to", "x"), ("linear maps", "Linear Algebra")]
    words = [text.content_words(F.col(n)) for n in "ab"]
    assert values(spark, rows, "a string, b string", text.coverage(*words)) == [1.0, None, 0.5]


def test_expand_and_snap(spark):
    rows = [("Intro. to adv lab work",)]
    assert values(spark, rows, "q string", text.expand_shorthand(F.col("q"))) == [
        "introduction to advanced laboratory work"
    ]
    rows = [("SORTING ", ["Sorting", "Graphs"]), ("graph", ["Sorting", "Graphs"]), (" Zeta", ["Sorting"]), (None, []), (None, ["A"])]
    got = values(spark, rows, "t string, ts array<string>", text.snap_topic(F.col("t"), F.col("ts")))
    assert got == ["Sorting", "Graphs", "Zeta", "General", "A"]


def test_summary_and_focus(spark):
    raw = "# Title\n---\n**Bold start.** " + "words " * 20 + "\n\n\n\n- item one\n\n\nend"
    got = values(spark, [(raw,), ("short",)], "s string", text.tidy_summary(F.col("s")))
    assert got[0].startswith("Bold start. words") and "\n\n\n" not in got[0] and "item one" in got[0] and "- item" not in got[0]
    assert got[1] is None
    got = values(spark, [("intro CS 10 about it",), ("nothing",)], "m string", text.focus_on_number(F.col("m"), F.lit("cs  10")))
    assert got == ["CS 10 about it", "nothing"]


def test_rounding_and_display(spark):
    assert values(spark, [(-2.5,), (2.5,), (2.4,)], "x double", display.round_half_up(F.col("x"))) == [-2, 3, 2]
    got = values(spark, [(0.0,), (0.0041,), (0.25,), (12.4,)], "x double", display.dollars(F.col("x")))
    assert got == ["$0.00", "$0.0041", "$0.250", "$12.40"]
    got = values(spark, [(12,), (1234,), (1_234_567,)], "x bigint", display.token_count(F.col("x")))
    assert got == ["12", "1.2k", "1.2M"]
    rows = [("kuali", "manual"), ("generic", None), (None, "search"), ("banner", "sitemap")]
    got = values(spark, rows, "p string, s string", display.provenance_label(F.col("p"), F.col("s")))
    assert got == ["Direct URL", "Scraped", None, "Banner"]


def test_natural_sort_and_subjects(spark):
    rows = [("CS 101",), ("CS 9",), ("cs 10A",), ("6.10",), ("6.9",)]
    df = spark.createDataFrame(rows, "n string").orderBy(c.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["6.9", "6.10", "CS 9", "cs 10A", "CS 101"]
    rows = [
        ("MC - Marine Craft", "mc", "MC", "Marine Craft"),
        ("Tidal Gardens (KELP)", "tidal-gardens", "KELP", "Tidal Gardens"),
        ("Bridges and Arches (Course 14)", "14", "14", "Bridges and Arches"),
        ("Theory of the Craft of Looms", "theory-of-looms", "TCL", "Theory of the Craft of Looms"),
        ("Weaving", "weaving-studio", "WEAV", "Weaving"),
        ("QY Quay Work", "qy", "QY", "Quay Work"),
    ]
    got = values(spark, rows, "t string, s string, c string, n string", c.derive_subject(F.col("t"), F.col("s")))
    assert [tuple(g) for g in got] == [r[2:] for r in rows]


def test_urls(spark):
    base = "https://X.edu/a/b.html?q=1#f"
    cases = {
        "c.html": "https://X.edu/a/c.html",
        "/c": "https://x.edu/c",
        "../c": "https://x.edu/c",
        "./d/../e/": "https://x.edu/a/e/",
        "?z=2": "https://X.edu/a/b.html?z=2",
        "//y.edu/q": "https://y.edu/q",
        "https://z.edu": "https://z.edu/",
        "mailto:a@b": "mailto:a@b",
    }
    got = values(spark, [(k,) for k in cases], "h string", web.resolve(F.col("h"), F.lit(base)))
    assert got == list(cases.values())
    urls = ["http://10.0.0.1/", "https://a.edu", "ftp://a.edu", "http://localhost:8080", "http://172.20.1.1", "http://172.40.1.1", "nope"]
    got = values(spark, [(u,) for u in urls], "u string", web.public_url(F.col("u")))
    assert got == [False, True, False, False, False, True, False]


def test_confidence(spark):
    rows = [(True, 95.0), (True, 0.7), (False, 0.9), (None, None), (True, float("inf")), (True, -3.0)]
    got = values(spark, rows, "c boolean, r double", web.confidence(F.col("c"), F.col("r")))
    assert got == [0.95, 0.7, 0.0, 0.5, 0.5, 0.0]


def test_page_score_and_platform(spark):
    catalog = "<title>Course Catalog</title>" + "<a href='/courses/x'>x</a>" * 30 + "courseleaf" + " " * 800
    news = "<title>News</title><article><p>x</p><time>now</time></article>" + " " * 800
    rows = [("https://catalog.a.edu/", catalog), ("https://www.a.edu/news/today", news), ("bad", news)]
    got = values(spark, rows, "u string, h string", web.page_score(F.col("u"), F.col("h")))
    assert got == [40 + 12 + 20 + 20 + 30 + 25, 4 - 45 - 60 - 25 - 15, 0]
    rows = [("https://a.edu", "x CourseDog y"), ("https://catalog.a.edu/courses", ""), ("https://a.edu/content.php?x", ""), ("https://a.edu", "hi")]
    got = values(spark, rows, "u string, h string", web.platform(F.col("u"), F.col("h")))
    assert got == ["coursedog", "courseleaf", "acalog", "generic"]
