"""SQL functions against the builders and operators they are made from."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import courses, sql, text
from lectern.operators import listing, search, similarity, sqltables

TITLES = [
    "Introduction to Psychology", "Linear Algebra for Data Science", "linear algebra", "Machine Learning", "Data Structures",
    "", None, "C++", "Organic Chemistry II", "It's \\ 100% _odd_ 'quoted'", "Data Structure and Algorithms",
]
NUMBERS = ["PSYC 101", "MATH-540", "6.1010", "CS 50", None, "", "18.06", "BIO 9A", "x", "CS 5000", "EECS 281"]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(i, NUMBERS[i % 11], TITLES[i % 11], i % 3) for i in range(44)]
    return spark.createDataFrame(rows, "course_id long, course_number string, title string, college_id int")


def test_scalar_functions_equal_the_builders(spark, catalog):
    made = sql.register(spark)
    assert made == ["course_content_words", "content_coverage", "course_level", "course_number_key", "similarity", "word_similarity"]
    typed = "data structures for chemists"
    got = spark.sql(
        f"""SELECT course_id, course_content_words(title) a, content_coverage(course_content_words('{typed}'), course_content_words(title)) b,
        course_level(course_number) c, course_number_key(course_number) d, similarity('{typed}', title) e, word_similarity('{typed}', title) f FROM {{t}}""",
        t=catalog,
    )
    title, q = F.col("title"), F.lit(typed)
    want = catalog.select(
        "course_id", text.content_words(title), text.coverage(text.content_words(q), text.content_words(title)), courses.course_level(F.col("course_number")),
        text.squash(F.col("course_number")), text.similarity(q, title), text.word_similarity(q, title),
    )
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "course_content_words" not in plan  # inlined


def test_spelled_expressions_hold_odd_literals(spark):
    odd = F.concat(F.lit("it's \\ \n `x`"), F.when(F.col("a b") > 0.3, F.lit(None)).otherwise(F.lit("ü")))
    df = spark.createDataFrame([(0.1,), (0.9,)], "`a b` double")
    assert df.select(F.expr(sql.spelled(odd))).collect() == df.select(odd).collect()


QUERIES = ["data structures", "Linear Algebra", "cs 50", "6.10", "c+", "x", "", "learn", "100% _odd_", "psychologie", "BIO9A"]


@pytest.mark.parametrize("options", [{}, {"per_college": 1, "rank_by": "exactness"}, {"exclude_college": 1, "limit": 3}, {"college": 2}])
def test_search_function_equals_the_operator(spark, catalog, options):
    sqltables.register_search(spark, catalog)
    typed = spark.createDataFrame([(q,) for q in QUERIES] + [(None,)], "query string")
    named = {"per_college": "p_per_college", "rank_by": "p_rank_by", "exclude_college": "p_exclude_college_id", "limit": "p_limit", "college": "p_college_id"}
    given = "".join(f", {named[k]} => {v!r}" for k, v in options.items())
    columns = "course_id, college_id, round(score, 9) score, round(exactness, 9) exactness, round(coverage, 9) coverage, place"
    got = spark.sql(f"SELECT typed.query, {columns} FROM {{typed}} AS typed, LATERAL search_courses(typed.query{given})", typed=typed)
    want = search.search_courses(catalog, typed, **options).selectExpr("query", "course_id", "college_id", "round(score, 9) score", "round(exactness, 9) exactness", "round(coverage, 9) coverage", "place")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    joins = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joins and "NestedLoopJoin" not in joins
    one = spark.sql(f"SELECT {columns} FROM search_courses('data structures'{given})")
    assert sorted(map(tuple, one.collect()), key=str) == sorted((tuple(r)[1:] for r in want.where("query = 'data structures'").collect()), key=str)


def test_similar_function_equals_the_operator(spark):
    vectors = [(i, i % 4, [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(40)] + [(90, 1, [0.0] * 5), (91, 2, None)]
    table = spark.createDataFrame(vectors, "course_id long, college_id int, embedding array<float>")
    sqltables.register_similar(spark, table)
    want = similarity.similar_courses(table, course_id=3, exclude_college=2, min_similarity=0.2)
    got = spark.sql("SELECT course_id, college_id, round(similarity, 9), place FROM similar_courses(p_course_id => 3, p_exclude_college_id => 2, p_min_similarity => 0.2D)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.selectExpr("course_id", "college_id", "round(similarity, 9)", "place").collect()))
    by_vector = spark.sql("SELECT * FROM similar_courses(array(1D, 0D, 0D, 0D, 0D), p_limit => 3)").count()
    assert by_vector == 3 and spark.sql("SELECT * FROM similar_courses()").count() == 0


@pytest.mark.parametrize("sort", ["course", "title", "level", "tests", "cost", "unknown"])
@pytest.mark.parametrize("descending", [False, True])
def test_listing_function_equals_the_operator(spark, catalog, sort, descending):
    rows = catalog.selectExpr("*", "'c' as credits", "cast(null as string) as summary", "concat('D', course_id % 5) as department_code", "'dep' as department_name")
    rows = rows.withColumns({"college_name": F.lit("Uni"), "college_short_name": F.lit(None).cast("string")})
    counts = catalog.selectExpr("course_id", "course_id % 2 as section_count", "course_id % 5 as test_set_count", "course_id % 3 as complete_test_sets", "0L as attempts_taken")
    costs = catalog.selectExpr("course_id", "double(course_id % 6) as cost").where("course_id < 30")
    sqltables.register_listing(spark, rows, counts, costs)
    want = listing.page(listing.course_rows(rows, counts, costs, "D", "tested"), sort, descending, 7, 5).collect()
    direction = str(descending).lower()
    got = spark.sql(f"SELECT * FROM admin_course_list(' d ', 'tested', '{sort}', {direction}, 7, 5) ORDER BY place").drop("place").collect()
    assert got == want and len(want) == 7
