"""What keeps queries within their limits on larger tables: who is broadcast, who is dealt out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalog, sqltables
from lectern.operators.ranks import number_rows
from lectern.plans import finder
from lectern.sources import pages, payloads
from lectern.sources.tables import Tables


def broadcast_parts(df):
    """The text of every subtree that the plan broadcasts, before it runs."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                j += 1
            out.append("\n".join(lines[i:j]))
    return out


def stored(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_courses_cut_to_prefixes_are_not_broadcast(spark, tmp_path):
    courses = stored(spark, tmp_path, [("a", "CS 1", 1), ("a", "", 2), ("a", None, 3), ("a", "MATH 2", 4), ("b", "CS 3", 5)], "site string, course_number string, n int")
    codes = [("a", "cs"), ("a", ""), ("a", "none"), ("b", "MATH"), ("a", None)]
    found = catalog.of_department(courses, spark.createDataFrame(codes, "site string, code string"), ["site"])
    assert not any("Generate" in part and "course_number" in part for part in broadcast_parts(found))
    got = sorted((r.site, "-" if r.code is None else r.code, r.n) for r in found.collect())
    whole = [("a", code, n) for code in ("-", "NONE") for n in (1, 2, 3, 4)]
    whole += [("b", "MATH", 5)]
    assert got == sorted([("a", "CS", 1), ("a", "", 2), *whole])


def test_shifts_of_slices_are_not_broadcast(spark, tmp_path):
    rows = stored(spark, tmp_path, [(g, n) for g in "ab" for n in range(5)], "g string, n int")
    placed = number_rows(rows, ["g"], [F.asc("n")], F.col("n"), "at")
    assert not broadcast_parts(placed)
    assert sorted(r.at for r in placed.collect()) == sorted([1, 2, 3, 4, 5] * 2)


def dealt(df):
    """Whether rows are dealt out by number before they are worked on."""
    return "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_links_are_read_on_all_cores_and_as_before(spark, tmp_path):
    html = '<a href="/x">A <b>b</b>  c</a><a href="../y/./z">up</a><a href="//o.edu/q">o</a><a href="?k">k</a><a href="mailto:a@b">m</a><a class="n">no</a><A HREF=" HTTPS://T.edu ">t</A>'
    store = stored(spark, tmp_path, [(1, "https://S.edu/d/e?f", html), (2, "https://s.edu", None)], "page_id int, url string, html string")
    linked = pages.links(store)
    assert dealt(linked)
    got = [(r.n, r.href, r.text) for r in linked.orderBy("n").collect()]
    assert got == [
        (0, "https://s.edu/x", "A b c"), (1, "https://s.edu/y/z", "up"), (2, "https://o.edu/q", "o"), (3, "https://S.edu/d/e?k", "k"),
        (4, "mailto:a@b", "m"), (5, "HTTPS://T.edu/", "t"),
    ]


def test_payloads_and_measures_are_worked_on_by_all_cores(spark, tmp_path):
    captures = stored(spark, tmp_path, [("s", 0, '[{"code":"MA 1","title":"t"}]'), ("s", 1, "[]")], "site string, n int, json string")
    found = payloads.kuali_courses(captures)
    assert dealt(found)
    assert [(r.course_number, r.title) for r in found.collect()] == [("MA 1", "t")]
    spark.createDataFrame([(1, "red widget")], "p_partkey int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert dealt(finder.trigram_measures(Tables(spark, str(tmp_path))))


def test_keys_of_a_searched_catalog_are_dealt_before_they_are_joined(spark, tmp_path):
    courses = stored(spark, tmp_path, [(1, "CS 1", "Hot gears", "u")], "course_id int, course_number string, title string, college_id string")
    sqltables.register_search(spark, courses, name="search_sizes")
    found = spark.sql("SELECT course_id, score FROM search_sizes('hot gears')")
    assert not any("Generate" in part and "REPARTITION_BY_COL" not in part and "FileScan" in part for part in broadcast_parts(found))
    assert [r.course_id for r in found.collect()] == [1]
