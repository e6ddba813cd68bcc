"""Sorted tables, numbered and read by page, against plain sorting."""

import functools

from pyspark.sql import functions as F

from lectern.operators import listing, paging


def test_pages_read_only_their_ranges(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 503 as cost", "if(id % 3 = 0, null, id % 5) as level")
    order = [F.col("level").desc_nulls_last(), F.col("cost").asc(), F.col("id").asc()]
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    pages = paging.Pages.build(rows, order, str(tmp_path / "p"), 300)
    assert pages.total == 5000 and len(pages.counts) == 17 and pages.page_count(500) == 10
    for limit, offset in ((7, 0), (500, 4400), (13, 2999), (50, 4990), (0, 3), (5, 9000), (3, -4)):
        got = pages.page(limit, offset)
        first = max(offset, 0)
        assert [tuple(r)[:3] for r in got.collect()] == want[first : first + limit]
        assert [r.place for r in got.collect()] == list(range(first + 1, min(first + limit, 5000) + 1))[: len(got.collect())]
    deep = pages.page(10, 4700)
    assert len(deep.inputFiles()) <= 2  # one range, whatever the offset
    numbered = {r.id: r.place for r in pages.numbered().collect()}
    assert [numbered[r[0]] for r in want] == list(range(1, 5001))


def test_pages_of_nothing(spark, tmp_path):
    pages = paging.Pages.build(spark.range(0), [F.col("id").asc()], str(tmp_path / "p"))
    assert pages.total == 0 and pages.page_count() == 1


def test_tables_sort_naturally_with_empties_last(spark):
    texts = ["b10", "B9", "", None, "É2", "e1", "a", "Á1", "b09x", "10", "9", " ", "é10"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")

    def natural(a, b):
        import re
        import unicodedata

        def key(s):
            plain = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
            return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", plain)]

        return (key(a) > key(b)) - (key(a) < key(b))

    full = [i for i, t in enumerate(texts) if t and t.strip()]
    up = sorted(full, key=functools.cmp_to_key(lambda i, j: natural(texts[i], texts[j]) or i - j))
    got = [r.id for r in listing.sort_empties_last(df, "t", False, "id").collect()]
    assert [i for i in got if i in full] == up and got[-2:] == [2, 3]
    down = [r.id for r in listing.sort_empties_last(df, "t", True, "id").collect()]
    assert down[-2:] == [2, 3]
    assert [natural(texts[i], texts[j]) >= 0 for i, j in zip(down, down[1:], strict=False) if i in full and j in full].count(False) == 0
    numbers = spark.createDataFrame([(1, 5), (2, None), (3, 40)], "id int, t int")
    assert [r.id for r in listing.sort_empties_last(numbers, "t", True, "id", text=False).collect()] == [3, 1, 2]
