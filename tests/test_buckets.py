"""Tables changed in place: only touched buckets, whole versions, writers that die or meet."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import writes
from lectern.sources import buckets
from lectern.sources.buckets import BucketTable, Conflict


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "int(id % 7) as kind", "concat('name ', id) as name")
    return BucketTable.store(df, str(tmp_path / "t"), ["id"], 40)


def changed(table, before):
    now = table.manifest()[1]["writes"]
    return {k for k in set(now) | set(before) if now.get(k) != before.get(k)}


def test_an_upsert_rewrites_only_its_buckets(spark, table):
    before = table.manifest()[1]["writes"]
    stored = table.read()
    source = spark.createDataFrame([(5, 1, "five"), (9999, 2, "new")], "id long, kind int, name string")
    want = rows(writes.upsert(stored, source, ["id"], ["name"]))
    table.upsert(source, ["name"])
    assert rows(table.read()) == want and len(want) == 2001
    assert len(changed(table, before)) <= 2
    assert rows(table.read(table.versions()[0])) == rows(spark.range(2000).selectExpr("id", "int(id % 7) as kind", "concat('name ', id) as name"))


def test_patch_fill_delete_and_toggle(spark, table):
    source = spark.createDataFrame([(1, None, "x"), (77_777, 3, "unknown")], "id long, kind int, name string")
    table.patch(source, ["name"])
    table.patch(source, ["kind"])
    assert rows(table.read().where("id IN (1, 77777)")) == [(1, None, "x")]
    table.fill_blanks(spark.createDataFrame([(1, 6, "longer"), (2, 9, "s")], "id long, kind int, name string"), ["kind"], ["name"])
    assert rows(table.read().where("id IN (1, 2)")) == [(1, 6, "longer"), (2, 2, "name 2")]
    table.delete(spark.range(1, 1990).toDF("id"))
    assert table.read().count() == 11
    assert len(table.versions()) == buckets.KEPT


def test_replaced_children_and_toggled_keys(spark, tmp_path):
    books = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "course long, book string")
    table = BucketTable.store(books, str(tmp_path / "b"), ["course"], 8)
    table.replace_children(spark.createDataFrame([(1,), (3,)], "course long"), spark.createDataFrame([(1, "z"), (4, "y")], "course long, book string"))
    assert rows(table.read()) == [(1, "z"), (2, "c"), (4, "y")]
    stars = BucketTable.store(spark.createDataFrame([(1, 1), (2, 2)], "u long, c long"), str(tmp_path / "s"), ["u", "c"], 8)
    stars.toggle(spark.createDataFrame([(1, 1), (3, 3), (2, 2), (2, 2), (4, 4), (4, 4)], "u long, c long"))
    assert rows(stars.read()) == [(2, 2), (3, 3)]


def test_a_writer_that_dies_leaves_the_old_version(spark, table):
    before = rows(table.read())
    source = spark.range(500).selectExpr("id", "1 as kind", "'broken' as name")
    broken = lambda old, new: new.withColumn("name", F.when(F.col("id") == 321, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="killed"):
        table.change(source, broken)
    assert rows(table.read()) == before and table.versions() == [0, 1]
    source.write.parquet(f"{table.path}/data/dead/bucket=0")  # a writer killed before its manifest
    assert rows(table.read()) == before and table.sweep() == []
    assert table.sweep(older_than_hours=0) == ["dead"]
    assert rows(table.read()) == before
    table.upsert(source, ["name"])
    assert table.read().where("name = 'broken'").count() == 500


def test_two_writers(spark, table):
    one = spark.createDataFrame([(3, 0, "one")], "id long, kind int, name string")
    bucket = {r[0]: r[1] for r in spark.range(2000).select("id", F.pmod(F.xxhash64("id"), F.lit(40))).collect()}
    other_id = next(i for i in bucket if bucket[i] != bucket[3])
    other = one.withColumn("id", F.lit(other_id)).withColumn("name", F.lit("other"))
    late = BucketTable(spark, table.path)
    calls = []

    def slow(old, new):
        if not calls:
            calls.append(1)
            late.upsert(other, ["name"])
        return writes.upsert(old, new, ["id"], ["name"])

    table.change(one, slow)  # the other writer left this bucket alone
    assert rows(table.read().where("name IN ('one', 'other')").select("name")) == [("one",), ("other",)] and len(calls) == 1

    def clash(old, new):
        calls.append(2)
        late.upsert(one.withColumn("name", F.lit("late")), ["name"])
        return writes.upsert(old, new, ["id"], ["kind"])

    with pytest.raises(Conflict):
        table.change(one, clash, attempts=2)
    assert calls.count(2) == 2 and rows(table.read().where("id = 3").select("name")) == [("late",)]


def test_a_tagged_change_counts_once_and_tables_grow(spark, table):
    keys = spark.createDataFrame([(3,)], "id long")
    same = lambda old, new: old.withColumn("kind", F.when(F.col("id") == 3, F.col("kind") + 1).otherwise(F.col("kind")))
    table.change(keys, same, ("s", 0))
    table.change(keys, same, ("s", 0))
    table.change(keys, same, ("s", 1))
    assert rows(table.read().where("id = 3").select("kind")) == [(5,)]
    before = rows(table.read())
    table.grow(90)
    assert rows(table.read()) == before and len(table.manifest()[1]["writes"]) == 90
    table.upsert(spark.createDataFrame([(3, 0, "after")], "id long, kind int, name string"), ["name"])
    assert rows(table.read().where("name = 'after'").select("id")) == [(3,)]


def test_empty_tables_and_sources(spark, tmp_path):
    schema = "id long, name string"
    empty = spark.createDataFrame([], schema)
    table = BucketTable.store(empty, str(tmp_path / "e"), ["id"], 4)
    assert table.read().collect() == []
    table.upsert(empty, ["name"])
    table.upsert(spark.createDataFrame([(None, "null key"), (1, None)], schema), ["name"])
    assert rows(table.read()) == [(1, None), (None, "null key")]


def test_cascade(spark, tmp_path):
    def make(name, data, schema, keys):
        return BucketTable.store(spark.createDataFrame(data, schema), str(tmp_path / name), keys, 6)

    tables = {
        "college": make("college", [(1,), (2,), (3,)], "college_id long", ["college_id"]),
        "course": make("course", [(i, i % 3 + 1) for i in range(30)], "course_id long, college_id long", ["course_id"]),
        "set": make("set", [(i, i % 30) for i in range(90)], "set_id long, course_id long", ["set_id"]),
        "usage": make("usage", [(i, i % 90) for i in range(200)], "usage_id long, set_id long", ["usage_id"]),
    }
    links = [("course", "college_id", "college", "college_id", "cascade"), ("set", "course_id", "course", "course_id", "cascade"), ("usage", "set_id", "set", "set_id", "null")]
    want = writes.cascade_delete({n: t.read() for n, t in tables.items()}, "college", spark.createDataFrame([(2,)], "college_id long"), links, "college_id")
    want = {n: rows(df.select(*tables[n].schema().names)) for n, df in want.items()}
    buckets.cascade_delete(tables, "college", spark.createDataFrame([(2,)], "college_id long"), links)
    assert {n: rows(t.read()) for n, t in tables.items()} == want
    assert len(want["course"]) == 20 and sum(r[1] is None for r in want["usage"]) > 0
