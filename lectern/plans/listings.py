"""Course listing, context, favourite and outline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import context, listing, paging, sqltables, stats
from lectern.plans.registry import query
from lectern.sources.tables import Tables
from lectern.streaming.logs import scratch


def listed_courses(t: Tables) -> DataFrame:
    """Orders as courses, numbered by priority and total so that levels spread."""
    return (
        t.read("orders")
        .select(
            F.col("o_orderkey").alias("course_id"),
            F.col("o_custkey").alias("department_id"),
            F.concat(
                F.lit("CS "), F.floor(F.col("o_totalprice") / 50).cast("string")
            ).alias("course_number"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderstatus").alias("credits"),
            F.when(F.col("o_orderstatus") == "F", "done").alias("summary"),
        )
        .join(
            t.departments().select("department_id", "college_id", "code", "department_name"),
            "department_id",
        )
        .withColumnRenamed("code", "department_code")
        .join(t.colleges().select("college_id", "college_name"), "college_id")
        .withColumn(
            "college_short_name", F.when(F.col("college_id") % 2 == 0, F.concat(F.lit("N"), "college_id"))
        )
    )


def course_figures(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    sections = lines.select(F.col("l_orderkey").alias("course_id"))
    # Line items shipped hold a test set; those returned hold an attempt too.
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    sets = lines.filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("course_id"),
        key.alias("test_set_id"),
        F.when(F.col("l_returnflag") == "N", "failed").otherwise("complete").alias("status"),
    )
    attempts = lines.filter("l_linestatus = 'F'").select(
        key.alias("test_set_id"), (F.col("l_returnflag") == "R").alias("submitted")
    )
    return sections, sets.dropDuplicates(["test_set_id"]), attempts


LISTING_SQL = """
    with lines as (select * from lineitem),
    sec as (select l_orderkey, count(*) as n from lines group by 1),
    keyed as (
      select l_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_linestatus || '-' || l_returnflag as id,
        l_returnflag from lines where l_linestatus = 'F'),
    sets as (select distinct l_orderkey, id, case when l_returnflag = 'N' then 'failed' else 'complete' end as status from keyed),
    taken as (select id, count(*) as taken from keyed where l_returnflag = 'R' group by 1),
    tests as (
      select l_orderkey, count(*) as total, count(*) filter (where status = 'complete') as complete,
        cast(coalesce(sum(taken), 0) as bigint) as taken
      from sets left join taken using (id) group by 1),
    cost as (select user_id, cast(sum(cast(value as decimal(12,6))) as double) as cost from events group by 1),
    base as (
      select o_orderkey as course_id, 'CS ' || cast(floor(o_totalprice / 50) as bigint) as course_number, o_orderpriority as title,
        o_orderstatus as credits, c_name as department_code, c_mktsegment as department_name,
        n_nationkey as college_id, n_name, case when n_nationkey % 2 = 0 then 'N' || n_nationkey end as short_name,
        floor(o_totalprice / 50) as num
      from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
    full_rows as (
      select course_id, course_number, title, credits,
        case when num < 50 then 'Introductory' when num < 100 then 'Undergraduate'
          when num < 1000 then case when floor(num / 100) <= 1 then 'Introductory' when floor(num / 100) <= 4 then 'Undergraduate' else 'Graduate' end
          else case when floor(num / 1000) <= 1 then 'Introductory' when floor(num / 1000) <= 4 then 'Undergraduate' else 'Graduate' end end as level,
        department_code, department_name, college_id, coalesce(short_name, n_name) as college_name,
        coalesce(sec.n, 0) as section_count, coalesce(tests.total, 0) as test_set_count,
        coalesce(tests.complete, 0) as complete_test_sets, coalesce(tests.taken, 0) as attempts_taken,
        coalesce(cost.cost, 0) as cost, credits = 'F' as has_summary
      from base left join sec on sec.l_orderkey = course_id left join tests on tests.l_orderkey = course_id
      left join cost on cost.user_id = course_id
      where {where})
"""
SEARCHED = (
    "contains(lower(course_number), '{q}') or contains(lower(title), '{q}') or contains(lower(department_code), '{q}')"
    " or contains(lower(department_name), '{q}') or contains(lower(n_name), '{q}') or contains(lower(coalesce(short_name, '')), '{q}')"
)


def listing_rows(t: Tables, text: str | None, tested: str) -> DataFrame:
    counts = stats.course_counts(*course_figures(t))
    spend = (
        t.ledger()
        .groupBy(F.col("college_id").alias("course_id"))
        .agg(F.sum("cost").cast("double").alias("cost"))
    )
    return listing.course_rows(listed_courses(t), counts, spend, text, tested)


@query("course_listing", LISTING_SQL.format(where="true") + " select * from full_rows")
def course_listing(t: Tables) -> DataFrame:
    return listing_rows(t, None, "all")


@query(
    "course_listing_page",
    LISTING_SQL.format(where=SEARCHED.format(q="machin"))
    + """, matching as (select * from full_rows where test_set_count > 0)
    select *, (select count(*) from matching) as total_count from matching
    order by complete_test_sets desc nulls last, test_set_count desc nulls last, lower(course_number), course_id
    limit 100 offset 50
    """,
)
def course_listing_page(t: Tables) -> DataFrame:
    rows = listing_rows(t, "MACHIN", "tested")
    return listing.page(rows, "tests", descending=True, limit=100, offset=50)


@query(
    "course_listing_levels",
    LISTING_SQL.format(where="true")
    + """, matching as (select * from full_rows where test_set_count = 0)
    select *, (select count(*) from matching) as total_count from matching
    order by case level when 'Introductory' then 1 when 'Undergraduate' then 2 when 'Graduate' then 3 else 4 end,
      lower(course_number), course_id limit 500
    """,
)
def course_listing_levels(t: Tables) -> DataFrame:
    return listing.page(listing_rows(t, "", "untested"), "level")


@query(
    "list_colleges",
    """
    select n_nationkey as college_id, n_name as college_name, r_name as region_name,
      case when n_nationkey % 7 <> 0 then n_nationkey end as rank
    from nation join region on r_regionkey = n_regionkey order by rank asc nulls last
    """,
)
def list_colleges(t: Tables) -> DataFrame:
    """Colleges by rank, unranked ones last."""
    ranked = t.colleges().withColumn("rank", F.when(F.col("college_id") % 7 != 0, F.col("rank")))
    return ranked.orderBy(F.asc_nulls_last("rank"))


@query(
    "list_departments",
    "select c_custkey as department_id, c_nationkey as college_id, c_name as code from customer where c_nationkey = 3 order by c_name",
)
def list_departments(t: Tables) -> DataFrame:
    picked = t.departments().filter(listing.optional(F.col("college_id"), 3))
    return picked.select("department_id", "college_id", "code").orderBy("code")


@query(
    "course_context",
    """
    select o_orderkey as course_id, o_orderpriority as title, c_name as code, n_name as college_name
    from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
    """,
)
def course_context(t: Tables) -> DataFrame:
    joined = context.course_context(
        t.courses().drop("scraped_at"),
        t.departments().select("department_id", "college_id", "code"),
        t.colleges().select("college_id", "college_name"),
    )
    return joined.select("course_id", "title", "code", "college_name")


def section_rows(t: Tables) -> DataFrame:
    """Line items as sections; a position may repeat, so the supplier is part of the key."""
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("course_id"),
        F.col("l_linenumber").alias("position"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("section_id"),
    ).distinct()


def set_rows(t: Tables) -> DataFrame:
    return t.read("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("section_id"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"
        ).alias("test_set_id"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "F", "complete").otherwise("generating").alias("status"),
        F.col("l_quantity").cast("bigint").alias("question_count"),
    )


@query(
    "set_scope",
    """
    select l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey || '-' || l_quantity as test_set_id,
      o_orderkey as course_id, c_nationkey as college_id
    from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    """,
)
def set_scope(t: Tables) -> DataFrame:
    return context.set_scope(
        set_rows(t), section_rows(t), t.courses(), t.departments()
    )


@query(
    "favorites",
    """
    with stars as (
      select user_id, ts as created_at, case when event_type = 'view' then user_id % 25 end as college_id,
        case when event_type = 'click' then event_id end as course_id
      from events where event_type in ('view', 'click'))
    select user_id, created_at, 'college' as kind, cast(college_id as varchar) as target_id, n_name as label,
      n_name as college_name, null::bigint as section_count
    from stars join nation on n_nationkey = college_id where college_id is not null
    union all
    select user_id, created_at, 'course', cast(course_id as varchar), o_orderpriority, n_name,
      (select count(*) from (select distinct l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem) where l_orderkey = course_id)
    from stars join orders on o_orderkey = course_id join customer on c_custkey = o_custkey
      join nation on n_nationkey = c_nationkey where course_id is not null and college_id is null
    """,
)
def favorites(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    stars = t.read("events").filter(kind.isin("view", "click")).select(
        "user_id",
        F.col("ts").alias("created_at"),
        F.when(kind == "view", F.col("user_id") % 25).alias("college_id"),
        F.when(kind == "click", F.col("event_id")).alias("course_id"),
    )
    return context.favorites(stars, t.colleges(), t.courses(), t.departments(), section_rows(t))


@query(
    "sets_by_section",
    """
    select l_orderkey as course_id, l_linenumber as position,
      l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey as section_id,
      l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey || '-' || l_quantity as test_set_id,
      l_shipdate as created_at,
      exists (select 1 from lineitem r where r.l_linestatus = 'F' and r.l_orderkey = l.l_orderkey
        and r.l_linenumber = l.l_linenumber and r.l_suppkey = l.l_suppkey and r.l_partkey = l.l_partkey) as ready
    from lineitem l
    """,
)
def sets_by_section(t: Tables) -> DataFrame:
    sections, sets = section_rows(t), set_rows(t)
    ready = context.sections_ready(sections, sets).select("section_id", F.lit(True).alias("ready"))
    return (
        context.sets_by_section(sections, sets)
        .join(ready, "section_id", "left")
        .withColumn("ready", F.coalesce("ready", F.lit(False)))
    )


@query(
    "orphan_sets",
    """
    select l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey || '-' || l_quantity as test_set_id
    from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')
    """,
)
def orphan_sets(t: Tables) -> DataFrame:
    """Sets left behind by courses that are still pending."""
    settled = t.read("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("course_id"))
    held = section_rows(t).join(settled, "course_id", "left_semi")
    return context.orphan_sets(set_rows(t), held).select("test_set_id")


@query(
    "sets_to_avoid",
    """
    with sets as (
      select event_id, user_id, ts from events where value > 50),
    pairs as (
      select a.event_id as for_set, a.user_id as section_id, b.event_id as test_set_id,
        row_number() over (partition by a.event_id order by b.ts desc, b.event_id desc) as place
      from events a join sets b on b.user_id = a.user_id and b.event_id <> a.event_id)
    select * from pairs where place <= 2
    """,
)
def sets_to_avoid(t: Tables) -> DataFrame:
    sets = t.read("events").select(
        F.col("user_id").alias("section_id"),
        F.col("event_id").alias("test_set_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("value") > 50, 25).otherwise(0).alias("question_count"),
    )
    return context.sets_to_avoid(sets.select("section_id", "test_set_id"), sets)


@query(
    "stems_to_avoid",
    """
    with avoid as (select distinct source, lang from documents where lang <> 'en')
    select a.source as for_set, d.lang as test_set_id, d.doc_id as position, d.text as question
    from avoid a join documents d on d.lang = a.lang
    """,
)
def stems_to_avoid(t: Tables) -> DataFrame:
    docs = t.read("documents")
    avoid = docs.filter("lang <> 'en'").select(
        F.col("source").alias("for_set"), F.col("lang").alias("test_set_id")
    ).distinct()
    questions = docs.select(
        F.col("lang").alias("test_set_id"),
        F.col("doc_id").alias("position"),
        F.col("text").alias("question"),
    )
    return context.stems_to_avoid(avoid, questions)


@query(
    "primary_textbook",
    """
    select course_id, textbook_id, required from (
      select l_orderkey as course_id, l_partkey * 10 + l_linenumber as textbook_id, l_returnflag = 'R' as required,
        row_number() over (partition by l_orderkey order by (l_returnflag = 'R') desc, l_partkey * 10 + l_linenumber) as rn
      from lineitem) where rn = 1
    """,
)
def primary_textbook(t: Tables) -> DataFrame:
    books = t.read("lineitem").select(
        F.col("l_orderkey").alias("course_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("textbook_id"),
        (F.col("l_returnflag") == "R").alias("required"),
    )
    return context.primary_textbook(books)


@query(
    "merge_outline",
    """
    with o as (
      select l_orderkey as course_id, l_linenumber as position, min(l_partkey) as a, max(l_partkey) as b from lineitem group by 1, 2)
    select course_id, position,
      case when a < b then a || ',shared,' || b else a || ',shared' end as topics
    from o
    """,
)
def merge_outline(t: Tables) -> DataFrame:
    """Outline sections joined with the syllabus unit in the same place, where there is one."""
    places = t.read("lineitem").groupBy(
        F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("position")
    ).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    text = lambda c: F.col(c).cast("string")
    outline = places.select("course_id", "position", F.array(text("a"), F.lit("shared")).alias("topics"))
    syllabus = places.filter("a < b").select(
        "course_id", "position", F.array(F.lit("shared"), text("b")).alias("topics")
    )
    merged = context.merge_outline(outline, syllabus)
    return merged.withColumn("topics", F.array_join("topics", ","))


@query(
    "search_users",
    """
    select user_id, count(*) as hits from events
    where contains('user' || user_id || '@school.edu', '7@') or starts_with(cast(user_id as varchar), '7')
    group by 1 having count(*) > 0
    """,
)
def search_users(t: Tables) -> DataFrame:
    """Users whose address holds the text or whose id starts with it."""
    address = F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@School.edu"))
    hit = F.contains(F.lower(address), F.lit("7@")) | F.startswith(F.col("user_id").cast("string"), F.lit("7"))
    return t.read("events").filter(hit).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "sql_listing",
    LISTING_SQL.format(where=SEARCHED.format(q="machin"))
    + """, matching as (select * from full_rows where test_set_count > 0)
    select *, (select count(*) from matching) as total_count, row_number() over (
        order by complete_test_sets desc nulls last, test_set_count desc nulls last, lower(course_number), course_id)::integer as place
    from matching order by place limit 100 offset 50
    """,
)
def sql_listing(t: Tables) -> DataFrame:
    """The same page from SQL."""
    counts = stats.course_counts(*course_figures(t))
    spend = t.ledger().groupBy(F.col("college_id").alias("course_id")).agg(F.sum("cost").cast("double").alias("cost"))
    sqltables.register_listing(t.spark, listed_courses(t), counts, spend)
    return t.spark.sql(
        "SELECT * FROM admin_course_list(p_query => 'MACHIN', p_tested => 'tested', p_sort => 'tests', p_desc => true, p_limit => 100, p_offset => 50)"
    )


def table_rows(t: Tables) -> DataFrame:
    """Customers with a label that mixes case and numbers and is sometimes blank."""
    segment = F.when(F.col("c_nationkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    label = F.concat_ws(" ", segment, F.col("c_nationkey") * 7)
    blank = F.when(F.col("c_acctbal") > 0, F.lit("")).otherwise(F.lit(None))
    return t.read("customer").select(
        F.col("c_custkey").alias("department_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", blank).otherwise(label).alias("label"),
        F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("coverage"),
    )


_TABLE_SQL = """
    with d as (
      select c_custkey as department_id, lower(c_mktsegment) as s, c_nationkey * 7 as n, c_mktsegment = 'MACHINERY' as blank,
        case when c_mktsegment <> 'MACHINERY' then (case when c_nationkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end) || ' ' || c_nationkey * 7
          when c_acctbal > 0 then '' end as label,
        case when c_acctbal > 1000 then c_acctbal end as coverage
      from customer)
"""


@query(
    "table_sorted",
    _TABLE_SQL
    + """
    select department_id, label, row_number() over (order by blank, case when not blank then s end, case when not blank then n end, department_id) as up,
      row_number() over (order by blank, case when not blank then s end desc, case when not blank then n end desc, department_id) as down,
      row_number() over (order by coverage nulls last, department_id) as coverage_up,
      row_number() over (order by coverage desc nulls last, department_id) as coverage_down
    from d
    """,
)
def table_sorted(t: Tables) -> DataFrame:
    """Places in the table sorted by label and by figure, both ways; blanks are last each time."""
    rows, out = table_rows(t), None
    for name, column, descending, text in (
        ("up", "label", False, True), ("down", "label", True, True), ("coverage_up", "coverage", False, False), ("coverage_down", "coverage", True, False),
    ):
        order = [listing.empties_last(column, descending, text), F.asc("department_id")]
        pages = paging.Pages.build(rows, order, scratch(t.spark, "table"))
        placed = pages.numbered().select("department_id", *([] if out else ["label"]), F.col("place").alias(name))
        out = placed if out is None else out.join(placed, "department_id")
    return out


@query(
    "course_listing_deep_page",
    LISTING_SQL.format(where="true")
    + """
    , placed as (
      select *, (select count(*) from full_rows) as total_count,
        row_number() over (order by cost desc nulls last, lower(course_number), course_id) as place from full_rows)
    select * from placed where place > total_count // 2 and place <= total_count // 2 + 500
    """,
)
def course_listing_deep_page(t: Tables) -> DataFrame:
    """A page from the middle of the listing, read from the ranges that hold it."""
    order = [c.desc_nulls_last() for c in listing.sort_columns("cost")] + [F.lower("course_number").asc(), F.col("course_id").asc()]
    pages = paging.Pages.build(listing_rows(t, None, "all"), order, scratch(t.spark, "listing"), 2_000)
    return pages.page(500, pages.total // 2)
