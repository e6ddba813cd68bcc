"""Keyed writes over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import writes
from lectern.plans.registry import REGISTRY, query
from lectern.sources import buckets
from lectern.sources.tables import Tables
from lectern.streaming.logs import scratch

NOW = "2002-01-01 00:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


@query(
    "upsert_departments",
    """
    with fresh as (
      select c_nationkey as college_id, c_name as code, 'Renamed ' || c_mktsegment as name from customer where c_acctbal < 0
      union all select s_nationkey, s_name, 'New' from supplier)
    select coalesce(f.college_id, c_nationkey) as college_id, coalesce(f.code, c_name) as code,
      coalesce(f.name, c_mktsegment) as name,
      case when f.code is not null then timestamp '2002-01-01' else timestamp '2001-01-01' end as scraped_at, c_custkey as department_id
    from customer full join fresh f on f.college_id = c_nationkey and f.code = c_name
    """,
)
def upsert_departments(t: Tables) -> DataFrame:
    """A re-scrape renames departments with a debt and brings the suppliers in as new ones."""
    customer = t.read("customer")
    stored = customer.select(
        F.col("c_nationkey").alias("college_id"),
        F.col("c_name").alias("code"),
        F.col("c_mktsegment").alias("name"),
        F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")).alias("scraped_at"),
        F.col("c_custkey").alias("department_id"),
    )
    renamed = customer.filter("c_acctbal < 0").select(
        F.col("c_nationkey").alias("college_id"),
        F.col("c_name").alias("code"),
        F.concat(F.lit("Renamed "), "c_mktsegment").alias("name"),
        now().alias("scraped_at"),
    )
    new = t.read("supplier").select(
        F.col("s_nationkey").alias("college_id"),
        F.col("s_name").alias("code"),
        F.lit("New").alias("name"),
        now().alias("scraped_at"),
    )
    return writes.upsert(
        stored, renamed.unionByName(new), ["college_id", "code"], ["name", "scraped_at"]
    )


@query(
    "upsert_courses",
    """
    with fresh as (
      select l_orderkey * 2 as k, max(l_partkey) as number, max(l_shipdate) as seen from lineitem group by 1)
    select coalesce(k, o_orderkey) as course_id, coalesce('PART ' || number, o_orderpriority) as title,
      o_orderstatus as ai_summary, coalesce(seen, o_orderdate) as scraped_at
    from orders full join fresh on k = o_orderkey
    """,
)
def upsert_courses(t: Tables) -> DataFrame:
    """Scraped rows repeat a course; the one with the highest part wins, and summaries stay."""
    stored = t.read("orders").select(
        F.col("o_orderkey").alias("course_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("ai_summary"),
        F.col("o_orderdate").alias("scraped_at"),
    )
    lines = t.read("lineitem").select(
        (F.col("l_orderkey") * 2).alias("course_id"), "l_partkey", F.col("l_shipdate").alias("scraped_at")
    )
    latest = lines.groupBy("course_id").agg(F.max("scraped_at").alias("scraped_at"))
    titled = writes.one_per_key(lines.select("course_id", "l_partkey"), ["course_id"], [F.col("l_partkey")])
    source = titled.join(latest, "course_id").select(
        "course_id", F.concat(F.lit("PART "), "l_partkey").alias("title"), "scraped_at"
    )
    return writes.upsert(stored, source, ["course_id"], ["title", "scraped_at"])


@query(
    "prune_sections",
    """
    with sections as (select distinct l_orderkey, l_linenumber from lineitem),
    used as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R')
    select l_orderkey as course_id, l_linenumber as position
    from sections s left join orders on o_orderkey = l_orderkey and o_orderstatus = 'F'
    where o_orderkey is null or l_linenumber < 3
      or exists (select 1 from used u where u.l_orderkey = s.l_orderkey and u.l_linenumber = s.l_linenumber)
    """,
)
def prune_sections(t: Tables) -> DataFrame:
    """Finished orders shrink to three sections; later ones stay only when a test was taken."""
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("section_id")
    sections = lines.select(
        key, F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("position")
    ).distinct()
    sizes = t.read("orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("course_id"), F.lit(3).alias("size")
    )
    used = lines.filter("l_returnflag = 'R'").select(key)
    kept = writes.prune_trailing(sections, sizes, used, "course_id", "position", "section_id", "size")
    return kept.select("course_id", "position")


@query(
    "replace_textbooks",
    """
    select l_orderkey as course_id, l_partkey as book, 'old' as edition from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')
    union all
    select o_orderkey, o_custkey, 'new' from orders where o_orderstatus = 'O' and o_totalprice > 200000
    """,
)
def replace_textbooks(t: Tables) -> DataFrame:
    """Open orders get a new list, which is empty for the cheap ones."""
    books = t.read("lineitem").select(
        F.col("l_orderkey").alias("course_id"), F.col("l_partkey").alias("book"), F.lit("old").alias("edition")
    )
    parents = t.read("orders").filter("o_orderstatus = 'O'")
    new = parents.filter("o_totalprice > 200000").select(
        F.col("o_orderkey").alias("course_id"), F.col("o_custkey").alias("book"), F.lit("new").alias("edition")
    )
    return writes.replace_children(
        books, parents.select(F.col("o_orderkey").alias("course_id")), new, "course_id"
    )


@query(
    "prune_departments",
    """
    select c_custkey as department_id, c_nationkey as college_id, c_name as code from customer
    where c_acctbal >= 4500 or exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')
    """,
)
def prune_departments(t: Tables) -> DataFrame:
    """The new list names rich customers only; the others go unless an order is pending."""
    customer = t.read("customer").select(
        F.col("c_custkey").alias("department_id"),
        F.col("c_nationkey").alias("college_id"),
        F.col("c_name").alias("code"),
        "c_acctbal",
    )
    held = t.read("orders").filter("o_orderstatus = 'P'").select("o_custkey")
    keys = ["college_id", "code"]
    return writes.prune_childless(
        customer.drop("c_acctbal"),
        customer.filter("c_acctbal >= 4500").select(*keys),
        held,
        keys,
        "department_id",
        "o_custkey",
        ["college_id"],
    )


@query(
    "patch_courses",
    """
    select o_orderkey as course_id, case when n is not null then 'lines: ' || n else o_orderpriority end as title,
      o_orderstatus as status, case when n is not null then timestamp '2002-01-01' else o_orderdate end as updated_at
    from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey
    """,
)
def patch_courses(t: Tables) -> DataFrame:
    stored = t.read("orders").select(
        F.col("o_orderkey").alias("course_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("updated_at"),
    )
    detail = t.read("lineitem").filter("l_returnflag = 'R'").groupBy(
        F.col("l_orderkey").alias("course_id")
    ).agg(F.concat(F.lit("lines: "), F.count(F.lit(1)).cast("string")).alias("title"))
    return writes.patch(stored, detail, ["course_id"], ["title"], ("updated_at", now()))


@query(
    "fill_blanks",
    """
    select d.doc_id, coalesce(case when lang <> 'fr' then lang end, 'q' || quality) as credits,
      case when coalesce(length('longer than the source ' || quality), 0) > length(source) then 'longer than the source ' || quality else source end as description
    from documents d left join labels l on l.doc_id = d.doc_id
    """,
)
def fill_blanks(t: Tables) -> DataFrame:
    base = t.read("documents").select(
        "doc_id",
        F.when(F.col("lang") != "fr", F.col("lang")).alias("credits"),
        F.col("source").alias("description"),
    )
    quality = F.col("quality").cast("string")
    detail = t.read("labels").select(
        "doc_id",
        F.concat(F.lit("q"), quality).alias("credits"),
        F.concat(F.lit("longer than the source "), quality).alias("description"),
    )
    return writes.fill_blanks(base, detail, ["doc_id"], ["credits"], ["description"])


@query(
    "backfill_checked",
    """
    select c_custkey as department_id, coalesce(case when c_acctbal >= 0 then timestamp '2001-06-01' end,
      (select max(o_orderdate) from orders where o_custkey = c_custkey)) as courses_scraped_at
    from customer
    """,
)
def backfill_checked(t: Tables) -> DataFrame:
    return writes.backfill_from_children(
        t.departments().select("department_id", "courses_scraped_at"),
        t.courses().select(F.col("department_id").alias("parent"), "scraped_at"),
        "department_id",
        "parent",
        "courses_scraped_at",
        "scraped_at",
    )


@query(
    "cascade_delete",
    """
    with n as (select n_nationkey as k from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA'),
    c as (select c_custkey as k from customer where c_nationkey in (select k from n)),
    o as (select o_orderkey as k from orders where o_custkey in (select k from c))
    select 'colleges' as name, count(*) as kept, cast(sum(n_nationkey) as bigint) as keys, count(*) as linked from nation where n_nationkey not in (select k from n)
    union all select 'departments', count(*), cast(sum(c_custkey) as bigint), count(*) from customer where c_custkey not in (select k from c)
    union all select 'courses', count(*), cast(sum(o_orderkey) as bigint), count(*) from orders where o_orderkey not in (select k from o)
    union all select 'sections', count(*), cast(sum(l_orderkey) as bigint), count(*) from lineitem where l_orderkey not in (select k from o)
    union all select 'usage', count(*), cast(sum(event_id) as bigint), count(*) filter (where event_id not in (select k from c)) from events
    """,
)
def cascade_delete(t: Tables) -> DataFrame:
    """Dropping a region's colleges takes their subtree along and unlinks the ledger."""
    tables = subtree(t)
    doomed = tables["colleges"].filter("region_name = 'ASIA'")
    return remainder(writes.cascade_delete(tables, "colleges", doomed, SUBTREE_LINKS, "college_id"))


SUBTREE_LINKS = [
    ("departments", "college_id", "colleges", "college_id", "cascade"),
    ("courses", "department_id", "departments", "department_id", "cascade"),
    ("sections", "course_id", "courses", "course_id", "cascade"),
    ("usage", "department_id", "departments", "department_id", "null"),
]
SUBTREE_KEYS = {
    "colleges": ["college_id"],
    "departments": ["department_id"],
    "courses": ["course_id"],
    "sections": ["course_id", "l_linenumber"],
    "usage": ["event_id"],
}


def subtree(t: Tables) -> dict[str, DataFrame]:
    return {
        "colleges": t.colleges().select("college_id", "region_name"),
        "departments": t.departments().select("department_id", "college_id"),
        "courses": t.courses().select("course_id", "department_id"),
        "sections": t.read("lineitem").select(F.col("l_orderkey").alias("course_id"), "l_linenumber"),
        "usage": t.read("events").select("event_id", F.col("event_id").alias("department_id")),
    }


def remainder(left: dict[str, DataFrame]) -> DataFrame:
    """What is left of each table of the subtree, as one row."""
    out = None
    for name, (key, *_) in SUBTREE_KEYS.items():
        link = "department_id" if name == "usage" else key
        row = left[name].agg(
            F.count(F.lit(1)).alias("kept"),
            F.sum(key).cast("bigint").alias("keys"),
            F.count(link).alias("linked"),
        ).select(F.lit(name).alias("name"), "kept", "keys", "linked")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "toggle_favorites",
    """
    with starred as (select distinct user_id, cast(json_extract(props, '$.k') as bigint) as course_id from events where event_type = 'purchase'),
    pressed as (select user_id, cast(json_extract(props, '$.k') as bigint) as course_id, count(*) as n from events where event_type in ('click', 'view') group by 1, 2)
    select coalesce(s.user_id, p.user_id) as user_id, coalesce(s.course_id, p.course_id) as course_id
    from starred s full join pressed p on p.user_id = s.user_id and p.course_id = s.course_id
    where (case when s.user_id is null then 0 else 1 end + coalesce(n, 0)) % 2 = 1
    """,
)
def toggle_favorites(t: Tables) -> DataFrame:
    target = F.get_json_object("props", "$.k").cast("bigint").alias("course_id")
    events = t.read("events")
    starred = events.filter("event_type = 'purchase'").select("user_id", target)
    presses = events.filter("event_type in ('click', 'view')").select("user_id", target)
    return writes.toggle(starred, presses, ["user_id", "course_id"])


@query("stored_cascade", REGISTRY["cascade_delete"].sql)
def stored_cascade(t: Tables) -> DataFrame:
    """The same removal from stored tables, of which only the buckets that lose rows are written."""
    folder = scratch(t.spark, "subtree")
    stored = {
        name: buckets.BucketTable.store(df, f"{folder}/{name}", SUBTREE_KEYS[name], 16) for name, df in subtree(t).items()
    }
    doomed = stored["colleges"].read().filter("region_name = 'ASIA'")
    buckets.cascade_delete(stored, "colleges", doomed, SUBTREE_LINKS)
    return remainder({name: table.read() for name, table in stored.items()})


@query("stored_toggle", REGISTRY["toggle_favorites"].sql)
def stored_toggle(t: Tables) -> DataFrame:
    """Stars kept as a stored table, one batch of presses after another (views, then clicks)."""
    target = F.get_json_object("props", "$.k").cast("bigint").alias("course_id")
    events = t.read("events")
    starred = events.filter("event_type = 'purchase'").select("user_id", target).distinct()
    keys = ["user_id", "course_id"]
    table = buckets.BucketTable.store(starred, scratch(t.spark, "stars"), keys, 16)
    for kind in ("view", "click"):
        table.toggle(events.filter(F.col("event_type") == kind).select("user_id", target))
    return table.read()


@query(
    "stored_courses",
    """
    with newest as (select max(o_orderdate) as day from orders),
    top as (select o_custkey as k, count(*) as n from orders group by 1 order by n desc, k limit 1)
    select o_orderkey as course_id, case when o_orderdate = day then 'Renamed ' || o_orderstatus else o_orderpriority end as title,
      case when o_orderdate = day then timestamp '2002-01-01' else o_orderdate end as scraped_at
    from orders, newest where o_custkey <> (select k from top)
    union all select -c_custkey, c_name, timestamp '2002-01-01' from customer where c_acctbal < -990
    """,
)
def stored_courses(t: Tables) -> DataFrame:
    """Courses stored by key: the last day's are scraped again, some are new, and the busiest department's go."""
    orders = t.read("orders")
    rows = orders.select(
        F.col("o_orderkey").alias("course_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("scraped_at")
    )
    table = buckets.BucketTable.store(rows, scratch(t.spark, "courses"), ["course_id"], 64)
    newest = orders.agg(F.max("o_orderdate")).scalar()
    again = orders.filter(F.col("o_orderdate") == newest).select(
        F.col("o_orderkey").alias("course_id"), F.concat(F.lit("Renamed "), "o_orderstatus").alias("title"), now().alias("scraped_at")
    )
    new = t.read("customer").filter("c_acctbal < -990").select(
        (-F.col("c_custkey")).alias("course_id"), F.col("c_name").alias("title"), now().alias("scraped_at")
    )
    table.upsert(again.unionByName(new), ["title", "scraped_at"])
    busiest = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)
    table.delete(orders.join(busiest, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("course_id")))
    return table.read()
