"""Coverage, run and cost queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.display import (
    age_text,
    dollars,
    grouped_count,
    location,
    rank_text,
    region,
    retrieval_text,
    token_count,
)
from lectern.operators import costs, listing, planning, stats
from lectern.plans.registry import query
from lectern.sources.tables import AS_OF, Tables

KINDS = {"view": "catalog_check", "click": "retrieval", "purchase": "profile", "signup": "test_generation"}

# Dollars per million tokens, by operation here.
RATES = {"view": ("3", "15"), "click": ("1", "5"), "purchase": ("0.02", "0")}


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def college_stats_of(t: Tables) -> DataFrame:
    return stats.college_stats(
        t.colleges(), t.departments(), t.courses(), t.sections(), t.course_attempts()
    )


COLLEGE_STATS_SQL = """
    select n.n_nationkey as college_id,
      coalesce(d.department_count, 0) as department_count,
      coalesce(c.course_count, 0) as course_count,
      coalesce(a.attempts_taken, 0) as attempts_taken,
      coalesce(s.test_set_count, 0) as test_set_count,
      c.last_scraped_at,
      coalesce(d.departments_with_courses, 0) as departments_with_courses,
      coalesce(d.departments_sourced, 0) as departments_sourced
    from nation n
    left join (
      select c_nationkey as k, count(*) as department_count,
        count(*) filter (where exists (select 1 from orders where o_custkey = c_custkey)) as departments_with_courses,
        count(*) filter (where c_acctbal >= 0) as departments_sourced
      from customer group by 1) d on d.k = n.n_nationkey
    left join (
      select c_nationkey as k, count(*) as course_count, max(o_orderdate) as last_scraped_at
      from orders join customer on c_custkey = o_custkey group by 1) c on c.k = n.n_nationkey
    left join (
      select c_nationkey as k, count(*) as test_set_count
      from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
      group by 1) s on s.k = n.n_nationkey
    left join (
      select c_nationkey as k, count(*) as attempts_taken
      from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
      where l_returnflag = 'R' group by 1) a on a.k = n.n_nationkey
"""


@query("college_stats", COLLEGE_STATS_SQL)
def college_stats(t: Tables) -> DataFrame:
    return college_stats_of(t)


def department_stats_of(t: Tables) -> DataFrame:
    return stats.department_stats(t.departments(), t.courses())


DEPARTMENT_STATS_SQL = """
    select c_custkey as department_id, count(o_orderkey) as course_count,
      max(o_orderdate) as last_scraped_at, c_nationkey as college_id,
      case when c_acctbal >= 0 then timestamp '2001-06-01 00:00:00' end as courses_scraped_at
    from customer left join orders on o_custkey = c_custkey
    group by c_custkey, c_nationkey, c_acctbal
"""


@query("department_stats", DEPARTMENT_STATS_SQL)
def department_stats(t: Tables) -> DataFrame:
    return department_stats_of(t)


def _latest_sql() -> str:
    columns = []
    for kind, prefix in KINDS.items():
        for source, name in (("ts", "at"), ("value", "cost"), ("k", "tokens"), ("ok", "ok")):
            agg = "bool_or" if name == "ok" else "max"
            columns.append(f"{agg}({source}) filter (where rn = 1 and event_type = '{kind}') as {prefix}_{name}")
    return f"""
        select user_id as college_id, {', '.join(columns)}
        from (select *, cast(json_extract(props, '$.k') as bigint) as k, event_type <> 'error' as ok,
                row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn
              from events)
        group by 1
    """


@query("latest_runs_pivot", _latest_sql())
def latest_runs_pivot(t: Tables) -> DataFrame:
    return stats.latest_runs(t.runs(), KINDS)


@query(
    "cost_rollups",
    """
    select user_id as college_id, count(*) as call_count,
      cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total_tokens,
      cast(sum(cast(value as decimal(12,6))) as double) as cost
    from events where user_id is not null group by 1
    """,
)
def cost_rollups(t: Tables) -> DataFrame:
    rolled = costs.rollup_by(t.ledger(), "college_id", ["total_tokens", "cost"])
    return rolled.withColumn("cost", F.col("cost").cast("double"))


@query(
    "cost_total",
    """
    select count(*) as call_count,
      cast(coalesce(sum(cast(json_extract(props, '$.k') as bigint)), 0) as bigint) as total_tokens,
      cast(coalesce(sum(cast(value as decimal(12,6))), 0) as double) as cost
    from events
    """,
)
def cost_total(t: Tables) -> DataFrame:
    return costs.ledger_total(t.ledger()).withColumn("cost", F.col("cost").cast("double"))


@query(
    "run_cost_window",
    """
    select r.event_id as run_id,
      cast(coalesce(sum(cast(l.value as decimal(12,6))), 0) as double) as run_cost,
      cast(coalesce(sum(cast(json_extract(l.props, '$.k') as bigint)), 0) as bigint) as run_tokens
    from events r left join events l
      on l.user_id = r.user_id and l.ts >= r.ts and l.ts <= r.ts + interval 24 hours
    where r.event_type = 'signup' group by 1
    """,
)
def run_cost_window(t: Tables) -> DataFrame:
    """Every signup opens a run of 24 hours at its college."""
    none = F.lit(None).cast("bigint")
    runs = t.read("events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("run_id"),
        none.alias("test_set_id"),
        none.alias("course_id"),
        F.col("user_id").alias("college_id"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("interval 24 hours")).alias("finished_at"),
    )
    ledger = t.ledger().withColumns({"test_set_id": none, "course_id": none})
    return costs.run_costs(runs, ledger).select(
        "run_id",
        F.col("run_cost").cast("double").alias("run_cost"),
        F.col("run_tokens").cast("bigint").alias("run_tokens"),
    )


@query(
    "rate_card",
    """
    select event_id as usage_id, k as input_tokens, 2 * k as output_tokens, 3 * k as total_tokens,
      cast(ri as double) as input_rate, cast(ro as double) as output_rate,
      cast(round((k * ri + 2 * k * ro) / 1000000.0, 6) as double) as cost
    from (select event_id, cast(json_extract(props, '$.k') as bigint) as k,
            case event_type when 'view' then 3.0 when 'click' then 1.0 when 'purchase' then 0.02 else 0 end as ri,
            case event_type when 'view' then 15.0 when 'click' then 5.0 else 0 end as ro
          from events)
    """,
)
def rate_card(t: Tables) -> DataFrame:
    """Ledger rows stamped with the rate of their model; a provider prefix is ignored."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    usage = t.read("events").select(
        F.col("event_id").alias("usage_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
        .otherwise(F.concat(F.lit("vendor/"), "event_type"))
        .alias("model"),
        k.alias("input_tokens"),
        (2 * k).alias("output_tokens"),
    )
    return costs.ledger_rows(usage, RATES).select(
        "usage_id",
        "input_tokens",
        "output_tokens",
        "total_tokens",
        F.col("input_rate").cast("double").alias("input_rate"),
        F.col("output_rate").cast("double").alias("output_rate"),
        F.round(F.col("cost").cast("double"), 6).alias("cost"),
    )


@query(
    "dashboard_totals",
    """
    select (select count(*) from nation) as colleges, (select count(*) from customer) as departments,
      (select count(*) from orders) as courses, (select count(*) from lineitem) as test_sets,
      (select count(*) from lineitem where l_returnflag = 'R') as attempts,
      (select count(distinct user_id) from events) as users,
      (select count(distinct c_nationkey) from customer join orders on o_custkey = c_custkey) as indexed,
      (select count(*) from events) as call_count,
      (select cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) from events) as total_tokens,
      (select cast(sum(cast(value as decimal(12,6))) as double) from events) as cost
    """,
)
def dashboard_totals(t: Tables) -> DataFrame:
    # Only the distinct departments that hold courses are needed to tell indexed colleges.
    holding = t.courses().select("department_id").distinct()
    indexed = t.departments().join(holding, "department_id", "left_semi").agg(
        F.countDistinct("college_id").alias("indexed")
    )
    parts = [
        stats.row_total(t.read("nation"), "colleges"),
        stats.row_total(t.read("customer"), "departments"),
        stats.row_total(t.read("orders"), "courses"),
        t.read("lineitem").agg(
            F.count(F.lit(1)).alias("test_sets"),
            F.count_if(F.col("l_returnflag") == "R").alias("attempts"),
        ),
        t.read("events").agg(F.countDistinct("user_id").alias("users")),
        indexed,
        costs.ledger_total(t.ledger()).withColumn("cost", F.col("cost").cast("double")),
    ]
    return stats.totals(parts)


@query(
    "fetch_plan",
    """
    with stat as (
      select c_custkey, c_nationkey, c_name, c_acctbal, count(o_orderkey) as n, max(o_orderdate) as last_at
      from customer left join orders on o_custkey = c_custkey group by all),
    checked as (
      select *, coalesce(case when c_acctbal >= 0 then timestamp '2001-06-01' end,
                         case when n > 0 then last_at end) as checked_at from stat),
    need as (select *, checked_at is null or checked_at < timestamp '2002-01-01' - interval 120 days as needed from checked),
    placed as (
      select *, row_number() over (partition by c_nationkey, needed order by c_name, c_custkey) as rn from need)
    select c_nationkey as college_id, c_custkey as department_id, c_name as code, checked_at,
      case when not needed then 'keep' when rn <= 3 then 'fetch' else 'defer' end as action,
      bool_and(last_at is null or last_at < timestamp '2002-01-01' - interval 120 days)
        over (partition by c_nationkey) as list_stale
    from placed
    """,
)
def fetch_plan(t: Tables) -> DataFrame:
    figures = department_stats_of(t)
    departments = t.departments().select("department_id", "college_id", "code")
    # A department row was last read when its newest course was.
    read_at = figures.select("department_id", F.col("last_scraped_at").alias("scraped_at"))
    return planning.fetch_plan(
        departments.join(read_at, "department_id", "left"), figures, as_of(), 120, 3
    )


@query(
    "bulk_candidates",
    f"""
    with s as ({COLLEGE_STATS_SQL}),
    picked as (
      select n_nationkey as college_id, n_nationkey as rank
      from nation join region on r_regionkey = n_regionkey join s on s.college_id = n_nationkey
      where n_nationkey between 1 and 20 and r_name <> 'ASIA'
        and (s.course_count = 0 or s.last_scraped_at is null
             or s.last_scraped_at < timestamp '2002-01-01' - interval 30 days
             or s.departments_sourced < s.department_count)
      order by rank, college_id limit 8)
    select 'job-1' as job_id, college_id, row_number() over (order by rank, college_id) - 1 as position,
      'pending' as status from picked
    """,
)
def bulk_candidates(t: Tables) -> DataFrame:
    chosen = planning.bulk_candidates(
        t.colleges(),
        college_stats_of(t),
        as_of(),
        30,
        1,
        20,
        F.col("region_name") != "ASIA",
        8,
        include_partial=True,
    )
    return planning.resume_items(planning.freeze_items(chosen, "job-1"))


@query(
    "cache_state",
    f"""
    select department_id,
      case when course_count > 0 then 'cached' when courses_scraped_at is not null then 'checked_empty'
        else 'needs_fetch' end as state,
      (last_scraped_at is null or last_scraped_at < timestamp '2002-01-01' - interval 30 days) as data_stale,
      (courses_scraped_at is null or courses_scraped_at < timestamp '2002-01-01' - interval 90 days) as url_stale
    from ({DEPARTMENT_STATS_SQL})
    """,
)
def cache_state(t: Tables) -> DataFrame:
    return department_stats_of(t).select(
        "department_id",
        planning.cache_state(F.col("courses_scraped_at"), F.col("course_count")).alias("state"),
        planning.stale(F.col("last_scraped_at"), as_of()).alias("data_stale"),
        planning.stale(F.col("courses_scraped_at"), as_of(), planning.CATALOG_DAYS).alias("url_stale"),
    )


@query(
    "rolling_24h",
    """
    select user_id, ts, event_id, c as in_day, c - 1 >= 10 as over_cap
    from (select *, count(*) over (partition by user_id order by ts
            range between interval 24 hours preceding and current row) as c from events)
    """,
)
def rolling_24h(t: Tables) -> DataFrame:
    return planning.rolling_day_counts(t.read("events"), "user_id", "ts", "event_id")


@query(
    "created_today",
    """
    select user_id, count(*) as created from events
    where ts >= timestamp '2024-01-15 12:00:00' - interval 24 hours and ts <= timestamp '2024-01-15 12:00:00'
    group by 1
    """,
)
def created_today(t: Tables) -> DataFrame:
    return planning.trailing_count(
        t.read("events"), "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    )


@query(
    "job_progress",
    """
    select user_id as job_id, count(*) as total,
      count(*) filter (where event_type in ('purchase', 'error')) as processed,
      count(*) filter (where event_type = 'purchase') as succeeded,
      count(*) filter (where event_type = 'error') as failed,
      cast(sum(cast(value as decimal(12,6))) as double) as total_cost
    from events group by 1
    """,
)
def job_progress(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "purchase", "succeeded")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("running")
    )
    items = t.read("events").select(
        F.col("user_id").alias("job_id"),
        status.alias("status"),
        F.col("value").cast("decimal(12,6)").alias("cost"),
    )
    return stats.job_progress(items).withColumn("total_cost", F.col("total_cost").cast("double"))


OUTCOME_SQL = """
    select user_id as college_id, count(*) as department_count,
      count(*) filter (where event_type in ('purchase', 'view')) as fetched,
      count(*) filter (where event_type = 'view') as empty,
      count(*) filter (where event_type = 'click') as in_store,
      count(*) filter (where event_type = 'signup') as deferred,
      count(*) filter (where event_type = 'error') as failed,
      cast(coalesce(sum(case when event_type = 'purchase' then cast(json_extract(props, '$.k') as bigint) end), 0) as bigint) as courses
    from events group by 1
"""


@query(
    "retrieval_outcome",
    f"""
    select *, not (failed > 0 and fetched = 0) as ok,
      department_count || ' departments · ' || fetched || ' fetched (' || courses || ' courses) · '
        || in_store || ' already in DB'
        || case when empty > 0 then ' · ' || empty || ' with no current courses' else '' end
        || case when failed > 0 then ' · ' || failed || ' failed' else '' end
        || case when deferred > 0 then ' · ' || deferred || ' left for later' else '' end as summary
    from ({OUTCOME_SQL})
    """,
)
def retrieval_outcome(t: Tables) -> DataFrame:
    outcome = F.create_map(
        *[F.lit(v) for v in "purchase fetched view empty click in_store signup deferred error failed".split()]
    )
    steps = t.read("events").select(
        F.col("user_id").alias("college_id"),
        outcome[F.col("event_type")].alias("outcome"),
        F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k").cast("bigint")).alias("courses"),
    )
    names = ["department_count", "fetched", "courses", "in_store", "empty", "failed", "deferred"]
    return stats.retrieval_outcome(steps).withColumn(
        "summary", retrieval_text(*[F.col(n) for n in names])
    )


@query(
    "overview_table",
    f"""
    with s as ({COLLEGE_STATS_SQL}), o as ({_latest_sql()}),
    c as (select user_id as college_id, count(*) as call_count,
            cast(sum(cast(value as decimal(12,6))) as double) as cost from events group by 1),
    j as (
      select n_nationkey as college_id, n_name as college_name,
        case when r_name = 'AMERICA' then 'us' else 'intl' end as region, n_nationkey as rank,
        s.department_count, s.course_count, s.test_set_count, s.departments_with_courses, s.departments_sourced,
        coalesce(c.call_count, 0) as call_count, coalesce(c.cost, 0) as cost, s.last_scraped_at,
        {', '.join(f"o.{p}_at, case when o.{p}_at is not null then coalesce(o.{p}_cost, 0) end as {p}_cost, case when o.{p}_at is not null then coalesce(o.{p}_tokens, 0) end as {p}_tokens, case when o.{p}_at is not null then o.{p}_ok end as {p}_ok" for p in KINDS.values())}
      from nation join region on r_regionkey = n_regionkey
      left join s on s.college_id = n_nationkey left join c on c.college_id = n_nationkey
      left join o on o.college_id = n_nationkey)
    select *, rank + case when region = 'intl' then 1000 else 0 end as rank_key,
      case when department_count > 0 then round(departments_sourced / department_count + department_count / 1000000, 9) end as coverage_key,
      greatest({', '.join(f"{p}_at" for p in KINDS.values())}) as activity_key
    from j
    """,
)
def overview_table(t: Tables) -> DataFrame:
    colleges = t.colleges().select(
        "college_id",
        "college_name",
        F.when(F.col("region_name") == "AMERICA", "us").otherwise("intl").alias("region"),
        "rank",
    )
    spend = costs.rollup_by(t.ledger(), "college_id", ["cost"]).withColumn(
        "cost", F.col("cost").cast("double")
    )
    prefixes = list(KINDS.values())
    figures = college_stats_of(t).drop("attempts_taken")
    table = stats.overview(colleges, figures, spend, stats.latest_runs(t.runs(), KINDS), prefixes)
    keys = listing.table_sort_keys(prefixes)
    return table.select(
        "*",
        keys["rank"].alias("rank_key"),
        F.round(keys["coverage"], 9).alias("coverage_key"),
        keys["activity"].alias("activity_key"),
    )


@query(
    "region_groups",
    """
    select case when r_name = 'AMERICA' then 'us' else 'intl' end as region,
      arg_min(r_name, n_nationkey) as heading, count(*) as colleges,
      count(*) filter (where exists (select 1 from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey)) as indexed
    from nation join region on r_regionkey = n_regionkey group by 1
    """,
)
def region_groups(t: Tables) -> DataFrame:
    colleges = t.colleges().select(
        "college_id",
        "rank",
        F.when(F.col("region_name") == "AMERICA", "us").otherwise("intl").alias("region"),
        F.col("region_name").alias("rank_source"),
    )
    counts = college_stats_of(t).select("college_id", "course_count")
    return stats.region_groups(colleges.join(counts, "college_id", "left"))


@query(
    "display_events",
    """
    select event_id,
      case when value = 0 then '$0.00' when value < 0.01 then '$' || printf('%.4f', value)
        when value < 1 then '$' || printf('%.3f', value) else '$' || printf('%.2f', value) end as dollars,
      case when event_id * 997 >= 1000000 then printf('%.1fM', floor((event_id * 997 + 50000) / 100000) / 10.0)
        when event_id * 997 >= 1000 then printf('%.1fk', floor((event_id * 997 + 50) / 100) / 10.0)
        else cast(event_id * 997 as varchar) end as tokens,
      format('{:,}', event_id) as grouped,
      case when s < 60 then cast(floor(s + 0.5) as bigint) || 's ago'
        when s < 3600 then cast(floor(s / 60 + 0.5) as bigint) || 'm ago'
        when s < 86400 then cast(floor(s / 3600 + 0.5) as bigint) || 'h ago'
        else cast(floor(s / 86400 + 0.5) as bigint) || 'd ago' end as age
    from (select *, greatest(0, datediff('microsecond', ts, timestamp '2024-01-20') // 1000000) as s from events)
    """,
)
def display_events(t: Tables) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    return t.read("events").select(
        "event_id",
        dollars(F.col("value")).alias("dollars"),
        token_count(F.col("event_id") * 997).alias("tokens"),
        grouped_count(F.col("event_id")).alias("grouped"),
        age_text(F.col("ts"), now).alias("age"),
    )


@query(
    "display_colleges",
    """
    select n_nationkey as college_id,
      case when r_name = 'AMERICA' then 'us' else 'intl' end as region,
      case when n_nationkey % 5 = 0 then country when r_name = 'AMERICA' then n_name || ', ST' else n_name || ', ' || country end as location,
      case when n_nationkey > 0 then '#' || n_nationkey || ' '
        || case when r_name = 'AMERICA' then 'nationally' else 'worldwide' end || ' (' || r_name || ')' end as rank_text
    from (select *, case when r_name = 'AMERICA' then 'United States' else r_name end as country
          from nation join region on r_regionkey = n_regionkey)
    """,
)
def display_colleges(t: Tables) -> DataFrame:
    home = F.col("region_name") == "AMERICA"
    country = F.when(home, "United States").otherwise(F.col("region_name"))
    twin = F.col("college_id") % 5 == 0
    city = F.when(twin, country).otherwise(F.col("college_name"))
    state = F.when(twin, country).otherwise(F.lit("ST"))
    rank = F.when(F.col("rank") > 0, F.col("rank"))
    return t.colleges().select(
        "college_id",
        region(country).alias("region"),
        location(city, state, country).alias("location"),
        rank_text(rank, F.col("region_name"), country).alias("rank_text"),
    )
