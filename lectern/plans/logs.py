"""Log queries: each runs its stream until the log is read up, then reads the table it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import stats
from lectern.plans.coverage import KINDS, _latest_sql
from lectern.plans.registry import query
from lectern.sources.tables import Tables
from lectern.streaming import logs


def events_stream(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    return logs.log_stream(t.spark, t.folder, schema, "events.parquet")


@query(
    "log_copy",
    "select event_id as seq, user_id as job_id, event_type as kind, ts as created_at from events",
)
def log_copy(t: Tables) -> DataFrame:
    """The log copied by an append stream."""
    stream = events_stream(t).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").alias("created_at"),
    )
    path = logs.scratch(t.spark, "log-copy")
    logs.append_to(stream, path)
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query(
    "log_tail",
    "select event_id, user_id, event_type from events where event_id > 700 order by event_id limit 500",
)
def log_tail(t: Tables) -> DataFrame:
    return logs.tail(t.read("events").select("event_id", "user_id", "event_type"), "event_id", 700)


_STATUS_SQL = """
    select user_id as job_id, max(ts) as heartbeat_at,
      case when arg_max(event_type, (ts, event_id)) = 'purchase' then 'completed' else 'running' end as status
    from events group by 1
"""


@query(
    "orphan_jobs",
    f"""
    select job_id, heartbeat_at, case when status = 'running' and heartbeat_at < timestamp '2024-01-31 12:00:00' - interval 90 seconds
      then 'interrupted' else status end as status from ({_STATUS_SQL})
    """,
)
def orphan_jobs(t: Tables) -> DataFrame:
    """Latest heartbeat per job, kept by a stream, and the jobs it shows to be orphaned."""
    beats = events_stream(t).select(
        F.col("user_id").alias("job_id"),
        F.col("ts").alias("heartbeat_at"),
        F.col("event_id"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"),
    )
    path = logs.scratch(t.spark, "heartbeats")
    logs.keep_latest(beats, path, ["job_id"], ["heartbeat_at", "event_id"])
    now = F.to_timestamp_ntz(F.lit("2024-01-31 12:00:00"))
    return logs.orphans(logs.newest_version(t.spark, path), now).drop("event_id")


@query(
    "set_progress",
    """
    select user_id, event_type as set_id, arg_max(value, (ts, event_id)) as question_count, max(ts) as updated_at
    from events group by 1, 2
    """,
)
def set_progress(t: Tables) -> DataFrame:
    changes = events_stream(t).select(
        "user_id",
        F.col("event_type").alias("set_id"),
        F.col("value").alias("question_count"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )
    path = logs.scratch(t.spark, "progress")
    logs.keep_latest(changes, path, ["user_id", "set_id"], ["updated_at", "event_id"])
    return logs.newest_version(t.spark, path).drop("event_id")


@query("latest_runs_live", _latest_sql())
def latest_runs_live(t: Tables) -> DataFrame:
    """The latest-run pivot over a table that a stream keeps to one row per college and kind."""
    runs = events_stream(t).select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("college_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").alias("finished_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        F.col("value").alias("cost"),
        (F.col("event_type") != "error").alias("ok"),
    )
    path = logs.scratch(t.spark, "runs")
    logs.keep_latest(runs, path, ["college_id", "kind"], ["finished_at", "run_id"])
    return stats.latest_runs(logs.newest_version(t.spark, path), KINDS)


@query(
    "live_status",
    """
    select user_id as job_id, count(*) filter (where event_type = 'signup') as started,
      count(*) filter (where event_type = 'purchase') as done, count(*) filter (where event_type = 'error') as failed,
      count(*) filter (where event_type in ('view', 'click')) as trace,
      cast(sum(cast(value as decimal(12,6))) as double) as cost, max(event_id) as last_seq,
      case arg_max(event_type, event_id) when 'signup' then 'started' when 'purchase' then 'done' when 'error' then 'failed' else 'trace' end as last_kind
    from events group by 1
    """,
)
def live_status(t: Tables) -> DataFrame:
    """Job counters from JSON event bodies, kept by a stream."""
    kind = F.create_map(*[F.lit(v) for v in "signup started purchase done error failed view trace click trace".split()])
    body = F.to_json(
        F.struct(
            kind[F.col("event_type")].alias("type"),
            F.col("value").cast("decimal(12,6)").alias("cost"),
        )
    )
    raw = events_stream(t).select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), body.alias("event")
    )
    parsed = raw.withColumn("e", F.from_json("event", "type string, cost decimal(12,6)")).select(
        "job_id", "seq", F.col("e.type").alias("kind"), F.col("e.cost").alias("cost")
    )
    path = logs.scratch(t.spark, "status")
    logs.keep_current(parsed, path, logs.job_status, logs.merge_status, ["job_id"])
    return logs.newest_version(t.spark, path).select(
        "job_id",
        "started",
        "done",
        "failed",
        "trace",
        F.col("cost").cast("double").alias("cost"),
        F.col("last.seq").alias("last_seq"),
        F.col("last.kind").alias("last_kind"),
    )


@query(
    "trace_summary",
    """
    select event_type as level, case when value > 400 then 500 else 200 end as status, count(*) as requests,
      round(avg(k), 6) as ms_mean, max(k) as ms_max, cast(sum(cast(floor(value) as bigint)) as bigint) as bytes
    from (select *, cast(json_extract(props, '$.k') as bigint) as k from events) group by 1, 2
    """,
)
def trace_summary(t: Tables) -> DataFrame:
    requests = events_stream(t).select(
        F.col("event_type").alias("level"),
        F.when(F.col("value") > 400, 500).otherwise(200).alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("ms"),
        F.floor("value").alias("bytes"),
    )
    path = logs.scratch(t.spark, "trace")
    logs.keep_current(requests, path, logs.trace_summary, logs.merge_trace, ["level", "status"])
    summary = logs.finish_trace(logs.newest_version(t.spark, path))
    return summary.withColumn("ms_mean", F.round("ms_mean", 6))


@query(
    "rolling_24h_live",
    """
    select user_id, ts, event_id, c as in_day, c - 1 >= 10 as over_cap
    from (select *, count(*) over (partition by user_id order by ts
            range between interval 24 hours preceding and current row) as c from events)
    """,
)
def rolling_24h_live(t: Tables) -> DataFrame:
    path = logs.scratch(t.spark, "rolling")
    logs.follow_rolling_counts(
        events_stream(t), lambda: t.read("events"), path, "user_id", "ts", "event_id"
    )
    return t.spark.read.parquet(f"{path}/rows").drop("batch")


@query(
    "interrupted_jobs_live",
    f"""
    select job_id, heartbeat_at, case when status = 'running' and heartbeat_at < (select max(ts) from events) - interval 90 seconds
      then 'interrupted' else status end as status from ({_STATUS_SQL})
    """,
)
def interrupted_jobs_live(t: Tables) -> DataFrame:
    """Jobs that timers on the log's own time found quiet, by the end of the log."""
    beats = events_stream(t).select(
        F.col("user_id").alias("job_id"),
        F.col("ts").alias("heartbeat_at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"),
    )
    path = logs.scratch(t.spark, "watch")
    logs.watch_jobs(beats, path, clock="event", wait=True)
    return logs.newest_version(t.spark, path).select("job_id", "heartbeat_at", "status")


@query(
    "rolling_24h_state",
    """
    select user_id, ts, event_id, c as in_day, c - 1 >= 10 as over_cap
    from (select *, count(*) over (partition by user_id order by ts
            range between interval 24 hours preceding and current row) as c from events)
    where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 hour
    """,
)
def rolling_24h_state(t: Tables) -> DataFrame:
    """The rolling day from keyed state: all hours that are over, an hour behind the end of the log."""
    path = logs.scratch(t.spark, "rolling-state")
    stream = events_stream(t)
    logs.keep_rolling_counts(stream, path, "user_id", "ts", "event_id")
    return t.spark.read.parquet(f"{path}/rows")
