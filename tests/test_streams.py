"""Streams over several micro-batches against their batch forms."""

import datetime
import random
import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators.planning import rolling_day_counts
from lectern.sources.buckets import BucketTable
from lectern.streaming import logs
from lectern.streaming.timers import RollingDay

START = datetime.datetime(2024, 1, 1)


def write_log(spark, folder, files=3, per_file=120):
    n = 0
    for i in range(files):
        rows = []
        for _ in range(per_file):
            user = 1 if n % 3 else n % 7
            rows.append((n, user, ["started", "done", "failed", "trace"][n % 4], START + datetime.timedelta(minutes=37 * n), float(n % 11)))
            n += 1
        df = spark.createDataFrame(rows, "seq bigint, job_id int, kind string, ts timestamp_ntz, cost double")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def rows(df):
    return sorted(map(str, df.collect()))


def test_streams_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = write_log(spark, folder)

    def stream():
        return logs.log_stream(spark, folder, log.schema, files=1)

    copy = str(tmp_path / "copy")
    logs.append_to(stream(), copy)
    assert rows(spark.read.parquet(f"{copy}/rows")) == rows(log)

    path = str(tmp_path / "latest")
    job = logs.keep_latest(stream(), path, ["job_id"], ["ts", "seq"])
    assert len({p["batchId"] for p in job.recentProgress if p["numInputRows"]}) == 3
    columns = log.columns
    assert rows(logs.newest_version(spark, path).select(*columns)) == rows(logs.latest(log, ["job_id"], ["ts", "seq"]).select(*columns))

    logs.keep_latest(stream(), path, ["job_id"], ["ts", "seq"])  # restarted with nothing new
    assert rows(logs.newest_version(spark, path).select(*columns)) == rows(logs.latest(log, ["job_id"], ["ts", "seq"]).select(*columns))
    more = log.selectExpr("seq + 100000 as seq", "job_id", "kind", "ts", "cost").limit(50)
    more.coalesce(1).write.mode("append").parquet(folder)
    logs.keep_latest(stream(), path, ["job_id"], ["ts", "seq"])  # restarted with new rows
    log = spark.read.parquet(folder)
    assert rows(logs.newest_version(spark, path).select(*columns)) == rows(logs.latest(log, ["job_id"], ["ts", "seq"]).select(*columns))
    assert len(BucketTable(spark, f"{path}/table").versions()) == 2

    path = str(tmp_path / "status")
    logs.keep_current(stream(), path, logs.job_status, logs.merge_status, ["job_id"])
    assert rows(logs.newest_version(spark, path)) == rows(logs.job_status(log))

    path = str(tmp_path / "rolling")
    logs.follow_rolling_counts(stream(), lambda: spark.read.parquet(folder), path, "job_id", "ts", "seq", cap=5)
    live = spark.read.parquet(f"{path}/rows").drop("batch")
    assert rows(live) == rows(rolling_day_counts(log, "job_id", "ts", "seq", 5).select(*live.columns))


def test_tail_and_orphans(spark):
    log = spark.range(1, 1200).withColumnRenamed("id", "seq")
    page = [r.seq for r in logs.tail(log, "seq", 100).collect()]
    assert page == list(range(101, 601))
    jobs = spark.createDataFrame([(1, "running", 0), (2, "running", 80), (3, "completed", 0)], "job_id int, status string, s int").withColumn("heartbeat_at", F.timestamp_seconds("s"))
    got = {r.job_id: r.status for r in logs.orphans(jobs, F.timestamp_seconds(F.lit(100))).collect()}
    assert got == {1: "interrupted", 2: "running", 3: "completed"}


def bytes_under(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    folder, path = str(tmp_path / "log"), str(tmp_path / "state")
    wide = spark.range(20_000).selectExpr("id as job_id", "id as seq", "repeat(sha2(string(id), 512), 2) as body")
    wide.coalesce(1).write.parquet(folder)

    def follow():
        stream = logs.log_stream(spark, folder, wide.schema)
        logs.keep_latest(stream, path, ["job_id"], ["seq"], buckets=50)

    follow()
    table = BucketTable(spark, f"{path}/table")
    before, size = table.manifest()[1]["writes"], bytes_under(tmp_path / "state")
    few = spark.createDataFrame([(7, 90_000, "new"), (11, 90_001, "new")], wide.schema)
    few.coalesce(1).write.mode("append").parquet(folder)
    follow()
    after = table.manifest()[1]["writes"]
    changed = [k for k in after if after[k] != before.get(k)]
    assert 1 <= len(changed) <= 2 and len(after) == 50
    written = sum(bytes_under(tmp_path / "state" / "table" / "data" / after[k] / f"bucket={k}") for k in changed)
    assert written < size / 15
    got = {r.job_id: r.body for r in logs.newest_version(spark, path).where("seq >= 90000").collect()}
    assert got == {7: "new", 11: "new"} and logs.newest_version(spark, path).count() == 20_000


def beats(spark, folder, rows):
    schema = "job_id int, heartbeat_at timestamp, seq long, status string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return logs.log_stream(spark, folder, spark.read.parquet(folder).schema)


def shown(spark, path):
    if not BucketTable(spark, f"{path}/table").versions():
        return {}
    return {r.job_id: r.status for r in logs.newest_version(spark, path).collect()}


def until(done, seconds=40):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.5)
    return done()


def test_a_quiet_job_is_interrupted_without_a_new_row_and_after_a_restart(spark, tmp_path):
    folder, path = str(tmp_path / "beats"), str(tmp_path / "watch")
    now = datetime.datetime.now()
    quiet, done = now - datetime.timedelta(seconds=600), now
    stream = beats(spark, folder, [(1, quiet, 1, "running"), (2, now, 1, "running"), (3, done, 1, "completed"), (None, now, 1, "running"), (5, None, 1, "running")])
    job = logs.watch_jobs(stream, path, seconds=8, every="500 milliseconds")
    assert until(lambda: shown(spark, path).get(1) == "interrupted")
    first = shown(spark, path)
    job.stop()
    assert set(first) == {1, 2, 3} and first[3] == "completed"
    job = logs.watch_jobs(stream, path, seconds=8, every="500 milliseconds")  # nothing new arrives
    assert until(lambda: shown(spark, path).get(2) == "interrupted")
    beats(spark, folder, [(2, datetime.datetime.now() + datetime.timedelta(seconds=3600), 2, "running")])
    assert until(lambda: shown(spark, path).get(2) == "running")
    job.stop()
    assert shown(spark, path) == {1: "interrupted", 2: "running", 3: "completed"}


def test_event_time_watch_equals_the_batch_predicate(spark, tmp_path):
    folder, path = str(tmp_path / "beats"), str(tmp_path / "watch")
    rng, at = random.Random(3), lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(rng.randrange(12), at(rng.randrange(60 * i, 60 * i + 100)), n, rng.choice(["running", "running", "completed"])) for i in range(4) for n in range(100 * i, 100 * i + 25)]
    for i in range(4):
        stream = beats(spark, folder, rows[25 * i : 25 * i + 25])
        logs.watch_jobs(stream, path, clock="event", late="200 seconds", wait=True)
    end = max(r[1] for r in rows) - datetime.timedelta(seconds=200)
    log = logs.latest(spark.read.parquet(folder), ["job_id"], ["heartbeat_at", "seq"])
    want = {r.job_id: r.status for r in logs.orphans(log, F.lit(end)).collect()}
    assert shown(spark, path) == want


def test_rolling_day_state_equals_the_window_out_of_order(spark, tmp_path):
    folder, path = str(tmp_path / "log"), str(tmp_path / "rolling")
    rng = random.Random(9)
    made = [(rng.choice([1, 1, 1, 2, 3, 4]), START + datetime.timedelta(seconds=rng.randrange(6 * 86400)), n) for n in range(900)]
    made.sort(key=lambda r: r[1] + datetime.timedelta(minutes=rng.randrange(100)))  # at most 100 minutes out of order
    made += [(9, START + datetime.timedelta(days=9), 5000)]  # ends all days before
    schema = "user_id int, ts timestamp_ntz, event_id long"
    for i in range(0, len(made), 200):
        spark.createDataFrame(made[i : i + 200], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = logs.log_stream(spark, folder, spark.read.parquet(folder).schema, files=1)
        logs.keep_rolling_counts(stream, path, "user_id", "ts", "event_id", cap=5, late="2 hours")
    got = spark.read.parquet(f"{path}/rows")
    want = rolling_day_counts(spark.read.parquet(folder), "user_id", "ts", "event_id", 5).where("user_id <> 9")
    assert rows(got) == rows(want.select(*got.columns))
    spark.createDataFrame([(9, START + datetime.timedelta(days=12), 5001)], schema).coalesce(1).write.mode("append").parquet(folder)
    logs.keep_rolling_counts(logs.log_stream(spark, folder, spark.read.parquet(folder).schema), path, "user_id", "ts", "event_id", cap=5, late="2 hours")
    hours = spark.read.format("statestore").option("stateVarName", "hours").load(f"{path}/checkpoint")
    assert {r[0] for r in hours.select("key.user_id").distinct().collect()} <= {9}  # idle users leave no state


class Cell:
    """A state value, or a map of them, that counts what is asked of it."""

    def __init__(self):
        self.value, self.held, self.asked = None, {}, 0

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        self.asked += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def iterator(self):
        return iter(list(self.held.items()))


def test_a_user_of_many_hours_has_one_timer_and_writes_each_hour_once():
    cells, timers = {}, []
    handle = SimpleNamespace(
        getMapState=lambda name, *_: cells.setdefault(name, Cell()), getValueState=lambda name, *_: cells.setdefault(name, Cell()), registerTimer=timers.append, deleteTimer=timers.remove
    )
    day = RollingDay("user_id", 5)
    day.init(handle)
    made = pd.DataFrame({"ts_us": [h * 3_600_000_000 + 5 for h in range(100, 148)], "key": range(48)})
    list(day.handleInputRows((1,), iter([made[24:], made[:24]]), None))
    assert timers == [101 * 3_600_000] and cells["hours"].asked == 48
    list(day.handleInputRows((1,), iter([made[:1] - [3_600_000_000 * 2, 0]]), None))
    assert timers == [99 * 3_600_000] and len(cells["hours"].held) == 49
