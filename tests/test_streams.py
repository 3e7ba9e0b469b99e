"""Streams over several micro-batches against their batch twins, with one hot job and events out of order."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from adlattice.streaming import jobs as S

SCHEMA = "job_id bigint, event_id bigint, ts timestamp, stage string, event string, kind string"


def events(seed=5, n=240):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        event = r.choice(["job_start", "stage_start", "stage_pass", "stage_fail", "job_pass"])
        kind = "start" if event in ("job_start", "stage_start") else "finish"
        # event numbers do not follow time
        rows.append((1 if r.random() < 0.6 else r.randrange(2, 9), (i * 7919) % 1009, start + dt.timedelta(minutes=9 * i + r.randrange(5)), f"s{r.randrange(3)}", event, kind))
    return rows


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Three files in time order, one a micro-batch."""
    S.prepare(spark)
    folder, rows = tmp_path_factory.mktemp("log"), events()
    for k in range(3):
        spark.createDataFrame(rows[k * 80:(k + 1) * 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"part{k}"))
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "part*"))
    return batch, stream, tmp_path_factory


def drained(spark, log, frame, mode):
    place = log[2].mktemp("out")
    seen = []

    def keep(df, n):
        seen.append(n)
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(str(place / f"t/{n}"))
    frame.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(place / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 3
    return spark.read.parquet(str(place / "t/*"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_state_machine(spark, log):
    got = drained(spark, log, S.job_state(log[1]), "append")
    last = got.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"), F.max("updated_at").alias("updated_at"))
    assert rows(last, "job_id", "status", "updated_at") == rows(S.job_state_batch(log[0]), "job_id", "status", "updated_at")


def waves(spark, tmp_path, schema, *batches):
    """A stream that takes the given rows a list per micro-batch."""
    place = tmp_path / uuid.uuid4().hex
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(place))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place))


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def test_changes_at_one_time_in_two_batches(spark, log, tmp_path):
    schema = "job_id bigint, event_id bigint, ts timestamp, event string"
    stream = waves(spark, tmp_path, schema, [(1, 1, at(0), "job_start"), (2, 9, at(0), "job_fail")], [(1, 2, at(0), "job_pass"), (2, 3, at(0), "job_start")], [(1, 0, at(0), "stage_start")])
    got = drained(spark, log, S.job_state(stream), "append")
    last = got.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"))
    assert rows(last, "job_id", "status") == [(1, "done"), (2, "fail")]
    counts = drained(spark, log, S.live_counts(S.job_state(stream)), "append").groupBy("status").agg(F.max_by("jobs", "version").alias("jobs"))
    assert rows(counts.filter("jobs <> 0"), "status", "jobs") == [("done", 1), ("fail", 1)]


def test_live_counts(spark, log):
    got = drained(spark, log, S.live_counts(S.job_state(log[1])), "append")
    want = S.job_state_batch(log[0]).groupBy("status").agg(F.count("*").alias("jobs"))
    assert rows(got.groupBy("status").agg(F.max_by("jobs", "version").alias("jobs")).filter("jobs <> 0"), "status", "jobs") == rows(want, "status", "jobs")


def test_first_failures(spark, log):
    got = drained(spark, log, S.live_failures(log[1]), "update")
    last = got.groupBy("job_id", "stage").agg(F.max_by("event_id", "batch").alias("event_id"))
    bad = log[0].filter("event = 'stage_fail'").groupBy("job_id", "stage").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert rows(last, "job_id", "stage", "event_id") == rows(bad, "job_id", "stage", "event_id")


def test_duplicate_starts(spark, log):
    got = drained(spark, log, S.dedupe_active(log[1].select("job_id", "event_id", "ts", "kind")), "append")
    assert rows(got, "job_id", "event_id", "verdict") == rows(S.dedupe_active_batch(log[0]), "job_id", "event_id", "verdict")


def test_stuck_starts(spark, log):
    calls = log[1].select("job_id", "event_id", "ts", "kind")
    got = drained(spark, log, S.stuck_jobs(calls), "append")
    newest = log[0].agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    assert rows(got, "job_id", "event_id") == rows(S.stuck_jobs_batch(log[0], F.lit(newest).cast("timestamp")), "job_id", "event_id")


def test_a_hot_job_in_one_batch(spark, log, tmp_path):
    """100,000 calls of one job over a day reach state as a row per hour."""
    r = random.Random(4)
    hot = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=i * 864 + 1_200_000 * (i > 50_000)), r.choice(["start", "finish"])) for i in range(100_000)]
    schema = "job_id bigint, event_id bigint, ts timestamp, kind string"
    batch = spark.createDataFrame(hot, schema)
    tail = [(1, 200_000, at(3000), "finish")]
    stream = waves(spark, tmp_path, schema, hot, tail, [(2, 1, at(3001), "start")])
    whole = batch.unionByName(spark.createDataFrame(tail + [(2, 1, at(3001), "start")], schema))
    assert rows(drained(spark, log, S.dedupe_active(stream), "append"), "job_id", "event_id", "verdict") == rows(S.dedupe_active_batch(whole), "job_id", "event_id", "verdict")
    assert rows(drained(spark, log, S.stuck_jobs(stream), "append"), "job_id", "event_id") == rows(S.stuck_jobs_batch(whole, F.lit(at(3001)).cast("timestamp")), "job_id", "event_id")


def test_cache_entries_expire(spark, log, tmp_path):
    schema = "cache_key string, request_id bigint, ts timestamp"
    stream = waves(spark, tmp_path, schema, [("a", 1, at(0)), ("a", 2, at(59)), ("b", 3, at(5)), ("a", 4, at(60))],
                   [("a", 5, at(60, 1)), ("a", 6, at(119)), ("b", 7, at(64, 59))], [("a", 8, at(300)), ("b", 9, at(301)), ("a", 10, at(300))])
    got = drained(spark, log, S.cached_lookup(stream), "append")
    served = {1: 1, 2: 1, 4: 1, 5: 5, 6: 5, 3: 3, 7: 3, 8: 8, 9: 9, 10: 8}
    assert rows(got, "request_id", "cache_hit", "served_by") == sorted((i, i != by, by) for i, by in served.items())


def test_sessions(spark, log):
    cols = ("job_id", "session_start", "session_end", "n")
    newest = log[0].agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    closed = S.job_sessions_batch(log[0]).filter(F.col("session_end") <= F.lit(newest).cast("timestamp"))
    got = drained(spark, log, S.job_sessions(log[1]), "append")
    assert rows(got, *cols) == rows(closed, *cols) and got.count() > 30


def test_sessions_merge_and_leave_out_late_rows(spark, log, tmp_path):
    stream = waves(spark, tmp_path, "job_id bigint, ts timestamp", [(1, at(0)), (1, at(50)), (2, at(10))], [(1, at(25)), (1, at(57)), (2, at(60))],
                   [(2, at(200))], [(1, at(20)), (2, at(195))], [(3, at(500))])
    got = drained(spark, log, S.job_sessions(stream), "append")
    # job 1's burst is bridged by minute 25; its minute 20 comes after the watermark, job 2's minute 195 before
    assert rows(got, "job_id", "session_start", "session_end", "n") == [
        (1, at(0), at(87), 4), (2, at(10), at(40), 1), (2, at(60), at(90), 1), (2, at(195), at(230), 2)]


def many_jobs(spark, log, tmp_path, make, schema, rows):
    """(rows put out, most rows of state) of a stream over 6,000 jobs, whose calls are hours apart, in three micro-batches."""
    place, out = tmp_path / uuid.uuid4().hex, tmp_path / uuid.uuid4().hex
    for k in range(3):
        spark.createDataFrame(rows[k * len(rows) // 3:(k + 1) * len(rows) // 3], schema).coalesce(1).write.mode("append").parquet(str(place))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place))
    q = (make(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).trigger(availableNow=True).start())
    q.awaitTermination()
    state = max(s["customMetrics"].get("numValueStateVars", 0) and s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.parquet(str(out)), state


def spread_calls(n=6000):
    r = random.Random(8)
    return [(r.randrange(n) if i % 50 else None, 3 * i, at(0, i * 30), r.choice(["start", "finish"])) for i in range(2 * n)]


CALLS = "job_id bigint, event_id bigint, ts timestamp, kind string"


def test_many_jobs_share_state_duplicates(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 16)
    calls = spread_calls()
    got, state = many_jobs(spark, log, tmp_path, S.dedupe_active, CALLS, calls)
    # the batch form asks for non-null jobs
    known = spark.createDataFrame([c for c in calls if c[0] is not None], CALLS)
    assert rows(got.filter("job_id IS NOT NULL"), "job_id", "event_id", "verdict") == rows(S.dedupe_active_batch(known), "job_id", "event_id", "verdict")
    none = [c for c in calls if c[0] is None]
    want = [(b[1], "DUPLICATE" if a and a[3] == "start" else "ACCEPTED") for a, b in zip([None, *none], none) if b[3] == "start"]
    assert rows(got.filter("job_id IS NULL"), "event_id", "verdict") == want and len(want) > 50
    assert state <= 32


def test_many_jobs_share_state_stuck(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 16)
    calls = [c for c in spread_calls() if c[0] is not None]
    got, state = many_jobs(spark, log, tmp_path, S.stuck_jobs, CALLS, calls)
    newest = calls[-1][2] - dt.timedelta(minutes=10)
    assert rows(got, "job_id", "event_id") == rows(S.stuck_jobs_batch(spark.createDataFrame(calls, CALLS), F.lit(newest).cast("timestamp")), "job_id", "event_id")
    assert state <= 64  # a bucket's value and timers


def test_many_jobs_share_state_sessions(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 16)
    calls = [c for c in spread_calls() if c[0] is not None]
    got, state = many_jobs(spark, log, tmp_path, S.job_sessions, CALLS, calls)
    newest = calls[-1][2] - dt.timedelta(minutes=10)
    closed = S.job_sessions_batch(spark.createDataFrame(calls, CALLS)).filter(F.col("session_end") <= F.lit(newest).cast("timestamp"))
    cols = ("job_id", "session_start", "session_end", "n")
    assert rows(got, *cols) == rows(closed, *cols) and got.count() > 5000
    assert state <= 64  # a bucket's value and timers
