"""Streaming queries over the event and line tables; each stream is drained once and its output read back.

The event log is written as waves in time order and read a wave per micro-batch, so state carries over several of them.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from adlattice.plans.fixtures import VIEWS, Tables
from adlattice.plans.registry import query
from adlattice.session import shared_folder
from adlattice.streaming import jobs as S


def _stream(t: Tables, name: str) -> DataFrame:
    """The table's files as a stream, at most 64 a micro-batch; the pattern matches a single file as well as a folder of parts."""
    return t.spark.readStream.option("maxFilesPerTrigger", 64).schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parque[t]")


WAVES, WAVE_FILES = 4, 4


def event_stream(t: Tables) -> DataFrame:
    """Events as a stream of ``WAVES`` micro-batches."""
    place = f"{_place(t)}/log"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = t.fx_event.select(us.alias("us")).approxQuantile("us", [i / WAVES for i in range(1, WAVES)], 0.001)
    wave = F.lit(0)
    for c in cuts:
        wave = wave + (us > int(c)).cast("int")
    for i in range(WAVES):  # one after the other, as files are taken by their age
        t.fx_event.filter(wave == i).repartition(WAVE_FILES).write.mode("append").parquet(place)
    log = t.spark.readStream.option("maxFilesPerTrigger", WAVE_FILES).schema(t.fx_event.schema).parquet(place)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def _place(t: Tables) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/adlattice-stream-{uuid.uuid4().hex}"


def drain(t: Tables, frame: DataFrame) -> DataFrame:
    """Runs a stream over all present files into a Parquet table and reads that table."""
    S.prepare(t.spark)
    place = _place(t)
    (frame.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/table")
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.schema(frame.schema).parquet(f"{place}/table")


def drain_batches(t: Tables, frame: DataFrame, mode: str) -> DataFrame:
    """The same for output modes a file sink does not take: each micro-batch is one folder, overwritten when re-run."""
    S.prepare(t.spark)
    place = _place(t)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table/batch={batch_id}")
    (frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(f"{place}/table")


_KIND = "CASE WHEN event IN ('job_start', 'stage_start') THEN 'start' WHEN event IN ('job_pass', 'stage_fail') THEN 'finish' END"
_CALLS = f"calls AS (SELECT job_id, event_id, ts, {_KIND} AS kind FROM fx_event WHERE event <> 'stage_pass')"


def calls(events: DataFrame) -> DataFrame:
    return events.filter("event <> 'stage_pass'").selectExpr("job_id", "event_id", "ts", f"{_KIND} AS kind")


@query("k01_stream_specs", """
SELECT l_orderkey AS job_id, s.slug, s.media, s.width, CASE WHEN s.safe_top IS NOT NULL AND s.safe_right IS NOT NULL AND s.safe_bottom IS NOT NULL AND s.safe_left IS NOT NULL THEN s.safe_top ELSE 0 END AS safe_top
FROM lineitem JOIN fx_spec s ON s.slug = 'sp' || l_partkey""")
def k_specs(t: Tables) -> DataFrame:
    messages = _stream(t, "lineitem").selectExpr("l_orderkey AS job_id", "array(concat('sp', l_partkey)) AS spec_ids", "CAST(NULL AS ARRAY<STRING>) AS target_media")
    return drain(t, S.stream_specs(messages, t.fx_spec)).select("job_id", "slug", "media", "width", "safe_top")


_DEDUPE = f"WITH {_CALLS} SELECT job_id, event_id, CASE WHEN prev = 'start' THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS verdict FROM (SELECT *, lag(kind) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS prev FROM calls) z WHERE kind = 'start'"


@query("k02_dedupe_active", _DEDUPE)
def k_dedupe(t: Tables) -> DataFrame:
    return drain(t, S.dedupe_active(calls(event_stream(t))))


@query("k02_dedupe_active_batch", _DEDUPE)
def k_dedupe_batch(t: Tables) -> DataFrame:
    return S.dedupe_active_batch(calls(t.fx_event))


_STATE = """WITH s AS (SELECT *, CASE WHEN event IN ('job_start', 'stage_start', 'stage_pass') THEN 'processing' WHEN event = 'job_pass' THEN 'done' WHEN event = 'stage_fail' THEN 'fail' END AS st FROM fx_event)
SELECT job_id, arg_max(st, {'t': ts, 'e': event_id}) AS status, MAX(ts) AS updated_at FROM s GROUP BY 1"""


@query("k03_job_state", _STATE)
def k_state(t: Tables) -> DataFrame:
    """Latest status from the stream of changes."""
    changes = drain(t, S.job_state(event_stream(t)))
    return changes.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"), F.max("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("k03_job_state_batch", _STATE)
def k_state_batch(t: Tables) -> DataFrame:
    return S.job_state_batch(t.fx_event)


_STUCK = f"""WITH {_CALLS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nxt FROM calls)
SELECT job_id, event_id FROM n WHERE kind = 'start' AND epoch_us(coalesce(nxt, TIMESTAMP '2100-01-01')) - epoch_us(ts) > 900000000"""


@query("k04_stuck_jobs_batch", _STUCK)
def k_stuck_batch(t: Tables) -> DataFrame:
    return S.stuck_jobs_batch(calls(t.fx_event), F.lit("2100-01-01").cast("timestamp"))


@query("k04_stuck_jobs", f"""WITH {_CALLS}, wm AS (SELECT epoch_ms(MAX(ts)) - 600000 AS w FROM calls), n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nxt FROM calls)
SELECT job_id, event_id FROM n, wm WHERE kind = 'start' AND CASE WHEN nxt IS NOT NULL THEN epoch_ms(nxt) > epoch_ms(ts) + 900000 ELSE epoch_ms(ts) + 900000 <= w END""")
def k_stuck(t: Tables) -> DataFrame:
    """Timer variant: starts near the end of the log stay open, as no watermark passes them."""
    return drain(t, S.stuck_jobs(calls(event_stream(t))))


_CACHE_KEY = "concat(stage, '/', CAST(job_id % 25 AS VARCHAR(9)))"


@query("k05_cached_lookup", f"""WITH RECURSIVE r AS (SELECT {_CACHE_KEY} AS k, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY {_CACHE_KEY} ORDER BY epoch_ms(ts), event_id) AS rn FROM fx_event),
w AS (SELECT k, rn, event_id, ms, event_id AS via, ms + 3600000 AS ends FROM r WHERE rn = 1
      UNION ALL SELECT r.k, r.rn, r.event_id, r.ms, CASE WHEN r.ms > w.ends THEN r.event_id ELSE w.via END, CASE WHEN r.ms > w.ends THEN r.ms + 3600000 ELSE w.ends END FROM w JOIN r ON r.k = w.k AND r.rn = w.rn + 1)
SELECT k AS cache_key, event_id AS request_id, event_id <> via AS cache_hit, via AS served_by FROM w""")
def k_cache(t: Tables) -> DataFrame:
    """Requests from the event log; entries expire in event time."""
    requests = event_stream(t).select(F.expr(_CACHE_KEY).alias("cache_key"), F.col("event_id").alias("request_id"), "ts")
    return drain(t, S.cached_lookup(requests))


@query("k06_live_counts", f"WITH z AS ({_STATE}) SELECT status, COUNT(*)::BIGINT AS jobs FROM z GROUP BY 1")
def k_counts(t: Tables) -> DataFrame:
    """One stream: status changes feed the counts."""
    out = drain(t, S.live_counts(S.job_state(event_stream(t))))
    return out.groupBy("status").agg(F.max_by("jobs", "version").alias("jobs")).filter("jobs <> 0")


@query("k07_stage_counts", """
SELECT 'tumbling' AS kind, date_trunc('hour', ts) AS window_start, stage, event, COUNT(*) AS n FROM fx_event GROUP BY 2, 3, 4
UNION ALL SELECT 'sliding', w, stage, event, COUNT(*) FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM fx_event) z GROUP BY 2, 3, 4""")
def k_stage_counts(t: Tables) -> DataFrame:
    one = S.stage_counts(t.fx_event).select(F.lit("tumbling").alias("kind"), "window_start", "stage", "event", "n")
    two = S.stage_counts(t.fx_event, "2 hours", "1 hour").select(F.lit("sliding").alias("kind"), "window_start", "stage", "event", "n")
    return one.unionByName(two).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("k07_job_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM fx_event WINDOW w AS (PARTITION BY job_id ORDER BY ts)), s AS (SELECT *, SUM(brk) OVER (PARTITION BY job_id ORDER BY ts) AS sid FROM g)
SELECT job_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n FROM s GROUP BY job_id, sid""")
def k_sessions(t: Tables) -> DataFrame:
    return S.job_sessions_batch(t.fx_event).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("k07_job_sessions_stream", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM fx_event WINDOW w AS (PARTITION BY job_id ORDER BY ts)), s AS (SELECT *, SUM(brk) OVER (PARTITION BY job_id ORDER BY ts) AS sid FROM g),
f AS (SELECT job_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n FROM s GROUP BY job_id, sid)
SELECT job_id, session_start, session_end, n FROM f WHERE epoch_ms(session_end) <= (SELECT epoch_ms(MAX(ts)) - 600000 FROM fx_event)""")
def k_sessions_stream(t: Tables) -> DataFrame:
    """Sessions that the watermark has passed; the last ones stay open."""
    return drain(t, S.job_sessions(event_stream(t))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("k07_stage_counts_stream", """WITH wm AS (SELECT MAX(ts) - INTERVAL 10 MINUTE AS w FROM fx_event)
SELECT date_trunc('hour', ts) AS window_start, stage, event, COUNT(*) AS n FROM fx_event, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2, 3""")
def k_stage_stream(t: Tables) -> DataFrame:
    """Closed windows only: the last ones wait for the watermark."""
    return drain(t, S.stage_counts(event_stream(t))).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "stage", "event", "n")


@query("k08_live_failures", "SELECT job_id, stage, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id FROM fx_event WHERE event = 'stage_fail' GROUP BY 1, 2")
def k_failures(t: Tables) -> DataFrame:
    found = drain_batches(t, S.live_failures(event_stream(t)), "update")
    return found.groupBy("job_id", "stage").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("k09_stream_upsert", """
SELECT slug, 'UPDATED' AS status FROM fx_spec WHERE sort_order % 3 <> 0 AND sort_order % 4 = 0 UNION ALL SELECT slug, 'UNCHANGED' FROM fx_spec WHERE sort_order % 3 <> 0 AND sort_order % 4 <> 0 UNION ALL SELECT slug, 'INSERTED' FROM fx_spec WHERE sort_order % 3 = 0""")
def k_upsert(t: Tables) -> DataFrame:
    cols = ["slug", "media", "width", "height", "placement_type", "parse_status", "safe_top", "sort_order"]
    place = _place(t)
    t.fx_spec.filter("sort_order % 3 <> 0").select(*cols).write.parquet(f"{place}/catalog/v0")
    stream = t.spark.sql(VIEWS["fx_spec"], part=_stream(t, "part")).select(*cols).withColumn("width", F.when(F.col("sort_order") % 4 == 0, F.col("width") + 1).otherwise(F.col("width")))
    writer = S.stream_upsert(stream.withColumn("batch_ord", F.col("sort_order")), place, f"{place}/checkpoint", cols[1:-1])
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{place}/status").select("slug", "status")


@query("a14_job_timing", "SELECT job_id, trunc((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1000)::BIGINT AS elapsed_ms, COUNT(*) FILTER (event = 'stage_start') AS stage_start, COUNT(*) FILTER (event = 'stage_pass') AS stage_pass, COUNT(*) FILTER (event = 'stage_fail') AS stage_fail FROM fx_event GROUP BY 1")
def a_timing(t: Tables) -> DataFrame:
    return S.job_timing(t.fx_event)


@query("a14_stage_pivot", "SELECT stage, " + ", ".join(f"COUNT(*) FILTER (event = '{k}') AS {k}" for k in ("job_start", "stage_start", "stage_pass", "stage_fail", "job_pass")) + " FROM fx_event GROUP BY 1")
def a_pivot(t: Tables) -> DataFrame:
    return S.stage_pivot(t.fx_event)
