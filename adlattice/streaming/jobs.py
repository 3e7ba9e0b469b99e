"""Structured Streaming over job messages and stage events.

A micro-batch reaches keyed state in two steps.  The events of a job and an hour fold into one row (what the hour begins and
ends with; results that the hour settles alone pass by), so a hot job brings a few rows where it had all its events.  State
then takes these rows by bucket: a bucket keeps one small value for each of its jobs and folds all their rows in one array
pass, as a call into Python per job, or per job and hour, costs far more than the work it does.  The size of a micro-batch is
bounded at the source (``maxFilesPerTrigger``).  Windows and watermarks are choices of this library.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from adlattice.operators import catalog as C
from adlattice.operators.scale import previous_row, running_max

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START, FINISH = ("job_start",), ("job_pass", "job_fail", "stage_fail")
STUCK_SECONDS = 900
SLICE_US = 3_600_000_000  # events of a key are ordered within an hour, then hour by hour


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark; a time without zone is read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def prepare(spark: SparkSession) -> None:
    """State store that keeps keyed state off the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# --- fan-out -----------------------------------------------------------------------------------------------------

def stream_specs(messages: DataFrame, specs: DataFrame) -> DataFrame:
    """Streaming messages joined with the static catalog: one row per job and spec, with its safe zone."""
    named = F.coalesce(F.size("spec_ids"), F.lit(0)) > 0
    by_id = messages.filter(named).select("job_id", F.explode(F.array_distinct("spec_ids")).alias("slug")).join(specs, "slug")
    by_media = (messages.filter(~named).select("job_id", F.explode(F.array_distinct("target_media")).alias("media"))
                .join(specs.filter("active"), "media"))
    items = by_id.unionByName(by_media)
    known = F.lit(True)
    for c in C.INSETS:
        known = known & F.col(c).isNotNull()
    return items.select("job_id", "slug", "media", "width", "height",
                        *[F.when(known, F.col(c)).otherwise(F.lit(0)).alias(c) for c in C.INSETS])


# --- in-flight duplicates ----------------------------------------------------------------------------------------

BUCKETS = 4096  # jobs share state in this many buckets; rows that are settled pass by in as many of their own, below 0
# a null job, and a null event (the last of its time), while arrays of whole numbers are folded
_NONE = {"job_id": -(1 << 63), "event_id": (1 << 63) - 1}


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(_NONE[name])).alias(name)


def _hours(events: DataFrame, *more: str) -> DataFrame:
    """job_id, microseconds and what else is asked of timed events, dealt to slices of a job."""
    us = _micros(F.col("ts"))
    marked = events.select(_whole("job_id"), us.alias("us"),
                           *[_whole(c) if c == "event_id" else c for c in more])
    return marked.withColumn("slice", F.floor(F.col("us") / SLICE_US)).repartition("job_id", "slice")


def _bucketed(rows: DataFrame, settled: Column) -> DataFrame:
    own, aside = (F.pmod(F.xxhash64(*c), F.lit(BUCKETS)) for c in (["job_id"], ["job_id", "event_id"]))
    return rows.withColumn("bucket", F.when(settled, -1 - aside).otherwise(own))


def _named(rows: DataFrame) -> DataFrame:
    """Nulls in place of ``_NONE``."""
    return rows.withColumns({c: F.when(F.col(c) != none, F.col(c)) for c, none in _NONE.items() if c in rows.columns})


def _columns(rows: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    """The named columns of all rows, one array each."""
    parts = [[f[n].to_numpy() for n in names] for f in rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.array([], np.int64)] * len(names)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its key, rows of a key being neighbours."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _ends(first: np.ndarray) -> np.ndarray:
    """Index of the last row of every key."""
    return np.append(np.flatnonzero(first)[1:], len(first)) - 1


def _arrays(state, *types) -> list[np.ndarray]:
    """The arrays a bucket holds, the first of them its jobs in order; empty ones without state."""
    held = state.get() if state.exists() else [[]] * len(types)
    return [np.array(c, t) for c, t in zip(held, types)]


def _found(jobs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a wanted job is among the sorted ``jobs``, its place where it is)."""
    at = np.searchsorted(jobs, wanted)
    there = at < len(jobs)
    there[there] = jobs[at[there]] == wanted[there]
    return there, at


def _replaced(jobs: np.ndarray, values: list[np.ndarray], by: np.ndarray, keep: np.ndarray, new: list[np.ndarray]) -> list[np.ndarray]:
    """``jobs`` and their values with those of the jobs ``by`` taken out, and the new values of ``by`` where ``keep`` put in."""
    stay = ~np.isin(jobs, by)
    merged = np.concatenate([jobs[stay], by[keep]])
    order = np.argsort(merged, kind="stable")
    return [merged[order], *[np.concatenate([old[stay], n[keep]])[order] for old, n in zip(values, new)]]


_CALL_SLICE = "job_id long, event_id long, us long, starts boolean, last_starts boolean, verdict string"


def _fold_calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first call of every slice, with what the slice ends in, and the verdict of every later start: the call before it is here."""
    job, hour, event_id, us, kind = _columns(frames, "job_id", "slice", "event_id", "us", "kind")
    if not len(job):
        return
    order = np.lexsort((event_id, us, hour, job))
    job, hour, event_id, us, starts = job[order], hour[order], event_id[order], us[order], kind[order] == "start"
    first = _first(job, hour)
    heads, later = np.flatnonzero(first), np.flatnonzero(starts & ~first)
    yield pd.DataFrame({"job_id": job[heads], "event_id": event_id[heads], "us": us[heads], "starts": starts[heads], "last_starts": starts[_ends(first)], "verdict": None})
    if len(later):
        yield pd.DataFrame({"job_id": job[later], "event_id": event_id[later], "us": us[later], "starts": True, "last_starts": True,
                            "verdict": np.where(starts[later - 1], "DUPLICATE", "ACCEPTED")})


class _InFlight(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._active = handle.getValueState("active", "jobs array<long>, active array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for frame in rows:
                yield frame[["job_id", "event_id", "verdict"]]
            return
        job, event_id, us, starts, last = _columns(rows, "job_id", "event_id", "us", "starts", "last_starts")
        order = np.lexsort((event_id, us, job))
        job, event_id, starts, last = job[order], event_id[order], starts[order].astype(bool), last[order].astype(bool)
        first = _first(job)
        jobs, held = _arrays(self._active, np.int64, bool)
        active = np.append(False, last[:-1])
        there, at = _found(jobs, job[first])
        before = np.zeros(len(there), bool)
        before[there] = held[at[there]]
        active[first] = before
        ends = _ends(first)
        self._active.update(tuple(c.tolist() for c in _replaced(jobs, [held], job[ends], np.ones(len(ends), bool), [last[ends]])))
        yield pd.DataFrame({"job_id": job[starts], "event_id": event_id[starts], "verdict": np.where(active[starts], "DUPLICATE", "ACCEPTED")})

    def close(self) -> None:
        pass


def dedupe_active(calls: DataFrame) -> DataFrame:
    """Verdict per start: DUPLICATE while the job is active; a finish releases it, and a later start is accepted again.

    ``calls``: job_id, event_id, ts, kind (start or finish).  State sees one row per hour of a job.
    """
    slices = _hours(calls, "event_id", "kind").mapInPandas(_fold_calls, _CALL_SLICE)
    return _named(_bucketed(slices, F.col("verdict").isNotNull()).groupBy("bucket").transformWithStateInPandas(
        _InFlight(), "job_id long, event_id long, verdict string", "Append", "None"))


def dedupe_active_batch(calls: DataFrame) -> DataFrame:
    """The same over a finished table: any start leaves the job active, so only the call just before a start counts."""
    timed = calls.withColumn("_us", _micros(F.col("ts")))
    seen = previous_row(timed, ["job_id"], "_us", ["kind"], "_p", width=SLICE_US, ties=["event_id"])
    duplicate = F.coalesce(F.col("_p.kind") == "start", F.lit(False))
    return seen.filter("kind = 'start'").select("job_id", "event_id", F.when(duplicate, "DUPLICATE").otherwise("ACCEPTED").alias("verdict"))


# --- state machine -----------------------------------------------------------------------------------------------

def job_status(event) -> Column:
    """Status an event puts its job in; null for events that change nothing."""
    e = F.col(event) if isinstance(event, str) else event
    return (F.when(e == "job_submitted", "pending").when(e.isin("job_start", "stage_start", "stage_pass"), "processing")
            .when(e == "job_pass", "done").when(e.isin("job_fail", "stage_fail"), "fail"))


class _Machine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "status string, micros long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, micros, event_id = self._state.get() if self._state.exists() else (None, None, None)
        best, last = None if micros is None else (micros, event_id), None
        for frame in rows:
            row = frame.sort_values(["ts", "event_id"]).iloc[-1]
            at = (pd.Timestamp(row["ts"]).value // 1000, int(row["event_id"]))
            if best is None or at > best:
                best, last = at, row
        if last is None:
            return
        self._state.update((last["status"], *best))
        yield pd.DataFrame({"job_id": [key[0]], "old_status": [old], "status": [last["status"]], "updated_at": [last["ts"]], "event_id": [int(last["event_id"])]})

    def close(self) -> None:
        pass


def job_state(events: DataFrame) -> DataFrame:
    """Stream of status changes: one row per job and micro-batch with the old and the new status, its time and its event.

    The last change of a job is the one with the greatest (updated_at, event_id): times alone may be equal.
    """
    changes = events.withColumn("status", job_status("event")).filter("status IS NOT NULL").select("job_id", "event_id", "ts", "status")
    return changes.groupBy("job_id").transformWithStateInPandas(
        _Machine(), "job_id long, old_status string, status string, updated_at timestamp, event_id long", "Append", "None")


def job_state_batch(events: DataFrame) -> DataFrame:
    changes = events.withColumn("status", job_status("event")).filter("status IS NOT NULL")
    return changes.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))


def _net(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gains and losses of every status within a task: a row per status."""
    net: dict[str, int] = {}
    for f in frames:
        for status, n in f.groupby("status")["n"].sum().items():
            net[status] = net.get(status, 0) + int(n)
    if net:
        yield pd.DataFrame({"status": list(net), "n": list(net.values())})


class _Tally(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "jobs long, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, version = self._held.get() if self._held.exists() else (0, 0)
        for frame in rows:
            jobs += int(frame["n"].sum())
        self._held.update((jobs, version + 1))
        yield pd.DataFrame({"status": [key[0]], "jobs": [jobs], "version": [version + 1]})

    def close(self) -> None:
        pass


def live_counts(changes: DataFrame) -> DataFrame:
    """Jobs per status, chained to a stream of status changes: the new status gains one, the old loses one.

    Tasks net their moves first, so state takes a row per status and task.  Every micro-batch that moves a status appends its
    new count; of a status the greatest ``version`` is the latest.
    """
    moves = F.array_compact(F.array(F.struct(F.col("status").alias("status"), F.lit(1).cast("long").alias("n")),
                                    F.when(F.col("old_status").isNotNull(), F.struct(F.col("old_status").alias("status"), F.lit(-1).cast("long").alias("n")))))
    net = changes.select(F.inline(moves)).mapInPandas(_net, "status string, n long")
    return net.groupBy("status").transformWithStateInPandas(_Tally(), "status string, jobs long, version long", "Append", "None")


def any_active(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.max(F.col("status").isin("pending", "processing") & (F.col("jobs") > 0)), F.lit(False)).alias("any_active"))


# --- timeouts ----------------------------------------------------------------------------------------------------

_RUN_SLICE = "job_id long, event_id long, first_ms long, last_ms long, open boolean, settled boolean, last_us long"


def _fold_runs(limit_ms: int):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first time and the last call of every slice; starts that a later call of the slice shows to be overdue pass state by."""
        job, hour, event_id, us, kind = _columns(frames, "job_id", "slice", "event_id", "us", "kind")
        if not len(job):
            return
        order = np.lexsort((event_id, us, hour, job))
        job, hour, event_id, us, starts = job[order], hour[order], event_id[order], us[order], kind[order] == "start"
        ms, first = us // 1000, _first(job, hour)
        ends = _ends(first)
        last_us = np.repeat(us[ends], np.diff(np.append(np.flatnonzero(first), len(first))))
        late = np.flatnonzero(starts[:-1] & ~first[1:] & (np.diff(ms) > limit_ms))
        for at, head, settled in ((ends, np.flatnonzero(first), False), (late, late, True)):
            if len(at):
                yield pd.DataFrame({"job_id": job[at], "event_id": event_id[at], "first_ms": ms[head], "last_ms": ms[at], "open": starts[at], "settled": settled, "last_us": last_us[at]})
    return fold


class _Watchdog(StatefulProcessor):
    """The open start of each job and when it is due; a bucket's only timer is at its earliest due time."""

    def __init__(self, seconds: int):
        self._ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "jobs array<long>, event_id array<long>, due array<long>")

    def _keep(self, jobs: np.ndarray, event_id: np.ndarray, due: np.ndarray) -> None:
        if len(jobs):
            self._open.update((jobs.tolist(), event_id.tolist(), due.tolist()))
            self._handle.registerTimer(int(due.min()))
        elif self._open.exists():
            self._open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for frame in rows:
                yield frame[["job_id", "event_id"]]
            return
        job, event_id, begin, last, opens = _columns(rows, "job_id", "event_id", "first_ms", "last_ms", "open")
        order = np.lexsort((event_id, begin, job))
        job, event_id, begin, last, opens = job[order], event_id[order], begin[order], last[order], opens[order].astype(bool)
        first = _first(job)
        jobs, held_id, held_due = _arrays(self._open, np.int64, np.int64, np.int64)
        if len(jobs):
            self._handle.deleteTimer(int(held_due.min()))
        # the call that is open when each slice begins: the one before it, and for a job's first slice what state holds
        before_id, due = np.append(-1, event_id[:-1]), np.append(0, last[:-1] + self._ms)
        was_open = np.append(False, opens[:-1])
        there, at = _found(jobs, job[first])
        was_open[first] = there
        known = np.flatnonzero(first)[there]
        before_id[known], due[known] = held_id[at[there]], held_due[at[there]]
        found = was_open & (begin > due)
        ends = _ends(first)
        self._keep(*_replaced(jobs, [held_id, held_due], job[ends], opens[ends], [event_id[ends], last[ends] + self._ms]))
        yield pd.DataFrame({"job_id": job[found], "event_id": before_id[found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, event_id, due = _arrays(self._open, np.int64, np.int64, np.int64)
        done = due <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if done.any():
            self._keep(jobs[~done], event_id[~done], due[~done])
            yield pd.DataFrame({"job_id": jobs[done], "event_id": event_id[done]})

    def close(self) -> None:
        pass


def stuck_jobs(calls: DataFrame, seconds: int = STUCK_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Starts without any further call of their job within the limit, found by event-time timers.  State sees one row per hour of a job."""
    slices = _hours(calls, "event_id", "kind").mapInPandas(_fold_runs(seconds * 1000), _RUN_SLICE)
    timed = slices.withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", late)
    return _named(_bucketed(timed, F.col("settled")).groupBy("bucket").transformWithStateInPandas(
        _Watchdog(seconds), "job_id long, event_id long", "Append", "EventTime"))


def stuck_jobs_batch(calls: DataFrame, now: Column, seconds: int = STUCK_SECONDS) -> DataFrame:
    """The same over a finished table, with ``now`` for starts that are a job's last call."""
    def overdue(later: Column, start: Column) -> Column:
        return _micros(later) - _micros(start) > seconds * 1_000_000
    timed = calls.withColumn("_us", _micros(F.col("ts")))
    seen = previous_row(timed, ["job_id"], "_us", ["event_id", "ts", "kind"], "_p", width=SLICE_US, ties=["event_id"])
    between = seen.filter((F.col("_p.kind") == "start") & overdue(F.col("ts"), F.col("_p.ts"))).select("job_id", F.col("_p.event_id").alias("event_id"))
    last = calls.groupBy("job_id").agg(F.max_by(F.struct("event_id", "ts", "kind"), F.struct("ts", "event_id")).alias("_l"))
    open_ = last.filter((F.col("_l.kind") == "start") & overdue(now, F.col("_l.ts"))).select("job_id", F.col("_l.event_id").alias("event_id"))
    return between.unionByName(open_)


# --- cache -------------------------------------------------------------------------------------------------------

class _Cache(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", "first_id long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        request_id, ms = _columns(rows, "request_id", "ms")
        order = np.lexsort((request_id, ms))
        request_id, ms = request_id[order], ms[order]
        held = tuple(self._entry.get()) if self._entry.exists() else None
        if held:
            self._handle.deleteTimer(held[1] + 1)
        by, at = np.empty(len(ms), np.int64), 0
        while at < len(ms):  # a step per entry, not per request
            if held is None or ms[at] > held[1]:
                held = (int(request_id[at]), int(ms[at]) + self._ttl)
            end = int(np.searchsorted(ms, held[1], "right"))
            by[at:end] = held[0]
            at = end
        self._entry.update(held)
        self._handle.registerTimer(held[1] + 1)
        yield pd.DataFrame({"cache_key": key[0], "request_id": request_id, "cache_hit": by != request_id, "served_by": by})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # no later request can reach the entry: its state goes
        if self._entry.exists() and self._entry.get()[1] < expiredTimerInfo.getExpiryTimeInMs():
            self._entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_lookup(requests: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Hit flag per request (cache_key, request_id, ts) and the request whose entry serves it, in event time.

    An entry lives ``ttl_seconds`` from the request that missed, however often it is hit; the first request after that misses
    again.  Timers drop the state of entries that the watermark has passed.
    """
    timed = requests.select("cache_key", "request_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("cache_key").transformWithStateInPandas(
        _Cache(ttl_seconds * 1000), "cache_key string, request_id long, cache_hit boolean, served_by long", "Append", "EventTime")


# --- event log ---------------------------------------------------------------------------------------------------

def stage_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window, stage and kind; rows later than the watermark are dropped when streaming."""
    marked = _timed(events, late)
    return (marked.groupBy(F.window("ts", width, slide or width).alias("w"), "stage", "event").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "event", "n"))


_BURST = "job_id long, first_us long, last_us long, n long"


def _fold_bursts(gap_us: int):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bursts of every slice: first and last time and number of events."""
        job, hour, us = _columns(frames, "job_id", "slice", "us")
        if not len(job):
            return
        order = np.lexsort((us, hour, job))
        job, hour, us = job[order], hour[order], us[order]
        opens = _first(job, hour)
        opens[1:] |= np.diff(us) > gap_us
        starts, ends = np.flatnonzero(opens), _ends(opens)
        yield pd.DataFrame({"job_id": job[starts], "first_us": us[starts], "last_us": us[ends], "n": ends - starts + 1})
    return fold


class _Sessions(StatefulProcessor):
    """Open bursts of jobs; two of a job that are at most the gap apart are one, so they merge in any order.

    A bucket's only timer is at the earliest end of its bursts.
    """

    def __init__(self, gap_us: int):
        self._gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "jobs array<long>, first array<long>, last array<long>, n array<long>")

    def _due(self, last_us: np.ndarray) -> np.ndarray:
        return -(-(last_us + self._gap) // 1000)

    def _keep(self, *bursts: np.ndarray) -> None:
        if len(bursts[0]):
            self._open.update(tuple(c.tolist() for c in bursts))
            self._handle.registerTimer(int(self._due(bursts[2]).min()))
        elif self._open.exists():
            self._open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _arrays(self._open, *[np.int64] * 4)
        if len(held[0]):
            self._handle.deleteTimer(int(self._due(held[2]).min()))
        job, first, last, n = (np.concatenate(c) for c in zip(held, _columns(rows, "job_id", "first_us", "last_us", "n")))
        order = np.lexsort((first, job))
        job, first, last, n = job[order], first[order], last[order], n[order]
        reach = pd.Series(last).groupby(job).cummax().to_numpy()
        opens = _first(job)
        opens[1:] |= first[1:] - reach[:-1] > self._gap
        starts = np.flatnonzero(opens)
        self._keep(job[starts], first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(n, starts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, first, last, n = _arrays(self._open, *[np.int64] * 4)
        done = self._due(last) <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if done.any():
            self._keep(*[c[~done] for c in (job, first, last, n)])
            yield pd.DataFrame({"job_id": job[done], "first_us": first[done], "last_us": last[done], "n": n[done]})

    def close(self) -> None:
        pass


def job_sessions(events: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Bursts of events per job, each sent once the watermark has passed its end; state holds the few bursts that are open.

    An event that comes after its hour's watermark is left out; one that comes before joins or bridges bursts.
    """
    gap = gap_seconds * 1_000_000
    bursts = _hours(events).mapInPandas(_fold_bursts(gap), _BURST).withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", late)
    own = bursts.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)))
    closed = _named(own.groupBy("bucket").transformWithStateInPandas(_Sessions(gap), "job_id long, first_us long, last_us long, n long", "Append", "EventTime"))
    return closed.select("job_id", F.timestamp_micros("first_us").alias("session_start"), F.timestamp_micros(F.col("last_us") + gap).alias("session_end"), "n")


def live_failures(events: DataFrame) -> DataFrame:
    """Earliest failure by (ts, event_id) of every job and stage: one value per key as state, sent again only when an earlier
    one arrives (update mode), so the last row of a key is right however the log is cut into micro-batches."""
    bad = events.filter(F.col("event").isin("stage_fail", "job_fail"))
    return bad.groupBy("job_id", "stage").agg(F.min(F.struct("ts", "event_id")).alias("_f")).select("job_id", "stage", "_f.ts", "_f.event_id")


def job_sessions_batch(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """The same bursts over a finished table, without a window over a whole job: a session starts where the event before is
    more than ``gap_seconds`` away, as in ``session_window``, and its start is carried forward slice by slice."""
    gap = gap_seconds * 1_000_000
    timed = events.select("job_id", "ts", _micros(F.col("ts")).alias("_us"))
    seen = previous_row(timed, ["job_id"], "_us", ["_us"], "_p", width=SLICE_US)
    opens = F.when(F.coalesce(F.col("_us") - F.col("_p._us") > gap, F.lit(True)), F.col("_us"))
    run = running_max(seen.withColumn("_opens", opens).drop("_p"), ["job_id"], "_us", F.col("_opens"), "_start", include_current=True, width=SLICE_US)
    return (run.groupBy("job_id", "_start").agg(F.max("_us").alias("_end"), F.count("*").alias("n"))
            .select("job_id", F.timestamp_micros("_start").alias("session_start"), F.timestamp_micros(F.col("_end") + gap).alias("session_end"), "n"))


def job_timing(events: DataFrame) -> DataFrame:
    """Elapsed milliseconds and event counts per job."""
    kinds = ("stage_start", "stage_pass", "stage_fail")
    return events.groupBy("job_id").agg(
        ((_micros(F.max("ts")) - _micros(F.min("ts"))) / 1000).cast("long").alias("elapsed_ms"),
        *[F.count_if(F.col("event") == k).alias(k) for k in kinds])


def stage_pivot(events: DataFrame) -> DataFrame:
    kinds = ["job_start", "stage_start", "stage_pass", "stage_fail", "job_pass"]
    return events.groupBy("stage").pivot("event", kinds).count().fillna(0, kinds)


# --- catalog -----------------------------------------------------------------------------------------------------

def stream_upsert(incoming: DataFrame, folder: str, checkpoint: str, compared: list[str]):
    """Writer that upserts every micro-batch into a versioned catalog below ``folder``.

    Batch n reads version n and overwrites version n + 1 and its status table, so a re-run batch gives the same files.
    Version 0 must exist.  Returns the writer, to be started with a trigger.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        existing = batch.sparkSession.read.parquet(f"{folder}/catalog/v{batch_id}")
        merged, status = C.upsert_specs(existing, batch, compared=compared)
        merged.write.mode("overwrite").parquet(f"{folder}/catalog/v{batch_id + 1}")
        status.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/status/batch={batch_id}")
    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
