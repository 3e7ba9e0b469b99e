"""Jobs, requests, results and stages: filters, roll-ups, naming and back-mapping."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adlattice import vocab
from adlattice.operators.scale import first_row, number_rows

BUSY = ("processing", "pending")


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def blank_to(col, default) -> Column:
    """The value, or the default when it is null or blank."""
    value = _c(col)
    return F.when(F.trim(value) == "", F.lit(None)).otherwise(value) if default is None else F.coalesce(
        F.when(F.trim(value) != "", value), F.lit(default))


# --- search ------------------------------------------------------------------------------------------------------

def filter_jobs(jobs: DataFrame, q: str | None = None, media: str | None = None, status: str | None = None,
                d_from: str | None = None, d_to: str | None = None) -> DataFrame:
    """All given conditions hold.  Text is looked for in id, advertiser and campaign, without regard to case."""
    out = jobs
    if q:
        needle = q.lower()
        cond = F.lit(False)
        for c in ("job_id", "advertiser", "campaign"):
            cond = cond | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle))
        out = out.filter(cond)
    if media:
        out = out.filter(F.array_contains("target_media", media))
    if status:
        out = out.filter(F.col("status") == status)
    day = F.to_date("created_at")
    if d_from:
        out = out.filter(day >= F.lit(d_from).cast("date"))
    if d_to:
        out = out.filter(day <= F.lit(d_to).cast("date"))
    return out


def date_bounds(preset, today) -> Column:
    """Struct d_from, d_to for today, week (from Monday) or month; null for any other word."""
    p, day = _c(preset), _c(today)
    start = (F.when(p == "today", day).when(p == "week", F.date_trunc("week", day).cast("date"))
             .when(p == "month", F.date_trunc("month", day).cast("date")))
    return F.struct(start.alias("d_from"), F.when(start.isNotNull(), day).alias("d_to"))


def sort_jobs(jobs: DataFrame, field: str, descending: bool = True) -> DataFrame:
    """Sorted by a field with blanks as empty text; the id settles ties."""
    key = F.coalesce(F.col(field).cast("string"), F.lit(""))
    return jobs.orderBy(key.desc() if descending else key.asc(), "job_id")


CUTS, AT_ONCE = 32, 100_000


def page(jobs: DataFrame, field: str, number: int, size: int, descending: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """Page ``number`` (from 1) of the jobs in the order of ``sort_jobs``, however deep it lies.

    ``CUTS`` rows, drawn by a hash of the id, cut the order into ranges; the rows of each range are counted, and only the
    ranges that the page lies in go on, until at most ``at_once`` rows are left to be sorted.  A pass is one scan that sends a count
    per range, so no task ever holds the rows before the page.  Rows alike in field and id stay together.
    """
    key = F.coalesce(F.col(field).cast("string"), F.lit(""))
    order = [key.desc() if descending else key.asc(), F.col("job_id").asc()]

    def reached(at) -> Column:
        """Whether a row comes at or behind the cut."""
        beyond = key < at["k"] if descending else key > at["k"]
        return beyond | ((key == at["k"]) & (F.col("job_id") >= at["job_id"]))
    rest, skip = jobs, (number - 1) * size
    while True:
        drawn = rest.select(key.alias("k"), "job_id").distinct().orderBy(F.xxhash64("job_id", F.lit(skip))).limit(CUTS)
        cuts = drawn.orderBy(F.col("k").desc() if descending else F.col("k").asc(), "job_id").collect()
        place = F.lit(0)
        for c in cuts:
            place = place + reached(c).cast("int")
        held = {r["place"]: r["n"] for r in rest.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        before, first, last, kept = 0, None, None, 0
        for i in range(len(cuts) + 1):
            n = held.get(i, 0)
            if before + n > skip and before < skip + size and n:
                first, last, kept = (i if first is None else first), i, kept + n
            elif first is None:
                skip, before = skip - n, before - n
            before += n
        if first is None:
            return rest.limit(0)
        if first > 0:
            rest = rest.filter(reached(cuts[first - 1]))
        if last < len(cuts):
            rest = rest.filter(~reached(cuts[last]))
        if kept <= max(at_once, size) or kept == sum(held.values()):
            return rest.orderBy(*order).offset(skip).limit(size)


def page_count(jobs: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("pages"))


def recent(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc_nulls_last(), "job_id")


# --- indicators --------------------------------------------------------------------------------------------------

def job_kpis(jobs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates in percent with one decimal; an empty table gives zeros."""
    counted = jobs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "fail").alias("fail"), F.count_if(F.col("status").isin(*BUSY)).alias("processing"))

    def rate(c: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), F.col("total")), F.lit(0.0)), 1)
    return counted.withColumns({f"{c}_rate": rate(c) for c in ("done", "fail", "processing")})


def job_insight() -> Column:
    """Alert level of a KPI row, the first that applies."""
    return (F.when(F.col("total") == 0, "none").when(F.col("done_rate") >= 80, "excellent")
            .when(F.col("fail_rate") >= 30, "failing").otherwise("normal"))


# --- requests ----------------------------------------------------------------------------------------------------

def normalise_request(req: DataFrame) -> DataFrame:
    """Defaults for blank fields; an unsupported version is marked with an error and keeps its value."""
    given = blank_to("pipeline_version", None)
    return req.withColumns({
        "smart_fit_strength": blank_to("smart_fit_strength", "balanced"),
        "focal_position": blank_to("focal_position", "center"),
        "psd_mode": blank_to("psd_mode", "artboard-first"),
        "version_source": F.when(given.isNull(), "default").when(given.isin(*vocab.VALID_VERSIONS), "explicit"),
        "error": F.when(given.isNotNull() & ~given.isin(*vocab.VALID_VERSIONS), "UNSUPPORTED_VERSION"),
        "render_policy": F.when(F.col("resize_mode") == "ai-auto", "ai-only").otherwise("legacy"),
        "ai_applied": F.coalesce("ai_applied", F.lit(False)),
        "pipeline_version": F.coalesce(given, F.lit(vocab.VALID_VERSIONS[0]))})


def source_type(name) -> Column:
    return F.when(F.coalesce(F.endswith(F.lower(_c(name)), F.lit(".psd")), F.lit(False)), "psd").otherwise("image")


def psd_mode(kind, mode) -> Column:
    m = _c(mode)
    allowed = F.when(m.isin("flatten", "layer-reflow", "object-reflow"), m).otherwise("artboard-first")
    return F.when(_c(kind) == "psd", allowed)


# --- results -----------------------------------------------------------------------------------------------------

def effective_path() -> Column:
    """The applied candidate's file when there is one, else the rendered file."""
    return F.when(F.coalesce("applied", F.lit(False)) & F.col("selected_path").isNotNull(), F.col("selected_path")).otherwise(F.col("file_path"))


def result_by_file(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """First result of a job with the wanted file name, for a table of (job_id, file_name)."""
    hits = results.join(wanted.select("job_id", "file_name").distinct(), ["job_id", "file_name"], "left_semi")
    return first_row(hits, ["job_id", "file_name"], ["ordinal"])


def result_status() -> Column:
    """Card badge: a size mismatch outranks the quality label."""
    return (F.when(~F.coalesce("valid", F.lit(True)), "invalid").when(F.col("quality_label") == "주의", "warn")
            .when(F.col("quality_label") == "품질 낮음", "quality-bad").otherwise("ok"))


def map_results(results: DataFrame, specs: DataFrame) -> DataFrame:
    """Spec of each result by slug and size, the first in spec order; a result without one keeps null."""
    lookup = (specs.select(F.coalesce("slug", F.lit("")).alias("slug"), "width", "height", "spec_id", "spec_ord")
              .groupBy("slug", "width", "height").agg(F.min_by("spec_id", "spec_ord").alias("spec_id")))
    return results.join(lookup, ["slug", "width", "height"], "left")


def job_outcome(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Status per job from its run and results; a null ``valid`` is not invalid.

    ``runs``: job_id, error (null when the run worked).
    """
    rolled = results.groupBy("job_id").agg(
        F.count("*").alias("results"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.coalesce("file_name", F.lit("")) == "").alias("missing"))
    joined = runs.join(rolled, "job_id", "left").fillna(0, ["results", "invalid", "missing"])
    status = F.when(F.col("error").isNotNull(), "fail").when(F.col("invalid") > 0, "fail").otherwise("done")
    keeps = F.when(F.col("error").isNotNull(), F.lit(0)).otherwise(F.col("results"))
    return joined.select("job_id", status.alias("status"), keeps.alias("results"), "invalid", "missing",
                         F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("invalid") > 0, F.lit("size mismatch")).alias("message"))


def name_results(results: DataFrame, keys: Sequence[str] = ("job_id",), order: str = "ordinal") -> DataFrame:
    """File name ``NN_slug_WxH.ext``; NN is the position in the job (two digits at least), also standing in for a blank slug."""
    n = number_rows(results, list(keys), order, "_n")
    index = F.col("_n") - 1
    slug = F.coalesce(F.when(F.col("slug") != "", F.col("slug")), F.concat(F.lit("spec"), index.cast("string")))
    ext = F.regexp_extract("file_path", r"(\.[^./]+)$", 1)
    ext = F.when(ext == "", ".png").otherwise(ext)
    return n.withColumn("new_name", F.concat(F.when(index < 10, "0").otherwise(""), index.cast("string"), F.lit("_"), slug, F.lit("_"), F.col("width").cast("string"),
                                             F.lit("x"), F.col("height").cast("string"), ext)).drop("_n")


def bundle_manifest(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Archive entries of finished jobs: effective path, entry name, archive name."""
    done = jobs.filter("status = 'done'").select("job_id", F.concat_ws("_", "advertiser", "campaign").alias("_a"))
    files = results.withColumn("path", effective_path()).filter(F.coalesce("path", F.lit("")) != "")
    return files.join(done, "job_id").select("job_id", "ordinal", "file_name", "path", F.concat("_a", F.lit(".zip")).alias("archive"))


def pick_layout(results: DataFrame, files: DataFrame) -> DataFrame:
    """Layout file per result: the one of its size, else the folder's common one (size key '')."""
    keyed = results.withColumn("_key", F.concat_ws("x", "width", "height"))
    own = files.filter("size_key <> ''").groupBy("job_id", F.col("size_key").alias("_key")).agg(F.min("path").alias("_own"))
    common = files.filter("size_key = ''").groupBy("job_id").agg(F.min("path").alias("_common"))
    return (keyed.join(own, ["job_id", "_key"], "left").join(common, "job_id", "left")
            .withColumn("layout_path", F.coalesce("_own", "_common")).drop("_key", "_own", "_common"))


# --- stages ------------------------------------------------------------------------------------------------------

def first_failure(stages: DataFrame, keys: Sequence[str] = ("job_id",), order: str = "ord") -> DataFrame:
    bad = F.col("status") == "FAIL"
    pick = F.min_by(F.when(bad, F.struct("stage", "reason")), F.when(bad, F.col(order)))
    return stages.groupBy(*keys).agg(pick.alias("_f"), F.count_if(bad).alias("failures")).select(
        *keys, "failures", F.col("_f.stage").alias("failed_stage"), F.col("_f.reason").alias("reason"))


def fail_closed(stages: DataFrame, keys: Sequence[str] = ("job_id",), order: str = "ord") -> DataFrame:
    """Stages that run: those up to the first FAIL.  One number per job is joined back, so no job is sorted whole."""
    stop = stages.filter("status = 'FAIL'").groupBy(*keys).agg(F.min(order).alias("_stop"))
    return stages.join(stop, list(keys), "left").filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def split_reason(reason) -> Column:
    """Struct code, detail of a ``[CODE] detail`` text; no code in other texts."""
    r = _c(reason)
    shape = r"(?s)^\[([A-Z_]+)\] (.*)$"
    return F.struct(F.nullif(F.regexp_extract(r, shape, 1), F.lit("")).alias("code"),
                    F.when(r.rlike(shape), F.regexp_extract(r, shape, 2)).otherwise(r).alias("detail"))


def to_results(runs: DataFrame) -> DataFrame:
    """Result rows of per-spec runs.  A run passes only with an output path; a failed row has empty paths."""
    ok = (F.col("status") == "PASS") & (F.coalesce("output_path", F.lit("")) != "")
    text = {c: F.coalesce(c, F.lit("")) for c in ("slug", "media")}
    missing = F.coalesce(F.nullif(text["slug"], F.lit("")), F.nullif(text["media"], F.lit("")), F.lit("unknown"))
    return runs.select(
        "job_id", "ordinal", text["slug"].alias("slug"), text["media"].alias("media"),
        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"),
        F.when(ok, F.col("output_path")).otherwise("").alias("file_path"),
        F.when(ok, F.regexp_extract("output_path", r"([^/]*)$", 1)).otherwise("").alias("file_name"),
        F.when(ok, F.col("file_size")).alias("file_size"), ok.alias("valid"),
        F.lit(vocab.RESULT_SOURCE).alias("render_source"), F.lit(False).alias("fallback_used"),
        F.lit(vocab.VALID_VERSIONS[0]).alias("pipeline_version"),
        F.when(~ok, F.coalesce("failed_stage", F.lit(""))).alias("failed_stage"),
        F.when(~ok, F.coalesce("reason", F.lit("UNKNOWN"))).alias("failure_code"), F.when(~ok, missing).alias("missing_key"))


def validate_stage() -> Column:
    """A failed stage must say why."""
    reasons = F.coalesce(F.size("reasons"), F.lit(0))
    return F.when((F.col("status") == "FAIL") & (reasons <= 0), "FAIL_WITHOUT_REASON").when(
        ~F.col("status").isin("PASS", "FAIL"), "UNKNOWN_STATUS")


def result_violations() -> Column:
    """Names of the contract rules a result row breaks, in rule order."""
    def empty(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""
    passed, failed = F.coalesce("valid", F.lit(False)), F.coalesce(~F.col("valid"), F.lit(False))
    rules = [
        (~F.col("pipeline_version").eqNullSafe(F.lit(vocab.VALID_VERSIONS[0])), "VERSION"),
        (F.coalesce("fallback_used", F.lit(True)), "FALLBACK_USED"),
        (~F.col("render_source").eqNullSafe(F.lit(vocab.RESULT_SOURCE)), "RENDER_SOURCE"),
        (F.col("valid").isNull(), "VALID_MISSING"), (F.col("width").isNull() | F.col("height").isNull(), "SIZE_MISSING"),
        (passed & (empty("file_path") | empty("file_name")), "PASS_WITHOUT_PATH"),
        (passed & (F.coalesce("file_size", F.lit(0)) <= 0), "PASS_WITHOUT_SIZE"),
        (failed & (~empty("file_path") | ~empty("file_name")), "FAIL_WITH_PATH"),
        (failed & empty("failed_stage"), "FAIL_WITHOUT_STAGE"), (failed & empty("failure_code"), "FAIL_WITHOUT_CODE")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def check_summary(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = checks.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("passed").alias("pass"),
                                    F.count_if(~F.col("passed")).alias("fail"))
    return out.withColumn("result", F.when(F.col("fail") == 0, "PASS").otherwise("FAIL"))


# --- attempts and caches -----------------------------------------------------------------------------------------

def best_attempt(attempts: DataFrame, key: str = "call_id") -> DataFrame:
    """Best passing attempt, or the best failing one; the earlier wins a tie."""
    return first_row(attempts, [key], [(~F.col("passed")).alias("p"), (-F.col("score")).alias("s"), F.col("attempt")])


def attempts_run(attempts: DataFrame, key: str = "call_id", enough: float = 0.85, most: int = 3) -> DataFrame:
    """Attempts which are made at all: up to the first good pass and at most ``most``."""
    stop = (attempts.filter(F.col("passed") & (F.col("score") >= enough)).groupBy(key)
            .agg(F.min("attempt").alias("_stop")))
    return (attempts.filter(F.col("attempt") <= most).join(stop, key, "left")
            .filter(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop"))).drop("_stop"))


def best_mask(masks: DataFrame, key: str) -> DataFrame:
    """Highest scored mask per detection, the lowest index on a tie; a missing score counts 0.8."""
    scored = masks.withColumn("score", F.coalesce("score", F.lit(0.8)))
    return first_row(scored, [key], [(-F.col("score")).alias("s"), F.col("idx")])


def evict(entries: DataFrame, now: Column, ttl: int = 3600, capacity: int = 500, batch: int = 50) -> DataFrame:
    """Entries marked expired (older than ttl seconds) and evicted (the oldest batch once capacity is reached)."""
    size = entries.agg(F.count("*").alias("n"))
    oldest = entries.orderBy("at", "key").limit(batch).select("key", F.lit(True).alias("_old"))
    marked = entries.join(oldest, "key", "left")
    return marked.withColumns({
        "expired": F.unix_timestamp(now) - F.unix_timestamp("at") > ttl,
        "evicted": F.coalesce("_old", F.lit(False)) & (size.scalar() >= capacity)}).drop("_old")


def cache_split(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with ``cache_hit`` and the cached id; a blank key never hits, and only READY entries count."""
    ready = (cache.filter((F.col("status") == "READY") & (F.coalesce("cache_key", F.lit("")) != ""))
             .groupBy("cache_key").agg(F.min("analysis_id").alias("cached_id")))
    return requests.join(ready, "cache_key", "left").withColumn("cache_hit", F.col("cached_id").isNotNull())


def share_by_hash(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Results of each distinct content handed to every source with that content."""
    return sources.join(results, "content_hash", "left")


def missing_ratio_types(artboards: DataFrame, selected: DataFrame, key: str = "job_id") -> DataFrame:
    """Ratio types none of the selected artboards has, as comma text."""
    chosen = artboards.join(selected, [key, "artboard_id"], "left_semi")
    kinds = F.array(*map(F.lit, vocab.RATIO_TYPES))
    have = chosen.groupBy(key).agg(F.collect_set(F.when(F.col("artboard_type").isin(*vocab.RATIO_TYPES), F.col("artboard_type"))).alias("_have"))
    return (artboards.select(key).distinct().join(have, key, "left")
            .select(key, F.array_join(F.array_except(kinds, F.coalesce("_have", F.array().cast("array<string>"))), ",").alias("missing")))
