"""Job, request, result and stage queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlattice import vocab
from adlattice.operators import jobs as J
from adlattice.plans.fixtures import Tables
from adlattice.plans.registry import query


@query("p08_filter_jobs", """
WITH m AS (SELECT js.job_id, list(DISTINCT s.media) AS tm FROM fx_job_spec js JOIN fx_spec s USING (slug) GROUP BY 1)
SELECT j.job_id, j.status FROM fx_job j JOIN m USING (job_id)
WHERE (contains(lower(j.job_id::VARCHAR), 'camp1') OR contains(lower(advertiser), 'camp1') OR contains(lower(campaign), 'camp1'))
  AND list_contains(tm, 'naver') AND status = 'done' AND created_at::DATE >= DATE '1992-06-01' AND created_at::DATE <= DATE '2020-12-31'""")
def p_filter_jobs(t: Tables) -> DataFrame:
    media = (t.fx_job_spec.join(t.fx_spec, "slug").groupBy("job_id").agg(F.collect_set("media").alias("target_media")))
    jobs = t.fx_job.join(media, "job_id")
    return J.filter_jobs(jobs, q="CAMP1", media="naver", status="done", d_from="1992-06-01", d_to="2020-12-31").select("job_id", "status")


@query("p09_date_bounds", """
SELECT job_id, CASE job_id % 4 WHEN 0 THEN created_at::DATE WHEN 1 THEN date_trunc('week', created_at)::DATE WHEN 2 THEN date_trunc('month', created_at)::DATE END::VARCHAR AS d_from,
  CASE WHEN job_id % 4 < 3 THEN created_at::DATE END::VARCHAR AS d_to FROM fx_job""")
def p_date_bounds(t: Tables) -> DataFrame:
    preset = F.element_at(F.array(*map(F.lit, ["today", "week", "month", "never"])), (F.col("job_id") % 4 + 1).cast("int"))
    b = t.fx_job.withColumn("b", J.date_bounds(preset, F.to_date("created_at")))
    return b.select("job_id", F.col("b.d_from").cast("string").alias("d_from"), F.col("b.d_to").cast("string").alias("d_to"))


_REQ = """SELECT job_id, CASE job_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'clean_v1' WHEN 3 THEN 'legacy' ELSE '' END AS pipeline_version,
 CASE job_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'fill' END AS smart_fit_strength, CASE job_id % 4 WHEN 0 THEN 'top' WHEN 1 THEN '  ' END AS focal_position,
 CASE job_id % 6 WHEN 0 THEN 'flatten' WHEN 1 THEN '' WHEN 2 THEN 'odd' WHEN 3 THEN 'object-reflow' END AS psd_mode,
 CASE job_id % 7 WHEN 0 THEN 'ai-auto' WHEN 1 THEN 'cover' END AS resize_mode, CASE job_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ai_applied,
 CASE job_id % 4 WHEN 0 THEN 'a.PSD' WHEN 1 THEN 'b.png' WHEN 2 THEN 'c.psd.jpg' END AS file_name FROM {jobs}"""


def requests(t: Tables) -> DataFrame:
    return t.spark.sql(_REQ, jobs=t.fx_job)


@query("p10_normalise_request", f"""
WITH r AS ({_REQ.format(jobs='fx_job')})
SELECT job_id, CASE WHEN trim(coalesce(pipeline_version, '')) = '' THEN 'clean_v1' ELSE pipeline_version END AS pipeline_version,
  CASE WHEN trim(coalesce(pipeline_version, '')) = '' THEN 'default' WHEN pipeline_version = 'clean_v1' THEN 'explicit' END AS version_source,
  CASE WHEN pipeline_version = 'legacy' THEN 'UNSUPPORTED_VERSION' END AS error,
  CASE WHEN trim(coalesce(smart_fit_strength, '')) = '' THEN 'balanced' ELSE smart_fit_strength END AS smart_fit_strength,
  CASE WHEN trim(coalesce(focal_position, '')) = '' THEN 'center' ELSE focal_position END AS focal_position,
  CASE WHEN trim(coalesce(psd_mode, '')) = '' THEN 'artboard-first' ELSE psd_mode END AS psd_mode,
  CASE WHEN resize_mode = 'ai-auto' THEN 'ai-only' ELSE 'legacy' END AS render_policy, coalesce(ai_applied, false) AS ai_applied FROM r""")
def p_normalise(t: Tables) -> DataFrame:
    return J.normalise_request(requests(t)).select("job_id", "pipeline_version", "version_source", "error", "smart_fit_strength",
                                                   "focal_position", "psd_mode", "render_policy", "ai_applied")


@query("p11_source_type", f"""
WITH r AS ({_REQ.format(jobs='fx_job')})
SELECT job_id, CASE WHEN lower(file_name) LIKE '%.psd' THEN 'psd' ELSE 'image' END AS source_type,
  CASE WHEN lower(file_name) LIKE '%.psd' THEN CASE WHEN psd_mode IN ('flatten', 'layer-reflow', 'object-reflow') THEN psd_mode ELSE 'artboard-first' END END AS mode FROM r""")
def p_source_type(t: Tables) -> DataFrame:
    r = requests(t).withColumn("source_type", J.source_type("file_name"))
    return r.select("job_id", "source_type", J.psd_mode("source_type", "psd_mode").alias("mode"))


_RES = """SELECT job_id, ordinal, slug, valid, file_size, file_name, score, applied, CASE WHEN score % 9 <> 0 THEN concat('/out/', file_name) ELSE '' END AS file_path,
 CASE WHEN score % 2 = 0 THEN concat('/cand/', file_name) END AS selected_path, CASE score % 4 WHEN 0 THEN '주의' WHEN 1 THEN '품질 낮음' WHEN 2 THEN '정상' END AS quality_label FROM {res}"""
_RES_SQL = f"r AS ({_RES.format(res='fx_result')})"
_EFF = "CASE WHEN applied AND selected_path IS NOT NULL THEN selected_path ELSE file_path END"


def results(t: Tables) -> DataFrame:
    return t.spark.sql(_RES, res=t.fx_result)


@query("p12_effective_path", f"WITH {_RES_SQL} SELECT job_id, ordinal, {_EFF} AS path FROM r")
def p_effective(t: Tables) -> DataFrame:
    return results(t).select("job_id", "ordinal", J.effective_path().alias("path"))


@query("p13_result_by_file", """
WITH r AS (SELECT job_id, ordinal, slug, CASE WHEN ordinal > 3 THEN 'f2.png' ELSE file_name END AS file_name FROM fx_result)
SELECT job_id, file_name, ordinal, slug FROM r WHERE file_name = 'f2.png' OR (file_name = 'f1.png' AND job_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY job_id, file_name ORDER BY ordinal) = 1""")
def p_result_by_file(t: Tables) -> DataFrame:
    r = t.fx_result.withColumn("file_name", F.when(F.col("ordinal") > 3, "f2.png").otherwise(F.col("file_name")))
    jobs = t.fx_job.select("job_id")
    wanted = jobs.withColumn("file_name", F.lit("f2.png")).union(jobs.filter("job_id % 2 = 0").withColumn("file_name", F.lit("f1.png")))
    return J.result_by_file(r.select("job_id", "file_name", "ordinal", "slug"), wanted)


@query("p20_result_status", f"""WITH {_RES_SQL} SELECT job_id, ordinal, CASE WHEN valid = false THEN 'invalid' WHEN quality_label = '주의' THEN 'warn' WHEN quality_label = '품질 낮음' THEN 'quality-bad' ELSE 'ok' END AS badge FROM r""")
def p_result_status(t: Tables) -> DataFrame:
    return results(t).select("job_id", "ordinal", J.result_status().alias("badge"))


@query("j07_map_results", """
WITH r AS (SELECT f.job_id, f.ordinal, coalesce(f.slug, '') AS slug, s.width + CASE WHEN f.score % 10 = 0 THEN 1 ELSE 0 END AS width, s.height FROM fx_result f JOIN fx_spec s USING (slug)),
sp AS (SELECT 'spec' || sort_order AS spec_id, slug, width, height FROM fx_spec)
SELECT r.job_id, r.ordinal, r.slug, r.width, r.height, sp.spec_id FROM r LEFT JOIN sp ON sp.slug = r.slug AND sp.width = r.width AND sp.height = r.height""")
def j_map_results(t: Tables) -> DataFrame:
    sizes = t.fx_spec.select("slug", "width", "height")
    r = t.fx_result.join(sizes, "slug").select("job_id", "ordinal", "slug", (F.col("width") + F.when(F.col("score") % 10 == 0, 1).otherwise(0)).alias("width"), "height")
    once = t.fx_spec.selectExpr("slug", "width", "height", "concat('spec', sort_order) AS spec_id", "sort_order AS spec_ord")
    again = once.selectExpr("slug", "width", "height", "concat('later', spec_ord) AS spec_id", "spec_ord + 1000000000 AS spec_ord")
    return J.map_results(r, once.union(again)).select("job_id", "ordinal", "slug", "width", "height", "spec_id")


@query("a04_job_kpis", """
SELECT campaign, COUNT(*) AS total, COUNT(*) FILTER (status = 'done') AS done, COUNT(*) FILTER (status = 'fail') AS fail, COUNT(*) FILTER (status IN ('processing', 'pending')) AS processing,
 round(COUNT(*) FILTER (status = 'done') * 100.0::DOUBLE / COUNT(*), 1) AS done_rate, round(COUNT(*) FILTER (status = 'fail') * 100.0::DOUBLE / COUNT(*), 1) AS fail_rate,
 round(COUNT(*) FILTER (status IN ('processing', 'pending')) * 100.0::DOUBLE / COUNT(*), 1) AS processing_rate FROM fx_job GROUP BY campaign""")
def a_kpis(t: Tables) -> DataFrame:
    return J.job_kpis(t.fx_job, ["campaign"])


@query("a05_job_insight", """
WITH k AS (SELECT advertiser, COUNT(*) AS total, round(COUNT(*) FILTER (status = 'done') * 100.0::DOUBLE / COUNT(*), 1) AS dr, round(COUNT(*) FILTER (status = 'fail') * 100.0::DOUBLE / COUNT(*), 1) AS fr FROM fx_job GROUP BY 1)
SELECT advertiser, CASE WHEN total = 0 THEN 'none' WHEN dr >= 80 THEN 'excellent' WHEN fr >= 30 THEN 'failing' ELSE 'normal' END AS insight FROM k""")
def a_insight(t: Tables) -> DataFrame:
    return J.job_kpis(t.fx_job, ["advertiser"]).select("advertiser", J.job_insight().alias("insight"))


@query("a07_job_outcome", """
WITH runs AS (SELECT job_id, CASE WHEN job_id % 19 = 0 THEN 'worker down' END AS error FROM fx_job),
r AS (SELECT job_id, COUNT(*) AS results, COUNT(*) FILTER (valid = false) AS invalid, COUNT(*) FILTER (score % 30 = 0) AS missing FROM fx_result GROUP BY 1)
SELECT job_id, CASE WHEN error IS NOT NULL OR coalesce(invalid, 0) > 0 THEN 'fail' ELSE 'done' END AS status, CASE WHEN error IS NOT NULL THEN 0 ELSE coalesce(results, 0) END AS results,
 coalesce(invalid, 0) AS invalid, coalesce(missing, 0) AS missing, CASE WHEN error IS NOT NULL THEN error WHEN coalesce(invalid, 0) > 0 THEN 'size mismatch' END AS message
FROM runs LEFT JOIN r USING (job_id)""")
def a_outcome(t: Tables) -> DataFrame:
    runs = t.fx_job.selectExpr("job_id", "CASE WHEN job_id % 19 = 0 THEN 'worker down' END AS error")
    r = t.fx_result.withColumn("file_name", F.when(F.col("score") % 30 != 0, F.col("file_name")).otherwise(""))
    return J.job_outcome(r, runs)


@query("w04_name_results", """
WITH r AS (SELECT f.job_id, f.ordinal, CASE WHEN f.score % 8 = 0 THEN '' ELSE f.slug END AS slug, s.width, s.height, CASE WHEN f.score % 3 = 0 THEN '/o/a.b/r.jpg' ELSE '/o/a.b/result' END AS p FROM fx_result f JOIN fx_spec s USING (slug)),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal) - 1 AS i FROM r)
SELECT job_id, ordinal, format('{:02d}', i) || '_' || CASE WHEN slug = '' THEN 'spec' || i ELSE slug END || '_' || width || 'x' || height || CASE WHEN p LIKE '%.jpg' THEN '.jpg' ELSE '.png' END AS new_name FROM n""")
def w_names(t: Tables) -> DataFrame:
    r = t.fx_result.join(t.fx_spec.select("slug", "width", "height"), "slug").selectExpr(
        "job_id", "ordinal", "CASE WHEN score % 8 = 0 THEN '' ELSE slug END AS slug", "width", "height",
        "CASE WHEN score % 3 = 0 THEN '/o/a.b/r.jpg' ELSE '/o/a.b/result' END AS file_path")
    return J.name_results(r).select("job_id", "ordinal", "new_name")


@query("s11_bundle_manifest", f"""WITH {_RES_SQL}, e AS (SELECT *, {_EFF} AS path FROM r)
SELECT e.job_id, ordinal, file_name, path, advertiser || '_' || campaign || '.zip' AS archive FROM e JOIN fx_job j ON j.job_id = e.job_id WHERE j.status = 'done' AND coalesce(path, '') <> ''""")
def s_bundle(t: Tables) -> DataFrame:
    return J.bundle_manifest(t.fx_job, results(t))


@query("s13_pick_layout", """
WITH r AS (SELECT f.job_id, f.ordinal, s.width, s.height FROM fx_result f JOIN fx_spec s USING (slug)),
own AS (SELECT job_id, width || 'x' || height AS k FROM r WHERE ordinal % 2 = 0),
fl AS (SELECT DISTINCT job_id, k, '/l/' || job_id || '/layout_result_' || k || '.json' AS path FROM own),
cm AS (SELECT job_id, '/l/' || job_id || '/layout_result.json' AS path FROM fx_job WHERE job_id % 3 = 0)
SELECT r.job_id, r.ordinal, coalesce(fl.path, cm.path) AS layout_path FROM r LEFT JOIN fl ON fl.job_id = r.job_id AND fl.k = r.width || 'x' || r.height LEFT JOIN cm ON cm.job_id = r.job_id""")
def s_pick_layout(t: Tables) -> DataFrame:
    r = t.fx_result.join(t.fx_spec.select("slug", "width", "height"), "slug").select("job_id", "ordinal", "width", "height")
    own = r.filter("ordinal % 2 = 0").selectExpr("job_id", "concat(width, 'x', height) AS size_key", "concat('/l/', job_id, '/layout_result_', width, 'x', height, '.json') AS path")
    common = t.fx_job.filter("job_id % 3 = 0").selectExpr("job_id", "'' AS size_key", "concat('/l/', job_id, '/layout_result.json') AS path")
    return J.pick_layout(r, own.union(common)).select("job_id", "ordinal", "layout_path")


# --- stages ------------------------------------------------------------------------------------------------------

_STAGES = """SELECT job_id, event_id AS ord, stage, CASE WHEN event = 'stage_fail' AND event_id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS status,
 CASE WHEN event = 'stage_fail' THEN CASE WHEN event_id % 3 = 0 THEN '[SOLID_COLOR] plate is flat' WHEN event_id % 3 = 1 THEN 'no code here' ELSE '[DECODE_FAILED] bad [file] x' END END AS reason FROM {ev}"""
_ST_SQL = f"st AS ({_STAGES.format(ev='fx_event')})"


def stages(t: Tables) -> DataFrame:
    return t.spark.sql(_STAGES, ev=t.fx_event)


@query("w05_first_failure", f"""WITH {_ST_SQL} SELECT job_id, COUNT(*) FILTER (status = 'FAIL') AS failures, arg_min(stage, ord) FILTER (status = 'FAIL') AS failed_stage, arg_min(reason, ord) FILTER (status = 'FAIL') AS reason FROM st GROUP BY 1""")
def w_first_failure(t: Tables) -> DataFrame:
    return J.first_failure(stages(t))


@query("w07_fail_closed", f"""WITH {_ST_SQL}, f AS (SELECT *, coalesce(MAX(CASE WHEN status = 'FAIL' THEN 1 END) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM st)
SELECT job_id, ord, stage, status FROM f WHERE dead = 0""")
def w_fail_closed(t: Tables) -> DataFrame:
    return J.fail_closed(stages(t)).select("job_id", "ord", "stage", "status")


@query("f23_split_reason", f"""WITH {_ST_SQL} SELECT ord, CASE WHEN regexp_matches(reason, '^\\[[A-Z_]+\\] ') THEN regexp_extract(reason, '^\\[([A-Z_]+)\\] (.*)$', 1) END AS code,
 CASE WHEN regexp_matches(reason, '^\\[[A-Z_]+\\] ') THEN regexp_extract(reason, '^\\[([A-Z_]+)\\] (.*)$', 2) ELSE reason END AS detail FROM st""")
def f_split_reason(t: Tables) -> DataFrame:
    return stages(t).select("ord", J.split_reason("reason").alias("s")).select("ord", "s.*")


_RUNS = """SELECT job_id, ordinal, CASE WHEN ordinal % 4 = 0 THEN NULL ELSE slug END AS slug, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE 'meta' END AS media, CASE WHEN score % 7 <> 0 THEN score + 100 END AS width, 250 AS height,
 CASE WHEN valid THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN score % 11 <> 0 THEN concat('/o/', ordinal, '/result.png') END AS output_path, file_size, CASE WHEN valid = false THEN 'LAYOUT' END AS failed_stage, CASE WHEN valid = false THEN '[X] y' END AS reason FROM {res}"""


@query("w06_to_results", f"""
WITH q AS ({_RUNS.format(res='fx_result')}), o AS (SELECT *, status = 'PASS' AND coalesce(output_path, '') <> '' AS ok FROM q)
SELECT job_id, ordinal, coalesce(slug, '') AS slug, coalesce(media, '') AS media, coalesce(width, 0) AS width, height, CASE WHEN ok THEN output_path ELSE '' END AS file_path, CASE WHEN ok THEN 'result.png' ELSE '' END AS file_name,
 CASE WHEN ok THEN file_size END AS file_size, ok AS valid, '{vocab.RESULT_SOURCE}' AS render_source, false AS fallback_used, 'clean_v1' AS pipeline_version, CASE WHEN NOT ok THEN coalesce(failed_stage, '') END AS failed_stage,
 CASE WHEN NOT ok THEN coalesce(reason, 'UNKNOWN') END AS failure_code, CASE WHEN NOT ok THEN coalesce(slug, media, 'unknown') END AS missing_key FROM o""")
def w_to_results(t: Tables) -> DataFrame:
    return J.to_results(t.spark.sql(_RUNS, res=t.fx_result))


@query("q07_validate_stage", f"""WITH {_ST_SQL} SELECT ord, CASE WHEN status = 'FAIL' AND (reason IS NULL OR ord % 4 = 0) THEN 'FAIL_WITHOUT_REASON' END AS violation FROM st""")
def q_stage(t: Tables) -> DataFrame:
    s = stages(t).withColumn("reasons", F.when(F.col("ord") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array("reason"))))
    return s.select("ord", J.validate_stage().alias("violation"))


@query("q08_validate_results", f"""
WITH q AS (SELECT job_id, ordinal, CASE WHEN score % 10 = 0 THEN 'v0' ELSE 'clean_v1' END AS pipeline_version, score % 12 = 0 AS fallback_used, CASE WHEN score % 14 = 0 THEN NULL ELSE '{vocab.RESULT_SOURCE}' END AS render_source,
  valid, CASE WHEN score % 6 = 0 THEN NULL ELSE 5 END AS width, 5 AS height, CASE WHEN score % 4 = 0 THEN '' ELSE '/o/x.png' END AS file_path, CASE WHEN score % 3 = 0 THEN '' ELSE 'x.png' END AS file_name, CASE WHEN score % 5 = 0 THEN 0 ELSE 9 END AS file_size,
  CASE WHEN score % 2 = 0 THEN 'LAYOUT' END AS failed_stage, CASE WHEN score % 7 = 0 THEN 'C' END AS failure_code FROM fx_result)
SELECT job_id, ordinal, coalesce(array_to_string(list_filter([CASE WHEN pipeline_version <> 'clean_v1' THEN 'VERSION' END, CASE WHEN fallback_used THEN 'FALLBACK_USED' END, CASE WHEN render_source IS NULL THEN 'RENDER_SOURCE' END,
 CASE WHEN valid IS NULL THEN 'VALID_MISSING' END, CASE WHEN width IS NULL THEN 'SIZE_MISSING' END, CASE WHEN valid AND (file_path = '' OR file_name = '') THEN 'PASS_WITHOUT_PATH' END, CASE WHEN valid AND file_size <= 0 THEN 'PASS_WITHOUT_SIZE' END,
 CASE WHEN valid = false AND (file_path <> '' OR file_name <> '') THEN 'FAIL_WITH_PATH' END, CASE WHEN valid = false AND failed_stage IS NULL THEN 'FAIL_WITHOUT_STAGE' END, CASE WHEN valid = false AND failure_code IS NULL THEN 'FAIL_WITHOUT_CODE' END],
 lambda v: v IS NOT NULL), ','), '') AS violations FROM q""")
def q_results(t: Tables) -> DataFrame:
    q = t.fx_result.selectExpr(
        "job_id", "ordinal", "valid", "CASE WHEN score % 10 = 0 THEN 'v0' ELSE 'clean_v1' END AS pipeline_version", "score % 12 = 0 AS fallback_used",
        f"CASE WHEN score % 14 = 0 THEN NULL ELSE '{vocab.RESULT_SOURCE}' END AS render_source", "CASE WHEN score % 6 = 0 THEN NULL ELSE 5 END AS width", "5 AS height",
        "CASE WHEN score % 4 = 0 THEN '' ELSE '/o/x.png' END AS file_path", "CASE WHEN score % 3 = 0 THEN '' ELSE 'x.png' END AS file_name",
        "CASE WHEN score % 5 = 0 THEN 0 ELSE 9 END AS file_size", "CASE WHEN score % 2 = 0 THEN 'LAYOUT' END AS failed_stage", "CASE WHEN score % 7 = 0 THEN 'C' END AS failure_code")
    return q.select("job_id", "ordinal", F.array_join(J.result_violations(), ",").alias("violations"))


@query("a16_check_summary", """SELECT slug, COUNT(*) AS total, COUNT(*) FILTER (coalesce(valid, true)) AS "pass", COUNT(*) FILTER (NOT coalesce(valid, true)) AS fail, CASE WHEN COUNT(*) FILTER (NOT coalesce(valid, true)) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM fx_result GROUP BY slug""")
def a_checks(t: Tables) -> DataFrame:
    return J.check_summary(t.fx_result.select("slug", F.coalesce("valid", F.lit(True)).alias("passed")), ["slug"])


# --- order, pages, attempts, caches ------------------------------------------------------------------------------

@query("w08_sort_jobs", "SELECT job_id, advertiser, status FROM fx_job ORDER BY advertiser DESC, job_id")
def w_sort(t: Tables) -> DataFrame:
    return J.sort_jobs(t.fx_job, "advertiser").select("job_id", "advertiser", "status")


@query("w09_page", "SELECT job_id, campaign FROM fx_job ORDER BY campaign DESC, job_id LIMIT 20 OFFSET 40")
def w_page(t: Tables) -> DataFrame:
    return J.page(t.fx_job, "campaign", 3, 20).select("job_id", "campaign")


@query("w09_page_count", "SELECT status, ceil(COUNT(*) / 20)::BIGINT AS pages FROM fx_job GROUP BY status")
def w_page_count(t: Tables) -> DataFrame:
    return J.page_count(t.fx_job, 20, ["status"])


@query("w10_recent", "SELECT job_id, created_at FROM fx_job ORDER BY created_at DESC, job_id")
def w_recent(t: Tables) -> DataFrame:
    return J.recent(t.fx_job).select("job_id", "created_at")


def attempts(t: Tables) -> DataFrame:
    return t.fx_attempt.selectExpr("call_id", "CAST(attempt + 1 AS INT) AS attempt", "error_code IS NULL AS passed", "score / 100 AS score")


_ATT = "a AS (SELECT call_id, (attempt + 1)::INT AS attempt, error_code IS NULL AS passed, score / 100 AS score FROM fx_attempt)"


@query("w11_best_attempt", f"WITH {_ATT} SELECT call_id, attempt, passed, score FROM a QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY passed DESC, score DESC, attempt) = 1")
def w_best(t: Tables) -> DataFrame:
    return J.best_attempt(attempts(t))


@query("w12_attempts_run", f"""WITH {_ATT}, s AS (SELECT *, coalesce(MAX((passed AND score >= 0.85)::INT) OVER (PARTITION BY call_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM a)
SELECT call_id, attempt, passed, score FROM s WHERE stopped = 0 AND attempt <= 3""")
def w_attempts(t: Tables) -> DataFrame:
    return J.attempts_run(attempts(t))


@query("w13_best_mask", """
WITH m AS (SELECT ok AS image_id, ln AS idx, CASE WHEN q % 6 = 0 THEN 0.8::DOUBLE ELSE (q % 10) / 10 END AS score FROM fx_line)
SELECT image_id, idx, score FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, idx) = 1""")
def w_best_mask(t: Tables) -> DataFrame:
    m = t.fx_line.selectExpr("ok AS image_id", "ln AS idx", "CASE WHEN q % 6 <> 0 THEN (q % 10) / 10 END AS score")
    return J.best_mask(m, "image_id")


@query("w14_evict", """
WITH e AS (SELECT 'k' || event_id AS key, ts AS wrote FROM fx_event), n AS (SELECT MAX(wrote) AS now, COUNT(*) AS c FROM e), o AS (SELECT key FROM e ORDER BY wrote, key LIMIT 50)
SELECT e.key, epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', wrote))::BIGINT > 3600 AS expired, c >= 500 AND e.key IN (SELECT key FROM o) AS evicted FROM e, n""")
def w_evict(t: Tables) -> DataFrame:
    e = t.fx_event.selectExpr("concat('k', event_id) AS key", "ts AS at")
    return J.evict(e, e.agg(F.max("at").alias("m")).scalar()).select("key", "expired", "evicted")


@query("j19_cache_split", """
WITH c AS (SELECT sha256(text) AS cache_key, MIN(doc_id) FILTER (doc_id % 3 <> 0) AS cached FROM documents GROUP BY 1), r AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN '' ELSE sha256(text) END AS k FROM documents)
SELECT r.doc_id, c.cached IS NOT NULL AS cache_hit, c.cached AS cached_id FROM r LEFT JOIN c ON c.cache_key = r.k""")
def j_cache(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("cache_key"))
    cache = d.select("cache_key", F.col("doc_id").alias("analysis_id"), F.when(F.col("doc_id") % 3 != 0, "READY").otherwise("FAILED").alias("status"))
    req = d.withColumn("cache_key", F.when(F.col("doc_id") % 40 == 0, "").otherwise(F.col("cache_key")))
    return J.cache_split(req, cache).select("doc_id", "cache_hit", "cached_id")


@query("j26_share_by_hash", """
WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), r AS (SELECT content_hash, MIN(doc_id) AS analysed, COUNT(*) AS copies FROM h GROUP BY 1)
SELECT doc_id, analysed, copies FROM h JOIN r USING (content_hash)""")
def j_share(t: Tables) -> DataFrame:
    src = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    res = src.groupBy("content_hash").agg(F.min("doc_id").alias("analysed"), F.count("*").alias("copies"))
    return J.share_by_hash(src, res).select("doc_id", "analysed", "copies")


@query("j15_missing_ratio_types", """
WITH a AS (SELECT ok AS job_id, ln AS id, CASE pk % 5 WHEN 0 THEN 'square' WHEN 1 THEN 'vertical' WHEN 2 THEN 'horizontal' WHEN 3 THEN 'custom' ELSE 'unknown' END AS t, q % 2 = 0 AS sel FROM fx_line),
m AS (SELECT job_id, list_filter(['square', 'vertical', 'horizontal'], lambda k: NOT list_contains(coalesce(list(t) FILTER (sel), []), k)) AS miss FROM a GROUP BY 1)
SELECT job_id, coalesce(array_to_string(miss, ','), '') AS missing FROM m""")
def j_ratio_types(t: Tables) -> DataFrame:
    a = t.fx_line.selectExpr("ok AS job_id", "ln AS artboard_id", "CASE pk % 5 WHEN 0 THEN 'square' WHEN 1 THEN 'vertical' WHEN 2 THEN 'horizontal' WHEN 3 THEN 'custom' ELSE 'unknown' END AS artboard_type", "q % 2 = 0 AS sel")
    return J.missing_ratio_types(a.drop("sel"), a.filter("sel").select("job_id", "artboard_id"))
