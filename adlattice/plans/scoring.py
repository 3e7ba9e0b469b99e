"""Score, class and comparison queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlattice import vocab
from adlattice.functions import answers as A, geometry as G, scoring as S
from adlattice.operators import compare as K, objects as O
from adlattice.plans.fixtures import Tables
from adlattice.plans.registry import query

# --- mask quality ------------------------------------------------------------------------------------------------
# Every measurement of a detection, derived with integers from the object table.
_DET = """SELECT image_id, ord, CASE WHEN role = 'protected_subject' THEN 'person' WHEN ord % 2 = 0 THEN 'product' ELSE role END AS role, x, y, CASE WHEN conf_pct = 31 THEN 0 ELSE w END AS w, h, 700 AS canvas_w, 520 AS canvas_h,
 (conf_pct * 2 % 100) / 100 AS detection_conf, (conf_pct * 7 % 100) / 100 AS mask_conf, CASE WHEN conf_pct = 17 THEN 0 WHEN conf_pct = 18 THEN 350000 WHEN conf_pct = 19 THEN 100 ELSE CAST((w * h * (conf_pct % 12)) / 10 AS BIGINT) END AS mask_pixels,
 (conf_pct % 11) / 10 AS edge_sharpness, (conf_pct * ord) % 24 AS fragments, (conf_pct % 15) / 25 AS hand_overlap, (conf_pct % 13) / 40 AS person_overlap, CASE WHEN conf_pct % 3 = 0 THEN (conf_pct % 8) / 8 END AS native_iou,
 CASE WHEN conf_pct % 4 <> 0 THEN (conf_pct % 9) / 8 END AS top_cov, CASE WHEN conf_pct % 4 <> 0 THEN (conf_pct % 10) / 9 END AS bottom_cov, CASE WHEN conf_pct % 4 <> 0 THEN (conf_pct % 7) / 6 END AS continuity,
 conf_pct % 5 = 0 AS top_clipped, conf_pct % 6 = 0 AS bottom_clipped FROM {obj}"""
_DET_DUCK = _DET.format(obj="fx_object").replace("CAST((w * h * (conf_pct % 12)) / 10 AS BIGINT)", "trunc((w * h * (conf_pct % 12)) / 10)::BIGINT")
_FAIL_SQL = f"""d AS ({_DET_DUCK}),
a AS (SELECT *, mask_pixels / (canvas_w * canvas_h) AS area, CASE WHEN w * h > 0 THEN mask_pixels / (w * h) ELSE 1.0 END AS fill FROM d),
f AS (SELECT *, CASE WHEN detection_conf < 0.1 OR mask_conf < 0.1 THEN 'confidence_too_low' WHEN mask_pixels = 0 THEN 'empty_mask' WHEN area < 0.001 THEN 'mask_too_small' WHEN area > 0.9 THEN 'mask_too_large_canvas_fill'
  WHEN fragments > 20 THEN 'too_many_fragments' WHEN NOT (w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= canvas_w * 1.05 AND y + h <= canvas_h * 1.05) THEN 'invalid_bbox' END AS reason FROM a)"""


def detections(t: Tables) -> DataFrame:
    return t.spark.sql(_DET, obj=t.fx_object)


@query("c01_hard_fail", f"WITH {_FAIL_SQL} SELECT image_id, ord, reason FROM f")
def c_hard_fail(t: Tables) -> DataFrame:
    return detections(t).select("image_id", "ord", S.hard_fail().alias("reason"))


@query("c02_mask_score", f"""
WITH {_FAIL_SQL},
m AS (SELECT *, role = 'product' AND top_cov IS NOT NULL AS meas, h / nullif(w, 0) AS ar FROM f),
g AS (SELECT *, CASE WHEN meas THEN least((top_cov + bottom_cov) / 2, 1.0) * 8 ELSE 0 END AS tb, CASE WHEN meas THEN least((top_cov + bottom_cov) / 2, 1.0) * 8 + least(continuity, 1.0) * 7 ELSE 0 END AS comp,
  detection_conf * 25 AS g1, mask_conf * 20 AS g2, edge_sharpness * 15 AS g3, CASE WHEN fragments = 1 THEN 8.0 WHEN fragments <= 3 THEN 5.0 WHEN fragments <= 6 THEN 2.0 ELSE 0 END AS g4,
  CASE WHEN fill BETWEEN 0.30 AND 0.85 THEN 6.0 WHEN (fill >= 0.15 AND fill < 0.30) OR (fill > 0.85 AND fill <= 0.95) THEN 2.0 ELSE 0 END AS g5,
  CASE WHEN role = 'product' AND w > 0 AND h > 0 AND ar BETWEEN 0.4 AND 3.0 THEN 8.0 WHEN role = 'product' AND w > 0 AND h > 0 AND ((ar >= 0.2 AND ar < 0.4) OR (ar > 3.0 AND ar <= 5.0)) THEN 3.0 ELSE 0 END AS g6,
  CASE WHEN role = 'product' THEN coalesce(native_iou, 0) * 5 ELSE 0 END AS g7, CASE WHEN detection_conf >= 0.7 THEN 1.0 WHEN detection_conf >= 0.5 THEN 0.75 WHEN detection_conf >= 0.3 THEN 0.5 ELSE 0.25 END * 5 AS g8,
  CASE WHEN area > 0.6 THEN 15.0 WHEN area > 0.4 THEN 5.0 ELSE 0 END AS l1, CASE WHEN fill > 0.95 THEN 8.0 ELSE 0 END AS l2, CASE WHEN fragments > 6 THEN least((fragments - 6) * 2.0, 12.0) ELSE 0 END AS l3,
  ((x <= 5)::INT + (y <= 5)::INT + (x + w >= canvas_w - 5)::INT + (y + h >= canvas_h - 5)::INT) / 4 * 10 AS l4,
  CASE WHEN hand_overlap >= 0.1 THEN least(hand_overlap / 0.5, 1.0) * 25 WHEN hand_overlap >= 0.05 THEN hand_overlap / 0.1 * 8 ELSE 0 END AS l5,
  CASE WHEN person_overlap >= 0.1 THEN least(person_overlap / 0.5, 1.0) * 18 WHEN person_overlap >= 0.05 THEN person_overlap / 0.1 * 5 ELSE 0 END AS l6,
  CASE WHEN meas THEN (top_clipped::INT + bottom_clipped::INT) * 4.0 ELSE 0 END AS l7 FROM m)
SELECT image_id, ord, reason AS fail_reason, round(CASE WHEN reason IS NULL THEN greatest(0, least(100, g1 + g2 + g3 + g4 + g5 + g6 + g7 + g8 + comp - (l1 + l2 + l3 + l4 + l5 + l6 + l7))) ELSE 0 END::DOUBLE, 2) AS total,
  round(CASE WHEN reason IS NULL THEN comp ELSE 0 END::DOUBLE, 2) AS completeness, round(CASE WHEN reason IS NULL THEN -l5 ELSE 0 END::DOUBLE, 2) + 0 AS hand, round(CASE WHEN reason IS NULL THEN -l7 - l3 ELSE 0 END::DOUBLE, 2) + 0 AS clip_frag FROM g""")
def c_mask_score(t: Tables) -> DataFrame:
    d = detections(t).withColumn("s", S.mask_score())
    return d.select("image_id", "ord", "s.fail_reason", "s.total", F.col("s.gain_completeness").alias("completeness"),
                    (F.col("s.loss_hand") + 0.0).alias("hand"), (F.col("s.loss_clipping") + F.col("s.loss_fragments") + 0.0).alias("clip_frag"))


@query("c03_score_helpers", f"""
WITH d AS ({_DET_DUCK})
SELECT image_id, ord, CASE WHEN detection_conf >= 0.7 THEN 1.0 WHEN detection_conf >= 0.5 THEN 0.75 WHEN detection_conf >= 0.3 THEN 0.5 ELSE 0.25 END::DOUBLE AS consistency,
 ((x <= 5)::INT + (y <= 5)::INT + (x + w >= canvas_w - 5)::INT + (y + h >= canvas_h - 5)::INT) / 4 AS clip,
 round(greatest(0, least(x + w, 250 + 200) - greatest(x, 250)) * greatest(0, least(y + h, 150 + 150) - greatest(y, 150)) / greatest(1, w * h + 30000 - greatest(0, least(x + w, 450) - greatest(x, 250)) * greatest(0, least(y + h, 300) - greatest(y, 150))), 9) AS iou FROM d""")
def c_helpers(t: Tables) -> DataFrame:
    return detections(t).select("image_id", "ord", S.role_consistency("detection_conf").alias("consistency"), S.edge_clip("x", "y", "w", "h", "canvas_w", "canvas_h").alias("clip"),
                                F.round(G.iou("x", "y", "w", "h", F.lit(250), F.lit(150), F.lit(200), F.lit(150)), 9).alias("iou"))


_SRC = "CASE conf_pct % 6 WHEN 0 THEN 'psd_alpha' WHEN 1 THEN 'psd_isolated_layer' WHEN 2 THEN 'bbox_coarse' WHEN 3 THEN 'composite_fallback' WHEN 4 THEN 'other' ELSE 'visual_context' END"


@query("c04_native_score", f"""SELECT image_id, ord, round(greatest(0, least(100, CASE conf_pct % 6 WHEN 0 THEN 80 WHEN 1 THEN 95 WHEN 2 THEN 35 WHEN 3 THEN 10 WHEN 4 THEN 5 ELSE 20 END + (conf_pct * 2 - 50) * 0.2)), 2)::DOUBLE AS score FROM fx_object""")
def c_native(t: Tables) -> DataFrame:
    return t.fx_object.select("image_id", "ord", S.native_score(F.expr(_SRC), F.col("conf_pct") * 2).alias("score"))


@query("c05_score_detections", f"WITH {_FAIL_SQL} SELECT image_id, ord, CASE WHEN reason IS NULL THEN 'detection' ELSE 'warning' END AS kind, CASE WHEN reason IS NOT NULL THEN 'detection_hard_fail:' || ord || ':' || reason END AS warning FROM f")
def c_score_detections(t: Tables) -> DataFrame:
    kept, warnings = O.score_detections(detections(t), "ord")
    keep = kept.select("image_id", "ord", F.lit("detection").alias("kind"), F.lit(None).cast("string").alias("warning"))
    return keep.unionByName(warnings.select("image_id", "ord", F.lit("warning").alias("kind"), "warning"))


# --- compare -----------------------------------------------------------------------------------------------------
_AN = """SELECT job_id, CASE WHEN job_id % 7 <> 0 THEN job_id END AS analysis_id, job_id % 11 = 0 AS reflow_recommended, CASE job_id % 9 WHEN 0 THEN 'poster_info' WHEN 1 THEN 'horizontal_bands' ELSE 'single_subject' END AS layout_type,
 CASE job_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS text_density, CASE WHEN job_id % 3 = 0 THEN 'high' ELSE 'low' END AS edge_risk, job_id % 5 AS date_like, CASE WHEN job_id % 13 = 0 THEN 'product_focused' ELSE 'text_heavy' END AS creative_type,
 job_id % 2 AS bands FROM {jobs}"""
_CLS = """c AS (SELECT *, CASE WHEN analysis_id IS NULL THEN 'none' WHEN reflow_recommended OR layout_type <> 'single_subject' OR (text_density = 'high' AND edge_risk = 'high' AND date_like >= 2) THEN 'poster'
 WHEN creative_type = 'product_focused' OR text_density IN ('low', 'medium') THEN 'product' ELSE 'general' END AS cls FROM a)"""
_CAND = f"""a AS ({_AN.format(jobs='fx_job')}), {_CLS}, l AS (SELECT *, CASE cls WHEN 'poster' THEN list_concat(['safe','balanced','letterbox','object-aware-fit'], CASE WHEN bands > 0 THEN ['poster-reflow'] ELSE [] END)
 WHEN 'product' THEN ['safe','balanced','fill','center-crop','focus-fill','object-aware-fit'] WHEN 'general' THEN ['safe','balanced','fill','object-aware-fit'] ELSE ['safe','balanced','fill'] END AS st FROM c),
k AS (SELECT job_id, cls, unnest(st) AS strength, (generate_subscripts(st, 1) - 1)::INT AS pos FROM l)"""


def analyses(t: Tables) -> DataFrame:
    return t.spark.sql(_AN, jobs=t.fx_job)


@query("c06_creative_class", f"WITH a AS ({_AN.format(jobs='fx_job')}), {_CLS} SELECT job_id, cls AS class FROM c")
def c_class(t: Tables) -> DataFrame:
    return analyses(t).select("job_id", K.creative_class().alias("class"))


@query("c07_candidate_strengths", f"WITH {_CAND} SELECT job_id, pos, strength FROM k")
def c_strengths(t: Tables) -> DataFrame:
    return K.candidate_rows(analyses(t)).select("job_id", "pos", "strength")


_COMPARE_JSON = """SELECT job_id, CONCAT('{{"bestCandidate":"', CASE job_id % 5 WHEN 0 THEN 'fill' WHEN 1 THEN 'mystery' WHEN 2 THEN 'focus-fill' ELSE 'safe' END, '","candidates":[{{"strength":"safe","score":', CAST(job_id % 100 AS STRING), ',"pros":["p1","p2"],"cons":"none"}},{{"strength":"fill","score":"high"}},{{"strength":"safe","score":99}},{{"strength":"balanced","score":',
 CAST(job_id % 50 AS STRING), '.7,"cons":["c"]}}]}}') AS raw FROM {jobs}"""
_ANS = """n AS (SELECT job_id, 0 AS pos, 'safe' AS strength, (job_id % 100)::INT AS score, 2 AS np, 0 AS nc FROM fx_job UNION ALL SELECT job_id, 1, 'fill', 0, 0, 0 FROM fx_job UNION ALL SELECT job_id, 2, 'safe', 99, 0, 0 FROM fx_job UNION ALL SELECT job_id, 3, 'balanced', (job_id % 50)::INT, 0, 1 FROM fx_job)"""


def _parsed(t: Tables) -> DataFrame:
    return t.spark.sql(_COMPARE_JSON, jobs=t.fx_job).select("job_id", A.parse_compare(F.col("raw")).alias("c"))


def _answer_rows(t: Tables) -> DataFrame:
    return _parsed(t).select("job_id", F.posexplode("c.candidates").alias("pos", "e")).select("job_id", "pos", "e.*")


@query("f11_parse_compare", f"WITH {_ANS} SELECT job_id, CASE job_id % 5 WHEN 0 THEN 'fill' WHEN 1 THEN 'balanced' WHEN 2 THEN 'focus-fill' ELSE 'safe' END AS best, pos, strength, score, np AS n_pros, nc AS n_cons FROM n")
def f_compare(t: Tables) -> DataFrame:
    return _parsed(t).select("job_id", "c.best", F.posexplode("c.candidates").alias("pos", "e")).select(
        "job_id", "best", "pos", "e.strength", "e.score", F.size("e.pros").alias("n_pros"), F.size("e.cons").alias("n_cons"))


_SCORED = f"{_CAND}, {_ANS}, f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY job_id, strength ORDER BY pos) = 1), s AS (SELECT k.*, coalesce(f.score, 0) AS score, f.np, f.nc FROM k LEFT JOIN f USING (job_id, strength))"


def _scored(t: Tables) -> DataFrame:
    return K.join_scores(K.candidate_rows(analyses(t)).select("job_id", "pos", "strength"), _answer_rows(t).select("job_id", "pos", "strength", "score", "pros", "cons"), ["job_id"])


@query("j08_join_scores", f"WITH {_SCORED} SELECT job_id, pos, strength, score, np AS n_pros, nc AS n_cons FROM s")
def j_scores(t: Tables) -> DataFrame:
    return _scored(t).select("job_id", "pos", "strength", "score", F.when(F.col("pros").isNotNull(), F.size("pros")).alias("n_pros"), F.when(F.col("cons").isNotNull(), F.size("cons")).alias("n_cons"))


@query("j09_best_score", f"""WITH {_SCORED}, v AS (SELECT job_id, CASE job_id % 5 WHEN 0 THEN 'fill' WHEN 1 THEN 'balanced' WHEN 2 THEN 'focus-fill' ELSE 'safe' END AS best FROM fx_job)
SELECT v.job_id, v.best, coalesce(s.score, 0) AS best_score FROM v LEFT JOIN s ON s.job_id = v.job_id AND s.strength = v.best""")
def j_best(t: Tables) -> DataFrame:
    return K.best_score(_parsed(t).select("job_id", F.col("c.best").alias("best")), _scored(t), ["job_id"])


_APPLY = """ch AS (SELECT job_id * 10 + ordinal AS choice_id, job_id, slug AS spec_id, CASE WHEN ordinal = 5 THEN 'gone' ELSE 'c' || job_id || '-' || CASE WHEN ordinal = 3 THEN 1 ELSE ordinal END END AS compare_id, CASE WHEN score % 4 = 0 THEN 'letterbox' ELSE 'safe' END AS candidate FROM fx_result),
cp AS (SELECT 'c' || job_id || '-' || ordinal AS compare_id, CASE WHEN ordinal = 4 THEN job_id + 1 ELSE job_id END AS job_id, slug AS spec_id FROM fx_result WHERE ordinal < 5),
jd AS (SELECT ch.*, CASE WHEN cp.job_id IS NULL THEN 'COMPARE_NOT_FOUND' WHEN cp.job_id <> ch.job_id THEN 'JOB_MISMATCH' WHEN cp.spec_id <> ch.spec_id THEN 'SPEC_MISMATCH' WHEN ch.candidate <> 'safe' THEN 'CANDIDATE_NOT_FOUND' END AS error FROM ch LEFT JOIN cp USING (compare_id))"""


def _choices(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    r = t.fx_result
    choices = r.selectExpr("job_id * 10 + ordinal AS choice_id", "job_id", "slug AS spec_id", "CASE WHEN ordinal = 5 THEN 'gone' ELSE concat('c', job_id, '-', CASE WHEN ordinal = 3 THEN 1 ELSE ordinal END) END AS compare_id",
                           "CASE WHEN score % 4 = 0 THEN 'letterbox' ELSE 'safe' END AS candidate")
    compares = r.filter("ordinal < 5").selectExpr("concat('c', job_id, '-', ordinal) AS compare_id", "CASE WHEN ordinal = 4 THEN job_id + 1 ELSE job_id END AS job_id", "slug AS spec_id")
    cands = compares.selectExpr("compare_id", "'safe' AS strength", "1 AS pos", "concat('/c/', compare_id, '.png') AS file_path")
    return choices, compares, cands, r.selectExpr("job_id", "ordinal", "slug AS spec_id")


@query("j10_apply_judged", f"WITH {_APPLY} SELECT choice_id, error FROM jd")
def j_apply_judged(t: Tables) -> DataFrame:
    return K.apply_candidate(*_choices(t))[0].select("choice_id", "error")


@query("j10_apply_candidate", f"""WITH {_APPLY}, l AS (SELECT * FROM jd WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY job_id, spec_id ORDER BY choice_id DESC) = 1), r AS (SELECT job_id, ordinal, slug AS spec_id, row_number() OVER (PARTITION BY job_id, slug ORDER BY ordinal) AS rn FROM fx_result)
SELECT r.job_id, r.ordinal, r.spec_id, l.compare_id AS selected_compare, '/c/' || l.compare_id || '.png' AS selected_path, l.compare_id IS NOT NULL AS applied FROM r LEFT JOIN l ON l.job_id = r.job_id AND l.spec_id = r.spec_id AND rn = 1""")
def j_apply(t: Tables) -> DataFrame:
    return K.apply_candidate(*_choices(t))[1].select("job_id", "ordinal", "spec_id", "selected_compare", "selected_path", "applied")


@query("j25_job_analysis", f"""
WITH a AS ({_AN.format(jobs='fx_job')}), q AS (SELECT j.job_id, j.job_id % 17 <> 0 AS known, CASE WHEN ordinal = 6 THEN 'nope' ELSE slug END AS slug, ordinal, CASE WHEN j.job_id % 3 = 0 THEN j.job_id END AS aid FROM fx_job_spec j)
SELECT q.job_id, q.ordinal, a.analysis_id, a.layout_type, CASE WHEN NOT known THEN 'JOB_NOT_FOUND' WHEN q.slug = 'nope' THEN 'SPEC_NOT_FOUND' END AS error FROM q LEFT JOIN a ON a.analysis_id = q.aid""")
def j_analysis(t: Tables) -> DataFrame:
    q = t.fx_job_spec.selectExpr("job_id", "job_id % 17 <> 0 AS job_known", "CASE WHEN ordinal = 6 THEN 'nope' ELSE slug END AS slug", "ordinal", "CASE WHEN job_id % 3 = 0 THEN job_id END AS analysis_id")
    return K.job_analysis(q, analyses(t).select("analysis_id", "layout_type"), t.fx_spec).select("job_id", "ordinal", "analysis_id", "layout_type", "error")


# --- classes -----------------------------------------------------------------------------------------------------
_FIT = "SELECT job_id, ordinal, CASE WHEN score % 10 = 0 THEN NULL ELSE score / 100 END AS match_score, CASE WHEN score % 3 = 0 THEN 'inferred' ELSE 'exact' END AS match_type, CASE score % 4 WHEN 0 THEN '1200x628' WHEN 1 THEN '300x1050' WHEN 2 THEN 'big' END AS artboard_size, CASE WHEN score % 7 = 0 THEN 0 ELSE 300 END AS width, 250 AS height FROM {res}"


@query("c13_artboard_fit", f"""
WITH r AS ({_FIT.format(res='fx_result')}), g AS (SELECT *, CASE artboard_size WHEN '1200x628' THEN 1200 / 628 WHEN '300x1050' THEN 300 / 1050 END AS sr, width / height AS tr FROM r), k AS (SELECT *, sr IS NOT NULL AND width <> 0 AND match_score IS NOT NULL AND match_score <= 0.999 AS ok FROM g)
SELECT job_id, ordinal, CASE WHEN match_score IS NULL THEN NULL WHEN match_score < 0.5 THEN 'bad' WHEN match_score < 0.8 OR match_type = 'inferred' THEN 'warn' ELSE 'good' END AS level,
 CASE WHEN ok THEN round(sr, 2) END AS src_ratio, CASE WHEN ok THEN round(abs(sr - tr), 2) END AS diff, CASE WHEN ok THEN abs(sr - tr) > 0.5 END AS large FROM k""")
def c_artboard(t: Tables) -> DataFrame:
    r = t.spark.sql(_FIT, res=t.fx_result).withColumn("g", S.ratio_gap())
    return r.select("job_id", "ordinal", S.artboard_level().alias("level"), "g.src_ratio", "g.diff", "g.large")


@query("c14_score_bands", "SELECT job_id, ordinal, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'mid' ELSE 'low' END AS band, CASE WHEN score % 9 = 0 THEN '' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'bad' END AS quality FROM fx_result")
def c_bands(t: Tables) -> DataFrame:
    return t.fx_result.select("job_id", "ordinal", S.score_band("score").alias("band"), S.quality_band(F.when(F.col("score") % 9 != 0, F.col("score"))).alias("quality"))


@query("c15_call_outcome", """
WITH p AS (SELECT call_id, MAX(coalesce(error_code, '')) FILTER (attempt = 0) AS e1, MAX(coalesce(error_code, '')) FILTER (attempt = 1) AS e2 FROM fx_attempt GROUP BY 1),
o AS (SELECT *, CASE WHEN e1 = '' THEN 'ok' WHEN e1 = 'unsupported_parameter' THEN CASE WHEN e2 = '' THEN 'param_corrected' ELSE 'param_retry_failed' END WHEN e1 = 'model_not_found' THEN CASE WHEN e2 = '' THEN 'fallback' ELSE 'fallback_failed' END ELSE 'error' END AS outcome FROM p)
SELECT call_id, outcome, CASE WHEN outcome IN ('ok', 'param_corrected') THEN 'gpt-5-mini' WHEN outcome = 'fallback' THEN 'gpt-4.1-mini' END AS used_model, CASE outcome WHEN 'ok' THEN 'max_completion_tokens' WHEN 'param_corrected' THEN 'max_tokens' WHEN 'fallback' THEN 'max_tokens' END AS token_parameter,
 CASE outcome WHEN 'fallback' THEN e1 WHEN 'param_corrected' THEN 'param_corrected:max_completion_tokens→max_tokens' END AS reason FROM o""")
def c_calls(t: Tables) -> DataFrame:
    return K.call_outcome(t.fx_attempt, "gpt-5-mini", "gpt-4.1-mini")


@query("c16_error_code", """SELECT call_id, attempt, CASE attempt % 5 WHEN 0 THEN coalesce(error_code, 'server_error') WHEN 1 THEN 'server_error' ELSE 'unknown' END AS code FROM fx_attempt""")
def c_error(t: Tables) -> DataFrame:
    code = F.coalesce(F.concat(F.lit('"'), "error_code", F.lit('"')), F.lit("null"))
    body = (F.when(F.col("attempt") % 5 == 0, F.concat(F.lit('{"error":{"code":'), code, F.lit(',"type":"server_error"}}')))
            .when(F.col("attempt") % 5 == 1, F.lit('{"error":{"type":"server_error"}}')).when(F.col("attempt") % 5 == 2, F.lit("<html>")).when(F.col("attempt") % 5 == 3, F.lit("")))
    return t.fx_attempt.select("call_id", "attempt", A.error_code(body).alias("code"))


_MSGS = ["Invalid version 4", "unsupported key", "bad Signature", "Unexpected end of data", "cannot decode composite", "something else"]


@query("c17_open_failure", """SELECT ok AS psd_id, ln, CASE q % 6 WHEN 0 THEN CASE WHEN pk % 3 = 0 THEN 'unsupported_internal_descriptor_version' ELSE CASE pk % 3 WHEN 1 THEN 'malformed_image_resource' ELSE 'unknown_parser_error' END END
 WHEN 1 THEN CASE pk % 3 WHEN 0 THEN 'unsupported_tagged_block' WHEN 1 THEN 'malformed_image_resource' ELSE 'unknown_parser_error' END WHEN 2 THEN 'invalid_psd_header' WHEN 3 THEN 'truncated_file' WHEN 4 THEN 'composite_decode_error'
 ELSE CASE pk % 3 WHEN 1 THEN 'malformed_image_resource' ELSE 'unknown_parser_error' END END AS category FROM fx_line""")
def c_open(t: Tables) -> DataFrame:
    kind = F.when(F.col("pk") % 3 == 0, "AssertionError").when(F.col("pk") % 3 == 1, "ValueError").otherwise("OSError")
    msg = F.element_at(F.array(*map(F.lit, _MSGS)), F.col("q") % 6 + 1)
    return t.fx_line.select(F.col("ok").alias("psd_id"), "ln", S.open_failure(kind, msg).alias("category"))
