"""Queries over detected objects and model answers."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlattice import vocab
from adlattice.functions import answers as A, text as T
from adlattice.operators import objects as O
from adlattice.operators.terms import scan_term_table
from adlattice.plans.fixtures import Tables
from adlattice.plans.registry import query

_OBJ = "fx_object"


def objects(t: Tables) -> DataFrame:
    return t.fx_object.withColumns({"object_id": F.concat(F.lit("o"), F.col("ord").cast("string")),
                                    "removable": F.col("role") != "protected_subject"})


def images(t: Tables) -> DataFrame:
    return t.fx_image.select("image_id", F.col("width").alias("image_w"), F.col("height").alias("image_h"))


# --- model answers -----------------------------------------------------------------------------------------------
# Every answer text is made from columns; the oracle states the expected row from the same columns.

_ANSWER = r"""SELECT image_id, ord, CONCAT('{"creativeType":"', CASE ord % 3 WHEN 0 THEN 'text_heavy' WHEN 1 THEN 'nonsense' ELSE 'poster_info' END, '","textDensity":"', CASE conf_pct % 3 WHEN 0 THEN 'high' ELSE 'dense' END,
 '","edgeRisk":5,"resizeMode":"cover","layoutType":"horizontal_bands","reflowRecommended":', CASE conf_pct % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"TRUE"' WHEN 2 THEN '7' ELSE 'false' END, ',"confidence":', CASE WHEN conf_pct % 5 = 0 THEN '"sure"' ELSE CAST(conf_pct AS STRING) END,
 ',"warnings":', CASE WHEN ord % 2 = 0 THEN '["a","b"]' ELSE '"none"' END,
 ',"detectedElements":[{"id":"e1","type":"', role, '","label":"L","group":"', CASE WHEN conf_pct % 2 = 0 THEN 'cta' ELSE 'zzz' END, '","importance":"', CASE WHEN required THEN 'required' ELSE '?' END, '","bbox":{"x":', CAST(x AS STRING), ',"y":"bad","width":', CAST(w AS STRING), '.9,"height":', CAST(h AS STRING), '}}],',
 '"elementGroups":', CASE WHEN ord % 5 = 0 THEN '"x"' ELSE CONCAT('[{"id":"g', CAST(ord AS STRING), '","name":"N","importance":"priority","elementIds":["e1","e2"]}]') END,
 ',"contentBands":[{"id":"b1","role":"headline","y1":', CAST(y AS STRING), ',"y2":', CAST(y + h - 60 AS STRING), ',"canDrop":true},{"id":"b2","y1":"0","y2":10},{"id":"b3","role":"zz","y1":0,"y2":', CAST(w AS STRING), ',"importance":"optional","reflowPriority":"hero","targetPlacement":"left"}]}') AS raw, role, required, conf_pct, x, y, w, h FROM {obj}"""


def _answers(t: Tables) -> DataFrame:
    text = _ANSWER.replace("{obj}", "<obj>").replace("{", "{{").replace("}", "}}").replace("<obj>", "{obj}")
    return t.spark.sql(text, obj=t.fx_object)


@query("f01_parse_analysis", f"""
SELECT image_id, ord, CASE ord % 3 WHEN 0 THEN 'text_heavy' WHEN 1 THEN 'balanced_mix' ELSE 'poster_info' END AS creative_type, CASE WHEN conf_pct % 3 = 0 THEN 'high' ELSE 'medium' END AS text_density, 'medium' AS edge_risk, 'center' AS subject_position,
 'cover' AS resize_mode, 'balanced' AS strength, 'horizontal_bands' AS layout_type, conf_pct % 4 < 2 AS reflow_recommended, CASE WHEN conf_pct % 5 <> 0 THEN conf_pct::DOUBLE END AS confidence, CASE WHEN ord % 2 = 0 THEN 2 ELSE 0 END AS n_warnings FROM {_OBJ}""")
def f_parse_analysis(t: Tables) -> DataFrame:
    rows = _answers(t).select("image_id", "ord", A.read_analysis(F.col("raw")).alias("r")).withColumns(A.analysis(F.col("r")))
    return rows.select(
        "image_id", "ord", "creative_type", "text_density", "edge_risk", "subject_position", "resize_mode", "strength", "layout_type", "reflow_recommended", "confidence",
        F.size("warnings").alias("n_warnings"))


@query("f02_parse_elements", f"""
SELECT image_id, ord, 'e1' AS id, CASE WHEN role IN ('product', 'logo', 'badge') THEN role ELSE 'decoration' END AS type, 'L' AS label, CASE WHEN conf_pct % 2 = 0 THEN 'cta' ELSE 'decorations' END AS "group",
 CASE WHEN required THEN 'required' ELSE 'optional' END AS importance, x, 0 AS y, w, h FROM {_OBJ}""")
def f_parse_elements(t: Tables) -> DataFrame:
    e = _answers(t).select("image_id", "ord", F.explode(A.parse_elements(F.get_json_object("raw", "$.detectedElements"))).alias("e"))
    return e.select("image_id", "ord", "e.id", "e.type", "e.label", "e.group", "e.importance", "e.bbox.*")


@query("f03_parse_groups", f"SELECT image_id, ord, 'g' || ord AS id, 'N' AS name, 'priority' AS importance, 'e1,e2' AS element_ids FROM {_OBJ} WHERE ord % 5 <> 0")
def f_parse_groups(t: Tables) -> DataFrame:
    g = _answers(t).select("image_id", "ord", F.explode(A.parse_groups(F.get_json_object("raw", "$.elementGroups"))).alias("g"))
    return g.select("image_id", "ord", "g.id", "g.name", "g.importance", F.array_join("g.element_ids", ",").alias("element_ids"))


@query("f04_parse_bands", f"""
SELECT image_id, ord, 'b1' AS id, 'headline' AS role, y AS y1, y + h - 60 AS y2, 'priority' AS importance, 'support' AS reflow_priority, true AS can_drop, 'center' AS target_placement FROM {_OBJ} WHERE h > 60
UNION ALL SELECT image_id, ord, 'b3', 'description', 0, w, 'optional', 'hero', false, 'left' FROM {_OBJ}""")
def f_parse_bands(t: Tables) -> DataFrame:
    b = _answers(t).select("image_id", "ord", F.explode(A.parse_bands(F.get_json_object("raw", "$.contentBands"))).alias("b"))
    return b.select("image_id", "ord", *[f"b.{c}" for c in ("id", "role", "y1", "y2", "importance", "reflow_priority", "can_drop", "target_placement")])


@query("f05_enum_defaults", f"""
SELECT image_id, ord, CASE WHEN role IN ({", ".join(repr(v) for v in vocab.ELEMENT_TYPES)}) THEN role ELSE 'decoration' END AS type,
 CASE WHEN role IN ({", ".join(repr(v) for v in vocab.BAND_ROLES)}) THEN role ELSE 'description' END AS band FROM {_OBJ}""")
def f_enums(t: Tables) -> DataFrame:
    return t.fx_object.select("image_id", "ord", A.one_of(F.col("role"), vocab.ELEMENT_TYPES, "decoration").alias("type"),
                              A.one_of(F.col("role"), vocab.BAND_ROLES, "description").alias("band"))


_PSD_ROLE = "CASE conf_pct % 7 WHEN 0 THEN 'Hero ' WHEN 1 THEN 'headline' WHEN 2 THEN 'BODY' WHEN 3 THEN 'btn' WHEN 4 THEN 'brand' WHEN 5 THEN 'badge' ELSE 'Badge' END"
_PSD_ROLE_OUT = "CASE conf_pct % 7 WHEN 0 THEN 'main_image' WHEN 1 THEN 'title' WHEN 2 THEN 'body_text' WHEN 3 THEN 'cta' WHEN 4 THEN 'logo' WHEN 5 THEN 'badge' ELSE 'unknown' END"


def _psd_answers(t: Tables) -> DataFrame:
    """Fenced every third row, not JSON every seventh."""
    o = t.fx_object.withColumn("psd_role", F.expr(_PSD_ROLE))
    js = F.concat(F.lit('{"objects":[{"id":"a'), "ord", F.lit('","role":"'), "psd_role", F.lit('","confidence":'), F.col("conf_pct").cast("string"),
                  F.lit(',"canScale":"no","safeZoneRequired":'), F.col("required").cast("string"), F.lit(',"reflowBehavior":"move_only","bbox":{"x":'), "x",
                  F.lit(',"y":'), "y", F.lit(',"width":'), "w", F.lit(',"height":'), "h", F.lit("}}]}"))
    raw = (F.when(F.col("conf_pct") % 7 == 6, F.concat(F.lit("Sorry, "), js)).when(F.col("ord") % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```\n"))).otherwise(js))
    return o.withColumn("raw", raw)


@query("f06_parse_objects", f"""
SELECT image_id, ord, 'a' || ord AS id, {_PSD_ROLE_OUT} AS role, 'optional' AS importance, conf_pct::DOUBLE AS confidence, 'move_only' AS reflow_behavior, required AS safe_zone_required, true AS can_scale, false AS can_crop,
 'missing_layer' AS match_status, x, y, w, h FROM {_OBJ} WHERE conf_pct % 7 <> 6""")
def f_parse_objects(t: Tables) -> DataFrame:
    o = _psd_answers(t).select("image_id", "ord", F.explode(A.parse_objects(F.col("raw"))).alias("o"))
    return o.select("image_id", "ord", *[f"o.{c}" for c in ("id", "role", "importance", "confidence", "reflow_behavior", "safe_zone_required", "can_scale", "can_crop", "match_status")], "o.bbox.*")


@query("f07_normalise_role", f"SELECT image_id, ord, {_PSD_ROLE_OUT} AS role FROM {_OBJ}")
def f_role(t: Tables) -> DataFrame:
    return t.fx_object.select("image_id", "ord", A.normalise_role(F.expr(_PSD_ROLE)).alias("role"))


def _scene_answers(t: Tables) -> DataFrame:
    one = F.concat(F.lit('{"id":"o'), "ord", F.lit('","role":"'), "role", F.lit('","required":'), F.col("required").cast("string"), F.lit(',"movable":'), F.col("movable").cast("string"),
                   F.lit(',"bbox":{"x":'), "x", F.lit(',"y":'), "y", F.lit(',"width":'), "w", F.lit(',"height":'), "h", F.lit('},"polygon":[[0,0],['), "x", F.lit(','), "y", F.lit(']]}'))
    js = F.concat(F.lit('{"objects":['), one, F.lit(',{"textContent":"T"}]}'))
    raw = (F.when(F.col("ord") % 7 == 5, F.lit("{broken")).when(F.col("ord") % 7 == 6, F.lit('{"objects":{"a":1}}'))
           .when(F.col("ord") % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js))
    return t.fx_object.withColumn("raw", raw)


@query("f08_build_manifest", f"""
WITH k AS (SELECT *, CASE ord % 7 WHEN 5 THEN 'JSON_PARSE_FAILED' WHEN 6 THEN 'OBJECTS_NOT_A_LIST' END AS error FROM {_OBJ})
SELECT image_id, ord, error, 'o' || ord AS object_id, role, required, movable, true AS removable, x, y, w, h, 2 AS points, 0.5::DOUBLE AS confidence, 0 AS z_index, '' AS text_content FROM k WHERE error IS NULL
UNION ALL SELECT image_id, ord, error, 'obj_1', 'decorative_ad', false, true, true, 0, 0, 0, 0, 0, 0.5, 1, 'T' FROM k WHERE error IS NULL
UNION ALL SELECT image_id, ord, error, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE error IS NOT NULL""")
def f_manifest(t: Tables) -> DataFrame:
    m = _scene_answers(t).select("image_id", "ord", A.build_manifest(F.col("raw")).alias("m")).select("image_id", "ord", "m.error", F.explode_outer("m.objects").alias("o"))
    return m.select("image_id", "ord", "error", F.col("o.id").alias("object_id"), *[f"o.{c}" for c in ("role", "required", "movable", "removable", "x", "y", "w", "h")],
                    F.when(F.col("o").isNotNull(), F.size("o.polygon")).alias("points"), "o.confidence", "o.z_index", "o.text_content")


_CAT = "CASE conf_pct % 7 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' WHEN 2 THEN '{c}' WHEN 3 THEN 'person_zone' WHEN 4 THEN 'decorative_panel' WHEN 5 THEN 'badge' ELSE '{a}' END"
_CAT_A, _CAT_B = _CAT.format(a="product", b="sub_product", c="title_group"), _CAT.format(a="main_product", b="brand_logo", c="advertising_text")


def _elements(t: Tables, category: str) -> DataFrame:
    box = "array((y * 2) % 900, (x * 2) % 900, (y * 2) % 900 + h, (x * 2) % 900 + w)"
    return t.fx_object.join(images(t), "image_id").selectExpr(
        "image_id", "ord AS pos", f"{category} AS category", f"CASE WHEN ord % 6 = 5 THEN array(1, 2) ELSE {box} END AS box", "image_w", "image_h")


_PX_SQL = f"""e AS (SELECT o.*, i.width AS iw, i.height AS ih, {_CAT_A} AS ca, {_CAT_B} AS cb FROM {_OBJ} o JOIN fx_image i USING (image_id) WHERE ord % 6 <> 5),
p AS (SELECT *, trunc(((y * 2) % 900) / 1000 * ih)::INT AS y1, trunc(((x * 2) % 900) / 1000 * iw)::INT AS x1, trunc(((y * 2) % 900 + h) / 1000 * ih)::INT AS y2, trunc(((x * 2) % 900 + w) / 1000 * iw)::INT AS x2 FROM e)"""


@query("f09_map_roles_scene", f"""
WITH {_PX_SQL}, r AS (SELECT *, CASE ca WHEN 'product' THEN 'product' WHEN 'sub_product' THEN 'product' WHEN 'title_group' THEN 'title_group' WHEN 'person_zone' THEN 'protected_subject' WHEN 'decorative_panel' THEN 'decorative_ad' END AS nr,
  greatest(0, least(x1, iw - 1)) AS ax, greatest(0, least(y1, ih - 1)) AS ay FROM p)
SELECT image_id, ord AS pos, 'obj_' || ord AS object_id, nr AS role, ca IN ('product', 'title_group') AS required, nr <> 'protected_subject' AS movable, CASE nr WHEN 'title_group' THEN 10 ELSE 0 END AS z_index,
  ax AS x, ay AS y, greatest(ax + 1, least(x2, iw)) - ax AS w, greatest(ay + 1, least(y2, ih)) - ay AS h FROM r WHERE nr IS NOT NULL""")
def f_map_scene(t: Tables) -> DataFrame:
    return O.map_roles(_elements(t, _CAT_A), "scene")


@query("f09_map_roles_category", f"""
WITH {_PX_SQL}, r AS (SELECT *, CASE cb WHEN 'main_product' THEN 'product' WHEN 'brand_logo' THEN 'logo' WHEN 'advertising_text' THEN 'title_group' WHEN 'person_zone' THEN 'protected_subject' ELSE 'decorative_ad' END AS nr FROM p),
q AS (SELECT *, CASE WHEN nr = 'title_group' THEN greatest(0, x1 - trunc(0.08::DOUBLE * iw)::INT) ELSE x1 END AS wx FROM r), s AS (SELECT *, greatest(0, least(wx, iw - 1)) AS ax, greatest(0, least(y1, ih - 1)) AS ay FROM q)
SELECT image_id, ord AS pos, 'obj_' || ord AS object_id, nr AS role, cb IN ('main_product', 'advertising_text') AS required, nr <> 'protected_subject' AS movable, ord AS z_index,
  ax AS x, ay AS y, greatest(ax + 1, least(x2, iw)) - ax AS w, greatest(ay + 1, least(y2, ih)) - ay AS h FROM s""")
def f_map_category(t: Tables) -> DataFrame:
    return O.map_roles(_elements(t, _CAT_B), "category")


_VERDICT = """SELECT ok AS image_id, ln AS ord, q, CASE WHEN q % 9 = 0 THEN 'not json' ELSE CONCAT(CASE WHEN ln % 3 = 0 THEN '```json\n' ELSE '' END, '{{"adObjectsRemaining":', CASE WHEN q % 2 = 0 THEN 'true' ELSE 'false' END, ',"remainingObjectIds":["o1","o', CAST(ln AS STRING), '"]',
 CASE WHEN q % 5 = 0 THEN ',"protectedSubjectPreserved":false' ELSE '' END, ',"visibleSeamDetected":', CASE WHEN q % 7 = 0 THEN 'true' ELSE '"maybe"' END, CASE WHEN q % 4 = 0 THEN ',"newlyGeneratedTextDetected":true' ELSE '' END,
 ',"sceneNaturalnessScore":0.', CAST(q AS STRING), '}}', CASE WHEN ln % 3 = 0 THEN '\n```' ELSE '' END) END AS raw FROM {line}"""


def verdicts(t: Tables) -> DataFrame:
    return t.spark.sql(_VERDICT, line=t.fx_line).withColumn("v", A.parse_validation(F.col("raw")))


_V_SQL = """v AS (SELECT ok AS image_id, ln AS ord, q, q % 9 = 0 AS bad, q % 9 <> 0 AND q % 2 = 0 AS ad, q % 9 = 0 OR q % 5 <> 0 AS prot, q % 9 <> 0 AND q % 7 = 0 AS seam, q % 9 <> 0 AND q % 4 = 0 AS txt,
 CASE WHEN q % 9 = 0 THEN 1.0 ELSE ('0.' || q)::DOUBLE END AS nat FROM fx_line)"""


@query("f10_parse_validation", f"""WITH {_V_SQL} SELECT image_id, ord, CASE WHEN bad THEN 'AI_RESPONSE_PARSE_FAILED' END AS error, ad AS ad_objects_remaining, prot AS protected_preserved, seam AS visible_seam, txt AS new_text, nat AS naturalness,
 CASE WHEN bad THEN '' ELSE 'o1,o' || ord END AS ids FROM v""")
def f_validation(t: Tables) -> DataFrame:
    return verdicts(t).select("image_id", "ord", "v.error", "v.ad_objects_remaining", "v.protected_preserved", "v.visible_seam", "v.new_text", "v.naturalness", F.array_join("v.remaining_ids", ",").alias("ids"))


@query("c08_scene_codes", f"""WITH {_V_SQL} SELECT image_id, ord, array_to_string(list_filter([CASE WHEN ad THEN 'AD_OBJECTS_REMAINING' END, CASE WHEN NOT prot THEN 'PROTECTED_SUBJECT_DAMAGED' END, CASE WHEN seam THEN 'VISIBLE_SEAM_DETECTED' END,
 CASE WHEN txt THEN 'NEW_TEXT_GENERATED' END, CASE WHEN nat < 0.7 THEN 'LOW_NATURALNESS_SCORE' END], lambda c: c IS NOT NULL), ',') AS codes FROM v""")
def c_scene(t: Tables) -> DataFrame:
    from adlattice.functions.scoring import scene_codes
    return verdicts(t).select("image_id", "ord", F.array_join(scene_codes(F.col("v")), ",").alias("codes"))


@query("j20_purge_protected", f"""
WITH {_V_SQL}, r AS (SELECT image_id, ord, CASE WHEN bad THEN [] ELSE ['o1', 'o' || ord] END AS ids, ad FROM v), pr AS (SELECT image_id, list('o' || ord) AS p FROM fx_object WHERE role = 'protected_subject' GROUP BY 1),
j AS (SELECT r.*, coalesce(p, []) AS p FROM r LEFT JOIN pr USING (image_id))
SELECT image_id || '-' || ord AS vid, array_to_string(list_filter(ids, lambda i: NOT list_contains(p, i)), ',') AS ids, CASE WHEN len(list_filter(ids, lambda i: list_contains(p, i))) > 0 THEN len(list_filter(ids, lambda i: NOT list_contains(p, i))) > 0 ELSE ad END AS ad_objects_remaining FROM j""")
def j_purge(t: Tables) -> DataFrame:
    v = verdicts(t).select(F.concat_ws("-", "image_id", "ord").alias("vid"), "image_id", F.col("v.remaining_ids").alias("remaining_ids"), F.col("v.ad_objects_remaining").alias("ad_objects_remaining"))
    man = v.select("vid", "image_id").join(objects(t).filter("role = 'protected_subject'").select("image_id", "object_id", "role"), "image_id")
    return O.purge_protected(v.drop("image_id"), man, "vid").select("vid", F.array_join("remaining_ids", ",").alias("ids"), "ad_objects_remaining")


_FENCE = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CONCAT('```json\n{{"n":', CAST(n_chars AS STRING), '}}\n```') WHEN 1 THEN CONCAT('  ```\n[', CAST(n_chars AS STRING), ']\n```\n```  ') WHEN 2 THEN CONCAT(' {{"n":', CAST(n_chars AS STRING), '}} ') WHEN 3 THEN 'Here you are: {{}}' ELSE '   ' END AS raw FROM {docs}"""


@query("f12_strip_fence", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"n":' || n_chars || '}' WHEN 1 THEN '[' || n_chars || ']' || chr(10) || '```' WHEN 2 THEN '{"n":' || n_chars || '}' END AS by_pattern,
 CASE doc_id % 5 WHEN 0 THEN '{"n":' || n_chars || '}' WHEN 1 THEN '[' || n_chars || ']' WHEN 2 THEN '{"n":' || n_chars || '}' WHEN 3 THEN 'Here you are: {}' ELSE '' END AS by_line FROM documents""")
def f_fence(t: Tables) -> DataFrame:
    d = t.spark.sql(_FENCE, docs=t.documents)
    return d.select("doc_id", A.json_start(F.col("raw")).alias("by_pattern"), A.strip_fence_lines(F.col("raw")).alias("by_line"))


@query("f14_safe_name", """SELECT doc_id, regexp_replace(left(text, 200), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}-]', '_', 'g') AS name FROM (SELECT doc_id, source || ' ' || lang || '/' || doc_id || '?é' AS text FROM documents) d""")
def f_safe(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.safe_name(F.concat("source", F.lit(" "), "lang", F.lit("/"), "doc_id", F.lit("?é"))).alias("name"))


_TERMS = ["license", "password", "http", "the ", "und", "api_key"]


@query("f16_scan_terms", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), k AS (SELECT unnest([{", ".join(repr(x) for x in _TERMS)}]) AS term)
SELECT doc_id, line_no::INT AS line_no, term, trim(line) AS line FROM l JOIN k ON contains(line, term)""")
def f_scan(t: Tables) -> DataFrame:
    return O.scan_terms(t.documents.select("doc_id", "text"), _TERMS, "doc_id")


@query("f16_scan_term_table", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), k AS (SELECT DISTINCT text AS term FROM benchmark WHERE length(text) > 0)
SELECT doc_id, line_no::INT AS line_no, term FROM l JOIN k ON contains(line, term)""")
def f_scan_table(t: Tables) -> DataFrame:
    return scan_term_table(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("text").alias("term")), "doc_id", with_line=False).select("doc_id", "line_no", "term")


@query("f19_content_hash", "SELECT doc_id, sha256(text) AS full_hash, left(sha256(text), 16) AS short_hash FROM documents")
def f_hash(t: Tables) -> DataFrame:
    h = F.sha2(F.col("text").cast("binary"), 256)
    return t.documents.select("doc_id", h.alias("full_hash"), F.substring(h, 1, 16).alias("short_hash"))


@query("f20_cache_keys", f"""SELECT doc_id, sha256(sha256(text) || ':' || (doc_id % 9) || ':0:300:' || n_chars || ':{vocab.ANALYSIS_VERSION}:model-a') AS analysis_key, left(sha256(text || '["' || source || '"]' || '0.25'), 32) AS segment_key FROM documents""")
def f_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.analysis_key(F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id") % 9, F.lit(0), F.lit(300), F.col("n_chars"), F.lit("model-a")).alias("analysis_key"),
                              T.segment_key(F.col("text").cast("binary"), F.concat(F.lit('["'), "source", F.lit('"]')), F.lit("0.25")).alias("segment_key"))


@query("f24_prompt_lines", f"""SELECT image_id, ord, CASE WHEN role = 'protected_subject' THEN 'protected' ELSE 'remove' END AS section, '  id=o' || ord || '  role=' || role || '  desc="q' || conf_pct || '"' AS line,
 '- [' || role || '] L' || ord || ' (importance: ' || CASE WHEN required THEN 'required' ELSE 'optional' END || ', group: cta)' AS element_line FROM {_OBJ}""")
def f_prompt_lines(t: Tables) -> DataFrame:
    o = objects(t).withColumns({"description": F.concat(F.lit("q"), "conf_pct"), "type": F.col("role"), "label": F.concat(F.lit("L"), "ord"),
                                "importance": F.when(F.col("required"), "required").otherwise("optional"), "group": F.lit("cta")})
    lines = O.element_lines(o).withColumnRenamed("line", "element_line")
    return O.manifest_lines(lines).select("image_id", "ord", "section", "line", "element_line")


# --- filters -----------------------------------------------------------------------------------------------------

_UI = f"""u AS (SELECT *, {_PSD_ROLE_OUT} AS prole, CASE ord % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'priority' WHEN 2 THEN 'optional' END AS importance, CASE conf_pct % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'matched_low_confidence' ELSE 'missing_layer' END AS match_status FROM {_OBJ})"""


def screen_objects(t: Tables) -> DataFrame:
    return t.fx_object.selectExpr("image_id", "ord", f"{_PSD_ROLE_OUT} AS role", "CASE ord % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'priority' WHEN 2 THEN 'optional' END AS importance",
                                  "CASE conf_pct % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'matched_low_confidence' ELSE 'missing_layer' END AS match_status")


@query("p14_visible_objects", f"""WITH {_UI} SELECT image_id, ord, prole AS role, CASE importance WHEN 'required' THEN 0 WHEN 'priority' THEN 1 ELSE 2 END AS importance_rank, prole IN ('title', 'body_text') AS is_text, match_status <> 'ready' AS unmatched FROM u WHERE prole NOT IN ('decoration', 'unknown')""")
def p_visible(t: Tables) -> DataFrame:
    return O.visible_objects(screen_objects(t)).select("image_id", "ord", "role", "importance_rank", O.category_test("text").alias("is_text"), O.category_test("unmatched").alias("unmatched"))


@query("a13_object_counts", f"""WITH {_UI} SELECT image_id, COUNT(*) AS n_all, COUNT(*) FILTER (prole = 'main_image') AS n_image, COUNT(*) FILTER (prole IN ('title', 'body_text')) AS n_text, COUNT(*) FILTER (prole IN ('logo', 'cta', 'badge')) AS n_logo_cta,
 COUNT(*) FILTER (prole = 'person') AS n_person, COUNT(*) FILTER (prole IN ('background', 'decoration')) AS n_bg_deco, COUNT(*) FILTER (match_status <> 'ready') AS n_unmatched FROM u WHERE prole NOT IN ('decoration', 'unknown') GROUP BY 1""")
def a_counts(t: Tables) -> DataFrame:
    return O.object_counts(screen_objects(t), ["image_id"])


@query("j14_reflow_ready", f"""
WITH {_UI}, g AS (SELECT image_id, bool_or(match_status <> 'missing_layer' AND prole = 'background') AS b, bool_or(match_status <> 'missing_layer' AND prole = 'title') AS ti, bool_or(match_status <> 'missing_layer' AND prole = 'main_image') AS m,
  bool_or(prole = 'title') AND bool_or(prole = 'main_image') AS screen_ready FROM u GROUP BY 1)
SELECT image_id, concat_ws(',', CASE WHEN NOT b THEN 'background' END, CASE WHEN NOT ti THEN 'title' END, CASE WHEN NOT m THEN 'main_image' END) AS missing, b AND ti AND m AS ready, screen_ready FROM g""")
def j_reflow(t: Tables) -> DataFrame:
    return O.reflow_ready(screen_objects(t), ["image_id"])


@query("p17_route_objects", f"""
WITH o AS (SELECT *, CASE WHEN conf_pct % 6 = 0 THEN 0 ELSE w * h END AS mask_area, role <> 'protected_subject' AND conf_pct % 11 <> 0 AS rem FROM {_OBJ})
SELECT image_id, ord, CASE WHEN role = 'protected_subject' THEN 'protected' WHEN NOT (movable AND rem) THEN 'skip' WHEN role = 'decorative_ad' THEN CASE WHEN mask_area > 0 THEN 'decorative' ELSE 'skip' END
 WHEN mask_area > 0 THEN 'extract' WHEN required THEN 'REQUIRED_MASK_EMPTY' ELSE 'skip' END AS route FROM o""")
def p_route(t: Tables) -> DataFrame:
    o = t.fx_object.withColumns({"mask_area": F.when(F.col("conf_pct") % 6 == 0, 0).otherwise(F.col("w") * F.col("h")), "removable": (F.col("role") != "protected_subject") & (F.col("conf_pct") % 11 != 0)})
    return o.select("image_id", "ord", O.route_objects().alias("route"))


@query("p18_composite_set", f"SELECT image_id, 'o' || ord AS object_id, CASE WHEN conf_pct % 4 = 0 THEN 0 ELSE conf_pct END AS z FROM {_OBJ} WHERE required AND ord % 3 <> 0")
def p_composite(t: Tables) -> DataFrame:
    o = objects(t).withColumn("z_index", F.when(F.col("conf_pct") % 4 != 0, F.col("conf_pct")))
    return O.composite_set(o.filter("ord % 3 <> 0").select("image_id", "object_id", "ord"), o, ["image_id"]).select("image_id", "object_id", "z")


@query("p22_inpaint_rects", f"""SELECT image_id, ord, greatest(0, x - 10) AS mx1, greatest(0, y - 10) AS my1, least(i.width, x + w + 10) AS mx2, least(i.height, y + h + 10) AS my2 FROM {_OBJ} o JOIN fx_image i USING (image_id) WHERE role IN ('title_group', 'logo')""")
def p_inpaint(t: Tables) -> DataFrame:
    return O.inpaint_rects(t.fx_object, images(t)).select("image_id", "ord", "mx1", "my1", "mx2", "my2")


@query("p23_segment_prompts", f"""
WITH o AS (SELECT *, CASE conf_pct % 3 WHEN 0 THEN '' WHEN 1 THEN 't' || ord END AS tc, CASE conf_pct % 4 WHEN 0 THEN 'd' || w WHEN 1 THEN '' END AS ds FROM {_OBJ})
SELECT image_id, ord, CASE WHEN coalesce(tc, '') <> '' AND coalesce(ds, '') <> '' THEN tc || ' . ' || ds WHEN coalesce(tc, '') <> '' THEN tc WHEN coalesce(ds, '') <> '' THEN ds ELSE role END AS prompt FROM o""")
def p_prompts(t: Tables) -> DataFrame:
    o = t.fx_object.withColumns({"text_content": F.when(F.col("conf_pct") % 3 == 0, "").when(F.col("conf_pct") % 3 == 1, F.concat(F.lit("t"), "ord")),
                                 "description": F.when(F.col("conf_pct") % 4 == 0, F.concat(F.lit("d"), "w")).when(F.col("conf_pct") % 4 == 1, "")})
    return o.select("image_id", "ord", O.segment_prompts().alias("prompt"))


# --- joins -------------------------------------------------------------------------------------------------------

@query("j13_missing_required", f"SELECT image_id, 'o' || ord AS object_id FROM {_OBJ} WHERE required AND movable AND role <> 'protected_subject' AND conf_pct % 3 = 0")
def j_missing(t: Tables) -> DataFrame:
    o = objects(t)
    return O.missing_required(o, o.filter("conf_pct % 3 <> 0"), ["image_id"]).select("image_id", "object_id")


@query("j16_drop_product_titles", f"""
SELECT image_id, ord, role FROM {_OBJ} o WHERE NOT (role IN ('title_group', 'logo') AND EXISTS (SELECT 1 FROM {_OBJ} p WHERE p.image_id = o.image_id AND p.role = 'product'
 AND greatest(0, least(o.x + o.w, p.x + p.w) - greatest(o.x, p.x)) * greatest(0, least(o.y + o.h, p.y + p.h) - greatest(o.y, p.y)) / (o.w * o.h) > 0.6))""")
def j_titles(t: Tables) -> DataFrame:
    return O.drop_product_titles(t.fx_object).select("image_id", "ord", "role")


_INTER = "(greatest(0, least(o.x + o.w, d.x + d.w) - greatest(o.x, d.x)) * greatest(0, least(o.y + o.h, d.y + d.h) - greatest(o.y, d.y)))"


@query("j17_iou_match", f"""
WITH e AS (SELECT * FROM {_OBJ} WHERE role IN ('product', 'logo') AND movable),
m AS (SELECT o.image_id, o.ord, d.det, {_INTER} / greatest(o.w * o.h + d.w * d.h - {_INTER}, 1) AS iou FROM e o JOIN fx_det d ON d.image_id = o.image_id AND d.quality >= 50),
b AS (SELECT * FROM m WHERE iou >= 0.25 QUALIFY row_number() OVER (PARTITION BY image_id, ord ORDER BY iou DESC, det) = 1)
SELECT e.image_id, e.ord, b.det, round(b.iou, 9) AS iou FROM e LEFT JOIN b USING (image_id, ord)""")
def j_iou(t: Tables) -> DataFrame:
    return O.iou_match(objects(t), t.fx_det).select("image_id", "ord", "det", F.round("iou", 9).alias("iou"))


@query("j18_union_candidates", f"""
WITH d AS (SELECT image_id, ord AS i, x, y, w, h, conf_pct AS conf, (conf_pct * 3) % 50 AS mc FROM {_OBJ}),
p AS (SELECT a.image_id, a.i, b.i AS j, least(a.x, b.x) AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h, greatest(a.conf, b.conf) AS conf, greatest(a.mc, b.mc) AS mask_conf,
  row_number() OVER (PARTITION BY a.image_id ORDER BY a.conf + b.conf DESC, a.i DESC, b.i DESC)::INT AS pair_rank
  FROM d a JOIN d b ON a.image_id = b.image_id AND a.i < b.i WHERE abs((a.y + a.h / 2) - (b.y + b.h / 2)) < greatest(a.h, b.h, 1) * 2.0 AND abs((a.x + a.w / 2) - (b.x + b.w / 2)) < greatest(a.w, b.w, 1) * 1.5)
SELECT * FROM p WHERE pair_rank <= 5""")
def j_union(t: Tables) -> DataFrame:
    d = t.fx_object.selectExpr("image_id", "ord AS i", "x", "y", "w", "h", "conf_pct AS conf", "(conf_pct * 3) % 50 AS mask_conf")
    return O.union_candidates(d).drop("conf_sum")


@query("j22_group_names", f"""
WITH g AS (SELECT image_id AS analysis_id, CASE ord % 3 WHEN 0 THEN 'main_copy' WHEN 1 THEN 'cta' ELSE 'x' || ord END AS group_id, CASE WHEN conf_pct % 2 = 0 THEN 'n' || conf_pct ELSE '' END AS name, ord FROM {_OBJ}),
o AS (SELECT analysis_id, group_id, arg_min(name, ord) AS own FROM g WHERE name <> '' GROUP BY 1, 2)
SELECT g.analysis_id, g.ord, g.group_id, coalesce(own, CASE g.group_id WHEN 'main_copy' THEN '메인 카피' WHEN 'cta' THEN 'CTA' END, g.group_id) AS group_name FROM g LEFT JOIN o USING (analysis_id, group_id)""")
def j_groups(t: Tables) -> DataFrame:
    g = t.fx_object.selectExpr("image_id AS analysis_id", "CASE ord % 3 WHEN 0 THEN 'main_copy' WHEN 1 THEN 'cta' ELSE concat('x', ord) END AS group_id", "CASE WHEN conf_pct % 2 = 0 THEN concat('n', conf_pct) ELSE '' END AS name", "ord")
    return O.group_names(g.drop("name"), g)


@query("g20_extend_bottom", f"""
WITH f AS (SELECT image_id, MIN(ord) AS ord FROM {_OBJ} WHERE role = 'product' GROUP BY 1), s AS (SELECT image_id, (width + height) % 400 AS bottom FROM fx_image), k AS (SELECT image_id, ord, bottom FROM f JOIN s USING (image_id))
SELECT o.image_id, o.ord, CASE WHEN k.bottom > o.y + o.h THEN k.bottom - o.y ELSE o.h END AS h, coalesce(k.bottom > o.y + o.h, false) AS extended FROM {_OBJ} o LEFT JOIN k USING (image_id, ord)""")
def g_extend(t: Tables) -> DataFrame:
    return O.extend_bottom(t.fx_object, t.fx_image.selectExpr("image_id", "(width + height) % 400 AS bottom")).select("image_id", "ord", "h", "extended")


# --- numbering ---------------------------------------------------------------------------------------------------

@query("w02_suffix_groups", f"""
WITH o AS (SELECT image_id, ord, CASE conf_pct % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'headline' ELSE 'sub' END AS g FROM {_OBJ}), n AS (SELECT *, row_number() OVER (PARTITION BY image_id, g ORDER BY ord) AS n FROM o)
SELECT image_id, ord, CASE WHEN coalesce(g, '') = '' THEN NULL WHEN n = 1 THEN g ELSE g || '_' || (n - 1) END AS group_id FROM n""")
def w_suffix(t: Tables) -> DataFrame:
    o = t.fx_object.selectExpr("image_id", "ord", "CASE conf_pct % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'headline' ELSE 'sub' END AS group_name")
    return O.suffix_groups(o, ["image_id"], "ord").select("image_id", "ord", "group_id")


@query("w03_number_detections", "SELECT image_id, det, 'det_' || lpad((row_number() OVER (PARTITION BY image_id ORDER BY CASE role WHEN 'product' THEN 0 WHEN 'person' THEN 1 ELSE 2 END, det))::VARCHAR, 3, '0') AS detection_id FROM fx_det")
def w_number(t: Tables) -> DataFrame:
    # the class in the upper half of a long, so no position can reach the next class
    seq = F.shiftleft(F.when(F.col("role") == "product", 0).when(F.col("role") == "person", 1).otherwise(2).cast("long"), 32) + F.col("det")
    return O.number_detections(t.fx_det.withColumn("seq", seq)).select("image_id", "det", "detection_id")


# --- rules -------------------------------------------------------------------------------------------------------

@query("q01_validate_manifest", f"""
WITH o AS (SELECT *, CASE WHEN conf_pct = 13 AND ord > 1 THEN 'o1' ELSE 'o' || ord END AS oid, role <> 'protected_subject' AS rem, CASE WHEN conf_pct % 19 = 0 THEN 0 ELSE 1 END AS poly FROM {_OBJ}),
c AS (SELECT o.*, CASE WHEN role = 'protected_subject' AND (movable OR rem) THEN 'PROTECTED_SUBJECT_VIOLATION' WHEN required AND poly = 0 THEN 'REQUIRED_POLYGON_MISSING'
   WHEN x < 0 OR y < 0 OR x + w > i.width OR y + h > i.height OR (poly = 1 AND (x * 3 > i.width OR y > i.height)) THEN 'COORDINATES_OUT_OF_BOUNDS' END AS code FROM o JOIN fx_image i USING (image_id)),
g AS (SELECT image_id, COUNT(*) AS n, COUNT(DISTINCT oid) AS d, bool_or(rem) AS rem, arg_min(code, ord) FILTER (code IS NOT NULL) AS code FROM c GROUP BY 1)
SELECT i.image_id, CASE WHEN g.n IS NULL THEN 'MANIFEST_EMPTY' WHEN g.n > g.d THEN 'DUPLICATE_IDS' WHEN g.code IS NOT NULL THEN g.code WHEN NOT g.rem THEN 'NO_REMOVABLE_OBJECTS' END AS code FROM (SELECT image_id FROM fx_image UNION ALL SELECT -1 - image_id FROM fx_image WHERE image_id % 23 = 0) i LEFT JOIN g USING (image_id)""")
def q_manifest(t: Tables) -> DataFrame:
    """Every image, and beside them some that have no objects at all."""
    bare = images(t).filter("image_id % 23 = 0").withColumn("image_id", -1 - F.col("image_id"))
    o = objects(t).withColumns({
        "object_id": F.when((F.col("conf_pct") == 13) & (F.col("ord") > 1), "o1").otherwise(F.col("object_id")),
        "polygon": F.when(F.col("conf_pct") % 19 == 0, F.array().cast("array<array<int>>")).otherwise(F.array(F.array(F.col("x") * 3, F.col("y"))))})
    return O.validate_manifest(o, images(t).unionByName(bare))


@query("q02_validate_extraction", f"""
WITH x AS (SELECT *, conf_pct % 8 <> 0 AS fe, CASE WHEN conf_pct % 6 = 0 THEN 0 ELSE w * h END AS ma, CASE WHEN conf_pct % 5 = 0 THEN 3 ELSE 0 END AS ad FROM {_OBJ} WHERE ord % 6 <> 2),
m AS (SELECT image_id, COUNT(*) AS n FROM {_OBJ} WHERE required AND movable AND role <> 'protected_subject' AND ord % 6 = 2 GROUP BY 1),
f AS (SELECT image_id, arg_min(code, ord) FILTER (code IS NOT NULL) AS code FROM (SELECT *, CASE WHEN NOT fe THEN 'REQUIRED_RGBA_MISSING' WHEN ma = 0 THEN 'REQUIRED_MASK_EMPTY' WHEN ad > 0 THEN 'POLYGON_ALPHA_LEAK' END AS code FROM x WHERE required) q GROUP BY 1)
SELECT i.image_id, CASE WHEN m.n > 0 THEN 'REQUIRED_OBJECT_NOT_EXTRACTED' ELSE f.code END AS code FROM (SELECT DISTINCT image_id FROM {_OBJ}) i LEFT JOIN m USING (image_id) LEFT JOIN f USING (image_id)""")
def q_extraction(t: Tables) -> DataFrame:
    o = objects(t)
    x = o.filter("ord % 6 <> 2").withColumns({"file_exists": F.col("conf_pct") % 8 != 0, "mask_area": F.when(F.col("conf_pct") % 6 == 0, 0).otherwise(F.col("w") * F.col("h")),
                                              "alpha_diff": F.when(F.col("conf_pct") % 5 == 0, 3).otherwise(0)})
    return O.validate_extraction(o, x, ["image_id"])


@query("q10_bbox_valid", f"SELECT image_id, ord, w - 30 > 0 AND h - 30 > 0 AND x - 5 >= 0 AND y - 5 >= 0 AND x - 5 + w - 30 <= 500 * 1.05 AND y - 5 + h - 30 <= 340 * 1.05 AS ok FROM {_OBJ}")
def q_bbox(t: Tables) -> DataFrame:
    o = t.fx_object.selectExpr("image_id", "ord", "x - 5 AS x", "y - 5 AS y", "w - 30 AS w", "h - 30 AS h", "500 AS canvas_w", "340 AS canvas_h")
    return o.select("image_id", "ord", O.bbox_valid().alias("ok"))


@query("q11_validate_segment_request", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'SOURCE_REQUIRED' WHEN doc_id % 5 = 1 THEN 'PROMPTS_PARSE_FAILED' END AS code, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 0 THEN 'product:2' ELSE 'product:9,person:4,hand:2,logo:2,cta:2' END AS prompts FROM documents""")
def q_segment(t: Tables) -> DataFrame:
    r = t.documents.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 1 THEN '/a.psd' ELSE '' END AS psd_path", "CASE WHEN doc_id % 4 > 1 THEN '/b.png' END AS source_path",
                               """CASE doc_id % 5 WHEN 0 THEN '[{"role":"product","texts":["a","b"]}]' WHEN 1 THEN '{oops' WHEN 2 THEN '[]' END AS prompts""")
    text = F.array_join(F.transform("used_prompts", lambda p: F.concat(p["role"], F.lit(":"), F.size(p["texts"]).cast("string"))), ",")
    return O.validate_segment_request(r).select("doc_id", "code", text.alias("prompts"))


# --- counts ------------------------------------------------------------------------------------------------------

@query("a08_call_counts", "WITH p AS (SELECT image_id, role, COUNT(*) AS c, bool_or(quality >= 50) AS d FROM fx_det GROUP BY 1, 2) SELECT image_id, SUM(c)::BIGINT AS calls, coalesce(string_agg(role, ',' ORDER BY role) FILTER (d), '') AS detected_tracks FROM p GROUP BY 1")
def a_calls(t: Tables) -> DataFrame:
    return O.call_counts(t.fx_det.select("image_id", F.col("role").alias("track"), F.lit(1).alias("calls"), (F.col("quality") >= 50).alias("detected")), ["image_id"])


@query("a09_manifest_stats", f"""SELECT image_id, COUNT(*) AS objects, COUNT(*) FILTER (role <> 'protected_subject') AS removable, COUNT(*) FILTER (required) AS required, COUNT(*) FILTER (role IN ('title_group', 'body_text_group', 'cta_group')) AS text_groups,
 COUNT(*) FILTER (conf_pct % 2 = 0) AS from_model, COUNT(*) FILTER (conf_pct % 2 = 1) AS from_polygon FROM {_OBJ} GROUP BY 1""")
def a_stats(t: Tables) -> DataFrame:
    return O.manifest_stats(objects(t).withColumn("mask_source", F.when(F.col("conf_pct") % 2 == 0, "sam2").otherwise("polygon")), ["image_id"])


@query("a12_date_like_count", f"""WITH e AS (SELECT image_id, CASE conf_pct % 5 WHEN 0 THEN '신청기간' WHEN 1 THEN 'x' END AS label, CASE ord % 3 WHEN 0 THEN 'DATE_info' WHEN 1 THEN 'cta' END AS g FROM {_OBJ})
SELECT image_id, COUNT(*) FILTER (coalesce(label = '신청기간', false) OR coalesce(g = 'DATE_info', false)) AS date_like, COUNT(*) FILTER (coalesce(label = '신청기간', false) OR coalesce(g = 'DATE_info', false)) >= 2 AS many FROM e GROUP BY 1""")
def a_dates(t: Tables) -> DataFrame:
    e = t.fx_object.selectExpr("image_id", "CASE conf_pct % 5 WHEN 0 THEN '신청기간' WHEN 1 THEN 'x' END AS label", "CASE ord % 3 WHEN 0 THEN 'DATE_info' WHEN 1 THEN 'cta' END AS group")
    return O.date_like_count(e, ["image_id"])


@query("a15_unknown_resources", """
WITH m AS (SELECT ok AS psd_id, ln, CASE q % 4 WHEN 0 THEN 'resource' WHEN 1 THEN 'key' WHEN 2 THEN 'key' END AS kind, CASE q % 4 WHEN 0 THEN (1000 + pk % 3)::VARCHAR WHEN 1 THEN 'CAI' WHEN 2 THEN 'k' || (pk % 2) END AS value FROM fx_line)
SELECT psd_id, kind, value, MIN(ln) AS first_seen FROM m WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def a_unknown(t: Tables) -> DataFrame:
    m = t.fx_line.selectExpr("ok AS psd_id", "ln", "CASE q % 4 WHEN 0 THEN concat('Unknown image resource ', 1000 + pk % 3) WHEN 1 THEN \"Unknown key: b'CAI '\" WHEN 2 THEN concat(\"Unknown tagged block: b'k\", pk % 2, \"'\") ELSE 'fine' END AS message")
    return O.unknown_resources(m, ["psd_id"], "ln")


@query("h03_merge_tracks", """
WITH p AS (SELECT ok AS image_id, bool_or(q % 3 = 0) AS d, MIN(CASE WHEN q % 9 = 0 THEN 'timeout' END) AS e FROM fx_line WHERE ln % 3 = 1 GROUP BY 1), x AS (SELECT ok AS image_id, bool_or(q % 2 = 0) AS d FROM fx_line WHERE ln % 3 = 2 GROUP BY 1), h AS (SELECT ok AS image_id, bool_or(q % 5 = 0) AS d FROM fx_line WHERE ln % 3 = 0 GROUP BY 1),
j AS (SELECT coalesce(p.image_id, x.image_id, h.image_id) AS image_id, coalesce(p.d, false) AS pd, coalesce(x.d, false) AS xd, coalesce(h.d, false) AS hd, CASE WHEN p.image_id IS NULL THEN 'track missing' ELSE p.e END AS pe, CASE WHEN x.image_id IS NULL THEN 'track missing' END AS xe, CASE WHEN h.image_id IS NULL THEN 'track missing' END AS he
  FROM p FULL JOIN x ON x.image_id = p.image_id FULL JOIN h ON h.image_id = coalesce(p.image_id, x.image_id))
SELECT image_id, pd AS product_detected, xd AS text_detected, hd AS person_detected, pe AS product_error, xe AS text_error, he AS person_error, 3 AS call_count, concat_ws(',', CASE WHEN pd THEN 'product' END, CASE WHEN xd THEN 'text' END, CASE WHEN hd THEN 'person' END) AS detected_tracks FROM j""")
def h_tracks(t: Tables) -> DataFrame:
    line = t.fx_line

    def part(rest: int, by: int, error) -> DataFrame:
        return line.filter(F.col("ln") % 3 == rest).groupBy(F.col("ok").alias("image_id")).agg(F.max(F.col("q") % by == 0).alias("detected"), error.alias("error"))
    none = F.min(F.lit(None).cast("string"))
    return O.merge_tracks({"product": part(1, 3, F.min(F.when(F.col("q") % 9 == 0, "timeout"))), "text": part(2, 2, none), "person": part(0, 5, none)})


@query("u01_removable_union", f"SELECT image_id, ord, CASE WHEN role = 'decorative_ad' THEN 'decorative' ELSE 'object' END AS kind FROM {_OBJ} WHERE role <> 'protected_subject' AND movable")
def u_removable(t: Tables) -> DataFrame:
    o = objects(t).filter("movable AND removable")
    return o.filter("role <> 'decorative_ad'").select("image_id", "ord", F.lit("object").alias("kind")).unionByName(o.filter("role = 'decorative_ad'").select("image_id", "ord", F.lit("decorative").alias("kind")))


@query("u03_id_set_ops", f"""
WITH a AS (SELECT DISTINCT image_id, role FROM {_OBJ} WHERE required), b AS (SELECT DISTINCT image_id, role FROM {_OBJ} WHERE conf_pct % 2 = 0)
SELECT 'minus' AS op, image_id, role FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT 'both', image_id, role FROM (SELECT * FROM a INTERSECT SELECT * FROM b) y""")
def u_sets(t: Tables) -> DataFrame:
    a, b = t.fx_object.filter("required").select("image_id", "role").distinct(), t.fx_object.filter("conf_pct % 2 = 0").select("image_id", "role")
    keys = ["image_id", "role"]
    return a.join(b, keys, "left_anti").select(F.lit("minus").alias("op"), *keys).unionByName(a.join(b, keys, "left_semi").select(F.lit("both").alias("op"), *keys))
