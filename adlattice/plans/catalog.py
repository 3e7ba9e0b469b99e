"""Catalog queries."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from adlattice import vocab
from adlattice.operators import catalog as C
from adlattice.plans.fixtures import Tables
from adlattice.plans.registry import query
from adlattice.session import shared_folder
from adlattice.sources.files import write_files
from adlattice.sources.tables import read_specs

_SPEC = "slug, sort_order, media, placement_type, width, height, active"


def _brief(df: DataFrame) -> DataFrame:
    return df.select(*[c.strip() for c in _SPEC.split(",")])


@query("s01_project_specs", """
SELECT media, 'n' || slug AS slug, CASE WHEN sort_order % 9 = 0 THEN 0 ELSE width END AS width, height, 10000 + CASE WHEN sort_order % 8 = 0 THEN 0 ELSE sort_order END AS sort_order,
       true AS active, safe_top, safe_right, safe_bottom, safe_left, parse_status, CASE WHEN sort_order % 4 = 0 THEN true WHEN sort_order % 4 = 1 THEN false END AS is_video,
       parse_status = 'parsed_text' AND safe_top IS NOT NULL AND safe_right IS NOT NULL AND safe_bottom IS NOT NULL AND safe_left IS NOT NULL AS has_zone
FROM fx_spec""")
def s_project_specs(t: Tables) -> DataFrame:
    """Catalog files, each a JSON array of at most 500 parts, written to the shared folder, scanned and projected."""
    o = F.col("sort_order")
    text = F.to_json(F.struct(
        o.alias("id"), "media", F.concat(F.lit("n"), "slug").alias("slug"), "width", "height",
        F.col("parse_status").alias("safeZoneParseStatus"), F.col("safe_top").alias("safeTop"), F.col("safe_right").alias("safeRight"),
        F.col("safe_bottom").alias("safeBottom"), F.col("safe_left").alias("safeLeft"), F.when(o % 4 < 3, o % 4 == 0).alias("isVideo")))
    text = F.when(o % 8 == 0, F.regexp_replace(text, r'"id":(\d+)', r'"id":"$1"')).otherwise(text)
    text = F.when(o % 9 == 0, F.regexp_replace(text, r'"width":(\d+)', r'"width":"wide"')).otherwise(text)
    text = F.when(o % 4 == 2, F.regexp_replace(text, r'"isVideo":false', r'"isVideo":"yes"')).otherwise(text)
    shelves = t.fx_spec.groupBy("media", F.floor(o / 500).alias("shelf")).agg(F.array_join(F.collect_list(text), ",\n").alias("js"))
    place = f"{shared_folder(t.spark).rstrip('/')}/adlattice-catalog-{uuid.uuid4().hex}"
    write_files(shelves.select(F.concat_ws("-", "media", F.col("shelf").cast("string")).alias("name"), F.concat(F.lit("[\n"), "js", F.lit("\n]\n")).alias("content"))
                .withColumn("name", F.concat("name", F.lit(".json"))), place)
    return read_specs(t.spark, place).select(
        "media", "slug", "width", "height", "sort_order", "active", "safe_top", "safe_right", "safe_bottom", "safe_left",
        "parse_status", "is_video", F.col("safe_zone").isNotNull().alias("has_zone"))


@query("s02_default_specs_by_catalog", """
WITH d AS (SELECT * FROM (VALUES ('google',23),('meta',5),('criteo',15),('mobion',12),('kakao',5),('linkedin',3),('tiktok',1)) v(media, n))
SELECT s.media, COUNT(*) AS catalog_specs, coalesce(any_value(d.n), 0)::BIGINT AS default_specs FROM fx_spec s LEFT JOIN d ON d.media = s.media GROUP BY s.media""")
def s_default_specs(t: Tables) -> DataFrame:
    counts = C.default_specs(t.spark).groupBy("media").agg(F.count("*").alias("n"))
    return (t.fx_spec.groupBy("media").agg(F.count("*").alias("catalog_specs")).join(counts, "media", "left")
            .select("media", "catalog_specs", F.coalesce("n", F.lit(0)).alias("default_specs")))


def _sql_text(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


_DEFAULT_ROWS = ", ".join("(" + ", ".join(map(_sql_text, (*row, True))) + ")" for row in vocab.DEFAULT_SPECS)


@query("s02_default_specs", f"""
SELECT d.media, placement_name, slug, width, height, aspect_ratio, sort_order, active, coalesce(n, 0)::BIGINT AS catalog_specs
FROM (VALUES {_DEFAULT_ROWS}) d(media, placement_name, slug, width, height, aspect_ratio, sort_order, active) LEFT JOIN (SELECT media, COUNT(*) AS n FROM fx_spec GROUP BY 1) c ON c.media = d.media""")
def s_default_rows(t: Tables) -> DataFrame:
    """Every built-in placement, beside the number of catalog specs of its media."""
    counts = t.fx_spec.groupBy("media").agg(F.count("*").alias("catalog_specs"))
    return C.default_specs(t.spark).join(counts, "media", "left").fillna(0, ["catalog_specs"])


@query("s03_init_specs", """SELECT media, COUNT(*) AS n FROM (SELECT media FROM fx_spec UNION ALL SELECT media FROM fx_spec WHERE sort_order % 3 = 0) u GROUP BY media""")
def s_init_specs(t: Tables) -> DataFrame:
    return C.init_specs(t.fx_spec, t.fx_spec.filter("sort_order % 3 = 0"), reset=False).groupBy("media").agg(F.count("*").alias("n"))


@query("p01_all_specs", f"SELECT {_SPEC} FROM fx_spec ORDER BY sort_order")
def p_all(t: Tables) -> DataFrame:
    return _brief(C.all_specs(t.fx_spec))


@query("p02_active_specs", f"SELECT {_SPEC} FROM fx_spec WHERE active ORDER BY sort_order")
def p_active(t: Tables) -> DataFrame:
    return _brief(C.active_specs(t.fx_spec))


@query("p03_specs_by_media", f"SELECT {_SPEC} FROM fx_spec WHERE media = 'naver' AND active")
def p_media(t: Tables) -> DataFrame:
    return _brief(C.specs_by_media(t.fx_spec, "naver"))


@query("p04_specs_by_media_in", f"SELECT {_SPEC} FROM fx_spec WHERE media IN ('naver', 'meta') AND active")
def p_media_in(t: Tables) -> DataFrame:
    return _brief(C.specs_by_media_in(t.fx_spec, ["naver", "meta"]))


@query("p05_specs_by_ids", f"SELECT {_SPEC} FROM fx_spec WHERE slug IN (SELECT slug FROM fx_job_spec)")
def p_ids(t: Tables) -> DataFrame:
    return _brief(C.specs_by_ids(t.fx_spec, t.fx_job_spec))


@query("p06_specs_by_placement", f"SELECT {_SPEC} FROM fx_spec WHERE placement_type = 'feed' OR slug = 'sp7' OR (media = 'google' AND slug = 'sp12')")
def p_one(t: Tables) -> DataFrame:
    s = t.fx_spec
    return _brief(C.specs_by_placement(s, "feed").union(C.specs_by_slug(s, "sp7")).union(C.spec_one(s, "google", "sp12")).distinct())


@query("p07_list_specs", f"""
SELECT 'both' AS mode, slug FROM fx_spec WHERE media = 'meta' AND active AND placement_type = 'feed'
UNION ALL SELECT 'media', slug FROM fx_spec WHERE media = 'meta' AND active
UNION ALL SELECT 'placement', slug FROM fx_spec WHERE placement_type = 'feed'
UNION ALL SELECT 'none', slug FROM fx_spec WHERE active""")
def p_list(t: Tables) -> DataFrame:
    out = None
    for mode, m, p in (("both", "meta", "feed"), ("media", "meta", None), ("placement", None, "feed"), ("none", None, None)):
        part = C.list_specs(t.fx_spec, m, p).select(F.lit(mode).alias("mode"), "slug")
        out = part if out is None else out.union(part)
    return out


@query("p19_spec_details", """
SELECT slug, coalesce(hl <> 0, false) OR parse_status = 'diagram_unreadable' OR coalesce(bg = false, false) OR coalesce(lv <> '', false) AS has_detail,
       parse_status = 'parsed_text' AND coalesce(safe_top, safe_right, safe_bottom, safe_left) IS NOT NULL AS has_zone
FROM (SELECT *, CASE WHEN sort_order % 4 < 3 THEN sort_order % 4 END AS hl, CASE WHEN sort_order % 11 = 0 THEN false WHEN sort_order % 11 = 1 THEN true END AS bg,
      CASE WHEN sort_order % 13 = 0 THEN '' WHEN sort_order % 13 = 1 THEN '2026-01-01' END AS lv FROM fx_spec) s""")
def p_details(t: Tables) -> DataFrame:
    s = t.fx_spec.selectExpr(
        "*", "CASE WHEN sort_order % 4 < 3 THEN sort_order % 4 END AS headline_max_chars", "CAST(NULL AS INT) AS description_max_chars",
        "CASE WHEN sort_order % 11 = 0 THEN false WHEN sort_order % 11 = 1 THEN true END AS bg_transparent",
        "CASE WHEN sort_order % 13 = 0 THEN '' WHEN sort_order % 13 = 1 THEN '2026-01-01' END AS last_verified",
        "CAST(NULL AS STRING) AS source_url")
    return s.select("slug", C.has_detail().alias("has_detail"), C.has_parsed_safe_zone().alias("has_zone"))


# --- upsert ------------------------------------------------------------------------------------------------------

_UPSERT_SQL = """
WITH ex AS (SELECT slug, 'id' || sort_order AS spec_id, media, width, height, placement_type, parse_status, safe_top, sort_order FROM fx_spec WHERE sort_order % 3 <> 0),
inc AS (SELECT CASE WHEN sort_order % 10 = 9 THEN 'sp' || (sort_order - 1) ELSE slug END AS slug, media, CASE WHEN sort_order % 4 = 0 THEN width + 1 ELSE width END AS width,
        height, placement_type, parse_status, safe_top, sort_order + 5 AS sort_order, sort_order AS batch_ord FROM fx_spec),
img AS (SELECT i.*, lag({'a': media, 'b': width, 'c': height, 'd': placement_type, 'e': parse_status, 'f': safe_top}) OVER w AS prev,
        {'a': media, 'b': width, 'c': height, 'd': placement_type, 'e': parse_status, 'f': safe_top} AS cur
        FROM inc i WINDOW w AS (PARTITION BY slug ORDER BY batch_ord)),
st AS (SELECT i.*, coalesce(prev, CASE WHEN e.slug IS NOT NULL THEN {'a': e.media, 'b': e.width, 'c': e.height, 'd': e.placement_type, 'e': e.parse_status, 'f': e.safe_top} END) AS bef
       FROM img i LEFT JOIN ex e ON e.slug = i.slug),
status AS (SELECT *, CASE WHEN bef IS NULL THEN 'INSERTED' WHEN bef IS NOT DISTINCT FROM cur THEN 'UNCHANGED' ELSE 'UPDATED' END AS status FROM st)
"""
_COMPARED = ["media", "width", "height", "placement_type", "parse_status", "safe_top"]


def _upsert_input(t: Tables) -> tuple[DataFrame, DataFrame]:
    existing = t.fx_spec.filter("sort_order % 3 <> 0").selectExpr(
        "slug", "concat('id', sort_order) AS spec_id", "media", "width", "height", "placement_type", "parse_status", "safe_top", "sort_order")
    incoming = t.fx_spec.selectExpr(
        "CASE WHEN sort_order % 10 = 9 THEN concat('sp', sort_order - 1) ELSE slug END AS slug", "media",
        "CASE WHEN sort_order % 4 = 0 THEN width + 1 ELSE width END AS width", "height", "placement_type", "parse_status", "safe_top",
        "sort_order + 5 AS sort_order", "sort_order AS batch_ord")
    return existing, incoming


@query("j01_upsert_status", _UPSERT_SQL + "SELECT slug, batch_ord, status FROM status")
def j_upsert_status(t: Tables) -> DataFrame:
    return C.upsert_specs(*_upsert_input(t), compared=_COMPARED)[1]


@query("j01_upsert_merged", _UPSERT_SQL + """,
wr AS (SELECT * FROM status WHERE status <> 'UNCHANGED' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY batch_ord DESC) = 1)
SELECT coalesce(e.slug, w.slug) AS slug, coalesce(e.spec_id, 'new-' || w.slug) AS spec_id, CASE WHEN w.slug IS NULL THEN e.media ELSE w.media END AS media,
       CASE WHEN w.slug IS NULL THEN e.width ELSE w.width END AS width, CASE WHEN w.slug IS NULL THEN e.height ELSE w.height END AS height,
       CASE WHEN w.slug IS NULL THEN e.safe_top ELSE w.safe_top END AS safe_top, CASE WHEN w.slug IS NULL THEN e.sort_order ELSE w.sort_order END AS sort_order
FROM ex e FULL JOIN wr w ON w.slug = e.slug""")
def j_upsert_merged(t: Tables) -> DataFrame:
    return C.upsert_specs(*_upsert_input(t), compared=_COMPARED)[0].select("slug", "spec_id", "media", "width", "height", "safe_top", "sort_order")


@query("j02_replace_specs", _UPSERT_SQL + """,
l AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY slug ORDER BY batch_ord DESC) = 1)
SELECT coalesce(e.slug, l.slug) AS slug, CASE WHEN l.slug IS NULL THEN e.width ELSE l.width END AS width, CASE WHEN l.slug IS NULL THEN e.sort_order ELSE l.sort_order END AS sort_order
FROM ex e FULL JOIN l ON l.slug = e.slug""")
def j_replace(t: Tables) -> DataFrame:
    existing, incoming = _upsert_input(t)
    return C.replace_specs(existing.drop("spec_id"), incoming).select("slug", "width", "sort_order")


@query("a01_seed_summary", _UPSERT_SQL + """
SELECT media, COUNT(*) AS loaded, COUNT(*) FILTER (status = 'INSERTED') AS inserted, COUNT(*) FILTER (status = 'UPDATED') AS updated,
       COUNT(*) FILTER (status = 'UNCHANGED') AS unchanged, 0::BIGINT AS failed, COUNT(*) AS total FROM status GROUP BY media""")
def a_seed(t: Tables) -> DataFrame:
    existing, incoming = _upsert_input(t)
    status = C.upsert_specs(existing, incoming, compared=_COMPARED)[1]
    return C.seed_summary(status.join(incoming.select("batch_ord", "media"), "batch_ord"), ["media"])


@query("a02_verify_catalog", """
WITH s AS (SELECT CASE WHEN sort_order % 50 = 0 THEN NULL WHEN sort_order % 20 = 1 THEN 'dup' || sort_order % 3 ELSE slug END AS slug, media, parse_status,
           sort_order % 17 = 0 AS needs_review, CASE WHEN sort_order % 40 = 3 THEN 0 ELSE width END AS width, height FROM fx_spec)
SELECT (COUNT(*) FILTER (media = 'naver'))::BIGINT AS total, COUNT(*) FILTER (media = 'naver' AND parse_status = 'parsed_text') AS parsed_text,
  COUNT(*) FILTER (media = 'naver' AND parse_status = 'diagram_unreadable') AS diagram_unreadable, COUNT(*) FILTER (media = 'naver' AND needs_review) AS needs_review,
  COUNT(*) FILTER (slug IS NULL OR slug = '') AS null_slug, COUNT(*) FILTER (width <= 0 OR height <= 0) AS bad_dims,
  COUNT(slug) - COUNT(DISTINCT slug) AS duplicate_slugs, COUNT(*) FILTER (media <> 'naver') AS foreign_media FROM s""")
def a_verify(t: Tables) -> DataFrame:
    s = t.fx_spec.selectExpr(
        "CASE WHEN sort_order % 50 = 0 THEN NULL WHEN sort_order % 20 = 1 THEN concat('dup', sort_order % 3) ELSE slug END AS slug", "media", "parse_status",
        "sort_order % 17 = 0 AS needs_review", "CASE WHEN sort_order % 40 = 3 THEN 0 ELSE width END AS width", "height")
    return C.verify_catalog(s, "naver")


def _deactivated(limit: int) -> str:
    return f"""
WITH h AS (SELECT *, media = 'naver' AND slug IN (SELECT slug FROM fx_job_spec) AS hit FROM fx_spec),
c AS (SELECT COUNT(*) FILTER (hit) AS found, COUNT(*) FILTER (hit AND active) AS was_active, COUNT(*) FILTER (hit) > {limit} AS refused FROM h)
SELECT slug, active AND (refused OR NOT hit) AS active, found, CASE WHEN refused THEN 0 ELSE was_active END AS modified, refused FROM h, c"""


def deactivated(t: Tables, limit: int) -> DataFrame:
    off, counts = C.deactivate(t.fx_spec, "naver", t.fx_job_spec, limit)
    return off.select("slug", "active", *[counts.select(c).scalar().alias(c) for c in ("found", "modified", "refused")])


@query("a03_deactivate", _deactivated(8))
def a_deactivate(t: Tables) -> DataFrame:
    return deactivated(t, 8)


@query("a03_deactivate_accepted", _deactivated(1_000_000_000))
def a_deactivate_accepted(t: Tables) -> DataFrame:
    return deactivated(t, 1_000_000_000)


@query("a06_media_selection", """
SELECT s.media, COUNT(*) AS specs, COUNT(c.slug) AS selected, COUNT(*) = COUNT(c.slug) AS all_selected, COUNT(c.slug) > 0 AND COUNT(c.slug) < COUNT(*) AS partial
FROM fx_spec s LEFT JOIN (SELECT DISTINCT slug FROM fx_job_spec WHERE ordinal = 2) c ON c.slug = s.slug GROUP BY s.media""")
def a_selection(t: Tables) -> DataFrame:
    return C.media_selection(t.fx_spec, t.fx_job_spec.filter("ordinal = 2"))


@query("f21_inset_map", """
SELECT slug, CASE WHEN safe_top IS NOT NULL AND safe_right IS NOT NULL AND safe_bottom IS NOT NULL AND safe_left IS NOT NULL AND parse_status = 'parsed_text'
            THEN safe_top || ',' || safe_right || ',' || safe_bottom || ',' || safe_left END AS strict,
       CASE WHEN parse_status = 'parsed_text' AND safe_top IS NOT NULL THEN coalesce(safe_right::VARCHAR, '-') END AS lenient_right FROM fx_spec""")
def f_inset_map(t: Tables) -> DataFrame:
    side = F.array_join(F.map_values("m"), ",")
    d = t.fx_spec.withColumn("m", C.inset_map()).withColumn("n", C.inset_map(need_all=False))
    return d.select("slug", F.when(F.col("m").isNotNull(), side).alias("strict"),
                    F.when(F.col("n").isNotNull(), F.coalesce(F.col("n")["right"].cast("string"), F.lit("-"))).alias("lenient_right"))


@query("j06_spec_items", """
SELECT slug, media, CASE WHEN sort_order % 12 = 0 THEN 'kept' WHEN parse_status = 'parsed_text' AND safe_top IS NOT NULL AND safe_right IS NOT NULL AND safe_bottom IS NOT NULL AND safe_left IS NOT NULL THEN 'built' END AS zone,
  sort_order % 3 = 0 OR sort_order % 5 = 1 AS has_rules, CASE WHEN sort_order % 5 = 1 THEN sort_order * 2 END AS max_kb FROM fx_spec""")
def j_spec_items(t: Tables) -> DataFrame:
    s = t.fx_spec.selectExpr(
        "*", "concat('place ', slug) AS placement_name", "CASE WHEN sort_order % 12 = 0 THEN map('kept', 1) END AS safe_zone",
        "CASE WHEN sort_order % 3 = 0 THEN array('png') END AS file_formats", "CASE WHEN sort_order % 5 = 1 THEN sort_order * 2 END AS max_file_size_kb",
        "CAST(NULL AS INT) AS min_file_size_kb")
    zone = F.when(F.map_contains_key("safe_zone", F.lit("kept")), "kept").when(F.col("safe_zone").isNotNull(), "built")
    return C.spec_items(s).select("slug", "media", zone.alias("zone"), F.col("file_rules").isNotNull().alias("has_rules"),
                                  F.col("file_rules.max_file_size_kb").alias("max_kb"))


# --- request resolution ------------------------------------------------------------------------------------------

_MSG_SQL = """
WITH ids AS (SELECT job_id, list(DISTINCT slug) AS spec_ids FROM fx_job_spec GROUP BY job_id),
msg AS (SELECT j.job_id, CASE WHEN j.job_id % 50 <> 0 AND j.job_id % 50 <> 1 THEN spec_ids END AS spec_ids,
        CASE WHEN j.job_id % 50 = 0 THEN ['kakao'] WHEN j.job_id % 50 = 1 THEN ['nowhere'] ELSE [] END AS tm FROM fx_job j LEFT JOIN ids USING (job_id)),
found AS (SELECT m.job_id, s.* FROM (SELECT job_id, unnest(spec_ids) AS slug FROM msg) m JOIN fx_spec s USING (slug)
          UNION ALL SELECT m.job_id, s.* FROM (SELECT job_id, unnest(tm) AS media FROM msg WHERE coalesce(len(spec_ids), 0) = 0) m JOIN fx_spec s ON s.media = m.media AND s.active)
"""


def messages(t: Tables) -> DataFrame:
    """One message per job: its spec ids, or a media list for every 50th."""
    ids = t.fx_job_spec.groupBy("job_id").agg(F.collect_set("slug").alias("ids"))
    return t.fx_job.select("job_id").join(ids, "job_id", "left").selectExpr(
        "job_id", "CASE WHEN job_id % 50 NOT IN (0, 1) THEN ids END AS spec_ids",
        "CASE WHEN job_id % 50 = 0 THEN array('kakao') WHEN job_id % 50 = 1 THEN array('nowhere') ELSE array() END AS target_media")


@query("j03_resolve_specs", _MSG_SQL + "SELECT job_id, slug, media, width, height FROM found")
def j_resolve(t: Tables) -> DataFrame:
    return C.resolve_specs(messages(t), t.fx_spec)[0].select("job_id", "slug", "media", "width", "height")


@query("j03_jobs_without_specs", _MSG_SQL + "SELECT job_id, 'no specs selected' AS error FROM msg WHERE job_id NOT IN (SELECT job_id FROM found)")
def j_resolve_failed(t: Tables) -> DataFrame:
    return C.resolve_specs(messages(t), t.fx_spec)[1]


@query("j04_job_media", _MSG_SQL + """, m AS (SELECT job_id, media, MIN(sort_order) AS fst FROM found GROUP BY 1, 2)
SELECT job_id, string_agg(media, ',' ORDER BY fst, media) AS media FROM m GROUP BY job_id""")
def j_media(t: Tables) -> DataFrame:
    return C.job_media(C.resolve_specs(messages(t), t.fx_spec, first_of_media=True)[0]).withColumn("media", F.array_join("media", ","))


@query("u04_distinct_media", "SELECT DISTINCT j.job_id, s.media FROM fx_job_spec j JOIN fx_spec s USING (slug)")
def u_distinct_media(t: Tables) -> DataFrame:
    return t.fx_job_spec.join(t.fx_spec, "slug").select("job_id", "media").dropDuplicates()


@query("j05_resolve_safe_zone", """
WITH r AS (SELECT job_id, ordinal, CASE WHEN ordinal = 3 THEN '' ELSE slug END AS slug FROM fx_job_spec),
d AS (SELECT slug, safe_top, safe_right, safe_bottom, safe_left FROM fx_spec WHERE safe_top IS NOT NULL AND safe_right IS NOT NULL AND safe_bottom IS NOT NULL AND safe_left IS NOT NULL)
SELECT job_id, ordinal, CASE WHEN d.slug IS NOT NULL THEN 'catalog' ELSE 'request' END AS zone_source,
  coalesce(d.safe_top, CASE WHEN ordinal % 2 = 0 THEN 11 END, CASE WHEN ordinal % 3 = 0 THEN 12 END, 0) AS zone_top,
  coalesce(d.safe_right, CASE WHEN ordinal % 3 = 0 THEN 22 END, ordinal, 0) AS zone_right, coalesce(d.safe_bottom, 0) AS zone_bottom,
  coalesce(d.safe_left, CASE WHEN ordinal % 2 = 0 THEN 44 END, 0) AS zone_left
FROM r LEFT JOIN d USING (slug)""")
def j_safe_zone(t: Tables) -> DataFrame:
    r = t.fx_job_spec.selectExpr(
        "job_id", "ordinal", "CASE WHEN ordinal = 3 THEN '' ELSE slug END AS slug",
        "CASE WHEN ordinal % 2 = 0 THEN map('top', 11, 'left', 44) END AS zone", "CASE WHEN ordinal % 3 = 0 THEN 12 END AS safeTop",
        "CASE WHEN ordinal % 3 = 0 THEN 22 END AS safeRight", "ordinal AS safe_right")
    return C.resolve_safe_zone(r, t.fx_spec).select("job_id", "ordinal", "zone_source", "zone_top", "zone_right", "zone_bottom", "zone_left")
