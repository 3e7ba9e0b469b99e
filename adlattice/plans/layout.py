"""Geometry and layout queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adlattice import vocab
from adlattice.functions import geometry as G, placing as PL
from adlattice.operators import layers as LY, layout as LO
from adlattice.plans.fixtures import Tables
from adlattice.plans.registry import query

# --- objects of each image in each placement of the job ----------------------------------------------------------

TARGETS_SQL = """
targets AS (
  SELECT js.job_id, js.ordinal, s.slug, s.width AS tgt_w, s.height AS tgt_h, i.width AS src_w, i.height AS src_h,
         CASE WHEN s.safe_top IS NOT NULL AND s.safe_right IS NOT NULL AND s.safe_bottom IS NOT NULL AND s.safe_left IS NOT NULL
              THEN s.safe_top ELSE 0 END AS safe_top,
         CASE WHEN s.safe_top IS NOT NULL AND s.safe_right IS NOT NULL AND s.safe_bottom IS NOT NULL AND s.safe_left IS NOT NULL
              THEN s.safe_right ELSE 0 END AS safe_right,
         CASE WHEN s.safe_top IS NOT NULL AND s.safe_right IS NOT NULL AND s.safe_bottom IS NOT NULL AND s.safe_left IS NOT NULL
              THEN s.safe_bottom ELSE 0 END AS safe_bottom,
         CASE WHEN s.safe_top IS NOT NULL AND s.safe_right IS NOT NULL AND s.safe_bottom IS NOT NULL AND s.safe_left IS NOT NULL
              THEN s.safe_left ELSE 0 END AS safe_left
  FROM fx_job_spec js JOIN fx_spec s ON js.slug = s.slug JOIN fx_image i ON i.image_id = js.job_id),
tx0 AS (
  SELECT *, greatest(1, round_even(src_w * least(tgt_w / src_w, tgt_h / src_h), 0)::INT) AS proj_w,
            greatest(1, round_even(src_h * least(tgt_w / src_w, tgt_h / src_h), 0)::INT) AS proj_h FROM targets),
tx AS (SELECT *, floor((tgt_w - proj_w) / 2)::INT AS off_x, floor((tgt_h - proj_h) / 2)::INT AS off_y FROM tx0),
placed AS (
  SELECT tx.*, o.ord, o.role, o.required, o.movable,
         off_x + round_even(o.x * (proj_w / src_w), 0)::INT AS px, off_y + round_even(o.y * (proj_h / src_h), 0)::INT AS py,
         greatest(1, round_even(o.w * (proj_w / src_w), 0)::INT) AS pw, greatest(1, round_even(o.h * (proj_h / src_h), 0)::INT) AS ph
  FROM tx JOIN fx_object o ON o.image_id = tx.job_id),
coded AS (
  SELECT *, CASE WHEN NOT (px >= 0 AND py >= 0 AND px + pw <= tgt_w AND py + ph <= tgt_h) THEN 'CANVAS_OVERFLOW'
                 WHEN required AND NOT (px >= safe_left AND py >= safe_top AND px + pw <= tgt_w - safe_right AND py + ph <= tgt_h - safe_bottom)
                 THEN 'SAFE_ZONE_VIOLATION' END AS code FROM placed)
"""


def targets(t: Tables) -> DataFrame:
    """One row per job and chosen placement with sizes and resolved insets.

    The catalog side carries no hint: it is broadcast only while its measured size allows it.
    """
    s = t.fx_spec.alias("s")
    insets = ["safe_top", "safe_right", "safe_bottom", "safe_left"]
    known = F.col("s.safe_top").isNotNull() & F.col("s.safe_right").isNotNull() & \
        F.col("s.safe_bottom").isNotNull() & F.col("s.safe_left").isNotNull()
    images = t.fx_image.select(F.col("image_id").alias("job_id"), F.col("width").alias("src_w"),
                               F.col("height").alias("src_h"))
    return (t.fx_job_spec.alias("j").join(s, "slug").join(images, "job_id")
            .select("job_id", "ordinal", "slug", F.col("s.width").alias("tgt_w"), F.col("s.height").alias("tgt_h"),
                    "src_w", "src_h", *[F.when(known, F.col(f"s.{c}")).otherwise(F.lit(0)).alias(c) for c in insets]))


def placed_objects(t: Tables) -> DataFrame:
    objects = t.fx_object.withColumnRenamed("image_id", "job_id")
    return LO.project_objects(targets(t).join(objects, "job_id"))


@query("entry_layout_violations", f"""
WITH {TARGETS_SQL}
SELECT job_id, ordinal, COUNT(*) AS objects, COUNT(*) FILTER (code IS NOT NULL) AS faults,
       arg_min(code, ord) FILTER (code IS NOT NULL) AS first_code, MIN(ord) FILTER (code IS NOT NULL) AS first_ord
FROM coded GROUP BY job_id, ordinal""")
def entry_layout_violations(t: Tables) -> DataFrame:
    return LO.first_violation(placed_objects(t), ["job_id", "ordinal"])


@query("g01_contain_transform", f"""
WITH {TARGETS_SQL} SELECT job_id, ordinal, proj_w, proj_h, off_x, off_y FROM tx""")
def contain_transform(t: Tables) -> DataFrame:
    return targets(t).select("job_id", "ordinal", G.contain("src_w", "src_h", "tgt_w", "tgt_h").alias("tx")).select(
        "job_id", "ordinal", "tx.*")


@query("g02_letterbox_projection", f"""
WITH {TARGETS_SQL} SELECT job_id, ordinal, ord, px, py, pw, ph FROM placed""")
def letterbox_projection(t: Tables) -> DataFrame:
    return placed_objects(t).select("job_id", "ordinal", "ord", "px", "py", "pw", "ph")


@query("g03_safe_zone_tests", f"""
WITH {TARGETS_SQL}
SELECT job_id, ordinal, ord, safe_left AS zl, safe_top AS zt, tgt_w - safe_right AS zr, tgt_h - safe_bottom AS zb,
       (px >= safe_left AND py >= safe_top AND px + pw <= tgt_w - safe_right AND py + ph <= tgt_h - safe_bottom) AS in_zone,
       (px >= 0 AND py >= 0 AND px + pw <= tgt_w AND py + ph <= tgt_h) AS in_canvas,
       (greatest(0, least(px + pw, tgt_w - safe_right) - greatest(px, safe_left))::BIGINT
        * greatest(0, least(py + ph, tgt_h - safe_bottom) - greatest(py, safe_top))) AS shared
FROM placed""")
def safe_zone_tests(t: Tables) -> DataFrame:
    z = G.safe_zone("tgt_w", "tgt_h", "safe_top", "safe_right", "safe_bottom", "safe_left")
    box = ("px", "py", "pw", "ph")
    return placed_objects(t).withColumn("z", z).select(
        "job_id", "ordinal", "ord", F.col("z.left").alias("zl"), F.col("z.top").alias("zt"), F.col("z.right").alias("zr"),
        F.col("z.bottom").alias("zb"), G.in_zone(F.col("z"), *box).alias("in_zone"),
        G.in_canvas(*box, "tgt_w", "tgt_h").alias("in_canvas"),
        G.intersection_area(*box, F.col("z.left"), F.col("z.top"), F.col("z.right") - F.col("z.left"),
                            F.col("z.bottom") - F.col("z.top")).alias("shared"))


@query("g04_safe_metrics", """
SELECT slug, CASE WHEN ok THEN width - safe_left - safe_right END AS safe_width, CASE WHEN ok THEN height - safe_top - safe_bottom END AS safe_height,
       CASE WHEN ok THEN safe_top / height * 100 END AS top_pct, CASE WHEN ok THEN safe_right / width * 100 END AS right_pct,
       CASE WHEN ok THEN safe_bottom / height * 100 END AS bottom_pct, CASE WHEN ok THEN safe_left / width * 100 END AS left_pct
FROM (SELECT *, coalesce(parse_status = 'parsed_text' AND width > 0 AND height > 0 AND safe_top >= 0 AND safe_right >= 0 AND safe_bottom >= 0
             AND safe_left >= 0 AND width - safe_left - safe_right > 0 AND height - safe_top - safe_bottom > 0, false) AS ok FROM fx_spec)""")
def safe_metrics(t: Tables) -> DataFrame:
    return t.fx_spec.select("slug", G.safe_metrics().alias("m")).select("slug", "m.*")


# --- candidates and placement ------------------------------------------------------------------------------------

LAYOUT = ["job_id", "ordinal"]


def pieces(t: Tables) -> DataFrame:
    return t.fx_object.select(F.col("image_id").alias("job_id"), F.format_string("o%d", F.col("ord")).alias("object_id"), "ord", "role", "required", "movable",
                              "x", "y", "w", "h")


def canvases(t: Tables) -> DataFrame:
    """The placements of a job with what candidates need of them."""
    return targets(t).select(
        *LAYOUT, F.col("src_w").alias("image_w"), F.least(F.col("tgt_w") / F.col("src_w"), F.col("tgt_h") / F.col("src_h")).alias("scale"),
        F.col("safe_left").alias("zone_left"), F.col("safe_top").alias("zone_top"),
        (F.col("tgt_w") - F.col("safe_right")).alias("zone_right"), (F.col("tgt_h") - F.col("safe_bottom")).alias("zone_bottom"),
        F.col("tgt_w").alias("canvas_w"), F.col("tgt_h").alias("canvas_h"), "src_w", "src_h", "tgt_w", "tgt_h")


def candidate_input(t: Tables) -> DataFrame:
    """Objects of every image against every placement of its job."""
    return pieces(t).join(canvases(t), "job_id")


_ANCHOR_SQL = "CASE role " + " ".join(
    f"WHEN '{r}' THEN [{', '.join(repr(a) for a in v)}]" for r, v in vocab.ROLE_ANCHORS.items()) + " ELSE ['top-center'] END"
CANDIDATE_SQL = f"""
WITH {TARGETS_SQL},
obj AS (
  SELECT f.job_id, f.ordinal, 'o' || o.ord AS object_id, o.ord, o.role, o.required, o.movable, o.x, o.y, o.w, o.h, f.src_w AS image_w,
         safe_left AS zl, safe_top AS zt, tgt_w - safe_right AS zr, tgt_h - safe_bottom AS zb, tgt_w AS canvas_w, tgt_h AS canvas_h,
         greatest(1, round_even(o.w * least(tgt_w / src_w, tgt_h / src_h), 0)::INT) AS ow,
         greatest(1, round_even(o.h * least(tgt_w / src_w, tgt_h / src_h), 0)::INT) AS oh,
         {_ANCHOR_SQL} AS anchors, CASE WHEN o.x + o.w / 2 > f.src_w / 2 THEN 'right' ELSE 'left' END AS side,
         off_x, off_y, proj_w, proj_h, src_w, src_h
  FROM tx f JOIN fx_object o ON o.image_id = f.job_id),
sided AS (
  SELECT *, list_concat(list_filter(anchors, lambda a: contains(a, side)), list_filter(anchors, lambda a: NOT contains(a, side))) AS aa,
         CASE WHEN role = 'product' AND ow < round_even(image_w * 0.25::DOUBLE, 0) THEN [round_even(round_even(image_w * 0.25::DOUBLE, 0) / ow * 100, 0) / 100, 1.0, 0.9, 0.8, 0.7, 0.6]::DOUBLE[]
              ELSE [1.0, 0.9, 0.8, 0.7, 0.6]::DOUBLE[] END AS ss FROM obj),
e1 AS (SELECT *, unnest(aa) AS anchor, generate_subscripts(aa, 1) - 1 AS ai FROM sided),
e2 AS (SELECT *, unnest(ss) AS cand_scale, generate_subscripts(ss, 1) - 1 AS si FROM e1),
e3 AS (SELECT *, greatest(1, round_even(ow * cand_scale, 0)::INT) AS cw, greatest(1, round_even(oh * cand_scale, 0)::INT) AS ch,
       (ai * len(ss) + si)::INT AS cand FROM e2),
cands AS (
  SELECT *, CASE anchor WHEN 'center-left' THEN zl + floor((zr - zl) / 3)::INT - floor(cw / 2)::INT
                        WHEN 'center-right' THEN zl + floor((zr - zl) * 2 / 3)::INT - floor(cw / 2)::INT
                        WHEN 'top-center' THEN zl + floor((zr - zl - cw) / 2)::INT WHEN 'bottom-center' THEN zl + floor((zr - zl - cw) / 2)::INT
                        WHEN 'top-right' THEN zr - cw WHEN 'right-center' THEN zr - cw WHEN 'bottom-right' THEN zr - cw ELSE zl END AS cx,
         CASE WHEN anchor LIKE 'top%' THEN zt WHEN anchor LIKE 'bottom%' THEN zb - ch ELSE zt + floor((zb - zt - ch) / 2)::INT END AS cy
  FROM e3),
prot AS (SELECT job_id, ordinal, off_x + round_even(x * (proj_w / src_w), 0)::INT AS qx, off_y + round_even(y * (proj_h / src_h), 0)::INT AS qy,
                greatest(1, round_even(w * (proj_w / src_w), 0)::INT) AS qw, greatest(1, round_even(h * (proj_h / src_h), 0)::INT) AS qh
         FROM obj WHERE role = 'protected_subject'),
valid AS (
  SELECT * FROM cands c WHERE cx >= 0 AND cy >= 0 AND cx + cw <= canvas_w AND cy + ch <= canvas_h
    AND (NOT required OR (cx >= zl AND cy >= zt AND cx + cw <= zr AND cy + ch <= zb))
    AND NOT EXISTS (SELECT 1 FROM prot p WHERE p.job_id = c.job_id AND p.ordinal = c.ordinal
        AND greatest(0, least(cx + cw, qx + qw) - greatest(cx, qx)) * greatest(0, least(cy + ch, qy + qh) - greatest(cy, qy)) / (qw * qh) > 0.30))
"""


def extracted(t: Tables) -> DataFrame:
    return candidate_input(t).filter("role <> 'protected_subject'")


def per_object(objects: DataFrame, *fields: str) -> DataFrame:
    """One row per object that has candidates, these in order, each as its colon-joined ``fields``; ``percent`` is the scale's.

    The text is made in the worker that made the candidates.  It isn't deterministic, as a filter on it would be pushed below it
    and compute every candidate twice.
    """
    text = F.arrow_udf(PL.texts([*fields]), "struct<n:bigint,candidates:string>").asNondeterministic()
    return objects.select(*LAYOUT, "object_id", text("cands").alias("_t")).filter("_t.n > 0").select(*LAYOUT, "object_id", "_t.n", "_t.candidates")


_BOX = ["cand", "cx", "cy", "cw", "ch"]


@query("g05_candidate_generation", CANDIDATE_SQL + """
SELECT job_id, ordinal, object_id, COUNT(*) AS n, string_agg(concat_ws(':', cand, anchor, round(cand_scale * 100)::INT, cx, cy, cw, ch), ';' ORDER BY cand) AS candidates
FROM cands WHERE role <> 'protected_subject' GROUP BY ALL""")
def candidate_generation(t: Tables) -> DataFrame:
    return per_object(LO.candidates(extracted(t)), "cand", "anchor", "percent", *_BOX[1:])


@query("g06_static_constraints", CANDIDATE_SQL + """
SELECT job_id, ordinal, object_id, COUNT(*) AS n, string_agg(concat_ws(':', cand, cx, cy, cw, ch), ';' ORDER BY cand) AS candidates FROM valid WHERE role <> 'protected_subject' GROUP BY ALL""")
def static_constraints(t: Tables) -> DataFrame:
    return per_object(LO.job_candidates(pieces(t), canvases(t), LAYOUT, "job_id"), *_BOX)


_PRIO_SQL = "CASE role " + " ".join(f"WHEN '{r}' THEN {p}" for r, p in vocab.ROLE_PRIORITY.items()) + " ELSE 99 END"


_GREEDY_SQL = CANDIDATE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ranked AS (SELECT job_id, ordinal, object_id, anchor, cx, cy, cw, ch,
                  row_number() OVER (PARTITION BY job_id, ordinal ORDER BY NOT required, {_PRIO_SQL}, object_id, cand) AS rn
           FROM valid WHERE role <> 'protected_subject'),
mx AS (SELECT job_id, ordinal, MAX(rn) AS n FROM ranked GROUP BY job_id, ordinal),
walk AS (
  SELECT job_id, ordinal, 0::BIGINT AS step, []::STRUCT(o VARCHAR, a VARCHAR, x INT, y INT, w INT, h INT)[] AS kept FROM mx
  UNION ALL
  SELECT w.job_id, w.ordinal, r.rn, CASE WHEN list_any_value(list_filter(w.kept, lambda k: k.o = r.object_id OR
           (greatest(0, least(k.x + k.w, r.cx + r.cw) - greatest(k.x, r.cx)) * greatest(0, least(k.y + k.h, r.cy + r.ch) - greatest(k.y, r.cy)))
            / least(k.w * k.h, r.cw * r.ch) > 0.30)) IS NOT NULL THEN w.kept
         ELSE list_append(w.kept, {{'o': r.object_id, 'a': r.anchor, 'x': r.cx, 'y': r.cy, 'w': r.cw, 'h': r.ch}}) END
  FROM walk w JOIN ranked r ON r.job_id = w.job_id AND r.ordinal = w.ordinal AND r.rn = w.step + 1),
fin AS (SELECT w.job_id, w.ordinal, unnest(w.kept) AS k FROM walk w JOIN mx ON mx.job_id = w.job_id AND mx.ordinal = w.ordinal AND mx.n = w.step),
verdicts AS (SELECT o.job_id, o.ordinal, COUNT(f.k) AS placed, COUNT(*) FILTER (o.required AND f.k IS NULL) AS unmet
             FROM obj o LEFT JOIN fin f ON f.job_id = o.job_id AND f.ordinal = o.ordinal AND f.k.o = o.object_id WHERE o.role <> 'protected_subject' GROUP BY 1, 2)
"""


def greedy(t: Tables) -> DataFrame:
    return LO.job_layouts(pieces(t), canvases(t), LAYOUT, "job_id")


@query("g07_greedy_placement", _GREEDY_SQL + """
SELECT f.job_id, f.ordinal, k.o AS object_id, k.a AS anchor, k.x AS cx, k.y AS cy, k.w AS cw, k.h AS ch FROM fin f JOIN verdicts v USING (job_id, ordinal) WHERE v.unmet = 0""")
def greedy_placement(t: Tables) -> DataFrame:
    """Placements of the layouts that succeed; a failed one has none."""
    return greedy(t).filter("code IS NULL").select(*LAYOUT, F.inline("kept")).select(*LAYOUT, "object_id", "anchor", "cx", "cy", "cw", "ch")


@query("g07_placement_outcome", _GREEDY_SQL + "SELECT job_id, ordinal, CASE WHEN unmet > 0 THEN 'NO_VALID_CANDIDATES' END AS code, unmet, placed FROM verdicts")
def placement_outcome(t: Tables) -> DataFrame:
    return greedy(t).select(*LAYOUT, "code", "unmet", "placed")


@query("q04_validate_layout", f"""
WITH {TARGETS_SQL},
man AS (SELECT t.job_id, t.ordinal, o.ord, o.required, o.movable, o.role FROM targets t JOIN fx_object o ON o.image_id = t.job_id),
keep AS (SELECT * FROM coded WHERE role <> 'protected_subject' AND ord % 5 <> 4),
per AS (SELECT m.job_id, m.ordinal, COUNT(*) FILTER (m.required AND m.movable AND m.role <> 'protected_subject' AND k.ord IS NULL) AS missing, COUNT(k.ord) AS n,
               arg_min(k.code, k.ord) FILTER (k.code IS NOT NULL) AS fc
        FROM man m LEFT JOIN keep k ON k.job_id = m.job_id AND k.ordinal = m.ordinal AND k.ord = m.ord GROUP BY 1, 2)
SELECT job_id, ordinal, missing, CASE WHEN n = 0 THEN 'NO_REMOVABLE_OBJECTS' WHEN missing > 0 THEN 'REQUIRED_OBJECT_MISSING' ELSE fc END AS code FROM per""")
def q_validate_layout(t: Tables) -> DataFrame:
    every = placed_objects(t).withColumn("object_id", F.col("ord"))
    manifest = every.select("job_id", "ordinal", "object_id", "required", "movable",
                            (F.col("role") != "protected_subject").alias("removable"), "src_w", "src_h")
    kept = every.filter((F.col("role") != "protected_subject") & (F.col("ord") % 5 != 4))
    return LO.validate_layout(manifest, kept, ["job_id", "ordinal"])


# --- layered files -----------------------------------------------------------------------------------------------

LAYER_SQL = """
lay0 AS (SELECT *, lower(trim(name, '[] ' || chr(9))) AS bare FROM fx_layer),
lay AS (SELECT * EXCLUDE (bare, x1, y1, x2, y2),
        CASE WHEN NOT is_group THEN x1 END AS x1, CASE WHEN NOT is_group THEN y1 END AS y1, CASE WHEN NOT is_group THEN x2 END AS x2, CASE WHEN NOT is_group THEN y2 END AS y2,
        CASE WHEN starts_with(bare, 'title-group') THEN 'title-group' WHEN starts_with(bare, 'product-group') THEN 'product-group'
             WHEN starts_with(bare, 'title') THEN 'title' WHEN starts_with(bare, 'body') THEN 'body' WHEN starts_with(bare, 'badge') THEN 'badge'
             WHEN starts_with(bare, 'product') THEN 'product' WHEN starts_with(bare, 'person') THEN 'person' WHEN starts_with(bare, 'logo') THEN 'logo'
             WHEN starts_with(bare, 'bg') THEN 'bg' ELSE 'unknown' END AS role FROM lay0),
spans AS (SELECT g.psd_id, g.ord, (SELECT MIN(c.ord) FROM lay c WHERE c.psd_id = g.psd_id AND c.ord > g.ord AND c.depth <= g.depth) AS stop FROM lay g WHERE g.is_group),
hulls AS (SELECT s.psd_id, s.ord, MIN(c.x1) AS x1, MIN(c.y1) AS y1, MAX(c.x2) AS x2, MAX(c.y2) AS y2
          FROM spans s JOIN lay c ON c.psd_id = s.psd_id AND c.ord > s.ord AND (s.stop IS NULL OR c.ord < s.stop) AND NOT c.is_group GROUP BY 1, 2),
filled AS (SELECT l.psd_id, l.ord, l.depth, l.name, l.is_group, l.visible, l.role,
           CASE WHEN l.is_group THEN h.x1 ELSE l.x1 END AS x1, CASE WHEN l.is_group THEN h.y1 ELSE l.y1 END AS y1,
           CASE WHEN l.is_group THEN h.x2 ELSE l.x2 END AS x2, CASE WHEN l.is_group THEN h.y2 ELSE l.y2 END AS y2
           FROM lay l LEFT JOIN hulls h ON h.psd_id = l.psd_id AND h.ord = l.ord),
tgt AS (SELECT * FROM filled WHERE visible AND x1 IS NOT NULL AND name NOT IN ('배경', 'background') AND NOT (is_group AND role <> 'badge')
        AND NOT (role IN ('bg', 'unknown') AND lower(name) NOT IN ('model', 'person'))),
sized AS (SELECT t.*, i.width AS src_w, i.height AS src_h,
          CASE WHEN psd_id % 2 = 0 THEN 970 ELSE 160 END AS tgt_w, CASE WHEN psd_id % 2 = 0 THEN 250 ELSE 600 END AS tgt_h
          FROM tgt t JOIN fx_image i ON i.image_id = t.psd_id)
"""


def layers(t: Tables) -> DataFrame:
    leaf = ~F.col("is_group")
    return LY.with_role(t.fx_layer).withColumns({c: F.when(leaf, F.col(c)) for c in ("x1", "y1", "x2", "y2")})


def sized_targets(t: Tables) -> DataFrame:
    size = t.fx_image.select(F.col("image_id").alias("psd_id"), F.col("width").alias("src_w"), F.col("height").alias("src_h"))
    even = F.col("psd_id") % 2 == 0
    return (LY.layout_targets(LY.fill_group_bboxes(layers(t))).join(size, "psd_id")
            .withColumns({"tgt_w": F.when(even, 970).otherwise(160), "tgt_h": F.when(even, 250).otherwise(600)}))


@query("f13_layer_role", f"WITH {LAYER_SQL} SELECT psd_id, ord, role FROM lay")
def f_layer_role(t: Tables) -> DataFrame:
    return LY.with_role(t.fx_layer).select("psd_id", "ord", "role")


@query("j23_fill_group_bboxes", f"WITH {LAYER_SQL} SELECT psd_id, ord, is_group, x1, y1, x2, y2 FROM filled")
def fill_group_bboxes(t: Tables) -> DataFrame:
    return LY.fill_group_bboxes(layers(t)).select("psd_id", "ord", "is_group", "x1", "y1", "x2", "y2")


@query("p15_layout_targets", f"WITH {LAYER_SQL} SELECT psd_id, ord, name, role, x1, y1, x2, y2 FROM tgt")
def layout_targets(t: Tables) -> DataFrame:
    return LY.layout_targets(LY.fill_group_bboxes(layers(t))).select("psd_id", "ord", "name", "role", "x1", "y1", "x2", "y2")


@query("p16_top_layers", f"""WITH {LAYER_SQL} SELECT psd_id, ord, name, role FROM lay
WHERE depth = 0 AND role <> 'bg' AND name NOT IN ('bg', '배경', 'background') AND visible""")
def top_layers(t: Tables) -> DataFrame:
    return LY.top_layers(layers(t)).select("psd_id", "ord", "name", "role")


@query("p21_expand_groups", f"""
WITH {LAYER_SQL},
anc AS (SELECT l.*, lower(name) IN ('bg', '배경', 'background') AS isbg,
        (SELECT MAX(p.ord) FROM lay p WHERE p.psd_id = l.psd_id AND p.ord < l.ord AND p.depth = 0) AS top,
        (SELECT MAX(p.ord) FROM lay p WHERE p.psd_id = l.psd_id AND p.ord < l.ord AND p.depth = 1) AS child FROM lay l),
tops AS (SELECT psd_id, ord, is_group, role FROM lay WHERE depth = 0 AND role <> 'bg' AND name NOT IN ('bg', '배경', 'background') AND visible),
kids AS (SELECT a.psd_id, a.ord, a.is_group, a.role FROM anc a JOIN tops p ON p.psd_id = a.psd_id AND p.ord = a.top WHERE p.is_group AND a.depth = 1 AND NOT a.isbg),
subs AS (SELECT psd_id, ord, child, role FROM anc WHERE depth = 2 AND NOT isbg AND visible AND child > top),
cnt AS (SELECT k.*, k.is_group AND (SELECT COUNT(*) FROM subs s WHERE s.psd_id = k.psd_id AND s.child = k.ord) > 1 AS open FROM kids k)
SELECT psd_id, ord, 'layer' AS piece, role AS piece_role FROM tops WHERE NOT is_group
UNION ALL SELECT psd_id, ord, 'child', role FROM cnt WHERE NOT open
UNION ALL SELECT s.psd_id, s.ord, 'sub', s.role FROM subs s JOIN cnt c ON c.psd_id = s.psd_id AND c.ord = s.child AND c.open""")
def expand_groups(t: Tables) -> DataFrame:
    return LY.expand_groups(layers(t))


@query("w01_first_by_role", f"""WITH {LAYER_SQL} SELECT psd_id, role, MIN(ord) AS ord, arg_min(name, ord) AS name FROM lay GROUP BY 1, 2""")
def first_by_role(t: Tables) -> DataFrame:
    return LY.first_by_role(layers(t).select("psd_id", "role", "ord", "name"))


@query("a10_detected_roles", f"""WITH {LAYER_SQL}
SELECT psd_id, coalesce(array_to_string(list_sort(list_distinct(list(role) FILTER (role <> 'unknown'))), ','), '') AS roles FROM lay GROUP BY 1""")
def detected_roles(t: Tables) -> DataFrame:
    return LY.detected_roles(layers(t))


@query("a11_hull", f"""WITH {LAYER_SQL} SELECT psd_id, role, MIN(x1) AS x1, MIN(y1) AS y1, MAX(x2) AS x2, MAX(y2) AS y2 FROM tgt GROUP BY 1, 2""")
def a_hull(t: Tables) -> DataFrame:
    return LY.hull(LY.layout_targets(LY.fill_group_bboxes(layers(t))), ["psd_id", "role"])


_AP_SQL = f"""WITH {LAYER_SQL},
ap AS (SELECT *, least(tgt_w / src_w, tgt_h / src_h) AS s FROM sized),
ap1 AS (SELECT *, (tgt_w - src_w * s) / 2 AS ox, (tgt_h - src_h * s) / 2 AS oy FROM ap),
ap2 AS (SELECT *, round_even(x1 * s + ox, 0)::INT AS nx1, round_even(y1 * s + oy, 0)::INT AS ny1 FROM ap1)
"""


@query("g08_ap_layout", _AP_SQL + """SELECT psd_id, ord, nx1, ny1, round_even(nx1 + (x2 - x1) * s, 0)::INT AS nx2, round_even(ny1 + (y2 - y1) * s, 0)::INT AS ny2 FROM ap2""")
def g_ap_layout(t: Tables) -> DataFrame:
    return LY.ap_layout(sized_targets(t)).select("psd_id", "ord", "nx1", "ny1", "nx2", "ny2")


@query("g09_ap_place", _AP_SQL + """SELECT psd_id, ord, trunc(x1 * s + ox)::INT AS render_x, trunc(y1 * s + oy)::INT AS render_y,
greatest(1, trunc((x2 - x1) * s)::INT) AS render_w, greatest(1, trunc((y2 - y1) * s)::INT) AS render_h FROM ap1 WHERE x2 > x1 AND y2 > y1""")
def g_ap_place(t: Tables) -> DataFrame:
    return LY.ap_place(sized_targets(t)).select("psd_id", "ord", "render_x", "render_y", "render_w", "render_h")


_PIVOT_SQL = f"""WITH {LAYER_SQL},
txt AS (SELECT *, (role IN ('title', 'body') AND NOT is_group) OR role = 'badge' AS is_text FROM sized),
piv AS (SELECT psd_id, any_value(src_w) AS src_w, any_value(src_h) AS src_h, any_value(tgt_w) AS tgt_w, any_value(tgt_h) AS tgt_h,
   MIN(ord) FILTER (role = 'logo') AS lo, MIN(ord) FILTER (role = 'product') AS po,
   MIN(ord) FILTER (role IN ('person', 'model') OR name IN ('model', 'person')) AS mo,
   MIN(x1) FILTER (is_text) AS tx1, MIN(y1) FILTER (is_text) AS ty1, MAX(x2) FILTER (is_text) AS tx2, MAX(y2) FILTER (is_text) AS ty2
   FROM txt GROUP BY psd_id),
p0 AS (SELECT p.*, l.x1 AS lx1, l.y1 AS ly1, l.x2 AS lx2, l.y2 AS ly2, q.x1 AS qx1, q.y1 AS qy1, q.x2 AS qx2, q.y2 AS qy2,
   m.x1 AS mx1, m.y1 AS my1, m.x2 AS mx2, m.y2 AS my2
   FROM piv p LEFT JOIN sized l ON l.psd_id = p.psd_id AND l.ord = lo LEFT JOIN sized q ON q.psd_id = p.psd_id AND q.ord = po
   LEFT JOIN sized m ON m.psd_id = p.psd_id AND m.ord = mo)
"""


@query("g10_edge_anchoring", _PIVOT_SQL + """,
e1 AS (SELECT * REPLACE (970 AS tgt_w, 250 AS tgt_h), least(1.0::DOUBLE, 250 / src_h) AS s FROM p0),
e2 AS (SELECT *, (tgt_h - src_h * s) / 2 AS oy, round_even(tgt_w - (mx2 - mx1) * s, 0)::INT AS nmx, round_even(30 + (qx2 - qx1) * s, 0)::INT AS nqx,
       round_even((tgt_h - (qy2 - qy1) * s) / 2, 0)::INT AS nqy FROM e1),
e3 AS (SELECT *, round_even(my1 * s + oy, 0)::INT AS nmy, coalesce(nmx, tgt_w - 30) AS rlim, coalesce(nqx + 30, 30) AS llim,
       least(tx1, lx1) AS ux1, least(ty1, ly1) AS uy1, greatest(tx2, lx2) AS ux2, greatest(ty2, ly2) AS uy2 FROM e2),
e4 AS (SELECT *, greatest(100, rlim - llim) AS room FROM e3),
e5 AS (SELECT *, CASE WHEN (ux2 - ux1) * s > room THEN s * (room / ((ux2 - ux1) * s)) ELSE s END AS ts FROM e4),
e6 AS (SELECT *, llim + (room - (ux2 - ux1) * ts) / 2 AS bx, (tgt_h - (uy2 - uy1) * ts) / 2 AS by_ FROM e5),
blk AS (SELECT t.psd_id, t.ord, CASE WHEN is_text THEN 'text' ELSE 'logo' END AS slot, t.x1, t.y1, t.x2, t.y2, e6.ts,
        round_even(bx + (t.x1 - ux1) * ts, 0)::INT AS nx1, round_even(by_ + (t.y1 - uy1) * ts, 0)::INT AS ny1
        FROM txt t JOIN e6 ON e6.psd_id = t.psd_id WHERE t.is_text OR t.ord = e6.lo)
SELECT psd_id, mo AS ord, 'model' AS slot, nmx AS nx1, nmy AS ny1, tgt_w AS nx2, round_even(nmy + (my2 - my1) * s, 0)::INT AS ny2, round(s, 6) AS scale_used FROM e6 WHERE mo IS NOT NULL
UNION ALL SELECT psd_id, po, 'prod', 30, nqy, nqx, round_even(nqy + (qy2 - qy1) * s, 0)::INT, round(s, 6) FROM e6 WHERE po IS NOT NULL
UNION ALL SELECT psd_id, ord, slot, nx1, ny1, round_even(nx1 + (x2 - x1) * ts, 0)::INT, round_even(ny1 + (y2 - y1) * ts, 0)::INT, round(ts, 6) FROM blk""")
def edge_anchoring(t: Tables) -> DataFrame:
    """Every file on a wide banner."""
    return LY.edge_layout(sized_targets(t).withColumns({"tgt_w": F.lit(970), "tgt_h": F.lit(250)})).withColumn("scale_used", F.round("scale_used", 6))


@query("g11_vertical_stacking", _PIVOT_SQL + """,
v1 AS (SELECT * REPLACE (160 AS tgt_w, 600 AS tgt_h), greatest(0.4::DOUBLE, least(1.0::DOUBLE, (160 - 60) / src_w)) AS s FROM p0),
v2 AS (SELECT *, round_even((tgt_w - (qx2 - qx1) * s) / 2, 0)::INT AS ax1, round_even(30 + (qy2 - qy1) * s, 0)::INT AS ay2 FROM v1),
v3 AS (SELECT *, coalesce(ay2 + 15, 30) AS top1, round_even((tgt_w - (lx2 - lx1) * s) / 2, 0)::INT AS bx1 FROM v2),
v4 AS (SELECT *, round_even(top1 + (ly2 - ly1) * s, 0)::INT AS by2 FROM v3),
v5 AS (SELECT *, coalesce(by2 + 30, top1) AS top2, CASE WHEN (tx2 - tx1) * s > tgt_w - 60 THEN (tgt_w - 60) / (tx2 - tx1) ELSE s END AS ts FROM v4),
v6 AS (SELECT *, tgt_h - 30 - (ty2 - ty1) * ts AS oy, (tgt_w - (tx2 - tx1) * ts) / 2 AS ox FROM v5),
v7 AS (SELECT *, greatest(100, coalesce(round_even(oy, 0)::INT - 30, tgt_h - 30) - top2) / (my2 - my1) AS fs FROM v6),
v8 AS (SELECT *, round_even((tgt_w - (mx2 - mx1) * fs) / 2, 0)::INT AS cx1 FROM v7),
blk AS (SELECT t.psd_id, t.ord, t.x1, t.y1, t.x2, t.y2, ts, round_even(ox + (t.x1 - tx1) * ts, 0)::INT AS nx1, round_even(oy + (t.y1 - ty1) * ts, 0)::INT AS ny1
        FROM txt t JOIN v8 ON v8.psd_id = t.psd_id WHERE t.is_text)
SELECT psd_id, po AS ord, 'prod' AS slot, ax1 AS nx1, 30 AS ny1, round_even(ax1 + (qx2 - qx1) * s, 0)::INT AS nx2, ay2 AS ny2, round(s, 6) AS scale_used FROM v8 WHERE po IS NOT NULL
UNION ALL SELECT psd_id, lo, 'logo', bx1, top1, round_even(bx1 + (lx2 - lx1) * s, 0)::INT, by2, round(s, 6) FROM v8 WHERE lo IS NOT NULL
UNION ALL SELECT psd_id, mo, 'model', cx1, top2, round_even(cx1 + (mx2 - mx1) * fs, 0)::INT, round_even(top2 + (my2 - my1) * fs, 0)::INT, round(fs, 6) FROM v8 WHERE mo IS NOT NULL
UNION ALL SELECT psd_id, ord, 'text', nx1, ny1, round_even(nx1 + (x2 - x1) * ts, 0)::INT, round_even(ny1 + (y2 - y1) * ts, 0)::INT, round(ts, 6) FROM blk""")
def vertical_stacking(t: Tables) -> DataFrame:
    """Every file on a tall banner."""
    return LY.vertical_layout(sized_targets(t).withColumns({"tgt_w": F.lit(160), "tgt_h": F.lit(600)})).withColumn("scale_used", F.round("scale_used", 6))


@query("j11_merge_layers", _AP_SQL + """,
r AS (SELECT psd_id, ord, trim(name, '[] ' || chr(9)) AS nm, trunc(x1 * s + ox)::INT AS render_x, trunc(y1 * s + oy)::INT AS render_y FROM ap1 WHERE x2 > x1 AND y2 > y1),
lst AS (SELECT psd_id, nm, arg_max(render_x, ord) AS render_x, arg_max(render_y, ord) AS render_y FROM r GROUP BY 1, 2)
SELECT l.psd_id, l.ord, l.name, lst.render_x, lst.render_y FROM lay l LEFT JOIN lst ON lst.psd_id = l.psd_id AND lst.nm = trim(l.name, '[] ' || chr(9))""")
def merge_layers(t: Tables) -> DataFrame:
    placed = LY.ap_place(sized_targets(t)).withColumn("name", LY.bare_name(F.col("name")))
    return LY.merge_layers(t.fx_layer.select("psd_id", "ord", "name"), placed).select("psd_id", "ord", "name", "render_x", "render_y")


@query("j12_apply_edits", """
WITH lay1 AS (SELECT psd_id, ord, name, x1 AS render_x, y1 AS render_y, x2 - x1 AS render_w, y2 - y1 AS render_h FROM fx_layer),
ed AS (SELECT psd_id, name, ord AS edit_no, x1 + 7 AS ex, CASE WHEN ord % 2 = 0 THEN y1 + 3 END AS ey, CASE WHEN ord % 3 = 0 THEN 50 END AS ew, x2 % 90 + 1 AS eh FROM fx_layer WHERE ord % 4 <> 1),
lst AS (SELECT *, row_number() OVER (PARTITION BY psd_id, name ORDER BY edit_no DESC) AS rn FROM ed)
SELECT l.psd_id, l.ord, l.name, coalesce(ex, render_x) AS render_x, coalesce(ey, render_y) AS render_y, coalesce(ew, render_w) AS render_w, coalesce(eh, render_h) AS render_h
FROM lay1 l LEFT JOIN lst ON lst.psd_id = l.psd_id AND lst.name = l.name AND rn = 1""")
def apply_edits(t: Tables) -> DataFrame:
    base = t.fx_layer
    stored = base.select("psd_id", "ord", "name", F.col("x1").alias("render_x"), F.col("y1").alias("render_y"),
                         (F.col("x2") - F.col("x1")).alias("render_w"), (F.col("y2") - F.col("y1")).alias("render_h"))
    edits = base.filter("ord % 4 <> 1").selectExpr(
        "psd_id", "name", "ord AS edit_no", "x1 + 7 AS render_x", "CASE WHEN ord % 2 = 0 THEN y1 + 3 END AS render_y",
        "CASE WHEN ord % 3 = 0 THEN 50 END AS render_w", "x2 % 90 + 1 AS render_h")
    return LY.apply_edits(stored, edits)


@query("j24_placement_roles", _AP_SQL + """,
ap3 AS (SELECT *, round_even(nx1 + (x2 - x1) * s, 0)::INT AS nx2, round_even(ny1 + (y2 - y1) * s, 0)::INT AS ny2 FROM ap2),
lst AS (SELECT * FROM ap3 QUALIFY row_number() OVER (PARTITION BY psd_id, name, depth ORDER BY ord DESC) = 1),
src AS (SELECT psd_id, name, depth, x1, y1, x2, y2 FROM fx_layer QUALIFY row_number() OVER (PARTITION BY psd_id, name, depth ORDER BY ord) = 1),
rl AS (SELECT psd_id, name, arg_max(role, ord) AS rb FROM lay GROUP BY 1, 2)
SELECT l.psd_id, trim(l.name, '[] ' || chr(9)) AS name, l.depth, l.nx1 AS render_x, greatest(0, l.ny1) AS render_y, greatest(1, l.nx2 - l.nx1) AS render_w,
       greatest(1, l.ny2 - l.ny1) AS render_h, coalesce(rb, 'unknown') AS role
FROM lst l JOIN src USING (psd_id, name, depth) LEFT JOIN rl USING (psd_id, name) WHERE src.x2 > src.x1 AND src.y2 > src.y1""")
def placement_roles(t: Tables) -> DataFrame:
    return LY.placement_roles(LY.ap_layout(sized_targets(t)), LY.with_role(t.fx_layer))


# --- per-row geometry --------------------------------------------------------------------------------------------

@query("g12_center_crop", f"""
WITH {TARGETS_SQL},
c AS (SELECT *, (src_w / src_h) > (tgt_w / tgt_h) AS wide, round_even(src_h * (tgt_w / tgt_h), 0)::INT AS rw, round_even(src_w / (tgt_w / tgt_h), 0)::INT AS rh FROM targets)
SELECT job_id, ordinal, CASE WHEN wide THEN floor((src_w - rw) / 2)::INT ELSE 0 END AS x, CASE WHEN wide THEN 0 ELSE floor((src_h - rh) / 2)::INT END AS y,
       CASE WHEN wide THEN rw ELSE src_w END AS w, CASE WHEN wide THEN src_h ELSE rh END AS h,
       CASE WHEN wide THEN rw / src_w ELSE rh / src_h END AS used FROM c""")
def center_crop(t: Tables) -> DataFrame:
    return targets(t).select("job_id", "ordinal", G.center_crop("src_w", "src_h", "tgt_w", "tgt_h").alias("c")).select("job_id", "ordinal", "c.*")


@query("g13_fit_right", f"""
WITH {TARGETS_SQL},
f AS (SELECT p.*, tgt_w - safe_left - safe_right AS ew, tgt_h - safe_top - safe_bottom AS eh, o.w AS cw, o.h AS ch FROM placed p JOIN fx_object o ON o.image_id = p.job_id AND o.ord = p.ord),
g AS (SELECT *, greatest(1, round_even(cw * least(1.0::DOUBLE, ew / cw, eh / ch), 0)::INT) AS w, greatest(1, round_even(ch * least(1.0::DOUBLE, ew / cw, eh / ch), 0)::INT) AS h FROM f)
SELECT job_id, ordinal, ord, safe_left + ew - w AS x, safe_top + floor((eh - h) / 2)::INT AS y, w, h FROM g""")
def g_fit_right(t: Tables) -> DataFrame:
    objects = t.fx_object.select(F.col("image_id").alias("job_id"), "ord", F.col("w").alias("cw"), F.col("h").alias("ch"))
    fit = G.fit_right("cw", "ch", "tgt_w", "tgt_h", "safe_top", "safe_right", "safe_bottom", "safe_left")
    return targets(t).join(objects, "job_id").select("job_id", "ordinal", "ord", fit.alias("f")).select("job_id", "ordinal", "ord", "f.*")


OUTPAINT_SQL = f"""
WITH {TARGETS_SQL},
o1 AS (SELECT *, safe_top + safe_right + safe_bottom + safe_left > 0 AS zoned, tgt_w - safe_left - safe_right AS zw, tgt_h - safe_top - safe_bottom AS zh FROM targets),
o2 AS (SELECT *, CASE WHEN zoned THEN least(zw / src_w, zh / src_h) ELSE least(tgt_w / src_w, tgt_h / src_h) END AS s FROM o1),
o3 AS (SELECT *, greatest(1, round_even(src_w * s, 0)::INT) AS render_w, greatest(1, round_even(src_h * s, 0)::INT) AS render_h FROM o2),
o4 AS (SELECT *, CASE WHEN zoned THEN safe_left + floor(zw / 2)::INT - floor(render_w / 2)::INT ELSE floor((tgt_w - render_w) / 2)::INT END AS x,
                 CASE WHEN zoned THEN safe_top + floor(zh / 2)::INT - floor(render_h / 2)::INT ELSE floor((tgt_h - render_h) / 2)::INT END AS y FROM o3),
o5 AS (SELECT *, tgt_w::BIGINT * tgt_h - greatest(0, least(tgt_w, x + render_w) - greatest(0, x))::BIGINT * greatest(0, least(tgt_h, y + render_h) - greatest(0, y)) AS empty_px FROM o4),
o6 AS (SELECT *, empty_px / (tgt_w::BIGINT * tgt_h) AS empty_ratio, empty_px / (tgt_w::BIGINT * tgt_h) < 0.01 AS skip,
       greatest(0, x) AS x1, least(tgt_w, x + render_w) AS x2, floor(tgt_w / 2)::INT AS mid, y > 0 OR tgt_h - (y + render_h) > 0 AS tall FROM o5)
"""


def outpaint(t: Tables) -> DataFrame:
    plan = G.outpaint_plan("src_w", "src_h", "tgt_w", "tgt_h", "safe_top", "safe_right", "safe_bottom", "safe_left")
    return targets(t).withColumn("plan", plan)


@query("g14_outpaint_plan", OUTPAINT_SQL + """
SELECT job_id, ordinal, zoned, render_w, render_h, x, y, x AS extend_l, tgt_w - (x + render_w) AS extend_r, y AS extend_t, tgt_h - (y + render_h) AS extend_b,
       empty_px, empty_ratio, skip FROM o6""")
def outpaint_plan(t: Tables) -> DataFrame:
    return outpaint(t).select("job_id", "ordinal", "plan.*")


@query("g15_outpaint_calls", OUTPAINT_SQL + """
SELECT job_id, ordinal, CASE WHEN skip THEN 0 WHEN zoned THEN 1 WHEN x1 > 0 AND x2 < tgt_w
       THEN (tall OR x1 > 0 OR x2 < mid)::INT + (tall OR x2 < tgt_w OR x1 > mid)::INT ELSE 1 END AS calls FROM o6""")
def outpaint_calls(t: Tables) -> DataFrame:
    return outpaint(t).select("job_id", "ordinal", G.outpaint_calls(F.col("plan"), "tgt_w").alias("calls"))


@query("g16_norm_to_px", """
WITH b AS (SELECT o.image_id, o.ord, o.role, i.width AS w, i.height AS h, (o.y * 2) % 900 AS n1, (o.x * 2) % 900 AS n2, (o.y * 2) % 900 + o.h AS n3, (o.x * 2) % 900 + o.w AS n4
           FROM fx_object o JOIN fx_image i ON i.image_id = o.image_id),
p AS (SELECT *, trunc(n1 / 1000 * h)::INT AS y1, trunc(n2 / 1000 * w)::INT AS x1, trunc(n3 / 1000 * h)::INT AS y2, trunc(n4 / 1000 * w)::INT AS x2 FROM b),
q AS (SELECT *, CASE WHEN role = 'title_group' THEN greatest(0, x1 - trunc(0.08::DOUBLE * w)::INT) ELSE x1 END AS tx1 FROM p),
r AS (SELECT *, greatest(0, least(x1, w - 1)) AS ax, greatest(0, least(y1, h - 1)) AS ay, greatest(0, least(tx1, w - 1)) AS cx FROM q)
SELECT image_id, ord, ax AS scene_x, ay AS scene_y, greatest(ax + 1, least(x2, w)) - ax AS scene_w, greatest(ay + 1, least(y2, h)) - ay AS scene_h,
       cx AS title_x, greatest(cx + 1, least(x2, w)) - cx AS title_w,
       greatest(0, x1) AS el_x, greatest(0, y1) AS el_y, greatest(1, least(w, x2) - greatest(0, x1)) AS el_w, greatest(1, least(h, y2) - greatest(0, y1)) AS el_h FROM r""")
def norm_to_px(t: Tables) -> DataFrame:
    img = t.fx_image.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih"))
    box = F.array(F.col("y") * 2 % 900, F.col("x") * 2 % 900, F.col("y") * 2 % 900 + F.col("h"), F.col("x") * 2 % 900 + F.col("w"))
    d = t.fx_object.join(img, "image_id").withColumn("box", box)
    for name in ("scene", "wide_title", "element"):
        d = d.withColumn(name, G.norm_to_px(F.col("box"), "iw", "ih", name, F.col("role")))
    return d.select("image_id", "ord", *[F.col(f"scene.{k}").alias(f"scene_{k}") for k in "xywh"],
                    F.col("wide_title.x").alias("title_x"), F.col("wide_title.w").alias("title_w"),
                    *[F.col(f"element.{k}").alias(f"el_{k}") for k in "xywh"])


@query("g17_normalise_bbox", """
SELECT image_id, ord, CASE WHEN ord % 5 = 2 AND ord % 2 = 0 THEN 0.0 ELSE x::DOUBLE END AS x, CASE WHEN ord % 5 = 2 AND ord % 2 = 0 THEN 0.0 ELSE y::DOUBLE END AS y,
 CASE WHEN ord % 5 = 4 THEN NULL ELSE w::DOUBLE END AS width, CASE WHEN ord % 5 = 4 THEN NULL ELSE h::DOUBLE END AS height FROM fx_object""")
def g_normalise_bbox(t: Tables) -> DataFrame:
    """Styles by ordinal: x/width, left/right, w/h (without x, y when even), x1/x2, and only x/y."""
    def m(**kv):
        return F.create_map(*[v for k, c in kv.items() for v in (F.lit(k), c.cast("double"))])
    x, y, w, h = (F.col(c) for c in "xywh")
    raw = (F.when(F.col("ord") % 5 == 0, m(x=x, y=y, width=w, height=h))
           .when(F.col("ord") % 5 == 1, m(left=x, top=y, right=x + w, bottom=y + h))
           .when((F.col("ord") % 5 == 2) & (F.col("ord") % 2 == 0), m(w=w, h=h))
           .when(F.col("ord") % 5 == 2, m(x=x, y=y, w=w, h=h))
           .when(F.col("ord") % 5 == 3, m(x1=x, y1=y, x2=x + w, y2=y + h)).otherwise(m(x=x, y=y)))
    d = t.fx_object.select("image_id", "ord", raw.alias("raw"))
    return d.select("image_id", "ord", G.normalise_bbox(F.col("raw")).alias("b")).select("image_id", "ord", "b.*")


@query("g18_box_clamp", """
WITH b AS (SELECT o.image_id, o.ord, o.x * 1.5::DOUBLE - 40 AS x1, o.y * 1.5::DOUBLE - 40 AS y1, (o.x + o.w) * 1.5::DOUBLE - 40 AS x2, (o.y + o.h) * 1.5::DOUBLE - 40 AS y2, i.width AS iw, i.height AS ih
           FROM fx_object o JOIN fx_image i ON i.image_id = o.image_id),
c AS (SELECT *, greatest(0, least(x1, iw)) AS a1, greatest(0, least(y1, ih)) AS b1, greatest(0, least(x2, iw)) AS a2, greatest(0, least(y2, ih)) AS b2 FROM b)
SELECT image_id, ord, trunc(a1)::INT AS x, trunc(b1)::INT AS y, greatest(1, trunc(a2 - a1)::INT) AS w, greatest(1, trunc(b2 - b1)::INT) AS h FROM c""")
def g_box_clamp(t: Tables) -> DataFrame:
    img = t.fx_image.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih"))

    def k(c):
        return c * 1.5 - 40
    box = G.box_clamp(k(F.col("x")), k(F.col("y")), k(F.col("x") + F.col("w")), k(F.col("y") + F.col("h")), "iw", "ih")
    return t.fx_object.join(img, "image_id").select("image_id", "ord", box.alias("b")).select("image_id", "ord", "b.*")


@query("g19_accept_refined", """
WITH b AS (SELECT o.image_id, o.ord, o.x AS x1, o.y AS y1, o.x + o.w AS x2, o.y + o.h AS y2, o.x + o.conf_pct % 37 - 5 AS n1, o.y + o.conf_pct % 29 - 5 AS m1,
   o.x + o.w - o.conf_pct % 31 AS n2, o.y + o.h - o.conf_pct % 13 AS m2, i.width AS iw, i.height AS ih FROM fx_object o JOIN fx_image i ON i.image_id = o.image_id),
c AS (SELECT *, greatest(0, n1) AS a1, greatest(0, m1) AS b1, least(iw, n2) AS a2, least(ih, m2) AS b2 FROM b),
d AS (SELECT *, a2 - a1 < 4 OR b2 - b1 < 4 OR (x2 - x1 > 0 AND a2 - a1 < (x2 - x1) * 0.75) OR (y2 - y1 > 0 AND b2 - b1 < (y2 - y1) * 0.75) AS keep FROM c)
SELECT image_id, ord, CASE WHEN keep THEN x1 ELSE a1 END AS x1, CASE WHEN keep THEN y1 ELSE b1 END AS y1, CASE WHEN keep THEN x2 ELSE a2 END AS x2, CASE WHEN keep THEN y2 ELSE b2 END AS y2 FROM d""")
def g_accept_refined(t: Tables) -> DataFrame:
    img = t.fx_image.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih"))
    d = t.fx_object.join(img, "image_id").selectExpr(
        "image_id", "ord", "iw", "ih", "struct(x AS x1, y AS y1, x + w AS x2, y + h AS y2) AS old",
        "struct(x + conf_pct % 37 - 5 AS x1, y + conf_pct % 29 - 5 AS y1, x + w - conf_pct % 31 AS x2, y + h - conf_pct % 13 AS y2) AS new")
    return d.select("image_id", "ord", G.accept_refined(F.col("old"), F.col("new"), "iw", "ih").alias("b")).select("image_id", "ord", "b.*")


@query("g21_crop_box", """
WITH b AS (SELECT o.image_id, o.ord, o.x - 20 AS x, o.y - 20 AS y, o.w * (1 + o.ord % 9) AS w, o.h * (1 + o.ord % 9) AS h, i.width AS iw, i.height AS ih
           FROM fx_object o JOIN fx_image i ON i.image_id = o.image_id),
c AS (SELECT *, greatest(0, x) AS x1, greatest(0, y) AS y1, least(iw, x + w) AS x2, least(ih, y + h) AS y2, NOT (w >= iw * 0.95 AND h >= ih * 0.95) AS ok FROM b),
d AS (SELECT *, greatest(0, x1 - 50) AS cx1, greatest(0, y1 - 50) AS cy1 FROM c)
SELECT image_id, ord, CASE WHEN ok THEN cx1 END AS cx1, CASE WHEN ok THEN cy1 END AS cy1, CASE WHEN ok THEN least(iw, x2 + 50) END AS cx2, CASE WHEN ok THEN least(ih, y2 + 50) END AS cy2,
  CASE WHEN ok THEN x1 - cx1 END AS bx1, CASE WHEN ok THEN y1 - cy1 END AS by1, CASE WHEN ok THEN x2 - cx1 END AS bx2, CASE WHEN ok THEN y2 - cy1 END AS by2 FROM d""")
def g_crop_box(t: Tables) -> DataFrame:
    img = t.fx_image.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih"))
    grow = 1 + F.col("ord") % 9
    box = G.crop_box(F.col("x") - 20, F.col("y") - 20, F.col("w") * grow, F.col("h") * grow, "iw", "ih")
    return t.fx_object.join(img, "image_id").select("image_id", "ord", box.alias("b")).select("image_id", "ord", "b.*")


@query("g22_fit_side", """
SELECT image_id, CASE WHEN greatest(width, height) <= 1280 THEN width ELSE greatest(1, trunc(width * (1280 / greatest(width, height)))::INT) END AS w,
       CASE WHEN greatest(width, height) <= 1280 THEN height ELSE greatest(1, trunc(height * (1280 / greatest(width, height)))::INT) END AS h FROM fx_image""")
def g_fit_side(t: Tables) -> DataFrame:
    return t.fx_image.select("image_id", G.fit_side("width", "height", 1280).alias("f")).select("image_id", "f.*")


@query("g26_bbox_polygon", """
SELECT image_id, ord, concat_ws(';', x || ',' || y, (x + w) || ',' || y, (x + w) || ',' || (y + h), x || ',' || (y + h)) AS polygon FROM fx_object""")
def g_bbox_polygon(t: Tables) -> DataFrame:
    text = F.array_join(F.transform("p", lambda q: F.array_join(q.cast("array<string>"), ",")), ";")
    return t.fx_object.withColumn("p", G.bbox_polygon("x", "y", "w", "h")).select("image_id", "ord", text.alias("polygon"))


@query("c09_route", f"""
WITH {TARGETS_SQL}, f AS (SELECT *, CASE ordinal % 4 WHEN 0 THEN 'b' WHEN 1 THEN '' WHEN 2 THEN 'C' ELSE NULL END AS forced FROM targets)
SELECT job_id, ordinal, CASE WHEN upper(coalesce(forced, '')) IN ('A','B','D','E','F','G') THEN upper(forced) WHEN src_w = tgt_w AND src_h = tgt_h THEN 'A' ELSE 'G' END AS route FROM f""")
def c_route(t: Tables) -> DataFrame:
    forced = F.when(F.col("ordinal") % 4 == 0, "b").when(F.col("ordinal") % 4 == 1, "").when(F.col("ordinal") % 4 == 2, "C")
    return targets(t).withColumn("forced", forced).select("job_id", "ordinal", G.route("forced", "src_w", "src_h", "tgt_w", "tgt_h").alias("route"))


@query("c10_layout_mode", f"""
WITH {TARGETS_SQL}
SELECT job_id, ordinal, CASE WHEN tgt_w / tgt_h <= 0.5 THEN 'VERTICAL_STACKING' WHEN tgt_w / tgt_h >= 2.5 OR (tgt_w / tgt_h) / (src_w / src_h) >= 1.5 THEN 'EDGE_ANCHORING' ELSE 'AP_LAYOUT' END AS mode FROM targets""")
def c_layout_mode(t: Tables) -> DataFrame:
    return targets(t).select("job_id", "ordinal", G.layout_mode("src_w", "src_h", "tgt_w", "tgt_h").alias("mode"))


@query("c11_api_size", "SELECT slug, CASE WHEN width / height > 1.2 THEN '1536x1024' WHEN width / height < 0.8 THEN '1024x1536' ELSE '1024x1024' END AS size FROM fx_spec")
def c_api_size(t: Tables) -> DataFrame:
    return t.fx_spec.select("slug", G.api_size("width", "height").alias("size"))


@query("c12_shape_classes", """
WITH r AS (SELECT slug, width / height AS r FROM fx_spec)
SELECT slug, CASE WHEN r >= 0.9 AND r <= 1.1 THEN 'square' WHEN r > 1 THEN 'horizontal' ELSE 'vertical' END AS orientation,
  CASE WHEN r >= 5 THEN 'ultra-wide' WHEN r >= 1.6 THEN 'wide' WHEN r <= 0.45 THEN 'tall' WHEN r <= 0.85 THEN 'vertical' ELSE 'square' END AS preview,
  CASE WHEN abs(r - 1) < 0.15 THEN 'square' WHEN r < 0.65 THEN 'vertical' WHEN r > 1.8 THEN 'horizontal' ELSE 'custom' END AS ratio_class FROM r""")
def c_shapes(t: Tables) -> DataFrame:
    return t.fx_spec.select("slug", G.orientation("width", "height").alias("orientation"), G.preview_type("width", "height").alias("preview"),
                            G.ratio_class("width", "height").alias("ratio_class"))


@query("j21_simple_ratio", """
WITH k AS (SELECT * FROM (VALUES (0,16,9),(1,4,3),(2,1,1),(3,9,16),(4,3,4),(5,2,1),(6,3,2),(7,21,9),(8,1,2),(9,1,3),(10,3,1)) v(o, a, b))
SELECT slug, arg_min(a || ':' || b, {'d': abs(width / height - a / b), 'o': o}) AS ratio FROM fx_spec, k GROUP BY slug""")
def j_simple_ratio(t: Tables) -> DataFrame:
    return t.fx_spec.select("slug", G.simple_ratio("width", "height").alias("ratio"))
