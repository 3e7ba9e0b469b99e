"""Mask and pixel queries.  Mask oracles work pixel by pixel, so they share nothing with the run algebra."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlattice.operators import masks as M, objects as O, pixels as P
from adlattice.plans.fixtures import Tables
from adlattice.plans.registry import query

W, H = 90, 12
I, IM = ["image_id"], ["image_id", "mask_id"]


def runs(t: Tables) -> DataFrame:
    return t.fx_run


def union(t: Tables) -> DataFrame:
    return M.mask_union(t.fx_run, I)


def canvas(t: Tables) -> DataFrame:
    return t.fx_run.select("image_id").distinct().withColumns({"canvas_w": F.lit(W), "canvas_h": F.lit(H)})


def parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two masks per image: union of its odd and of its even runs (the odd ones shifted to make them meet)."""
    odd = t.fx_run.filter("mask_id % 2 = 1").selectExpr("image_id", "y % 3 AS y", "x0", "x1")
    even = t.fx_run.filter("mask_id % 2 = 0").selectExpr("image_id", "y % 3 AS y", "x0", "x1")
    return M.mask_union(odd, I), M.mask_union(even, I)


PX = "px AS (SELECT DISTINCT image_id, y, unnest(range(x0, x1)) AS x FROM fx_run)"
AB = """pa AS (SELECT DISTINCT image_id, y % 3 AS y, unnest(range(x0, x1)) AS x FROM fx_run WHERE mask_id % 2 = 1),
pb AS (SELECT DISTINCT image_id, y % 3 AS y, unnest(range(x0, x1)) AS x FROM fx_run WHERE mask_id % 2 = 0)"""


def to_runs(source: str, keys: str = "image_id", cond: str = "true") -> str:
    return (f"SELECT {keys}, y::INT AS y, MIN(x)::INT AS x0, (MAX(x) + 1)::INT AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS g "
            f"FROM (SELECT DISTINCT {keys}, y, x FROM {source} WHERE {cond}) z) zz GROUP BY {keys}, y, g")


@query("x01_mask_area", f"""WITH {PX}, a AS (SELECT image_id, COUNT(*) AS area FROM px GROUP BY 1), b AS (SELECT image_id, MAX(mask_id) AS bw FROM fx_run GROUP BY 1)
SELECT image_id, area, round(area / {W * H} * 100, 2) AS coverage_pct, CASE WHEN bw % 4 <> 0 THEN area / (20 * 10) ELSE 1.0 END::DOUBLE AS fill FROM a JOIN b USING (image_id)""")
def x_area(t: Tables) -> DataFrame:
    c = canvas(t).join(t.fx_run.groupBy("image_id").agg(F.max("mask_id").alias("m")), "image_id").select(
        "image_id", "canvas_w", "canvas_h", F.when(F.col("m") % 4 != 0, 20).otherwise(0).alias("box_w"), F.lit(10).alias("box_h"))
    return M.coverage(union(t), c, I).select("image_id", "area", "coverage_pct", "fill")


@query("x02_mask_bbox", f"""WITH {PX} SELECT image_id, greatest(0, MIN(x) - 2)::INT AS bx1, greatest(0, MIN(y) - 2)::INT AS by1, least({W}, MAX(x) + 3)::INT AS bx2, least({H}, MAX(y) + 3)::INT AS by2 FROM px GROUP BY 1""")
def x_bbox(t: Tables) -> DataFrame:
    return M.mask_bbox(t.fx_run.join(canvas(t), "image_id"), I, 2, ("canvas_w", "canvas_h"))


@query("x03_mask_union", f"WITH {PX} {to_runs('px')}")
def x_union(t: Tables) -> DataFrame:
    return union(t)


_BOXES = f"bx AS (SELECT image_id, mask_id, (x0 * 7) % 100 AS bx, y % 8 AS by_ FROM fx_run)"


def _boxes(t: Tables) -> DataFrame:
    return t.fx_run.selectExpr("image_id", "mask_id", "(x0 * 7) % 100 AS box_x", "y % 8 AS box_y", "x1 AS mask_w", "y + 1 AS mask_h", "150 AS canvas_w", "14 AS canvas_h")


@query("x04_place_mask", f"""WITH {_BOXES} SELECT r.image_id, r.mask_id, y + by_ AS y, x0 + bx AS x0, x1 + bx AS x1, NULL AS code FROM fx_run r JOIN bx USING (image_id, mask_id) WHERE NOT (bx + x1 > 150 OR by_ + y + 1 > 14)
UNION ALL SELECT r.image_id, r.mask_id, NULL, NULL, NULL, 'SIZE_MISMATCH' FROM fx_run r JOIN bx USING (image_id, mask_id) WHERE bx + x1 > 150 OR by_ + y + 1 > 14""")
def x_place(t: Tables) -> DataFrame:
    moved, bad = M.place_mask(t.fx_run, _boxes(t), IM)
    return moved.withColumn("code", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query("x05_extend_left", f"""WITH {PX}, l AS (SELECT image_id, MIN(x) AS l FROM px GROUP BY 1), e AS (SELECT * FROM px UNION SELECT p.image_id, p.y, unnest(range(greatest(0, l - 20), l)) FROM px p JOIN l USING (image_id)) {to_runs('e')}""")
def x_extend(t: Tables) -> DataFrame:
    return M.extend_left(union(t), I, gap=20)


@query("x06_dilate", f"""WITH d AS (SELECT DISTINCT image_id, y + dy AS y, unnest(range(greatest(0, x0 - 2), least({W}, x1 + 2))) AS x FROM fx_run, (SELECT unnest(range(-2, 3)) AS dy) k WHERE y + dy >= 0 AND y + dy < {H}) {to_runs('d')}""")
def x_dilate(t: Tables) -> DataFrame:
    return M.dilate(union(t), I, 2, F.lit(W), F.lit(H))


@query("x07_complement", f"""WITH {PX}, i AS (SELECT DISTINCT image_id FROM fx_run), full_ AS (SELECT image_id, y, x FROM i, (SELECT unnest(range(0, {H})) AS y) a, (SELECT unnest(range(0, {W})) AS x) b), c AS (SELECT f.* FROM full_ f ANTI JOIN px USING (image_id, y, x)) {to_runs('c')}""")
def x_complement(t: Tables) -> DataFrame:
    return M.complement(union(t), canvas(t), I)


@query("x08_mask_and", f"WITH {AB}, c AS (SELECT * FROM pa SEMI JOIN pb USING (image_id, y, x)) {to_runs('c')}")
def x_and(t: Tables) -> DataFrame:
    return M.mask_and(*parts(t), I)


@query("x08_mask_minus", f"WITH {AB}, c AS (SELECT * FROM pa ANTI JOIN pb USING (image_id, y, x)) {to_runs('c')}")
def x_minus(t: Tables) -> DataFrame:
    return M.mask_minus(*parts(t), I)


@query("x09_overlap_ratio", f"WITH {AB}, c AS (SELECT pa.image_id, COUNT(*) AS area, COUNT(pb.x) AS shared FROM pa LEFT JOIN pb USING (image_id, y, x) GROUP BY 1) SELECT image_id, area, shared, shared / area AS ratio FROM c")
def x_ratio(t: Tables) -> DataFrame:
    return M.overlap_ratio(*parts(t), I)


_ROLES = """prod AS (SELECT image_id, mask_id, y % 3 AS y, unnest(range(x0, x1)) AS x FROM fx_run WHERE mask_id % 3 = 1), hand AS (SELECT DISTINCT image_id, y % 3 AS y, unnest(range(x0, x1)) AS x FROM fx_run WHERE mask_id % 3 = 2),
per AS (SELECT DISTINCT image_id, y % 3 AS y, unnest(range(x0, x1)) AS x FROM fx_run WHERE mask_id % 3 = 0),
f AS (SELECT p.image_id, p.mask_id, p.y, p.x, h.x IS NOT NULL AS hh, q.x IS NOT NULL AS pp FROM prod p LEFT JOIN hand h USING (image_id, y, x) LEFT JOIN per q ON q.image_id = p.image_id AND q.y = p.y AND q.x = p.x),
r AS (SELECT image_id, mask_id, COUNT(*) AS area, COUNT(*) FILTER (hh) / COUNT(*) AS hr, COUNT(*) FILTER (pp) / COUNT(*) AS pr, COUNT(*) FILTER (NOT hh AND NOT pp) AS sub FROM f GROUP BY 1, 2)"""


def role_masks(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = t.fx_run.selectExpr("image_id", "mask_id", "y % 3 AS y", "x0", "x1")
    return M.mask_union(r.filter("mask_id % 3 = 1"), IM), M.mask_union(r.filter("mask_id % 3 = 2"), I), M.mask_union(r.filter("mask_id % 3 = 0"), I)


@query("x10_subtract_ratios", f"WITH {_ROLES} SELECT image_id, mask_id, area, hr AS hand_ratio, pr AS person_ratio, sub AS sub_area, (hr > 0.05 OR pr > 0.05) AND sub > area * 0.3 AS has_sub FROM r")
def x_subtract(t: Tables) -> DataFrame:
    return M.subtract_candidates(*role_masks(t), "image_id", "mask_id")[0]


@query("x10_subtract_runs", f"WITH {_ROLES}, k AS (SELECT f.* FROM f JOIN r USING (image_id, mask_id) WHERE (hr > 0.05 OR pr > 0.05) AND sub > area * 0.3 AND NOT hh AND NOT pp) {to_runs('k', 'image_id, mask_id')}")
def x_subtract_runs(t: Tables) -> DataFrame:
    return M.subtract_candidates(*role_masks(t), "image_id", "mask_id")[1]


@query("u02_all_detections", f"""WITH {_ROLES} SELECT image_id, 'd' || mask_id AS detection_id FROM fx_run UNION ALL SELECT image_id, 'd' || mask_id || '_sub' FROM r WHERE (hr > 0.05 OR pr > 0.05) AND sub > area * 0.3""")
def u_all(t: Tables) -> DataFrame:
    own = t.fx_run.select("image_id", F.concat(F.lit("d"), F.col("mask_id").cast("string")).alias("detection_id"))
    ratios = M.subtract_candidates(*role_masks(t), "image_id", "mask_id")[0].filter("has_sub")
    return own.unionByName(ratios.select("image_id", F.concat(F.lit("d"), F.col("mask_id").cast("string"), F.lit("_sub")).alias("detection_id")))


@query("x11_completeness", f"""
WITH {PX}, b AS (SELECT image_id, MIN(x0) % 20 - 3 AS bx, MIN(y) - 1 AS by_, 60 AS w, 8 AS h FROM fx_run GROUP BY 1), c AS (SELECT image_id, greatest(0, bx) AS x, greatest(0, by_) AS y, least({W}, greatest(0, bx) + w) AS x2, least({H}, greatest(0, by_) + h) AS y2 FROM b),
m AS (SELECT c.image_id, p.y - c.y AS r, p.x - c.x AS k FROM c JOIN px p ON p.image_id = c.image_id AND p.x >= c.x AND p.x < c.x2 AND p.y >= c.y AND p.y < c.y2),
a AS (SELECT image_id, COUNT(DISTINCT r) AS nr, MIN(r) AS r0, MAX(r) AS r1, COUNT(DISTINCT k) AS nk, MIN(k) AS k0, MAX(k) AS k1 FROM m GROUP BY 1), j AS (SELECT c.*, y2 - y AS bh, x2 - c.x AS bw, a.* EXCLUDE (image_id) FROM c LEFT JOIN a USING (image_id))
SELECT image_id, coalesce(1.0 - r0 / bh, 0) AS top_cov, coalesce((r1 + 1) / bh, 0) AS bottom_cov, coalesce(nr / (r1 - r0 + 1), 0) AS continuity, coalesce(nr / bh, 0) AS v_fill, coalesce(nk / bw, 0) AS h_fill, coalesce(r0 > bh * 0.1, true) AS top_clipped,
 coalesce(bh - 1 - r1 > bh * 0.1, true) AS bottom_clipped, coalesce(k0 > bw * 0.1, true) AS left_clipped, coalesce(bw - 1 - k1 > bw * 0.1, true) AS right_clipped, coalesce(r1 - r0 + 1, 0)::INT AS span_rows, bh::INT AS box_rows FROM j""")
def x_completeness(t: Tables) -> DataFrame:
    boxes = t.fx_run.groupBy("image_id").agg((F.min("x0") % 20 - 3).alias("x"), (F.min("y") - 1).alias("y")).selectExpr("*", "60 AS w", "8 AS h", f"{W} AS canvas_w", f"{H} AS canvas_h")
    return M.completeness(union(t), boxes, I)


def low_union(t: Tables) -> DataFrame:
    return M.mask_union(t.fx_run.selectExpr("image_id", "y % 4 AS y", "x0", "x1"), I)


_LOW = f"lp AS (SELECT DISTINCT image_id, y % 4 AS y, unnest(range(x0, x1)) AS x FROM fx_run), ru AS ({to_runs('lp')}), rn AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x0) AS id FROM ru)"


@query("x12_fragments", f"""
WITH RECURSIVE {_LOW}, e AS (SELECT a.image_id, a.id AS u, b.id AS v FROM rn a JOIN rn b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.x0 - 1 < b.x1 AND b.x0 < a.x1 + 1),
reach AS (SELECT image_id, id AS node, id AS lab FROM rn UNION SELECT r.image_id, e.v, r.lab FROM reach r JOIN e ON e.image_id = r.image_id AND e.u = r.node), m AS (SELECT image_id, node, MIN(lab) AS lab FROM reach GROUP BY 1, 2)
SELECT image_id, COUNT(DISTINCT lab) AS fragments FROM m GROUP BY 1""")
def x_fragments(t: Tables) -> DataFrame:
    return M.fragments(low_union(t), I)


def _merged(rel: str) -> str:
    """Runs of a row that touch become one."""
    return f"""SELECT image_id, y, MIN(x0) AS x0, MAX(x1) AS x1 FROM (SELECT *, SUM(brk) OVER (PARTITION BY image_id, y ORDER BY x0, x1) AS g FROM (
  SELECT *, CASE WHEN x0 <= MAX(x1) OVER (PARTITION BY image_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM {rel}) z) z GROUP BY image_id, y, g"""


def _outside(rel: str) -> str:
    return f"""SELECT image_id, y, a AS x0, b AS x1 FROM (SELECT image_id, y, coalesce(lag(x1) OVER (PARTITION BY image_id, y ORDER BY x0, x1), 0) AS a, x0 AS b FROM (
  SELECT image_id, y, x0, x1 FROM {rel} UNION ALL SELECT image_id, y, 180, 180 FROM frame) z) z WHERE b > a"""


def _spread(rel: str) -> str:
    return f"SELECT image_id, y + dy AS y, greatest(0, x0 - dx) AS x0, least(180, x1 + dx) AS x1 FROM {rel}, disk WHERE y + dy BETWEEN 0 AND 23"


def _pieces(n: int, rel: str) -> str:
    """Runs with the area of their 4-connected piece: labels sink to the least along the edges."""
    return f"""n{n} AS (SELECT *, row_number() OVER (ORDER BY image_id, y, x0) AS id FROM {rel}),
e{n} AS (SELECT a.id AS u, b.id AS v FROM n{n} a JOIN n{n} b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 AND b.x0 < a.x1),
c{n}(id, lab) USING KEY (id) AS (SELECT id, id FROM n{n} UNION (SELECT e.v, MIN(c.lab) FROM c{n} c JOIN e{n} e ON c.id = e.u JOIN recurring.c{n} r ON r.id = e.v GROUP BY e.v, r.lab HAVING MIN(c.lab) < r.lab)),
p{n} AS (SELECT image_id, y, x0, x1, SUM(x1 - x0) OVER (PARTITION BY lab) AS size FROM n{n} JOIN c{n} USING (id))"""


_CLEAN = f"""
WITH RECURSIVE disk AS (SELECT dy, floor(sqrt(25 - dy * dy))::INT AS dx FROM range(-5, 6) t(dy)),
frame AS (SELECT image_id, y FROM (SELECT DISTINCT image_id FROM fx_run) z, range(0, 24) t(y)),
big AS (SELECT image_id, unnest(range(y % 4 * 6, y % 4 * 6 + 5)) AS y, x0 * 2 AS x0, x1 * 2 AS x1 FROM fx_run),
one AS ({_merged('big')}), wide AS ({_spread('one')}), grown AS ({_merged('wide')}), far AS ({_outside('grown')}), eaten AS ({_spread('far')}), gone AS ({_merged('eaten')}),
closed AS ({_outside('gone')}), gaps AS ({_outside('closed')}),
{_pieces(1, 'gaps')},
patched AS (SELECT image_id, y, x0, x1 FROM closed UNION ALL SELECT image_id, y, x0, x1 FROM p1 WHERE size < 64), filled AS ({_merged('patched')}),
{_pieces(2, 'filled')}
SELECT image_id, y::INT AS y, x0::INT AS x0, x1::INT AS x1 FROM p2 WHERE size >= 128"""


@query("x13_clean_mask", _CLEAN)
def x_clean(t: Tables) -> DataFrame:
    """Masks scaled up fourfold so that closing and the size thresholds act on them."""
    big = t.fx_run.selectExpr("image_id", "explode(sequence(y % 4 * 6, y % 4 * 6 + 4)) AS y", "x0 * 2 AS x0", "x1 * 2 AS x1")
    frame = t.fx_run.select("image_id").distinct().withColumns({"canvas_w": F.lit(180), "canvas_h": F.lit(24)})
    return M.clean_mask(M.mask_union(big, I), frame, I)


@query("x14_letterbox_runs", """
WITH p AS (SELECT image_id, 40 + width % 30 AS tw, 20 + height % 20 AS th, width, height FROM fx_image), q AS (SELECT *, greatest(1, round_even(width * least(tw / width, th / height), 0)::INT) AS pw, greatest(1, round_even(height * least(tw / width, th / height), 0)::INT) AS ph FROM p),
o AS (SELECT *, floor((tw - pw) / 2)::INT AS ox, floor((th - ph) / 2)::INT AS oy FROM q), r AS (SELECT *, unnest(range(0, th)) AS y FROM o)
SELECT image_id, y::INT AS y, 0 AS x0, tw::INT AS x1 FROM r WHERE oy > 0 AND (y < oy OR y >= oy + ph) UNION ALL SELECT image_id, y::INT, 0, ox FROM r WHERE NOT (oy > 0 AND (y < oy OR y >= oy + ph)) AND ox > 0
UNION ALL SELECT image_id, y::INT, ox + pw, tw::INT FROM r WHERE NOT (oy > 0 AND (y < oy OR y >= oy + ph)) AND ox > 0 AND tw > ox + pw""")
def x_letterbox(t: Tables) -> DataFrame:
    from adlattice.functions import geometry as G
    p = t.fx_image.selectExpr("image_id", "width", "height", "40 + width % 30 AS tgt_w", "20 + height % 20 AS tgt_h")
    p = p.select("image_id", "tgt_w", "tgt_h", G.contain("width", "height", "tgt_w", "tgt_h").alias("t")).select("image_id", "tgt_w", "tgt_h", "t.*")
    return M.letterbox_runs(p, I)


@query("x15_polygon_runs", f"""
WITH q AS (SELECT image_id, ord, x % 40 AS ax, y % 10 AS ay, x % 40 + w % 30 + 2 AS bx, y % 10 + h % 5 + 1 AS by_ FROM fx_object), p AS (SELECT image_id, ord AS mask_id, unnest(range(ay, least(by_, 20))) AS y, ax, bx FROM q)
SELECT image_id, mask_id, y::INT AS y, ax AS x0, least(bx, 60)::INT AS x1 FROM p""")
def x_polygon(t: Tables) -> DataFrame:
    """Rectangles given as polygons, whose fill is known exactly."""
    q = t.fx_object.selectExpr("image_id", "ord AS mask_id", "x % 40 AS ax", "y % 10 AS ay", "x % 40 + w % 30 + 2 AS bx", "y % 10 + h % 5 + 1 AS by")
    poly = F.array(F.array("ax", "ay"), F.array("bx", "ay"), F.array("bx", "by"), F.array("ax", "by"))
    return M.polygon_runs(q.select("image_id", "mask_id", poly.alias("polygon"), F.lit(60).alias("canvas_w"), F.lit(20).alias("canvas_h")), IM)


# --- pixels ------------------------------------------------------------------------------------------------------
PIX = """pix AS (SELECT vec_id, pos % 8 AS x, pos // 8 AS y, v AS r, (v * 3) % 256 AS g, (v * 7) % 256 AS b FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, greatest(0, least(255, floor(unnest(embedding)::DOUBLE * 255)::INT + 128)) // CASE WHEN vec_id % 9 = 0 THEN 300 ELSE 1 END AS v FROM embeddings) s)"""
V = ["vec_id"]


def pixels(t: Tables) -> DataFrame:
    """Vectors read as 8 × 8 pictures; every ninth is black."""
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "f"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("f").cast("double") * 255).cast("int") + 128))
    v = F.floor(v / F.when(F.col("vec_id") % 9 == 0, 300).otherwise(1)).cast("int")
    return e.select("vec_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), v.alias("r"), (v * 3 % 256).alias("g"), (v * 7 % 256).alias("b"))


@query("x16_solid_color", f"WITH {PIX} SELECT vec_id, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) AS spatial_std, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 < 2.0 AS solid FROM pix GROUP BY 1")
def x_solid(t: Tables) -> DataFrame:
    return P.solid_color(pixels(t), V).withColumn("spatial_std", F.round("spatial_std", 6))


@query("x17_pixel_stats", f"""
WITH {PIX}, s AS (SELECT vec_id, (var_pop(r) + var_pop(g) + var_pop(b)) / 3 AS v, stddev_pop(r) < 0.5 AND stddev_pop(g) < 0.5 AND stddev_pop(b) < 0.5 AS single_color, COUNT(*) AS n FROM pix GROUP BY 1),
h AS (SELECT vec_id, (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 AS grey, COUNT(*) AS c FROM pix GROUP BY 1, 2), e AS (SELECT h.vec_id, -SUM(c / n * log2(c / n)) AS ent FROM h JOIN s USING (vec_id) GROUP BY 1)
SELECT vec_id, round(v, 2) AS variance, v < 1.0 AS blank, single_color, round(ent, 4) + 0.0 AS entropy FROM s JOIN e USING (vec_id)""")
def x_stats(t: Tables) -> DataFrame:
    return P.pixel_stats(pixels(t), V).withColumn("entropy", F.col("entropy") + 0.0)


_BAND = f"""{PIX}, bd AS (SELECT vec_id, median(r) FILTER (q) AS mr, median(g) FILTER (q) AS mg, median(b) FILTER (q) AS mb, greatest(stddev_pop(r) FILTER (q), stddev_pop(g) FILTER (q), stddev_pop(b) FILTER (q)) AS sd FROM (SELECT *, x = 1 AND vec_id % 4 <> 1 AS q FROM pix) z GROUP BY 1),
bb AS (SELECT vec_id, coalesce(trunc(mr)::INT, 0) AS bg_r, coalesce(trunc(mg)::INT, 0) AS bg_g, coalesce(trunc(mb)::INT, 0) AS bg_b, coalesce(sd, 100.0) AS bg_std, (vec_id % 20) / 64 >= 0.2 AS force_ai FROM bd)"""


def band(t: Tables) -> DataFrame:
    p = pixels(t).withColumn("band", (F.col("x") == 1) & (F.col("vec_id") % 4 != 1))
    sizes = t.embeddings.selectExpr("vec_id", "64 AS total_px", "vec_id % 20 AS removal_px")
    return P.band_background(p, sizes, V)


@query("x18_band_background", f"WITH {_BAND} SELECT vec_id, bg_r, bg_g, bg_b, round(bg_std, 6) AS bg_std, force_ai, bg_std < 25 AS uniform FROM bb")
def x_band(t: Tables) -> DataFrame:
    return band(t).withColumn("bg_std", F.round("bg_std", 6))


@query("x19_natural_background", f"""WITH {PIX}, k AS (SELECT *, greatest(r, g, b) / 255 > 0.75 AND CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END < 0.2 AS q FROM (SELECT vec_id, 240 - r // 16 AS r, 235 - g // 4 AS g, 230 - b // 16 AS b FROM pix) z),
a AS (SELECT vec_id, COUNT(*) FILTER (q) AS n, median(r) FILTER (q) AS mr, median(g) FILTER (q) AS mg, median(b) FILTER (q) AS mb, median(r) AS ar, median(g) AS ag, median(b) AS ab FROM k GROUP BY 1)
SELECT vec_id, n AS bright_px, trunc(CASE WHEN n >= 40 THEN mr ELSE ar END)::INT AS bg_r, trunc(CASE WHEN n >= 40 THEN mg ELSE ag END)::INT AS bg_g, trunc(CASE WHEN n >= 40 THEN mb ELSE ab END)::INT AS bg_b, CASE WHEN n >= 40 THEN 'bg_only' ELSE 'all_natural' END AS source FROM a""")
def x_natural(t: Tables) -> DataFrame:
    light = pixels(t).selectExpr("vec_id", "240 - r div 16 AS r", "235 - g div 4 AS g", "230 - b div 16 AS b")
    return P.natural_background(light, V, least=40)


@query("x20_fill_strategy", f"WITH {_BAND} SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'full_image_ai' WHEN bg_std < 25 AND NOT force_ai THEN 'direct_fill' ELSE 'masked_ai' END AS strategy FROM bb")
def x_strategy(t: Tables) -> DataFrame:
    return band(t).select("vec_id", P.fill_strategy(F.col("vec_id") % 6 == 0, F.col("bg_std"), F.col("force_ai")).alias("strategy"))


@query("x21_needs_bg_removal", f"""WITH {PIX}, k AS (SELECT *, (y < 3)::INT + (y >= 5)::INT + (x < 3)::INT + (x >= 5)::INT AS w, (r + g + b) / 3 AS m, greatest(r, g, b) - least(r, g, b) AS sp FROM pix)
SELECT vec_id, vec_id % 5 = 0 OR SUM(CASE WHEN m < 55 THEN w ELSE 0 END) / SUM(w) >= 0.15 OR SUM(CASE WHEN sp < 30 AND m > 120 THEN w ELSE 0 END) / SUM(w) >= 0.15 AS remove_bg FROM k GROUP BY vec_id""")
def x_border(t: Tables) -> DataFrame:
    p = pixels(t).withColumns({"role": F.when(F.col("vec_id") % 5 == 0, "logo").otherwise("product"), "w": F.lit(8), "h": F.lit(8)})
    return P.needs_bg_removal(p, V)


@query("x22_scan_bottom", f"""WITH RECURSIVE {PIX}, pr AS (SELECT vec_id, y * 8 + x AS i, r % 60 AS m FROM pix WHERE y * 8 + x >= 10),
wk AS (SELECT vec_id, 9 AS i, 0 AS dark, 9 AS last FROM (SELECT DISTINCT vec_id FROM pr) z UNION ALL SELECT w.vec_id, p.i, CASE WHEN m > 30 THEN 0 ELSE dark + 1 END, CASE WHEN m > 30 THEN p.i ELSE last END FROM wk w JOIN pr p ON p.vec_id = w.vec_id AND p.i = w.i + 1 WHERE w.dark < 5)
SELECT vec_id, CASE WHEN MAX(last) < 10 THEN 10 ELSE least(MAX(last) + 1, 64) END::INT AS bottom FROM wk GROUP BY 1""")
def x_scan(t: Tables) -> DataFrame:
    prof = pixels(t).selectExpr("vec_id", "y * 8 + x AS y", "r % 60 AS row_max", "10 AS bottom", "64 AS image_h").filter("y >= 10")
    return M.scan_bottom(prof, V)


@query("x23_edge_sharpness", f"""WITH {PIX}, a AS (SELECT vec_id, COUNT(*) FILTER (g > 30) AS n, SUM(g) FILTER (g > 30) AS s, COUNT(*) FILTER (g > 30 AND g < 100) AS lo FROM pix GROUP BY 1)
SELECT vec_id, n AS edge_px, CASE WHEN n >= 10 THEN s / n ELSE 0 END::DOUBLE AS gradient, CASE WHEN n >= 10 THEN least(s / n / 200, 1.0) ELSE 0 END::DOUBLE AS sharpness, CASE WHEN n >= 10 THEN lo / n ELSE 1 END::DOUBLE AS low_contrast, n >= 10 AND s / n / 200 > 1 AS clamped FROM a""")
def x_edges(t: Tables) -> DataFrame:
    return M.edge_sharpness(pixels(t).groupBy("vec_id", F.col("g").alias("value")).agg(F.count("*").alias("n")), V)


@query("x24_trim_by_profile", f"""WITH {PIX}, e AS (SELECT vec_id, x * 5 AS x, y * 4 AS y FROM pix WHERE r > 150), cy AS (SELECT vec_id, y, COUNT(*) AS n FROM e GROUP BY 1, 2), ry AS (SELECT vec_id, MIN(y) AS y1, MAX(y) AS y2 FROM (SELECT *, MAX(n) OVER (PARTITION BY vec_id) AS pk FROM cy) z WHERE n > pk * 0.3 GROUP BY 1),
cx AS (SELECT e.vec_id, x, COUNT(*) AS n FROM e JOIN ry USING (vec_id) WHERE y BETWEEN y1 AND y2 GROUP BY 1, 2), rx AS (SELECT vec_id, MIN(x) AS x1, MAX(x) AS x2 FROM (SELECT *, MAX(n) OVER (PARTITION BY vec_id) AS pk FROM cx) z WHERE n > pk * 0.3 GROUP BY 1),
b AS (SELECT vec_id, greatest(0, x1 - 3) AS a, greatest(0, y1 - 3) AS b, least(40, x2 + 4) AS c, least(32, y2 + 4) AS d FROM ry JOIN rx USING (vec_id))
SELECT vec_id, CASE WHEN c - a < 10 OR d - b < 10 THEN 0 ELSE a END::INT AS cx1, CASE WHEN c - a < 10 OR d - b < 10 THEN 0 ELSE b END::INT AS cy1, CASE WHEN c - a < 10 OR d - b < 10 THEN 40 ELSE c END::INT AS cx2, CASE WHEN c - a < 10 OR d - b < 10 THEN 32 ELSE d END::INT AS cy2 FROM b""")
def x_trim(t: Tables) -> DataFrame:
    e = pixels(t).filter("r > 150").selectExpr("vec_id", "x * 5 AS x", "y * 4 AS y", "40 AS w", "32 AS h")
    return M.trim_by_profile(e, V, share=0.3)


@query("x25_drop_vertical_lines", "SELECT image_id, ord FROM fx_object WHERE NOT (x % 30 <= 15 AND h > 200 * 0.25 AND w % 60 <= 20)")
def x_lines(t: Tables) -> DataFrame:
    return M.drop_vertical_lines(t.fx_object.selectExpr("image_id", "ord", "x % 30 AS x", "w % 60 AS w", "h", "200 AS image_h")).select("image_id", "ord")


@query("x27_uniform_sides", f"""WITH {PIX}, k AS (SELECT vec_id, 'left' AS side, r, g, b FROM pix WHERE x < 2 UNION ALL SELECT vec_id, 'right', r, g, b FROM pix WHERE x >= 6 UNION ALL SELECT vec_id, 'bottom', r, g, b FROM pix),
a AS (SELECT vec_id, side, greatest(stddev_pop(r), stddev_pop(g), stddev_pop(b)) AS sd, trunc(median(r))::INT AS mr FROM k GROUP BY 1, 2) SELECT vec_id, side, round(sd, 6) AS std, sd < 60 AS uniform, CASE WHEN sd < 60 THEN mr END AS fill_r FROM a""")
def x_sides(t: Tables) -> DataFrame:
    """Pictures placed 5 right of the left edge and at the top of a 30 × 20 canvas."""
    p = pixels(t).selectExpr("vec_id", "x + 5 AS x", "y", "r", "g", "b", "30 AS canvas_w", "20 AS canvas_h", "5 AS bx1", "0 AS by1", "13 AS bx2", "8 AS by2")
    return P.uniform_sides(p, V, 60.0, sample=2).select("vec_id", "side", F.round("std", 6).alias("std"), "uniform", "fill_r")


@query("x28_lr_brightness", f"""WITH {PIX}, a AS (SELECT vec_id, avg((r + g + b) / 3) FILTER (x < 2) AS l, avg((r + g + b) / 3) FILTER (x >= 6) AS q FROM pix GROUP BY 1) SELECT vec_id, round(l, 6) AS "left", round(q, 6) AS "right", round(abs(l - q), 6) AS gap, abs(l - q) >= 10 AS separate FROM a""")
def x_lr(t: Tables) -> DataFrame:
    p = pixels(t).withColumns({"bx1": F.lit(0), "bx2": F.lit(8)})
    d = P.lr_brightness(p, V, 10.0, sample=2)
    return d.select("vec_id", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), F.round("gap", 6).alias("gap"), "separate")


@query("x29_alpha_leak", f"WITH {AB}, d AS (SELECT coalesce(pa.image_id, pb.image_id) AS image_id FROM pa FULL JOIN pb ON pa.image_id = pb.image_id AND pa.y = pb.y AND pa.x = pb.x WHERE pa.x IS NULL OR pb.x IS NULL) SELECT image_id, COUNT(*) AS diff_px, 'POLYGON_ALPHA_LEAK' AS code FROM d GROUP BY 1")
def x_leak(t: Tables) -> DataFrame:
    return M.alpha_leak(*parts(t), I)


@query("q03_validate_masks", f"""WITH {AB}, i AS (SELECT DISTINCT image_id FROM fx_run), a AS (SELECT image_id, COUNT(*) AS n FROM pa GROUP BY 1), s AS (SELECT pa.image_id, COUNT(*) AS n FROM pa JOIN pb USING (image_id, y, x) GROUP BY 1),
c AS (SELECT i.image_id, CASE WHEN i.image_id % 10 = 0 THEN 'SIZE_MISMATCH' WHEN a.n IS NULL THEN 'REMOVAL_MASK_EMPTY' WHEN s.n > 0 THEN 'MASK_OVERLAP' END AS code, s.n FROM i LEFT JOIN a USING (image_id) LEFT JOIN s USING (image_id)) SELECT image_id, code, CASE WHEN code = 'MASK_OVERLAP' THEN n END AS shared_px FROM c""")
def q_masks(t: Tables) -> DataFrame:
    sizes = canvas(t).selectExpr("image_id", "90 AS declared_w", "12 AS declared_h", "CASE WHEN image_id % 10 = 0 THEN 91 ELSE 90 END AS removal_w", "12 AS removal_h", "90 AS restore_w", "12 AS restore_h")
    return M.validate_masks(*parts(t), sizes, I)


_PIC = f"""{PIX}, s AS (SELECT vec_id, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS sd FROM pix GROUP BY 1)"""


def _pictures(t: Tables) -> DataFrame:
    return P.solid_color(pixels(t), V).selectExpr("vec_id", "spatial_std", "vec_id % 13 <> 0 AS exists", "CASE WHEN vec_id % 13 <> 1 THEN 8 ELSE -1 END AS height", "CASE WHEN vec_id % 7 = 0 THEN 9 ELSE 8 END AS width", "8 AS tgt_w", "8 AS tgt_h")


@query("q05_validate_render", f"WITH {_PIC} SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'RESULT_NOT_FOUND' WHEN vec_id % 13 = 1 THEN 'RESULT_DECODE_FAILED' WHEN vec_id % 7 = 0 THEN 'RESULT_SIZE_MISMATCH' WHEN sd < 2 THEN 'SOLID_COLOR_RESULT' END AS code FROM s")
def q_render(t: Tables) -> DataFrame:
    return P.validate_picture(_pictures(t), "result", V)


@query("q06_validate_scene", f"WITH {_PIC} SELECT vec_id, CASE WHEN vec_id % 13 < 2 THEN 'SCENE_PLATE_DECODE_FAILED' WHEN vec_id % 7 = 0 THEN 'TARGET_SIZE_MISMATCH' WHEN sd < 2 THEN 'SOLID_COLOR_IMAGE' END AS code FROM s")
def q_scene(t: Tables) -> DataFrame:
    return P.validate_picture(_pictures(t), "plate", V)
