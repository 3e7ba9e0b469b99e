"""Pixel geometry as column expressions.

``px_round`` rounds half to even and ``px_cut`` truncates toward zero; which of the two an operator uses
is part of its meaning, because neighbouring placements differ by a pixel otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlattice import vocab


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def px_round(x) -> Column:
    return F.rint(_c(x)).cast("int")


def px_cut(x) -> Column:
    return _c(x).cast("int")


def floor_div(a, b) -> Column:
    return F.floor(_c(a) / _c(b)).cast("int")


def clamp(x, lo, hi) -> Column:
    return F.greatest(_c(lo), F.least(_c(x), _c(hi)))


# --- letterbox ---------------------------------------------------------------------------------------------------

def contain(src_w, src_h, tgt_w, tgt_h) -> Column:
    """Struct proj_w, proj_h, off_x, off_y of the source fitted whole into the target."""
    src_w, src_h, tgt_w, tgt_h = map(_c, (src_w, src_h, tgt_w, tgt_h))
    scale = F.least(tgt_w / src_w, tgt_h / src_h)
    proj_w = F.greatest(F.lit(1), px_round(src_w * scale))
    proj_h = F.greatest(F.lit(1), px_round(src_h * scale))
    return F.struct(proj_w.alias("proj_w"), proj_h.alias("proj_h"),
                    floor_div(tgt_w - proj_w, 2).alias("off_x"), floor_div(tgt_h - proj_h, 2).alias("off_y"))


def project(x, y, w, h, tx: Column, src_w, src_h) -> Column:
    """Struct x, y, w, h of a source box inside the letterboxed target; each axis has its own scale."""
    sx, sy = tx["proj_w"] / _c(src_w), tx["proj_h"] / _c(src_h)
    return F.struct((tx["off_x"] + px_round(_c(x) * sx)).alias("x"), (tx["off_y"] + px_round(_c(y) * sy)).alias("y"),
                    F.greatest(F.lit(1), px_round(_c(w) * sx)).alias("w"),
                    F.greatest(F.lit(1), px_round(_c(h) * sy)).alias("h"))


# --- safe zone ---------------------------------------------------------------------------------------------------

def safe_zone(width, height, top, right, bottom, left) -> Column:
    """Struct left, top, right, bottom; right and bottom are exclusive."""
    return F.struct(_c(left).alias("left"), _c(top).alias("top"), (_c(width) - _c(right)).alias("right"),
                    (_c(height) - _c(bottom)).alias("bottom"))


def in_zone(zone: Column, x, y, w, h) -> Column:
    x, y = _c(x), _c(y)
    return ((x >= zone["left"]) & (y >= zone["top"]) & (x + _c(w) <= zone["right"]) & (y + _c(h) <= zone["bottom"]))


def in_canvas(x, y, w, h, canvas_w, canvas_h) -> Column:
    x, y = _c(x), _c(y)
    return (x >= 0) & (y >= 0) & (x + _c(w) <= _c(canvas_w)) & (y + _c(h) <= _c(canvas_h))


def intersection_area(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Shared area of two boxes, 0 when apart; in long, so large canvases do not overflow."""
    dx = F.least(_c(ax) + _c(aw), _c(bx) + _c(bw)) - F.greatest(_c(ax), _c(bx))
    dy = F.least(_c(ay) + _c(ah), _c(by) + _c(bh)) - F.greatest(_c(ay), _c(by))
    return F.greatest(dx, F.lit(0)).cast("long") * F.greatest(dy, F.lit(0)).cast("long")


def safe_metrics(width="width", height="height", top="safe_top", right="safe_right", bottom="safe_bottom",
                 left="safe_left", status="parse_status") -> Column:
    """Struct of inner size and inset percentages, null unless the zone is parsed and leaves room."""
    w, h, t, r, b, l = map(_c, (width, height, top, right, bottom, left))
    ok = ((_c(status) == "parsed_text") & (w > 0) & (h > 0) & (t >= 0) & (r >= 0) & (b >= 0) & (l >= 0)
          & (w - l - r > 0) & (h - t - b > 0))
    return F.when(ok, F.struct((w - l - r).alias("safe_width"), (h - t - b).alias("safe_height"),
                               (t / h * 100).alias("top_pct"), (r / w * 100).alias("right_pct"),
                               (b / h * 100).alias("bottom_pct"), (l / w * 100).alias("left_pct")))


# --- coordinate dialects -----------------------------------------------------------------------------------------

def norm_to_px(box: Column, width, height, dialect: str, role: Column | None = None) -> Column:
    """Box ``[ymin, xmin, ymax, xmax]`` in thousandths to pixels; null when it has not four numbers.

    Dialect ``scene`` clamps to the last pixel and keeps 1 px at least, ``wide_title`` also moves the left edge of
    titles out by 8 % of the width, ``element`` clamps each edge on its own.
    """
    w, h = _c(width), _c(height)
    y1, x1, y2, x2 = (px_cut(box[i] / 1000 * side) for i, side in enumerate((h, w, h, w)))
    if dialect == "element":
        left, top = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1)
        out_w = F.greatest(F.lit(1), F.least(w, x2) - left)
        out_h = F.greatest(F.lit(1), F.least(h, y2) - top)
    else:
        if dialect == "wide_title":
            x1 = F.when(role == "title_group", F.greatest(F.lit(0), x1 - px_cut(F.lit(0.08) * w))).otherwise(x1)
        elif dialect != "scene":
            raise ValueError(dialect)
        left, top = clamp(x1, 0, w - 1), clamp(y1, 0, h - 1)
        out_w = F.greatest(left + 1, F.least(x2, w)) - left
        out_h = F.greatest(top + 1, F.least(y2, h)) - top
    return F.when(F.size(box) == 4, F.struct(left.alias("x"), top.alias("y"), out_w.alias("w"), out_h.alias("h")))


def normalise_bbox(raw: Column) -> Column:
    """One struct x, y, width, height from any of four key styles of a ``map<string,double>``."""
    def has(k):
        return F.map_contains_key(raw, k)

    def box(x, y, w, h):
        return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    zero = F.lit(0.0)
    return (F.when(raw.isNull(), None)
            .when(has("width") & has("x"), box(raw["x"], raw["y"], raw["width"], raw["height"]))
            .when(has("left"), box(raw["left"], raw["top"], raw["right"] - raw["left"], raw["bottom"] - raw["top"]))
            .when(has("w"), box(F.coalesce(raw["x"], zero), F.coalesce(raw["y"], zero), raw["w"], raw["h"]))
            .when(has("x1"), box(raw["x1"], raw["y1"], raw["x2"] - raw["x1"], raw["y2"] - raw["y1"]))
            .otherwise(box(raw["x"], raw["y"], raw["width"], raw["height"])))


def box_clamp(x1, y1, x2, y2, img_w, img_h) -> Column:
    """Corner box clamped to the image, truncated, at least 1 px each way."""
    cx1, cx2 = clamp(x1, 0, img_w), clamp(x2, 0, img_w)
    cy1, cy2 = clamp(y1, 0, img_h), clamp(y2, 0, img_h)
    return F.struct(px_cut(cx1).alias("x"), px_cut(cy1).alias("y"), F.greatest(F.lit(1), px_cut(cx2 - cx1)).alias("w"),
                    F.greatest(F.lit(1), px_cut(cy2 - cy1)).alias("h"))


def accept_refined(old: Column, new: Column, img_w, img_h) -> Column:
    """The refined corner box, clamped, unless it is under 4 px or under 75 % of the old side."""
    x1, y1 = F.greatest(F.lit(0), new["x1"]), F.greatest(F.lit(0), new["y1"])
    x2, y2 = F.least(_c(img_w), new["x2"]), F.least(_c(img_h), new["y2"])
    ow, oh = old["x2"] - old["x1"], old["y2"] - old["y1"]
    keep = ((x2 - x1 < 4) | (y2 - y1 < 4) | ((ow > 0) & (x2 - x1 < ow * 0.75)) | ((oh > 0) & (y2 - y1 < oh * 0.75)))
    fields = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    return F.struct(*[F.when(keep, old[k]).otherwise(v).alias(k) for k, v in fields.items()])


def crop_box(x, y, w, h, img_w, img_h, pad: int = 50, cover: float = 0.95) -> Column:
    """Padded crop window and the box inside it; null when the box covers the canvas."""
    x, y, w, h, img_w, img_h = map(_c, (x, y, w, h, img_w, img_h))
    x1, y1 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x2, y2 = F.least(img_w, x + w), F.least(img_h, y + h)
    cx1, cy1 = F.greatest(F.lit(0), x1 - pad), F.greatest(F.lit(0), y1 - pad)
    whole = (w >= img_w * cover) & (h >= img_h * cover)
    return F.when(~whole, F.struct(
        cx1.alias("cx1"), cy1.alias("cy1"), F.least(img_w, x2 + pad).alias("cx2"), F.least(img_h, y2 + pad).alias("cy2"),
        (x1 - cx1).alias("bx1"), (y1 - cy1).alias("by1"), (x2 - cx1).alias("bx2"), (y2 - cy1).alias("by2")))


def fit_side(w, h, max_side: int) -> Column:
    """Struct w, h after shrinking the longer side to ``max_side``; never enlarged."""
    w, h = _c(w), _c(h)
    longest = F.greatest(w, h)
    scale = F.lit(max_side) / longest

    def side(v):
        return F.when(longest <= max_side, v).otherwise(F.greatest(F.lit(1), px_cut(v * scale)))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def bbox_polygon(x, y, w, h) -> Column:
    x, y, w, h = map(_c, (x, y, w, h))
    return F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))


def center_crop(src_w, src_h, tgt_w, tgt_h) -> Column:
    """Struct x, y, w, h of the centred crop with the target's ratio, and the share of the source used."""
    sw, sh = _c(src_w), _c(src_h)
    target = _c(tgt_w) / _c(tgt_h)
    wide = (sw / sh) > target
    cw = F.when(wide, px_round(sh * target)).otherwise(sw)
    ch = F.when(wide, sh).otherwise(px_round(sw / target))
    return F.struct(F.when(wide, floor_div(sw - cw, 2)).otherwise(F.lit(0)).alias("x"),
                    F.when(wide, F.lit(0)).otherwise(floor_div(sh - ch, 2)).alias("y"), cw.alias("w"), ch.alias("h"),
                    F.when(wide, cw / sw).otherwise(ch / sh).alias("used"))


def fit_right(cut_w, cut_h, width, height, top, right, bottom, left) -> Column:
    """Cut-out shrunk (never enlarged) into the safe zone, right aligned and vertically centred."""
    cw, ch = _c(cut_w), _c(cut_h)
    ew, eh = _c(width) - _c(left) - _c(right), _c(height) - _c(top) - _c(bottom)
    scale = F.least(F.lit(1.0), ew / cw, eh / ch)
    pw, ph = F.greatest(F.lit(1), px_round(cw * scale)), F.greatest(F.lit(1), px_round(ch * scale))
    return F.struct((_c(left) + ew - pw).alias("x"), (_c(top) + floor_div(eh - ph, 2)).alias("y"),
                    pw.alias("w"), ph.alias("h"))


def outpaint_plan(src_w, src_h, width, height, top, right, bottom, left, force_side: int = 0,
                  min_empty: float = 0.01) -> Column:
    """Where the shrunken source goes and how far the picture must be extended on each side."""
    sw, sh, w, h, t, r, b, l = map(_c, (src_w, src_h, width, height, top, right, bottom, left))
    zoned = (t + r + b + l) > 0
    zw, zh = w - l - r, h - t - b
    scale = F.when(zoned, F.least(zw / sw, zh / sh)).otherwise(F.least(w / sw, h / sh))
    rw = F.greatest(F.lit(1), px_round(sw * scale))
    if force_side > 0:
        forced = ~zoned & (floor_div(w - rw, 2) < force_side)
        scale = F.when(forced, (w - 2 * force_side) / sw).otherwise(scale)
        rw = F.greatest(F.lit(1), px_round(sw * scale))
    rh = F.greatest(F.lit(1), px_round(sh * scale))
    px = F.when(zoned, l + floor_div(zw, 2) - floor_div(rw, 2)).otherwise(floor_div(w - rw, 2))
    py = F.when(zoned, t + floor_div(zh, 2) - floor_div(rh, 2)).otherwise(floor_div(h - rh, 2))
    kept_w = F.greatest(F.lit(0), F.least(w, px + rw) - F.greatest(F.lit(0), px))
    kept_h = F.greatest(F.lit(0), F.least(h, py + rh) - F.greatest(F.lit(0), py))
    area = w.cast("long") * h
    empty = area - kept_w.cast("long") * kept_h
    return F.struct(zoned.alias("zoned"), rw.alias("render_w"), rh.alias("render_h"), px.alias("x"), py.alias("y"),
                    px.alias("extend_l"), (w - (px + rw)).alias("extend_r"), py.alias("extend_t"),
                    (h - (py + rh)).alias("extend_b"), empty.alias("empty_px"), (empty / area).alias("empty_ratio"),
                    (empty / area < min_empty).alias("skip"))


def outpaint_calls(plan: Column, width, sequential: bool = True, split_gap: float = 0.0,
                   gap: Column | None = None) -> Column:
    """How many extension calls a plan takes: none, one, or one per half of the canvas that has a hole."""
    w = _c(width)
    x1, x2 = F.greatest(F.lit(0), plan["x"]), F.least(w, plan["x"] + plan["render_w"])
    two_sided = (x1 > 0) & (x2 < w)
    mid = floor_div(w, 2)
    full_height = (plan["extend_t"] > 0) | (plan["extend_b"] > 0)
    left_hole = full_height | (x1 > 0) | (x2 < mid)
    right_hole = full_height | (x2 < w) | (x1 > mid)
    split = F.lit(sequential)
    if split_gap > 0:
        split = split | F.coalesce(gap >= split_gap, F.lit(False))
    halves = left_hole.cast("int") + right_hole.cast("int")
    return F.when(plan["skip"], 0).when(plan["zoned"], 1).when(split & two_sided, halves).otherwise(1)


# --- shape classes -----------------------------------------------------------------------------------------------

def layout_mode(src_w, src_h, tgt_w, tgt_h) -> Column:
    target = _c(tgt_w) / _c(tgt_h)
    source = _c(src_w) / _c(src_h)
    return (F.when(target <= 0.5, "VERTICAL_STACKING")
            .when((target >= 2.5) | (target / source >= 1.5), "EDGE_ANCHORING").otherwise("AP_LAYOUT"))


def api_size(w, h) -> Column:
    ratio = _c(w) / _c(h)
    return F.when(ratio > 1.2, "1536x1024").when(ratio < 0.8, "1024x1536").otherwise("1024x1024")


def orientation(w, h) -> Column:
    r = _c(w) / _c(h)
    return F.when((r >= 0.9) & (r <= 1.1), "square").when(r > 1, "horizontal").otherwise("vertical")


def preview_type(w, h) -> Column:
    r = _c(w) / _c(h)
    return (F.when(r >= 5, "ultra-wide").when(r >= 1.6, "wide").when(r <= 0.45, "tall").when(r <= 0.85, "vertical")
            .otherwise("square"))


def ratio_class(w, h) -> Column:
    r = _c(w) / _c(h)
    return (F.when(F.abs(r - 1.0) < 0.15, "square").when(r < 0.65, "vertical").when(r > 1.8, "horizontal")
            .otherwise("custom"))


def simple_ratio(w, h) -> Column:
    """Nearest of the well-known ratios, the earlier on a tie: a least over eleven literals, no join."""
    r = _c(w) / _c(h)
    options = [F.struct(F.abs(r - F.lit(a / b)).alias("gap"), F.lit(i).alias("ord"), F.lit(f"{a}:{b}").alias("label"))
               for i, (a, b) in enumerate(vocab.KNOWN_RATIOS)]
    return F.least(*options)["label"]


def route(forced, src_w, src_h, tgt_w, tgt_h, environment: str = "") -> Column:
    """Processing type: a valid request, else the environment's, else A for equal sizes, else G."""
    same = (_c(src_w) == _c(tgt_w)) & (_c(src_h) == _c(tgt_h))
    by_size = F.when(same, "A").otherwise("G")
    if environment in ("A", "B", "D", "E", "F", "G"):
        by_size = F.lit(environment)
    asked = F.upper(F.coalesce(_c(forced), F.lit("")))
    return F.when(asked.isin("A", "B", "D", "E", "F", "G"), asked).otherwise(by_size)


# --- box scores --------------------------------------------------------------------------------------------------

def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    inter = intersection_area(ax, ay, aw, ah, bx, by, bw, bh)
    union = _c(aw).cast("long") * _c(ah) + _c(bw).cast("long") * _c(bh) - inter
    return inter / F.greatest(union, F.lit(1))
