"""Detected objects of images: routing, overlap joins, role maps, rule sets, prompts and counts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlattice import vocab
from adlattice.functions import geometry as G
from adlattice.operators.scale import number_rows, overlap_pairs, top_n
from adlattice.session import materialise

SWALLOWED = 0.6
MIN_IOU = 0.25
MIN_QUALITY = 50.0
UNION_PAIRS = 5
INPAINT_PAD = 10
#: Boxes of an image up to which they travel as one array; those of fuller images meet by grid cell.
BOXES_AT_ONCE = 64


def _corners(df: DataFrame, p: str, x="x", y="y", w="w", h="h") -> DataFrame:
    x, y, w, h = (F.col(c) if isinstance(c, str) else c for c in (x, y, w, h))
    return df.withColumns({f"{p}x1": x, f"{p}y1": y, f"{p}x2": x + w, f"{p}y2": y + h})


# --- filters -----------------------------------------------------------------------------------------------------

def visible_objects(objects: DataFrame) -> DataFrame:
    """Objects shown in a list, with their importance rank (unknown words rank last)."""
    rank = F.when(F.col("importance") == "required", 0).when(F.col("importance") == "priority", 1).otherwise(2)
    shown = ~F.coalesce(F.col("role").isin(*vocab.VISIBLE_EXCLUDED), F.lit(False))
    return objects.filter(shown).withColumn("importance_rank", rank)


def category_test(category: str) -> Column:
    if category == "all":
        return F.lit(True)
    if category == "unmatched":
        return ~F.col("match_status").eqNullSafe(F.lit("ready"))
    roles = vocab.OBJECT_CATEGORIES.get(category)
    return F.lit(True) if roles is None else F.col("role").isin(*roles)


def objects_in(objects: DataFrame, category: str) -> DataFrame:
    return visible_objects(objects).filter(category_test(category))


def object_counts(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = ["all", *vocab.OBJECT_CATEGORIES, "unmatched"]
    return visible_objects(objects).groupBy(*keys).agg(*[F.count_if(category_test(n)).alias(f"n_{n}") for n in names])


def route_objects(strict_decorative: bool = False) -> Column:
    """What extraction does with an object; ``mask_area`` is the area of its rasterised polygon.

    Decorative objects keep their mask in one variant and are skipped in the other.
    """
    decorative = F.lit("skip") if strict_decorative else F.when(F.col("mask_area") > 0, "decorative").otherwise("skip")
    return (F.when(F.col("role") == "protected_subject", "protected")
            .when(~(F.col("movable") & F.col("removable")), "skip").when(F.col("role") == "decorative_ad", decorative)
            .when(F.col("mask_area") > 0, "extract").when(F.col("required"), "REQUIRED_MASK_EMPTY").otherwise("skip"))


def composite_set(placed: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Placed objects which are pasted, with their drawing rank (z, ord): required ones, by z-order then placement order."""
    z = objects.filter("required").groupBy(*keys, "object_id").agg(F.max(F.coalesce("z_index", F.lit(0))).alias("z"))
    kept = placed.join(z, [*keys, "object_id"])
    return kept.withColumn("draw_key", F.struct("z", "ord"))


def inpaint_rects(objects: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Padded, clamped boxes of titles and logos."""
    hit = objects.filter(F.col("role").isin("title_group", "logo")).join(images, key)
    p = INPAINT_PAD
    return hit.withColumns({
        "mx1": F.greatest(F.lit(0), F.col("x") - p), "my1": F.greatest(F.lit(0), F.col("y") - p),
        "mx2": F.least(F.col("image_w"), F.col("x") + F.col("w") + p),
        "my2": F.least(F.col("image_h"), F.col("y") + F.col("h") + p)})


def segment_prompts() -> Column:
    """Prompt text: content and description joined, or the role word when both are blank."""
    texts = F.array_compact(F.array(F.nullif("text_content", F.lit("")), F.nullif("description", F.lit(""))))
    return F.when(F.size(texts) > 0, F.array_join(texts, " . ")).otherwise(F.col("role"))


def usable_prompts(prompts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Prompts that run (role, joined text), and one warning per skipped experimental one."""
    skip = F.coalesce("experimental", F.lit(False))
    warnings = prompts.filter(skip).select(*keys, F.concat(F.lit("experimental_prompt_skipped:"), "role").alias("warning"))
    run = prompts.filter(~skip & (F.coalesce(F.size("texts"), F.lit(0)) > 0))
    return run.select(*keys, "role", F.array_join("texts", " . ").alias("prompt")), warnings


# --- joins -------------------------------------------------------------------------------------------------------

def missing_required(manifest: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required, movable, removable, unprotected objects that are not among the given ones."""
    need = manifest.filter(F.col("required") & F.col("movable") & F.col("removable") & (F.col("role") != "protected_subject"))
    return need.join(got.select(*keys, "object_id").distinct(), [*keys, "object_id"], "left_anti")


def reflow_ready(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing required roles, readiness, and the weaker screen rule; flags only, so any group size is fine."""
    matched = F.col("match_status").isin(*vocab.MATCHED_STATUSES)
    have = {r: F.max(F.coalesce(matched & (F.col("role") == r), F.lit(False))) for r in vocab.REQUIRED_OBJECT_ROLES}
    seen = {r: F.max(F.coalesce(F.col("role") == r, F.lit(False))) for r in ("title", "main_image")}
    agg = objects.groupBy(*keys).agg(*[c.alias(f"_h_{r}") for r, c in have.items()], *[c.alias(f"_s_{r}") for r, c in seen.items()])
    missing = F.array_compact(F.array(*[F.when(~F.col(f"_h_{r}"), F.lit(r)) for r in vocab.REQUIRED_OBJECT_ROLES]))
    return agg.select(*keys, F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("ready"),
                      (F.col("_s_title") & F.col("_s_main_image")).alias("screen_ready"))


def drop_product_titles(objects: DataFrame, key: str = "image_id") -> DataFrame:
    """Objects without the titles and logos that lie over 60 % inside a product box.

    Equal boxes are judged once, and only boxes which share a grid cell meet.
    """
    box = ["x", "y", "w", "h"]
    titles = F.col("role").isin("title_group", "logo")
    ask = objects.filter(titles).select(key, *box).distinct()
    gone = _swallowed(ask, objects.filter("role = 'product'").select(key, *box).distinct(), key).withColumn("_gone", F.lit(True))
    return objects.join(gone, [key, *box], "left").filter(~(titles & F.coalesce("_gone", F.lit(False)))).drop("_gone")


def _swallowed(ask: DataFrame, products: DataFrame, key: str) -> DataFrame:
    box = ["x", "y", "w", "h"]
    inside = overlap_pairs(_corners(ask, "l"), _corners(products, "r").drop(*box), [key])
    inter = G.intersection_area("x", "y", "w", "h", "rx1", "ry1", F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1"))
    return inside.filter(inter / (F.col("w").cast("long") * F.col("h")) > SWALLOWED).select(key, *box).distinct()


def _crowded(rows: DataFrame, key: str, at_once: int) -> DataFrame | None:
    """The keys with more than ``at_once`` rows, if there are any; ``rows`` should be written."""
    many = materialise(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > at_once).select(key))
    return None if many.isEmpty() else many


def iou_match(objects: DataFrame, dets: DataFrame, key: str = "image_id", min_iou: float = MIN_IOU,
              min_quality: float = MIN_QUALITY, at_once: int = BOXES_AT_ONCE) -> DataFrame:
    """Best detection per eligible object by IoU; the earliest detection wins a tie, its role plays no part.

    ``dets``: key, det, x, y, w, h, quality.  The detections of an image with at most ``at_once`` travel to its objects as one
    array, so nothing is moved once per cell.  In a fuller image copies of a box collapse to their first detection before the join,
    and boxes meet only in cells of their own size class.
    """
    box = ["x", "y", "w", "h"]
    eligible = objects.filter(F.col("role").isin("product", "logo") & F.col("movable") & F.col("removable"))
    usable = dets.filter((F.col("quality") >= min_quality) & (F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull())
    usable = materialise(usable.select(key, "det", *box))
    many = _crowded(usable, key, at_once)
    few = usable if many is None else usable.join(many, key, "left_anti")
    listed = few.groupBy(key).agg(F.collect_list(F.struct("det", *box)).alias("_dets"))
    calm = eligible if many is None else eligible.join(many, key, "left_anti")

    def match(d: Column) -> Column:
        return F.struct((-G.iou(*box, *[d[c] for c in box])).alias("far"), d["det"].isNull().alias("none"), d["det"].alias("det"))
    whole = (F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    best = F.array_min(F.filter(F.transform("_dets", match), lambda m: m["far"] <= -min_iou))
    out = calm.join(listed, key, "left").withColumn("_m", F.when(whole, best)).withColumns({"det": F.col("_m.det"), "iou": -F.col("_m.far")}).drop("_m", "_dets")
    if many is None:
        return out
    full = eligible.join(many, key, "left_semi")
    todo = full.filter("w > 0 AND h > 0").select(key, *box).distinct()
    best_dets = usable.join(many, key, "left_semi").groupBy(key, *box).agg(F.min("det").alias("det"))
    met = full.join(_close_pairs(todo, best_dets, key, min_iou), [key, *box], "left").withColumns({"det": F.col("_m.det"), "iou": F.col("_m.iou")}).drop("_m")
    return out.unionByName(met)


def _pair_iou(box: Sequence[str]) -> Column:
    return G.iou(*box, "rx1", "ry1", F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1"))


def _best_of(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.min_by(F.struct("det", "iou"), F.struct(-F.col("iou"), "det")).alias("_m"))


def _close_pairs(left: DataFrame, right: DataFrame, key: str, level: float) -> DataFrame:
    """Best partner of IoU at least ``level`` per box.

    Such a partner's sides are between ``level`` and 1 / ``level`` times as long, so its size class (a power of 1 / level) is
    the same or a neighbour, and its corner is at most (1 - level) of the longer side away, so its corner lies in a few cells
    of that class's grid.
    """
    box = ["x", "y", "w", "h"]
    base = 1.0 / level

    def size_class(c: str) -> Column:
        return F.floor(F.log(F.col(c).cast("double")) / F.log(F.lit(base)) + 1e-9)

    def cell(cls: Column) -> Column:
        return F.greatest(F.lit(1.0), F.pow(F.lit(base), cls + 1) * (1.0 - level))
    keyed = right.withColumns({"_cw": size_class("w"), "_ch": size_class("h")}).withColumns(
        {"_gx": F.floor(F.col("x") / cell(F.col("_cw"))), "_gy": F.floor(F.col("y") / cell(F.col("_ch")))})
    keyed = _corners(keyed, "r").drop(*box)
    near = F.sequence(F.lit(-1), F.lit(1))
    probe = left.withColumn("_dw", F.explode(near)).withColumn("_dh", F.explode(near)).withColumns(
        {"_cw": size_class("w") + F.col("_dw"), "_ch": size_class("h") + F.col("_dh")})

    def cells(pos: str, side: str, cls: str) -> Column:
        reach = F.greatest(F.col(side).cast("double"), F.pow(F.lit(base), F.col(cls) + 1)) * (1.0 - level) + 1
        return F.sequence(F.floor((F.col(pos) - reach) / cell(F.col(cls))), F.floor((F.col(pos) + reach) / cell(F.col(cls))))
    probe = probe.withColumn("_gx", F.explode(cells("x", "w", "_cw"))).withColumn("_gy", F.explode(cells("y", "h", "_ch")))
    pairs = probe.join(keyed, [key, "_cw", "_ch", "_gx", "_gy"]).withColumn("iou", _pair_iou(box)).filter(F.col("iou") >= level)
    return _best_of(pairs, [key, *box])


def union_candidates(dets: DataFrame, key: str = "image_id", pairs: int = UNION_PAIRS, block: int = BOXES_AT_ONCE) -> DataFrame:
    """The best ``pairs`` nearby product pairs of each image as one hull box.

    ``dets``: key, i (position), x, y, w, h, conf, mask_conf.  An image of at most ``block`` detections is paired as one array.
    """
    dets = materialise(dets.select(key, "i", "x", "y", "w", "h", "conf", "mask_conf"))
    many = _crowded(dets, key, block)
    out = _listed_pairs(dets.filter(F.col(key).isNotNull()) if many is None else dets.join(many, key, "left_anti"), key, pairs)
    return out if many is None else out.unionByName(_settled_pairs(dets.join(many, key, "left_semi"), key, pairs, block))


def _listed_pairs(dets: DataFrame, key: str, pairs: int) -> DataFrame:
    """Pairs within the array of an image's detections; only the best ones leave it."""
    fields = ("i", "x", "y", "w", "h", "conf", "mask_conf")
    whole = F.lit(True)
    for c in ("i", "x", "y", "w", "h"):
        whole = whole & F.col(c).isNotNull()
    listed = dets.filter(whole).groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("_d")).filter(F.size("_d") > 1)

    def near(a: Column, b: Column) -> Column:
        return ((a["i"] < b["i"]) & (F.abs(a["y"] * 2 + a["h"] - b["y"] * 2 - b["h"]) < F.greatest(a["h"], b["h"], F.lit(1)) * 4)
                & (F.abs(a["x"] * 2 + a["w"] - b["x"] * 2 - b["w"]) < F.greatest(a["w"], b["w"], F.lit(1)) * 3))

    def pair(a: Column, b: Column) -> Column:
        return F.struct((a["conf"] + b["conf"]).alias("s"), a["i"].alias("i"), b["i"].alias("j"), a.alias("l"), b.alias("r"))
    met = F.flatten(F.transform("_d", lambda a: F.transform(F.filter("_d", lambda b: near(a, b)), lambda b: pair(a, b))))
    top = F.slice(F.sort_array(met, asc=False), 1, pairs)
    found = listed.select(key, F.posexplode(top).alias("_at", "_p")).select(
        key, (F.col("_at") + 1).alias("pair_rank"), *[F.col(f"_p.{p}.{c}").alias(f"{p}_{c}") for p in "lr" for c in fields])
    return _hulls(found, key)


def _settled_pairs(dets: DataFrame, key: str, pairs: int, block: int) -> DataFrame:
    """Pairs of images of any size.

    Among equal boxes only the best ``pairs`` + 1 can be part of a winning pair.  The best ``block`` detections by (confidence,
    position) of every image are paired first; an image is settled when that is all it has, or when its last winner outranks every
    pair that could still hold one of the others.  The rest goes on with four times as many.
    """
    box = ["x", "y", "w", "h"]
    copies = Window.partitionBy(key, *box).orderBy(F.col("conf").desc(), F.col("i").desc())
    few = materialise(dets.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= pairs + 1).drop("_r"))
    out = None
    while True:
        rank = [F.col("conf").desc(), F.col("i").desc()]
        head = top_n(few, [key], rank, block + 1, "i")
        order = F.struct("conf", "i")
        seen = head.groupBy(key).agg(F.count("*").alias("_n"), F.max("conf").alias("_top"), F.min(order).alias("_least"))
        head = materialise(head.join(seen, key))
        inside = head.filter((F.col("_n") <= block) | (order > F.col("_least"))).drop("_n", "_top", "_least")
        first = materialise(_best_pairs(inside, key, pairs))
        last = first.filter(F.col("pair_rank") == pairs).select(key, F.col("conf_sum").alias("_s"), F.col("i").alias("_i"))
        limit = F.col("_top") + F.col("_least.conf")
        beyond = (F.col("_s") > limit) | ((F.col("_s") == limit) & (F.col("_i") > F.col("_least.i")))
        open_ = (head.select(key, "_n", "_top", "_least").distinct().filter(F.col("_n") > block).join(last, key, "left")
                 .filter(~F.coalesce(beyond, F.lit(False))).select(key))
        settled = first.join(open_, key, "left_anti")
        out = settled if out is None else out.unionByName(settled)
        few = materialise(few.join(open_, key, "left_semi"))
        if few.isEmpty():
            return out
        block *= 4


def _best_pairs(few: DataFrame, key: str, pairs: int) -> DataFrame:
    box = ["x", "y", "w", "h"]
    reach_x, reach_y = F.greatest("w", F.lit(1)) * 3, F.greatest("h", F.lit(1)) * 4
    # doubled coordinates keep centres whole; boxes grown by their own reach must overlap if the pair is near
    few = few.withColumns({"_cx": F.col("x") * 2 + F.col("w"), "_cy": F.col("y") * 2 + F.col("h"), "_rx": reach_x, "_ry": reach_y})

    def side(p: str) -> DataFrame:
        cols = {c: f"{p}_{c.lstrip('_')}" for c in ["i", *box, "conf", "mask_conf", "_cx", "_cy"]}
        grown = few.withColumns({f"{p}x1": F.col("_cx") - F.col("_rx"), f"{p}x2": F.col("_cx") + F.col("_rx") + 1,
                                 f"{p}y1": F.col("_cy") - F.col("_ry"), f"{p}y2": F.col("_cy") + F.col("_ry") + 1})
        return grown.select(key, f"{p}x1", f"{p}x2", f"{p}y1", f"{p}y2", *[F.col(a).alias(b) for a, b in cols.items()])
    met = overlap_pairs(side("l"), side("r"), [key], cell=512, self_order=("l_i", "r_i"))
    near = met.filter((F.abs(F.col("l_cy") - F.col("r_cy")) < F.greatest("l_h", "r_h", F.lit(1)) * 4)
                      & (F.abs(F.col("l_cx") - F.col("r_cx")) < F.greatest("l_w", "r_w", F.lit(1)) * 3))
    total = F.col("l_conf") + F.col("r_conf")
    top = Window.partitionBy(key).orderBy(total.desc(), F.col("l_i").desc(), F.col("r_i").desc())
    return _hulls(near.withColumn("pair_rank", F.row_number().over(top)).filter(F.col("pair_rank") <= pairs), key)


def _hulls(best: DataFrame, key: str) -> DataFrame:
    total = F.col("l_conf") + F.col("r_conf")
    ux, uy = F.least("l_x", "r_x"), F.least("l_y", "r_y")
    return best.select(
        key, F.col("l_i").alias("i"), F.col("r_i").alias("j"), "pair_rank", ux.alias("x"), uy.alias("y"),
        F.greatest(F.lit(1), F.greatest(F.col("l_x") + F.col("l_w"), F.col("r_x") + F.col("r_w")) - ux).alias("w"),
        F.greatest(F.lit(1), F.greatest(F.col("l_y") + F.col("l_h"), F.col("r_y") + F.col("r_h")) - uy).alias("h"),
        F.greatest("l_conf", "r_conf").alias("conf"), F.greatest("l_mask_conf", "r_mask_conf").alias("mask_conf"), total.alias("conf_sum"))


def purge_protected(verdicts: DataFrame, manifest: DataFrame, key: str = "image_id") -> DataFrame:
    """Remaining ids without protected ones; the flag changes only if something was taken out."""
    # written once: the ids are compared and taken out in two passes, the answers are parsed in one
    verdicts = materialise(verdicts)
    ids = verdicts.select(key, F.explode("remaining_ids").alias("object_id")).distinct()
    hit = (ids.join(manifest.filter("role = 'protected_subject'").select(key, "object_id").distinct(), [key, "object_id"], "left_semi")
           .groupBy(key).agg(F.collect_set("object_id").alias("_p")))
    joined = verdicts.join(hit, key, "left")
    left = F.when(F.col("_p").isNull(), F.col("remaining_ids")).otherwise(F.filter("remaining_ids", lambda v: ~F.array_contains("_p", v)))
    return joined.withColumn("remaining_ids", left).withColumn(
        "ad_objects_remaining", F.when(F.col("_p").isNull(), F.col("ad_objects_remaining")).otherwise(F.size("remaining_ids") > 0)).drop("_p")


def group_names(ids: DataFrame, groups: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Display name of each group id: the analysis' own first, then the label table, then the id."""
    own = groups.filter(F.coalesce("name", F.lit("")) != "").groupBy(key, "group_id").agg(F.min_by("name", "ord").alias("_own"))
    label = F.create_map(*[F.lit(x) for kv in vocab.GROUP_LABELS.items() for x in kv])
    return ids.join(own, [key, "group_id"], "left").withColumn(
        "group_name", F.coalesce("_own", F.try_element_at(label, F.col("group_id")), F.col("group_id"))).drop("_own")


def map_roles(elements: DataFrame, dialect: str, key: str = "image_id") -> DataFrame:
    """Detector elements as scene objects.

    ``scene`` skips unknown roles and orders z by role; ``category`` maps unknown ones to decorative.  Boxes without four
    numbers are skipped.  ``elements``: key, pos, category, box, image_w, image_h.
    """
    table = vocab.SCENE_ROLES if dialect == "scene" else vocab.CATEGORY_ROLES
    look = F.create_map(*[x for k, (r, q) in table.items() for x in (F.lit(k), F.struct(F.lit(r).alias("role"), F.lit(q).alias("required")))])
    found = F.try_element_at(look, F.col("category"))
    base = elements.filter(F.size("box") == 4).withColumn("_f", found)
    if dialect == "scene":
        base = base.filter(F.col("_f").isNotNull())
        z = F.create_map(*[F.lit(x) for kv in vocab.SCENE_Z.items() for x in kv])
        z_index = F.coalesce(F.try_element_at(z, F.col("_f.role")), F.col("pos"))
    else:
        z_index = F.col("pos")
    role = F.coalesce("_f.role", F.lit("decorative_ad"))
    px = G.norm_to_px(F.col("box"), "image_w", "image_h", "scene" if dialect == "scene" else "wide_title", role)
    return base.withColumn("_b", px).select(
        key, F.concat(F.lit("obj_"), F.col("pos").cast("string")).alias("object_id"), "pos", role.alias("role"),
        F.coalesce("_f.required", F.lit(False)).alias("required"), (role != "protected_subject").alias("movable"),
        z_index.alias("z_index"), *[F.col(f"_b.{c}").alias(c) for c in "xywh"])


def extend_bottom(objects: DataFrame, scans: DataFrame, key: str = "image_id") -> DataFrame:
    """Height of the first product of an image grown down to the scanned bottom, when that is lower."""
    first = objects.filter("role = 'product'").groupBy(key).agg(F.min("ord").alias("ord")).join(scans, key)
    joined = objects.join(first, [key, "ord"], "left")
    grows = F.coalesce(F.col("bottom") > F.col("y") + F.col("h"), F.lit(False))
    return joined.withColumns({"h": F.when(grows, F.col("bottom") - F.col("y")).otherwise(F.col("h")), "extended": grows}).drop("bottom")


def suffix_groups(objects: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Repeated group names get ``_1``, ``_2`` …; the first keeps its name, blanks stay null."""
    named = objects.filter(F.coalesce("group_name", F.lit("")) != "")
    counted = number_rows(named, [*keys, "group_name"], order, "_n")
    with_id = counted.withColumn("group_id", F.when(F.col("_n") == 1, F.col("group_name")).otherwise(
        F.concat("group_name", F.lit("_"), (F.col("_n") - 1).cast("string")))).drop("_n")
    rest = objects.filter(F.coalesce("group_name", F.lit("")) == "").withColumn("group_id", F.lit(None).cast("string"))
    return with_id.unionByName(rest)


def number_detections(dets: DataFrame, key: str = "image_id", order: str = "seq") -> DataFrame:
    """Ids ``det_001`` … in prompt and position order (``seq``)."""
    return number_rows(dets, [key], order, "_n").withColumn(
        "detection_id", F.concat(F.lit("det_"), F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0"))
                                 .otherwise(F.col("_n").cast("string")))).drop("_n")


# --- rule sets ---------------------------------------------------------------------------------------------------

def validate_manifest(objects: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """One code per image, the first that applies: empty, duplicate ids, then object by object, then nothing removable.

    ``objects``: key, object_id, ord, role, required, movable, removable, x, y, w, h, polygon.  ``images``: key, image_w,
    image_h.
    """
    px_bad = F.exists("polygon", lambda p: (F.size(p) >= 2) & (
        (p[0] < 0) | (p[1] < 0) | (p[0] > F.col("image_w")) | (p[1] > F.col("image_h"))))
    out = ((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("image_w"))
           | (F.col("y") + F.col("h") > F.col("image_h")))
    code = (F.when((F.col("role") == "protected_subject") & (F.col("movable") | F.col("removable")), "PROTECTED_SUBJECT_VIOLATION")
            .when(F.col("required") & (F.coalesce(F.size("polygon"), F.lit(0)) <= 0), "REQUIRED_POLYGON_MISSING")
            .when(out | F.coalesce(px_bad, F.lit(False)), "COORDINATES_OUT_OF_BOUNDS"))
    coded = objects.join(images, key).withColumn("_code", code)
    bad = F.col("_code").isNotNull()
    per_id = coded.groupBy(key, "object_id").agg(
        F.count("*").alias("_n"), F.max("removable").alias("_rem"),
        F.min(F.when(bad, F.struct(F.col("ord"), F.col("_code").alias("code")))).alias("_first"))
    per = per_id.groupBy(key).agg(F.max("_n").alias("_n"), F.max("_rem").alias("_rem"), F.min("_first").alias("_first"))
    return images.select(key).join(per, key, "left").select(key, (
        F.when(F.col("_n").isNull(), "MANIFEST_EMPTY").when(F.col("_n") > 1, "DUPLICATE_IDS")
        .when(F.col("_first").isNotNull(), F.col("_first.code")).when(~F.col("_rem"), "NO_REMOVABLE_OBJECTS")).alias("code"))


def validate_extraction(manifest: DataFrame, extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required objects present, their file there, their mask filled, their alpha equal to the mask: first failure.

    ``extracted``: keys, object_id, ord, required, file_exists, mask_area, alpha_diff.
    """
    missing = missing_required(manifest, extracted, keys).groupBy(*keys).agg(F.count("*").alias("_missing"))
    code = (F.when(~F.col("file_exists"), "REQUIRED_RGBA_MISSING").when(F.col("mask_area") == 0, "REQUIRED_MASK_EMPTY")
            .when(F.col("alpha_diff") > 0, "POLYGON_ALPHA_LEAK"))
    rows = extracted.filter("required").withColumn("_code", code)
    bad = F.col("_code").isNotNull()
    first = rows.groupBy(*keys).agg(F.min_by(F.when(bad, F.col("_code")), F.when(bad, F.col("ord"))).alias("_code"))
    base = manifest.select(*keys).distinct().join(missing, list(keys), "left").join(first, list(keys), "left")
    return base.select(*keys, F.when(F.col("_missing") > 0, "REQUIRED_OBJECT_NOT_EXTRACTED").otherwise(F.col("_code")).alias("code"))


def validate_segment_request(req: DataFrame) -> DataFrame:
    """Code of an unusable request, and the prompts to use: given ones, or the defaults for an empty list."""
    blank_source = (F.coalesce("psd_path", F.lit("")) == "") & (F.coalesce("source_path", F.lit("")) == "")
    bad_prompts = F.coalesce("prompts", F.lit("[]")) != "[]"
    parsed = F.from_json(F.col("prompts"), "array<struct<role:string,texts:array<string>,experimental:boolean>>")
    code = (F.when(blank_source, "SOURCE_REQUIRED").when(bad_prompts & parsed.isNull(), "PROMPTS_PARSE_FAILED"))
    defaults = F.array(*[F.struct(F.lit(r).alias("role"), F.array(*map(F.lit, words)).alias("texts"),
                                  F.lit(r in vocab.EXPERIMENTAL_PROMPTS).alias("experimental")) for r, words in vocab.DEFAULT_PROMPTS.items()])
    use = F.when(F.coalesce(F.size(parsed), F.lit(0)) > 0, parsed).otherwise(defaults)
    return req.withColumns({"code": code, "used_prompts": F.when(code.isNull(), use)})


def bbox_valid(canvas_w="canvas_w", canvas_h="canvas_h") -> Column:
    """Positive size inside the canvas with 5 % slack on the far edges."""
    nan = F.isnan(F.col("x").cast("double")) | F.isnan(F.col("w").cast("double")) | F.isnan(F.col("y").cast("double")) | F.isnan(F.col("h").cast("double"))
    return ((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & ~nan
            & (F.col("x") + F.col("w") <= F.col(canvas_w) * 1.05) & (F.col("y") + F.col("h") <= F.col(canvas_h) * 1.05))


# --- counts ------------------------------------------------------------------------------------------------------

def manifest_stats(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    role = F.col("role")
    return objects.groupBy(*keys).agg(
        F.count("*").alias("objects"), F.count_if("removable").alias("removable"), F.count_if("required").alias("required"),
        F.count_if(role.isin("title_group", "body_text_group", "cta_group")).alias("text_groups"),
        F.count_if(F.col("mask_source") == "sam2").alias("from_model"), F.count_if(F.col("mask_source") == "polygon").alias("from_polygon"))


def call_counts(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model calls per key and the sorted list of tracks which detected something (at most one entry per track name)."""
    per = tracks.groupBy(*keys, "track").agg(F.sum("calls").alias("calls"), F.max("detected").alias("detected"))
    names = F.sort_array(F.collect_set(F.when(F.col("detected"), F.col("track"))))
    return per.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.array_join(names, ",").alias("detected_tracks"))


def merge_tracks(tracks: dict[str, DataFrame], key: str = "image_id") -> DataFrame:
    """Outer join of per-track outputs (key, detected, error) on the image; an absent track is an undetected one with an
    error, and each track counts one call."""
    out = None
    for name, frame in tracks.items():
        part = frame.select(key, F.col("detected").alias(f"{name}_detected"), F.col("error").alias(f"{name}_error"), F.lit(True).alias(f"_{name}"))
        out = part if out is None else out.join(part, key, "full_outer")
    for name in tracks:
        out = out.withColumns({
            f"{name}_detected": F.coalesce(f"{name}_detected", F.lit(False)),
            f"{name}_error": F.when(F.col(f"_{name}").isNull(), F.lit("track missing")).otherwise(F.col(f"{name}_error"))})
    names = F.array_compact(F.array(*[F.when(F.col(f"{n}_detected"), F.lit(n)) for n in tracks]))
    return out.withColumns({"call_count": F.lit(len(tracks)), "detected_tracks": F.array_join(names, ",")}).drop(*[f"_{n}" for n in tracks])


def date_like_count(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements whose label or group speaks of dates, and whether there are at least two."""
    label, group = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("group", F.lit("")))
    hit = F.lit(False)
    for w in vocab.DATE_LABELS:
        hit = hit | F.contains(label, F.lit(w))
    for w in vocab.DATE_GROUPS:
        hit = hit | F.contains(group, F.lit(w))
    return elements.groupBy(*keys).agg(F.count_if(hit).alias("date_like")).withColumn("many", F.col("date_like") >= 2)


def unknown_resources(messages: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct unknown resource ids and block keys in order of first appearance, one row each with its rank key."""
    msg = F.col("message")
    rid = F.when(F.contains(msg, F.lit("Unknown image resource")), F.regexp_extract(msg, r"(\d+)$", 1))
    block = F.when(F.contains(msg, F.lit("Unknown tagged block")) | F.contains(msg, F.lit("Unknown key")), F.trim(F.regexp_extract(msg, r"b'([^']+)'", 1)))
    found = messages.select(*keys, order, F.when(rid.isNotNull(), F.lit("resource")).otherwise("key").alias("kind"),
                            F.nullif(F.coalesce(rid, block), F.lit("")).alias("value")).filter(F.col("value").isNotNull())
    return found.groupBy(*keys, "kind", "value").agg(F.min(order).alias("first_seen"))


# --- prompts and text --------------------------------------------------------------------------------------------

def _lines(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def scan_terms(texts: DataFrame, terms: Sequence[str], key: str) -> DataFrame:
    """Lines that contain a term of a fixed word list: key, line number from 1, term, trimmed line."""
    found = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(t)), F.lit(t)) for t in terms]))
    return _lines(texts, key).select(
        key, (F.col("pos") + 1).alias("line_no"), F.explode(found).alias("term"), F.trim("line").alias("line"))


def element_lines(elements: DataFrame) -> DataFrame:
    """Prompt line of each detected element."""
    return elements.withColumn("line", F.format_string("- [%s] %s (importance: %s, group: %s)", "type", "label", "importance", "group"))


def manifest_lines(objects: DataFrame) -> DataFrame:
    """Summary line of each object and the section it belongs to."""
    return objects.withColumns({
        "section": F.when(F.col("role") == "protected_subject", "protected").otherwise("remove"),
        "line": F.format_string('  id=%s  role=%s  desc="%s"', "object_id", "role", "description")})


# --- scoring -----------------------------------------------------------------------------------------------------

def score_detections(dets: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Detections with their score struct, and a warning row for every one that failed hard."""
    from adlattice.functions.scoring import mask_score
    scored = dets.withColumn("score", mask_score())
    failed = scored.filter(F.col("score.fail_reason").isNotNull())
    text = F.concat_ws(":", F.lit("detection_hard_fail"), F.col(id_col).cast("string"), F.col("score.fail_reason"))
    return scored.filter(F.col("score.fail_reason").isNull()), failed.withColumn("warning", text)
