"""Quality scores and classes as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlattice import vocab
from adlattice.functions.geometry import _c

# thresholds of the mask score
MIN_CONFIDENCE, MIN_AREA, MAX_AREA, MAX_FRAGMENTS = 0.10, 0.001, 0.90, 20
OVERLAP_SOFT, OVERLAP_HARD = 0.05, 0.10
EDGE_EXPECTED, EDGE_MIN_PIXELS = 200.0, 10
NATURALNESS = 0.70


def role_consistency(confidence) -> Column:
    c = _c(confidence)
    return F.when(c >= 0.7, 1.0).when(c >= 0.5, 0.75).when(c >= 0.3, 0.5).otherwise(0.25)


def edge_clip(x, y, w, h, canvas_w, canvas_h, margin: int = 5) -> Column:
    """Share of the four sides that lie within the margin of the canvas edge."""
    x, y = _c(x), _c(y)
    sides = [x <= margin, y <= margin, x + _c(w) >= _c(canvas_w) - margin, y + _c(h) >= _c(canvas_h) - margin]
    return sum((s.cast("int") for s in sides[1:]), sides[0].cast("int")) / 4.0


def native_score(source, product_score) -> Column:
    base = F.create_map(*[F.lit(x) for kv in vocab.NATIVE_MASK_BASE.items() for x in kv])
    score = F.coalesce(F.try_element_at(base, _c(source)), F.lit(5.0)) + (_c(product_score) - 50.0) * 0.20
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)


def hard_fail() -> Column:
    """Reason a detection is discarded, the first that applies.  Reads the columns of ``mask_score``."""
    from adlattice.operators.objects import bbox_valid
    area = F.col("mask_pixels") / F.greatest(F.col("canvas_w").cast("long") * F.col("canvas_h"), F.lit(1))
    return (F.when((F.col("detection_conf") < MIN_CONFIDENCE) | (F.col("mask_conf") < MIN_CONFIDENCE), "confidence_too_low")
            .when(F.col("mask_pixels") == 0, "empty_mask").when(area < MIN_AREA, "mask_too_small")
            .when(area > MAX_AREA, "mask_too_large_canvas_fill").when(F.col("fragments") > MAX_FRAGMENTS, "too_many_fragments")
            .when(~bbox_valid(), "invalid_bbox"))


def mask_score() -> Column:
    """Struct of gains, penalties and total of one detection.

    Columns read: detection_conf, mask_conf, edge_sharpness, fragments, mask_pixels, canvas_w, canvas_h, x, y, w, h,
    role, hand_overlap, person_overlap, native_iou, top_cov, bottom_cov, continuity, top_clipped, bottom_clipped (the last
    five null when completeness was not measured).  A hard-failed detection scores zero throughout.
    """
    zero = F.lit(0.0)
    canvas = F.greatest(F.col("canvas_w").cast("long") * F.col("canvas_h"), F.lit(1))
    area = F.col("mask_pixels") / canvas
    bw, bh = F.greatest(F.col("w"), F.lit(0)), F.greatest(F.col("h"), F.lit(0))
    box = bw.cast("long") * bh
    fill = F.when(box > 0, F.col("mask_pixels") / F.greatest(box, F.lit(1))).otherwise(1.0)
    frag, product = F.col("fragments"), F.col("role") == "product"
    sized = product & (bw > 0) & (bh > 0)
    aspect = F.try_divide(bh, bw)
    measured = product & F.col("top_cov").isNotNull()

    top_bottom = F.when(measured, F.least((F.col("top_cov") + F.col("bottom_cov")) / 2.0, F.lit(1.0)) * 8.0).otherwise(0.0)
    complete = F.when(measured, top_bottom + F.least(F.col("continuity"), F.lit(1.0)) * 7.0).otherwise(0.0)

    def overlap_penalty(col: str, hard: float, soft: float) -> Column:
        v = F.col(col)
        return (F.when(v >= OVERLAP_HARD, F.least(v / 0.5, F.lit(1.0)) * hard)
                .when(v >= OVERLAP_SOFT, (v / OVERLAP_HARD) * soft).otherwise(0.0))
    gains = {
        "confidence": F.col("detection_conf") * 25, "mask_confidence": F.col("mask_conf") * 20, "edge": F.col("edge_sharpness") * 15,
        "fragment": F.when(frag == 1, 8.0).when(frag <= 3, 5.0).when(frag <= 6, 2.0).otherwise(0.0),
        "bbox_fill": F.when((fill >= 0.30) & (fill <= 0.85), 6.0).when(((fill >= 0.15) & (fill < 0.30)) | ((fill > 0.85) & (fill <= 0.95)), 2.0).otherwise(0.0),
        "aspect": F.when(sized & (aspect >= 0.4) & (aspect <= 3.0), 8.0).when(sized & (((aspect >= 0.2) & (aspect < 0.4)) | ((aspect > 3.0) & (aspect <= 5.0))), 3.0).otherwise(0.0),
        "native": F.when(product, F.coalesce("native_iou", zero) * 5).otherwise(0.0),
        "role": role_consistency("detection_conf") * 5, "completeness": complete}
    penalties = {
        "area_leak": F.when(area > 0.60, 15.0).when(area > 0.40, 5.0).otherwise(0.0), "overfill": F.when(fill > 0.95, 8.0).otherwise(0.0),
        "fragments": F.when(frag > 6, F.least((frag - 6) * 2.0, F.lit(12.0))).otherwise(0.0),
        "edge_clip": edge_clip("x", "y", "w", "h", "canvas_w", "canvas_h") * 10.0,
        "hand": overlap_penalty("hand_overlap", 25.0, 8.0), "person": overlap_penalty("person_overlap", 18.0, 5.0),
        "clipping": F.when(measured, (F.col("top_clipped").cast("int") + F.col("bottom_clipped").cast("int")) * 4.0).otherwise(0.0)}
    total = sum(list(gains.values())[1:], list(gains.values())[0]) - sum(list(penalties.values())[1:], list(penalties.values())[0])
    total = F.greatest(zero, F.least(F.lit(100.0), total))
    reason = hard_fail()

    def kept(v: Column) -> Column:
        return F.when(reason.isNull(), F.round(v, 2)).otherwise(0.0)
    return F.struct(
        reason.alias("fail_reason"), *[kept(v).alias(f"gain_{k}") for k, v in gains.items()],
        kept(top_bottom).alias("gain_top_bottom"), *[kept(-v).alias(f"loss_{k}") for k, v in penalties.items()],
        kept(total).alias("total"), F.when(reason.isNull(), F.round(F.greatest(zero, area - 0.3) / 0.7, 3)).otherwise(1.0).alias("leak_risk"),
        F.round(fill, 3).alias("fill_ratio"), F.round(area, 4).alias("area_ratio"))


def scene_codes(v: Column) -> Column:
    """Fail codes of a scene verdict struct; duplicated fragments are not among them on purpose."""
    rules = [(v["ad_objects_remaining"], "AD_OBJECTS_REMAINING"), (~v["protected_preserved"], "PROTECTED_SUBJECT_DAMAGED"),
             (v["visible_seam"], "VISIBLE_SEAM_DETECTED"), (v["new_text"], "NEW_TEXT_GENERATED"),
             (v["naturalness"] < NATURALNESS, "LOW_NATURALNESS_SCORE")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def artboard_level() -> Column:
    """Fit of the chosen artboard; an inferred match is never better than a warning."""
    s = F.col("match_score")
    return (F.when(s.isNull(), None).when(s < 0.50, "bad").when(s < 0.80, "warn")
            .when(F.col("match_type") == "inferred", "warn").otherwise("good"))


def ratio_gap() -> Column:
    """Struct src_ratio, tgt_ratio, diff, large; null when sizes are unknown or the match is (near) perfect."""
    parts = F.split("artboard_size", "x")
    sw, sh = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    src, tgt = F.try_divide(sw, sh), F.try_divide(F.col("width"), F.col("height"))
    diff = F.abs(src - tgt)
    ok = ((F.coalesce(sw, F.lit(0)) != 0) & (F.coalesce(sh, F.lit(0)) != 0) & (F.coalesce("width", F.lit(0)) != 0)
          & (F.coalesce("height", F.lit(0)) != 0) & F.coalesce(F.col("match_score") <= 0.999, F.lit(False)))
    return F.when(ok, F.struct(F.round(src, 2).alias("src_ratio"), F.round(tgt, 2).alias("tgt_ratio"), F.round(diff, 2).alias("diff"),
                               (diff > 0.5).alias("large")))


def score_band(score) -> Column:
    s = _c(score)
    return F.when(s >= 85, "high").when(s >= 70, "mid").otherwise("low")


def quality_band(score) -> Column:
    s = _c(score)
    return F.when(s.isNull(), "").when(s >= 70, "good").when(s >= 50, "warn").otherwise("bad")


def open_failure(kind, message) -> Column:
    """Why a layered file could not be opened, from the error's type name and text."""
    k, m = _c(kind), F.lower(_c(message))

    def has(*words: str) -> Column:
        out = F.contains(m, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(m, F.lit(w))
        return out
    asserted = k == "AssertionError"
    return (F.when(asserted & has("version"), "unsupported_internal_descriptor_version")
            .when(asserted & has("key", "block", "tag", "unsupported", "unknown"), "unsupported_tagged_block")
            .when(has("signature") & has("invalid", "wrong", "expected", "bad"), "invalid_psd_header")
            .when(has("truncated", "unexpected end", "eof", "end of file"), "truncated_file")
            .when(has("composite", "decode"), "composite_decode_error")
            .when(k.isin("struct.error", "ValueError"), "malformed_image_resource").otherwise("unknown_parser_error"))


def token_parameter(model) -> Column:
    m = F.lower(_c(model))
    return F.when(m.rlike(r"^(gpt-5|o1|o3|o4)"), "max_completion_tokens").otherwise("max_tokens")
