"""Statistics over pixel tables ``(keys…, x, y, r, g, b)``: all plain aggregates, combined map-side.

Medians are exact.  A channel has 256 values, so the counts a median keeps per group are bounded.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

RGB = ("r", "g", "b")
SOLID = 2.0
TEXT_ROLES = ("title_group", "body_text_group", "cta_group", "badge", "logo")


def channel_std(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(*[F.stddev_pop(c).alias(f"std_{c}") for c in RGB], F.count("*").alias("px"))


def solid_color(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the channels' spatial deviations, and whether the picture is solid (below 2)."""
    s = channel_std(pixels, keys)
    mean = (F.col("std_r") + F.col("std_g") + F.col("std_b")) / 3
    return s.select(*keys, mean.alias("spatial_std"), (mean < SOLID).alias("solid"))


def pixel_stats(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean variance, blank and single-colour flags, and the entropy of the grey histogram in bits."""
    grey = F.floor((F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768) / 65536)
    base = pixels.groupBy(*keys).agg(*[F.var_pop(c).alias(f"_v{c}") for c in RGB], F.count("*").alias("_n"))
    hist = pixels.groupBy(*keys, grey.alias("_g")).agg(F.count("*").alias("_c"))
    ent = hist.join(base.select(*keys, "_n"), list(keys)).groupBy(*keys).agg(
        (-F.sum(F.col("_c") / F.col("_n") * F.log2(F.col("_c") / F.col("_n")))).alias("entropy"))
    var = (F.col("_vr") + F.col("_vg") + F.col("_vb")) / 3
    single = (F.sqrt("_vr") < 0.5) & (F.sqrt("_vg") < 0.5) & (F.sqrt("_vb") < 0.5)
    return base.join(ent, list(keys)).select(*keys, F.round(var, 2).alias("variance"), (var < 1.0).alias("blank"), single.alias("single_color"),
                                             F.round("entropy", 4).alias("entropy"))


def _medians(cond: Column) -> list[Column]:
    return [F.median(F.when(cond, F.col(c))).cast("int").alias(f"_m{c}") for c in RGB]


def band_background(pixels: DataFrame, sizes: DataFrame, keys: Sequence[str], uniform: float = 25.0, large: float = 0.20) -> DataFrame:
    """Background colour from the band around the removal area (column ``band``), its deviation, and the fill decision.

    An empty band is black with deviation 100.  ``sizes``: keys, total_px, removal_px.
    """
    band = F.col("band")
    agg = pixels.groupBy(*keys).agg(*_medians(band), F.greatest(*[F.stddev_pop(F.when(band, F.col(c))) for c in RGB]).alias("_std"))
    j = sizes.join(agg, list(keys), "left")
    std = F.coalesce("_std", F.lit(100.0))
    ai = F.col("removal_px") / F.col("total_px") >= large
    return j.select(*keys, *[F.coalesce(f"_m{c}", F.lit(0)).alias(f"bg_{c}") for c in RGB], std.alias("bg_std"), ai.alias("force_ai"), (std < uniform).alias("uniform"))


def natural_background(pixels: DataFrame, keys: Sequence[str], least: int = 100) -> DataFrame:
    """Median colour of bright, unsaturated pixels when there are enough, else of all pixels; and which it was."""
    hi, lo = F.greatest(*RGB), F.least(*RGB)
    plain = (hi / 255.0 > 0.75) & (F.when(hi > 0, (hi - lo) / hi).otherwise(0.0) < 0.20)
    agg = pixels.groupBy(*keys).agg(F.count_if(plain).alias("bright_px"), *_medians(plain), *[F.median(c).cast("int").alias(f"_a{c}") for c in RGB])
    enough = F.col("bright_px") >= least
    return agg.select(*keys, "bright_px", *[F.when(enough, F.col(f"_m{c}")).otherwise(F.col(f"_a{c}")).alias(f"bg_{c}") for c in RGB],
                      F.when(enough, "bg_only").otherwise("all_natural").alias("source"))


def fill_strategy(type_b: Column, bg_std: Column, force_ai: Column) -> Column:
    return F.when(type_b, "full_image_ai").when((bg_std < 25.0) & ~force_ai, "direct_fill").otherwise("masked_ai")


def needs_bg_removal(pixels: DataFrame, keys: Sequence[str], border: int = 3, dark: int = 55, range_: int = 30, bright: int = 120,
                     share: float = 0.15) -> DataFrame:
    """Text roles always; others when enough border pixels are dark or achromatic-bright.

    Corner pixels belong to two sides and count twice.  ``pixels`` also has role, w, h.
    """
    b = F.least(F.lit(border), F.floor(F.col("h") / 2), F.floor(F.col("w") / 2))
    weight = ((F.col("y") < b).cast("int") + (F.col("y") >= F.col("h") - b).cast("int") + (F.col("x") < b).cast("int") + (F.col("x") >= F.col("w") - b).cast("int"))
    light = (F.col("r") + F.col("g") + F.col("b")) / 3
    grey = (F.greatest(*RGB) - F.least(*RGB) < range_) & (light > bright)
    agg = pixels.withColumn("_w", weight).groupBy(*keys).agg(
        F.max("role").alias("_role"), F.sum("_w").alias("_n"), F.sum(F.when(light < dark, F.col("_w")).otherwise(0)).alias("_d"), F.sum(F.when(grey, F.col("_w")).otherwise(0)).alias("_g"))
    ratio = [F.coalesce(F.try_divide(c, "_n"), F.lit(0.0)) for c in ("_d", "_g")]
    return agg.select(*keys, (F.col("_role").isin(*TEXT_ROLES) | (ratio[0] >= share) | (ratio[1] >= share)).alias("remove_bg"))


def uniform_sides(pixels: DataFrame, keys: Sequence[str], threshold: float, sample: int = 10) -> DataFrame:
    """Sides of the placed picture whose neighbouring strip is uniform, with the strip's median colour.

    ``pixels`` (inside the placed box) also has canvas_w, canvas_h, bx1, by1, bx2, by2.  Only sides with room are tested.
    """
    strips = F.array_compact(F.array(
        F.when((F.col("bx1") > 0) & (F.col("x") >= F.col("bx1")) & (F.col("x") < F.least(F.col("bx1") + sample, F.col("bx2"))), F.lit("left")),
        F.when((F.col("bx2") < F.col("canvas_w")) & (F.col("x") >= F.greatest(F.col("bx2") - sample, F.col("bx1"))) & (F.col("x") < F.col("bx2")), F.lit("right")),
        F.when((F.col("by1") > 0) & (F.col("y") >= F.col("by1")) & (F.col("y") < F.col("by2")), F.lit("top")),
        F.when((F.col("by2") < F.col("canvas_h")) & (F.col("y") >= F.col("by1")) & (F.col("y") < F.col("by2")), F.lit("bottom"))))
    agg = pixels.withColumn("side", F.explode(strips)).groupBy(*keys, "side").agg(
        F.greatest(*[F.stddev_pop(c) for c in RGB]).alias("std"), *[F.median(c).cast("int").alias(f"fill_{c}") for c in RGB])
    flat = F.col("std") < threshold
    return agg.select(*keys, "side", "std", flat.alias("uniform"), *[F.when(flat, F.col(f"fill_{c}")).alias(f"fill_{c}") for c in RGB])


def lr_brightness(pixels: DataFrame, keys: Sequence[str], threshold: float, sample: int = 10) -> DataFrame:
    """Brightness of the strips at the left and right edge of the placed box, and whether they differ enough."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    left, right = F.col("x") < F.least(F.col("bx1") + sample, F.col("bx2")), F.col("x") >= F.greatest(F.col("bx2") - sample, F.col("bx1"))
    inside = (F.col("x") >= F.col("bx1")) & (F.col("x") < F.col("bx2"))
    agg = pixels.filter(inside).groupBy(*keys).agg(F.avg(F.when(left, mean)).alias("left"), F.avg(F.when(right, mean)).alias("right"))
    return agg.withColumn("gap", F.abs(F.col("left") - F.col("right"))).withColumn("separate", F.col("gap") >= threshold)


def validate_picture(pictures: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Code of a rendered picture or scene plate: absent, unreadable, wrong size, solid; null when fine.

    ``pictures``: keys, exists, width, height (−1 when unreadable), spatial_std, tgt_w, tgt_h.
    """
    names = {"result": ("RESULT_NOT_FOUND", "RESULT_DECODE_FAILED", "RESULT_SIZE_MISMATCH", "SOLID_COLOR_RESULT"),
             "plate": ("SCENE_PLATE_DECODE_FAILED", "SCENE_PLATE_DECODE_FAILED", "TARGET_SIZE_MISMATCH", "SOLID_COLOR_IMAGE")}[prefix]
    code = (F.when(~F.col("exists"), names[0]).when(F.coalesce("height", F.lit(-1)) < 0, names[1])
            .when((F.col("width") != F.col("tgt_w")) | (F.col("height") != F.col("tgt_h")), names[2]).when(F.col("spatial_std") < SOLID, names[3]))
    return pictures.select(*keys, code.alias("code"))
