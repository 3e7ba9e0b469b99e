"""Binary masks as rows of half-open runs ``(keys…, y, x0, x1)``.

A canonical mask has disjoint, non-touching runs per row.  Row-wise windows partition by ``(keys, y)``; before each, runs
that start at the same column are combined map-side, so a partition never holds more rows than the canvas has columns,
however many copies of a mask come in.  Only masks of at most ``RUNS_AT_ONCE`` runs are gathered, by closing and labelling;
no operator pairs or gathers a larger one.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlattice.session import materialise

LEFT_GAP = 80
DISK = {dy: int((25 - dy * dy) ** 0.5) for dy in range(-5, 6)}
#: Runs of a mask, and pixels of its canvas, up to which closing and labelling take it as one row; larger masks meet in joins.
RUNS_AT_ONCE, PIXELS_AT_ONCE = 1000, 1 << 22
#: Holes below, and pieces from, this share of the canvas or so many pixels, the greater, are filled and kept.
HOLE_SHARE, HOLE_LEAST, PIECE_SHARE, PIECE_LEAST = 0.001, 64, 0.002, 128


def _row(keys: Sequence[str]) -> list[str]:
    return [*keys, "y"]


def mask_union(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Canonical union of all runs of a key: overlapping and touching runs of a row become one."""
    longest = runs.filter(F.col("x1") > F.col("x0")).groupBy(*_row(keys), "x0").agg(F.max("x1").alias("x1"))
    w = Window.partitionBy(*_row(keys)).orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("_start", F.when(reach.isNull() | (reach < F.col("x0")), F.col("x0")))
    island = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_i", island).groupBy(*_row(keys), "_i").agg(F.max("x1").alias("x1")).withColumnRenamed("_i", "x0").select(
        *_row(keys), "x0", "x1")


def mask_area(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of a canonical mask."""
    return runs.groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("area"))


def coverage(runs: DataFrame, canvas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, percent of the canvas, and fill of the box (1.0 for a box without area), 0 for masks without runs.

    ``canvas``: keys, canvas_w, canvas_h, box_w, box_h.
    """
    a = canvas.join(mask_area(runs, keys), list(keys), "left").withColumn("area", F.coalesce("area", F.lit(0).cast("long")))
    size, box = F.col("canvas_w").cast("long") * F.col("canvas_h"), F.col("box_w").cast("long") * F.col("box_h")
    return a.withColumns({"coverage_pct": F.round(F.col("area") / size * 100, 2),
                          "fill": F.when(box > 0, F.col("area") / F.greatest(box, F.lit(1))).otherwise(1.0)})


def mask_bbox(runs: DataFrame, keys: Sequence[str], pad: int = 0, canvas: tuple[str, str] | None = None) -> DataFrame:
    """Bounding box with exclusive far edges, optionally padded and clamped to (width, height) columns; an empty mask
    has no row."""
    extra = [F.max(c).alias(c) for c in canvas] if canvas else []
    b = runs.filter(F.col("x1") > F.col("x0")).groupBy(*keys).agg(
        F.min("x0").alias("bx1"), F.min("y").alias("by1"), F.max("x1").alias("bx2"), (F.max("y") + 1).alias("by2"), *extra)
    if pad:
        hi = [F.col(c) for c in canvas]
        b = b.withColumns({"bx1": F.greatest(F.lit(0), F.col("bx1") - pad), "by1": F.greatest(F.lit(0), F.col("by1") - pad),
                           "bx2": F.least(hi[0], F.col("bx2") + pad), "by2": F.least(hi[1], F.col("by2") + pad)})
    return b.select(*keys, "bx1", "by1", "bx2", "by2")


def place_mask(runs: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Runs moved to their box position, and a SIZE_MISMATCH row for masks that would leave the canvas.

    ``boxes``: keys, box_x, box_y, mask_w, mask_h, canvas_w, canvas_h.
    """
    out = (F.col("box_x") + F.col("mask_w") > F.col("canvas_w")) | (F.col("box_y") + F.col("mask_h") > F.col("canvas_h"))
    judged = boxes.withColumn("_out", out)
    moved = runs.join(judged.filter(~F.col("_out")), list(keys)).select(
        *keys, (F.col("y") + F.col("box_y")).alias("y"), (F.col("x0") + F.col("box_x")).alias("x0"), (F.col("x1") + F.col("box_x")).alias("x1"))
    return moved, judged.filter("_out").select(*keys, F.lit("SIZE_MISMATCH").alias("code"))


def extend_left(runs: DataFrame, keys: Sequence[str], gap: int = LEFT_GAP) -> DataFrame:
    """Every row of the mask also covers ``gap`` pixels left of the mask's leftmost column."""
    left = runs.groupBy(*keys).agg(F.min("x0").alias("_l"))
    rows = runs.select(*_row(keys)).distinct().join(left, list(keys))
    strips = rows.select(*_row(keys), F.greatest(F.lit(0), F.col("_l") - gap).alias("x0"), F.col("_l").alias("x1"))
    return mask_union(runs.select(*_row(keys), "x0", "x1").unionByName(strips), keys)


def _spread(runs: DataFrame, keys: Sequence[str], reach: Column, canvas_w: Column, canvas_h: Column) -> DataFrame:
    """Runs repeated over an array of (dy, dx) reaches, clamped to the canvas."""
    return (runs.withColumn("_r", F.explode(reach)).withColumn("_y", F.col("y") + F.col("_r.dy"))
            .filter((F.col("_y") >= 0) & (F.col("_y") < canvas_h))
            .select(*keys, F.col("_y").alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("_r.dx")).alias("x0"),
                    F.least(canvas_w, F.col("x1") + F.col("_r.dx")).alias("x1")))


def dilate(runs: DataFrame, keys: Sequence[str], r: int, canvas_w: Column, canvas_h: Column) -> DataFrame:
    """Square dilation by r pixels."""
    reach = F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda d: F.struct(d.alias("dy"), F.lit(r).alias("dx")))
    return mask_union(_spread(runs, keys, reach, canvas_w, canvas_h), keys)


def complement(runs: DataFrame, canvas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of a canonical mask's outside.  ``canvas``: keys, canvas_w, canvas_h."""
    ends = canvas.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("canvas_h") - 1))).select(
        *_row(keys), F.col("canvas_w").alias("x0"), F.col("canvas_w").alias("x1"))
    both = runs.select(*_row(keys), "x0", "x1").unionByName(ends)
    w = Window.partitionBy(*_row(keys)).orderBy("x0", "x1")
    gap = both.select(*_row(keys), F.coalesce(F.lag("x1").over(w), F.lit(0)).alias("_a"), F.col("x0").alias("_b"))
    return gap.filter(F.col("_b") > F.col("_a")).select(*_row(keys), F.col("_a").alias("x0"), F.col("_b").alias("x1"))


def _sweep(masks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Row segments with the number of runs of each mask over them (``c0``, ``c1`` …): one sorted pass, no run pairs."""
    def edges(i: int, runs: DataFrame) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("s")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("s"))))
        return runs.select(*_row(keys), ends.alias("_e")).select(
            *_row(keys), F.col("_e.x").alias("x"), *[(F.col("_e.s") if i == j else F.lit(0)).alias(f"d{j}") for j in range(len(masks))])
    both = edges(0, masks[0])
    for i, m in enumerate(masks[1:], 1):
        both = both.unionByName(edges(i, m))
    steps = both.groupBy(*_row(keys), "x").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(len(masks))])
    w = Window.partitionBy(*_row(keys)).orderBy("x")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = steps.select(*_row(keys), F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"),
                       *[F.sum(f"d{j}").over(sofar).alias(f"c{j}") for j in range(len(masks))])
    return seg.filter(F.col("x1").isNotNull())


def mask_and(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mask_union(_sweep([a, b], keys).filter("c0 > 0 AND c1 > 0"), keys)


def mask_minus(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mask_union(_sweep([a, b], keys).filter("c0 > 0 AND c1 = 0"), keys)


def _pixels_where(cond: str) -> Column:
    return F.sum(F.when(F.expr(cond), F.col("x1") - F.col("x0")).otherwise(0).cast("long"))


def overlap_ratio(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each mask of ``a`` covered by ``b``; 0 without cover.  One sweep gives both areas."""
    areas = _sweep([a, b], keys).groupBy(*keys).agg(_pixels_where("c0 > 0").alias("area"), _pixels_where("c0 > 0 AND c1 > 0").alias("shared"))
    return areas.filter("area > 0").withColumn("ratio", F.col("shared") / F.col("area"))


def spread_to(masks: DataFrame, covers: DataFrame, key: str, mask_key: str) -> DataFrame:
    """Runs of a per-image cover repeated for every mask of the image which has pixels in that row."""
    rows = masks.select(key, mask_key, "y").distinct()
    return rows.join(covers.select(key, "y", "x0", "x1"), [key, "y"])


def subtract_candidates(prod: DataFrame, hand: DataFrame, person: DataFrame, key: str, mask_key: str) -> tuple[DataFrame, DataFrame]:
    """Overlap ratios of product masks with hand and person cover, and runs of the ``_sub`` masks left after taking both
    away: where an overlap is above 5 % and over 30 % of the area remains."""
    keys = [key, mask_key]
    h, p = spread_to(prod, hand, key, mask_key), spread_to(prod, person, key, mask_key)
    seg = _sweep([prod, h, p], keys)
    areas = seg.groupBy(*keys).agg(_pixels_where("c0 > 0").alias("area"), _pixels_where("c0 > 0 AND c1 > 0").alias("_h"),
                                   _pixels_where("c0 > 0 AND c2 > 0").alias("_p"), _pixels_where("c0 > 0 AND c1 = 0 AND c2 = 0").alias("sub_area"))
    ratios = areas.select(*keys, "area", (F.col("_h") / F.col("area")).alias("hand_ratio"), (F.col("_p") / F.col("area")).alias("person_ratio"), "sub_area")
    ratios = ratios.withColumn("has_sub", ((F.col("hand_ratio") > 0.05) | (F.col("person_ratio") > 0.05)) & (F.col("sub_area") > F.col("area") * 0.30))
    left = mask_union(seg.filter("c0 > 0 AND c1 = 0 AND c2 = 0"), keys)
    return ratios, left.join(ratios.filter("has_sub").select(*keys), keys, "left_semi")


def completeness(runs: DataFrame, boxes: DataFrame, keys: Sequence[str], clip: float = 0.10) -> DataFrame:
    """Cover of a box's top, bottom and sides by its mask, and vertical continuity.

    ``boxes``: keys, x, y, w, h, canvas_w, canvas_h (box size at least 1).  Columns are covered where any row is: the union
    of the runs without their row.  Boxes outside the canvas give no row.
    """
    x1, y1 = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    b = boxes.select(*keys, x1.alias("_bx"), y1.alias("_by"), F.least("canvas_w", x1 + F.greatest(F.lit(1), F.col("w"))).alias("_bx2"),
                     F.least("canvas_h", y1 + F.greatest(F.lit(1), F.col("h"))).alias("_by2")).filter("_bx2 > _bx AND _by2 > _by")
    inside = runs.join(b, list(keys)).filter((F.col("y") >= F.col("_by")) & (F.col("y") < F.col("_by2"))).select(
        *keys, (F.col("y") - F.col("_by")).alias("y"), (F.greatest("x0", "_bx") - F.col("_bx")).alias("x0"), (F.least("x1", "_bx2") - F.col("_bx")).alias("x1")).filter("x1 > x0")
    rows = inside.select(*_row(keys)).distinct().groupBy(*keys).agg(F.count("*").alias("rows"), F.min("y").alias("first_row"), F.max("y").alias("last_row"))
    flat = mask_union(inside.select(*keys, F.lit(0).alias("y"), "x0", "x1"), keys)
    cols = flat.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("cols"), F.min("x0").alias("first_col"), (F.max("x1") - 1).alias("last_col"))
    j = b.join(rows, list(keys), "left").join(cols, list(keys), "left")
    h, w, has = F.col("_by2") - F.col("_by"), F.col("_bx2") - F.col("_bx"), F.col("rows").isNotNull()
    span = F.col("last_row") - F.col("first_row") + 1

    def when(v: Column, other) -> Column:
        return F.when(has, v).otherwise(F.lit(other))
    return j.select(
        *keys, when(1.0 - F.col("first_row") / h, 0.0).alias("top_cov"), when((F.col("last_row") + 1) / h, 0.0).alias("bottom_cov"),
        when(F.col("rows") / span, 0.0).alias("continuity"), when(F.col("rows") / h, 0.0).alias("v_fill"), when(F.col("cols") / w, 0.0).alias("h_fill"),
        when(F.col("first_row") > h * clip, True).alias("top_clipped"), when((h - 1 - F.col("last_row")) > h * clip, True).alias("bottom_clipped"),
        when(F.col("first_col") > w * clip, True).alias("left_clipped"), when((w - 1 - F.col("last_col")) > w * clip, True).alias("right_clipped"),
        when(span, 0).alias("span_rows"), h.alias("box_rows"))


# --- components --------------------------------------------------------------------------------------------------

def _joined(ys: list[int], lefts: list[int], rights: list[int], slack: int) -> list[int]:
    """For every run of one mask, ordered by row and column, the number of the first run of its piece."""
    root = list(range(len(ys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    above = above_end = row = 0
    while row < len(ys):
        end = row
        while end < len(ys) and ys[end] == ys[row]:
            end += 1
        if ys[above] + 1 == ys[row]:
            for b in range(row, end):
                while above < above_end and rights[above] + slack <= lefts[b]:
                    above += 1
                for a in range(above, above_end):
                    if lefts[a] - slack >= rights[b]:
                        break
                    if lefts[b] < rights[a] + slack:
                        u, v = find(a), find(b)
                        root[max(u, v)] = min(u, v)
        above, above_end, row = row, end, end
    return [find(i) for i in range(len(ys))]


def _label_masks(slack: int):
    def label(ys: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        out = []
        for y, x0, x1 in zip(ys, lefts, rights):
            x0, x1 = x0.tolist(), x1.tolist()
            first = _joined(y.tolist(), x0, x1, slack)
            size = [0] * len(first)
            for i, r in enumerate(first):
                size[r] += x1[i] - x0[i]
            out.append((first, [size[r] for r in first]))
        return pd.DataFrame(out, columns=["first", "size"])
    return F.pandas_udf(label, "first array<int>, size array<long>")


def _labelled(runs: DataFrame, keys: Sequence[str], diagonal: bool, at_once: int) -> DataFrame:
    """Canonical runs with the ``label`` and ``_size``, in pixels, of the component they belong to.

    A mask of at most ``at_once`` runs is labelled as one row, a larger one by ``_star_labels``.  A run without key or place touches none.
    """
    slack = 1 if diagonal else 0
    # numbers are written with their run, so they are the same in every later read
    named = materialise(runs.withColumn("_id", F.monotonically_increasing_id()))
    size = (F.col("x1") - F.col("x0")).cast("long")
    placed = F.lit(True)
    for c in (*_row(keys), "x0", "x1"):
        placed = placed & F.col(c).isNotNull()
    known = named.filter(placed)
    large = materialise(known.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > at_once).select(*keys))
    crowded = not large.isEmpty()
    rest = [c for c in named.columns if c not in (*keys, "y", "x0", "x1", "_id")]
    one = F.struct("y", "x0", "x1", "_id", *rest)
    few = known.join(large, list(keys), "left_anti") if crowded else known
    masks = few.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_m"))
    marked = masks.withColumn("_p", _label_masks(slack)("_m.y", "_m.x0", "_m.x1"))
    zipped = F.arrays_zip("_m", F.transform("_p.first", lambda i: F.col("_m")[i]["_id"]).alias("label"), F.col("_p.size").alias("_size"))
    out = marked.select(*keys, F.inline(zipped).alias("_m", "label", "_size"))
    columns = [*[F.col(c) if c in keys else F.col(f"_m.`{c}`").alias(c) for c in runs.columns], "label", "_size"]
    alone = named.filter(~placed).select(*runs.columns, F.col("_id").alias("label"), size.alias("_size"))
    out = out.select(*columns).unionByName(alone)
    if not crowded:
        return out
    starred = materialise(_star_labels(known.join(large, list(keys), "left_semi"), keys, slack).drop("_id"))
    return out.unionByName(starred.join(starred.groupBy(*keys, "label").agg(F.sum(size).alias("_size")), [*keys, "label"]))


def components(runs: DataFrame, keys: Sequence[str], diagonal: bool = True, at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """Canonical runs with the component ``label`` they belong to.

    Runs of neighbouring rows are connected when they share a column (or touch diagonally).
    """
    return _labelled(runs, keys, diagonal, at_once).drop("_size")


def _star_labels(named: DataFrame, keys: Sequence[str], slack: int) -> DataFrame:
    """Labels of masks of any size, the least ``_id`` of a component.

    They come from alternating large-star / small-star rounds over the edge list: each round is two aggregations with joins, the
    number of rounds grows with the logarithm of the component size, and the lineage is cut by a written table per round.
    """
    # the runs of the next row meet through buckets of columns, so a wide row is not paired with a whole row
    cell = 64

    def bucketed(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
        return df.withColumn("_c", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    a = bucketed(named, F.col("x0") - slack, F.col("x1") - 1 + slack).select(*keys, (F.col("y") + 1).alias("y"), "_c", F.col("x0").alias("_a0"), F.col("x1").alias("_a1"), F.col("_id").alias("_u"))
    b = bucketed(named, F.col("x0"), F.col("x1") - 1).select(*keys, "y", "_c", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"), F.col("_id").alias("_v"))
    touching = (F.col("_a0") - slack < F.col("_b1")) & (F.col("_b0") < F.col("_a1") + slack)
    edges = materialise(a.join(b, [*keys, "y", "_c"]).filter(touching)
                        .select(F.least("_u", "_v").alias("lo"), F.greatest("_u", "_v").alias("hi")).distinct())
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_in = large.filter("v < u").distinct()
        roots = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(roots, "u")
        edges = materialise(small.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                            .unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).filter("hi <> lo").distinct())
        # done once every edge points at a root: no lower end is itself below another node
        if edges.join(edges.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").isEmpty():
            break
    labels = edges.groupBy(F.col("hi").alias("_id")).agg(F.min("lo").alias("label"))
    return named.join(labels, "_id", "left").withColumn("label", F.coalesce("label", "_id"))


def fragments(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of 8-connected pieces per mask."""
    return components(runs, keys).select(*keys, "label").distinct().groupBy(*keys).agg(F.count("*").alias("fragments"))


REACH = max(DISK)


#: Bits of masks that are closed and cleaned together.
BITS_AT_ONCE = 1 << 19


@lru_cache(maxsize=16)
def _canvas(width: int, height: int) -> tuple[int, int, bytes]:
    """Bits of a row, whole bytes with ``REACH`` spare bits on both sides; rows with as many spare ones; and the canvas as bits."""
    step = -(-(width + 2 * REACH) // 8) * 8
    row, none = (((1 << width) - 1) << REACH).to_bytes(step // 8, "little"), bytes(REACH * step // 8)
    return step, height + 2 * REACH, none + row * height + none


def _dilated(v: int, step: int) -> int:
    wide = [v]
    for _ in range(REACH):
        wide.append(wide[-1] | wide[-1] << 1 | wide[-1] >> 1)
    out = 0
    for dy, dx in DISK.items():
        out |= wide[dx] << dy * step if dy >= 0 else wide[dx] >> -dy * step
    return out


def _bits(v: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little")


def _closed_bits(n: int, mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int, height: int) -> np.ndarray:
    """Closing of ``n`` masks with the disk; what lies within reach of the canvas counts.

    A mask's rows of bits follow each other, as do the masks: the spare bits around each keep it from reaching another.
    """
    step, rows, inside = _canvas(width, height)
    x0, x1 = np.maximum(x0, -REACH), np.minimum(x1, width + REACH)
    near = (y >= -REACH) & (y < height + REACH) & (x1 > x0)
    at = ((mask * rows + y + REACH) * step + REACH)[near]
    ends = np.zeros(n * rows * step + 1, np.int32)
    np.add.at(ends, at + x0[near], 1)
    np.subtract.at(ends, at + x1[near], 1)
    packed = np.packbits(np.cumsum(ends[:-1], dtype=np.int32) > 0, bitorder="little")
    canvas = int.from_bytes(inside * n, "little")
    closed = canvas & ~_dilated(canvas & ~_dilated(int.from_bytes(packed.tobytes(), "little"), step), step)
    return _bits(closed.to_bytes(len(packed), "little"))


def _ends(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bits begin and end."""
    at = np.flatnonzero(bits[1:] != bits[:-1]) + 1  # the first and the last bit are spare ones
    return at[::2], at[1::2]


def _sizes(begin: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """For every run of bits the area of its 4-connected piece: labels sink to the least of those that touch."""
    first, last = np.searchsorted(end, begin - step, "right"), np.searchsorted(begin, end - step, "left")
    n = np.maximum(last - first, 0)
    low = np.repeat(np.arange(len(begin)), n)
    high = np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    label = np.arange(len(begin))
    while True:
        a, b = label[low], label[high]
        apart = a != b
        if not apart.any():
            return np.bincount(label, end - begin, len(label))[label]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]


def _placed(begin: np.ndarray, end: np.ndarray, width: int, height: int) -> list[np.ndarray]:
    """Mask, row, left and right end of runs of bits."""
    step, rows, _ = _canvas(width, height)
    y, x0 = np.divmod(begin, step)
    return [y // rows, y % rows - REACH, x0 - REACH, x0 - REACH + end - begin]


def _closed(ys: list[int], lefts: list[int], rights: list[int], width: int, height: int) -> list[tuple[int, int, int]]:
    y, x0, x1 = (np.array(v, np.int64) for v in (ys, lefts, rights))
    runs = _ends(_closed_bits(1, np.zeros(len(y), np.int64), y, x0, x1, width, height))
    return list(zip(*[v.tolist() for v in _placed(*runs, width, height)[1:]]))


def _cleaned(n: int, mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int, height: int) -> list[np.ndarray]:
    """``clean_mask`` of ``n`` masks on canvases of a size: mask, y, x0, x1."""
    step, area = _canvas(width, height)[0], width * height
    bits = _closed_bits(n, mask, y, x0, x1, width, height)
    begin, end = _ends(_bits(_canvas(width, height)[2] * n) & ~bits)
    small = _sizes(begin, end, step) < max(int(area * HOLE_SHARE), HOLE_LEAST)
    fill = np.zeros(len(bits) + 1, np.int8)
    fill[begin[small]], fill[end[small]] = 1, -1
    begin, end = _ends(bits | np.cumsum(fill[:-1], dtype=np.int8).view(np.uint8))
    kept = _sizes(begin, end, step) >= max(int(area * PIECE_SHARE), PIECE_LEAST)
    return _placed(begin[kept], end[kept], width, height)


def _clean_masks(masks: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    n, flat = pc.list_value_length(masks).to_numpy(), masks.flatten()
    runs = [pc.struct_field(flat, c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1")]
    first = np.cumsum(n) - n
    sizes, made = np.column_stack([width.to_numpy(), height.to_numpy()]), []
    for w, h in np.unique(sizes, axis=0).tolist():
        mine = np.flatnonzero((sizes == (w, h)).all(axis=1))
        step, rows, _ = _canvas(w, h)
        for some in np.split(mine, range(max(BITS_AT_ONCE // (step * rows), 1), len(mine), max(BITS_AT_ONCE // (step * rows), 1))):
            which = np.repeat(np.arange(len(some)), n[some])
            at = np.arange(len(which)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + first[some][which]
            found = _cleaned(len(some), which, *[v[at] for v in runs], w, h)
            made.append([some[found[0]], *found[1:]])
    mask, *columns = (np.concatenate(c) for c in zip(*made)) if made else [np.empty(0, np.int64)] * 4
    order = np.argsort(mask, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(mask, minlength=len(n)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c[order].astype(np.int32)) for c in columns], ["y", "x0", "x1"]))


def _close_masks(ys: pd.Series, lefts: pd.Series, rights: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    made = [_closed(y.tolist(), a.tolist(), b.tolist(), int(w), int(h)) for y, a, b, w, h in zip(ys, lefts, rights, width, height)]
    return pd.DataFrame([tuple([run[i] for run in runs] for i in range(3)) for runs in made], columns=["y", "x0", "x1"])


def close_gaps(runs: DataFrame, canvas: DataFrame, keys: Sequence[str], at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """Closing with the disk of radius 5: dilation, then erosion as the dilation of the outside.

    A mask of at most ``at_once`` runs on a canvas of at most ``PIXELS_AT_ONCE`` is closed as one row, a larger one run by run.
    """
    runs = materialise(runs.select(*_row(keys), "x0", "x1").filter("y IS NOT NULL AND x1 > x0"))
    sizes = runs.groupBy(*keys).agg(F.count("*").alias("_n"))
    mine = canvas.select(*keys, "canvas_w", "canvas_h").distinct()
    big = (F.col("_n") > at_once) | (F.col("canvas_w").cast("long") * F.col("canvas_h") > PIXELS_AT_ONCE)
    large = materialise(mine.join(sizes, list(keys)).filter(big).select(*mine.columns))
    crowded = not large.isEmpty()
    few = runs.join(large, list(keys), "left_anti") if crowded else runs
    masks = few.groupBy(*keys).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("_m")).join(mine.filter("canvas_w > 0 AND canvas_h > 0"), list(keys))
    closing = F.pandas_udf(_close_masks, "y array<int>, x0 array<int>, x1 array<int>")
    closed = masks.withColumn("_c", closing("_m.y", "_m.x0", "_m.x1", "canvas_w", "canvas_h"))
    out = closed.select(*keys, F.inline(F.arrays_zip(F.col("_c.y").alias("y"), F.col("_c.x0").alias("x0"), F.col("_c.x1").alias("x1"))).alias("y", "x0", "x1"))
    return out.unionByName(_close_runs(runs.join(large, list(keys), "left_semi"), large, keys)) if crowded else out


def _close_runs(runs: DataFrame, canvas: DataFrame, keys: Sequence[str]) -> DataFrame:
    sized = runs.join(canvas, list(keys))
    reach = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in DISK.items()])
    grown = mask_union(_spread(sized, keys, reach, F.col("canvas_w"), F.col("canvas_h")), keys)
    outside = complement(grown, canvas, keys).join(canvas, list(keys))
    eaten = mask_union(_spread(outside, keys, reach, F.col("canvas_w"), F.col("canvas_h")), keys)
    return complement(eaten, canvas, keys)


def _pieces(runs: DataFrame, keys: Sequence[str], at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """Runs with the area of their 4-connected piece."""
    return _labelled(runs.dropna(subset=list(keys)), keys, False, at_once)


def clean_mask(runs: DataFrame, canvas: DataFrame, keys: Sequence[str], at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """Closing, filling of small holes, then removal of small pieces (thresholds grow with the canvas).

    A mask of at most ``at_once`` runs on one canvas of at most ``PIXELS_AT_ONCE`` goes through all steps as one row; others go
    step by step.
    """
    runs = materialise(runs)
    there = runs.select(*_row(keys), "x0", "x1").filter("y IS NOT NULL AND x1 > x0")
    sizes = there.groupBy(*keys).agg(F.count("*").alias("_n"))
    mine = canvas.groupBy(*keys).agg(F.count("*").alias("_c"), F.max("canvas_w").alias("canvas_w"), F.max("canvas_h").alias("canvas_h"))
    fits = (F.col("_c") == 1) & (F.col("canvas_w") > 0) & (F.col("canvas_h") > 0) & (F.col("canvas_w").cast("long") * F.col("canvas_h") <= PIXELS_AT_ONCE)
    apart = materialise(mine.join(sizes, list(keys)).filter(~F.coalesce(fits & (F.col("_n") <= at_once), F.lit(False))).select(*keys))
    crowded = not apart.isEmpty()
    few = there.join(apart, list(keys), "left_anti") if crowded else there
    masks = few.groupBy(*keys).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("_m")).join(mine.drop("_c"), list(keys))
    clean = F.arrow_udf(_clean_masks, "array<struct<y:int,x0:int,x1:int>>")
    out = masks.select(*keys, F.inline(clean("_m", "canvas_w", "canvas_h")))
    if not crowded:
        return out
    return out.unionByName(_clean_runs(runs.join(apart, list(keys), "left_semi"), canvas.join(apart, list(keys), "left_semi"), keys, at_once))


def _clean_runs(runs: DataFrame, canvas: DataFrame, keys: Sequence[str], at_once: int) -> DataFrame:
    closed = materialise(close_gaps(runs, canvas, keys, at_once))
    area = F.col("canvas_w").cast("long") * F.col("canvas_h")
    mine = canvas.join(runs.select(*keys).distinct(), list(keys), "left_semi")
    holes = _pieces(complement(closed, mine, keys), keys, at_once).join(canvas, list(keys))
    small = holes.filter(F.col("_size") < F.greatest((area * HOLE_SHARE).cast("long"), F.lit(HOLE_LEAST)))
    filled = mask_union(closed.select(*_row(keys), "x0", "x1").unionByName(small.select(*_row(keys), "x0", "x1")), keys)
    kept = _pieces(filled, keys, at_once).join(canvas, list(keys)).filter(F.col("_size") >= F.greatest((area * PIECE_SHARE).cast("long"), F.lit(PIECE_LEAST)))
    return kept.select(*_row(keys), "x0", "x1")


# --- generated masks ---------------------------------------------------------------------------------------------

def letterbox_runs(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars around the projected picture: placed has tgt_w, tgt_h, proj_w, proj_h, off_x, off_y."""
    rows = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("tgt_h") - 1)))
    bar = (F.col("off_y") > 0) & ((F.col("y") < F.col("off_y")) | (F.col("y") >= F.col("off_y") + F.col("proj_h")))
    right = F.col("off_x") + F.col("proj_w")
    def run(a, b):
        return F.struct(a.alias("x0"), b.alias("x1"))
    spans = F.when(bar, F.array(run(F.lit(0), F.col("tgt_w")))).when(F.col("off_x") > 0, F.array(run(F.lit(0), F.col("off_x")), run(right, F.col("tgt_w"))))
    return rows.select(*keys, "y", F.explode(spans).alias("_s")).select(*keys, "y", "_s.x0", "_s.x1").filter("x1 > x0")


def polygon_runs(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hard-edged even-odd fill at pixel centres; fewer than three points give nothing.

    ``polygons``: keys, polygon (array of [x, y]), canvas_w, canvas_h.  Each edge is crossed with the rows it spans, and
    the crossings of a row are paired in order.
    """
    p = F.col("polygon")
    pairs = F.zip_with(p, F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1)), lambda a, b: F.struct(
        a[0].cast("double").alias("ax"), a[1].cast("double").alias("ay"), b[0].cast("double").alias("bx"), b[1].cast("double").alias("by")))
    e = polygons.filter(F.size("polygon") >= 3).select(*keys, "canvas_w", "canvas_h", F.explode(pairs).alias("e")).select(*keys, "canvas_w", "canvas_h", "e.*").filter("ay <> by")
    lo, hi = F.ceil(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5) - 1
    first, last = F.greatest(F.lit(0), lo).cast("int"), F.least(F.col("canvas_h") - 1, hi).cast("int")
    rows = e.filter(last >= first).withColumn("y", F.explode(F.sequence(first, last)))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    w = Window.partitionBy(*_row(keys)).orderBy("_x")
    crossed = rows.withColumn("_x", at).withColumns({"_n": F.row_number().over(w), "_next": F.lead("_x").over(w)})
    x0, x1 = F.ceil(F.col("_x") - 0.5), F.ceil(F.col("_next") - 0.5)
    spans = crossed.filter("_n % 2 = 1 AND _next IS NOT NULL").select(
        *_row(keys), F.greatest(F.lit(0), x0).cast("int").alias("x0"), F.least(F.col("canvas_w"), x1).cast("int").alias("x1"))
    return mask_union(spans, keys)


# --- checks ------------------------------------------------------------------------------------------------------

def alpha_leak(alpha: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels where alpha and mask differ, per key, and the code when there are any."""
    diff = mask_union(_sweep([alpha, mask], keys).filter("(c0 > 0) <> (c1 > 0)"), keys)
    return mask_area(diff, keys).withColumnRenamed("area", "diff_px").withColumn("code", F.lit("POLYGON_ALPHA_LEAK"))


def validate_masks(removal: DataFrame, restore: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SIZE_MISMATCH, REMOVAL_MASK_EMPTY or MASK_OVERLAP with the number of shared pixels, the first that applies.

    ``sizes``: keys, declared_w, declared_h, removal_w, removal_h, restore_w, restore_h.
    """
    both = mask_area(mask_and(removal, restore, keys), keys).withColumnRenamed("area", "shared_px")
    j = sizes.join(mask_area(removal, keys), list(keys), "left").join(both, list(keys), "left")
    bad = F.lit(False)
    for side in ("removal", "restore"):
        bad = bad | (F.col(f"{side}_w") != F.col("declared_w")) | (F.col(f"{side}_h") != F.col("declared_h"))
    shared = F.coalesce("shared_px", F.lit(0).cast("long"))
    code = F.when(bad, "SIZE_MISMATCH").when(F.coalesce("area", F.lit(0)) == 0, "REMOVAL_MASK_EMPTY").when(shared > 0, "MASK_OVERLAP")
    return j.select(*keys, code.alias("code"), F.when(code == "MASK_OVERLAP", shared).alias("shared_px"))


# --- profiles ----------------------------------------------------------------------------------------------------

def scan_bottom(profile: DataFrame, keys: Sequence[str], dark_rows: int = 5, bright: int = 30, most: int = 300) -> DataFrame:
    """New bottom edge: the last bright row before the first run of ``dark_rows`` dark rows under the current bottom.

    ``profile``: keys, y, row_max, bottom, image_h, from the current bottom on; at most ``most`` rows per key count, which
    bounds the window.
    """
    rows = profile.filter((F.col("y") >= F.col("bottom")) & (F.col("y") < F.least(F.col("image_h"), F.col("bottom") + most)))
    lit = F.col("row_max") > bright
    w = Window.partitionBy(*keys).orderBy("y")
    since = rows.withColumn("_last", F.coalesce(F.max(F.when(lit, F.col("y"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("bottom") - 1))
    stop = since.filter(F.col("y") - F.col("_last") >= dark_rows).groupBy(*keys).agg(F.min("y").alias("_stop"))
    kept = since.join(stop, list(keys), "left").filter(F.col("_stop").isNull() | (F.col("y") < F.col("_stop")))
    found = kept.groupBy(*keys).agg(F.max(F.when(F.col("row_max") > bright, F.col("y"))).alias("_b"))
    base = profile.groupBy(*keys).agg(F.max("bottom").alias("bottom"), F.max("image_h").alias("image_h"))
    return base.join(found, list(keys), "left").select(*keys, F.when(F.col("_b").isNotNull(), F.least(F.col("_b") + 1, F.col("image_h"))).otherwise(F.col("bottom")).alias("bottom"))


def edge_sharpness(hist: DataFrame, keys: Sequence[str], floor: int = 30, expected: float = 200.0, least: int = 10) -> DataFrame:
    """Boundary metric from an edge histogram (keys, value, n)."""
    strong = F.col("value") > floor
    agg = hist.groupBy(*keys).agg(
        F.sum(F.when(strong, F.col("n")).otherwise(0)).alias("edge_px"), F.sum(F.when(strong, F.col("n") * F.col("value")).otherwise(0)).alias("_s"),
        F.sum(F.when(strong & (F.col("value") < 100), F.col("n")).otherwise(0)).alias("_low"))
    ok = F.col("edge_px") >= least
    mean = F.try_divide("_s", "edge_px")
    return agg.select(*keys, "edge_px", F.when(ok, mean).otherwise(0.0).alias("gradient"), F.when(ok, F.least(mean / expected, F.lit(1.0))).otherwise(0.0).alias("sharpness"),
                      F.when(ok, F.try_divide("_low", "edge_px")).otherwise(1.0).alias("low_contrast"), F.coalesce(ok & (mean / expected > 1.0), F.lit(False)).alias("clamped"))


def trim_by_profile(edges: DataFrame, keys: Sequence[str], share: float = 0.05, pad: int = 3, least: int = 10) -> DataFrame:
    """Crop window around rows, then columns, with more than ``share`` of the greatest edge count; the whole picture when
    there is nothing to trim or too little would be left.

    ``edges``: keys, x, y of edge pixels, w, h.
    """
    def span(df: DataFrame, axis: str) -> DataFrame:
        counts = df.groupBy(*keys, axis).agg(F.count("*").alias("_n"))
        peak = counts.groupBy(*keys).agg(F.max("_n").alias("_peak"))
        dense = counts.join(peak, list(keys)).filter(F.col("_n") > F.col("_peak") * share)
        return dense.groupBy(*keys).agg(F.min(axis).alias(f"{axis}1"), F.max(axis).alias(f"{axis}2"))
    size = edges.groupBy(*keys).agg(F.max("w").alias("w"), F.max("h").alias("h"))
    rows = span(edges, "y")
    inner = edges.join(rows, list(keys)).filter((F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y2")))
    j = size.join(rows, list(keys)).join(span(inner, "x"), list(keys))
    fx1, fy1 = F.greatest(F.lit(0), F.col("x1") - pad), F.greatest(F.lit(0), F.col("y1") - pad)
    fx2, fy2 = F.least(F.col("w"), F.col("x2") + 1 + pad), F.least(F.col("h"), F.col("y2") + 1 + pad)
    keep = (F.col("w") <= least) | (F.col("h") <= least) | (fx2 - fx1 < least) | (fy2 - fy1 < least)
    return j.select(*keys, F.when(keep, 0).otherwise(fx1).alias("cx1"), F.when(keep, 0).otherwise(fy1).alias("cy1"),
                    F.when(keep, F.col("w")).otherwise(fx2).alias("cx2"), F.when(keep, F.col("h")).otherwise(fy2).alias("cy2"))


def drop_vertical_lines(pieces: DataFrame) -> DataFrame:
    """Components without thin, tall ones at the left border (x, w, h of the piece and image_h)."""
    return pieces.filter(~((F.col("x") <= 15) & (F.col("h") > F.col("image_h") * 0.25) & (F.col("w") <= 20)))
