"""Group-wise operators that never hold a whole group in one task.

A job, image or slug may own a third of all rows.  ``Window.partitionBy(key)`` would send that third
to a single task, so ordered work over such keys runs here in two levels:

1. a window over ``(key, chunk)``, where a chunk is a slice of the group's integer order column;
2. one summary row per ``(key, chunk)``, carried over the chunks of a key and joined back.

Level 2 handles 1/``width`` of the rows.  Results are exact whatever the partitioning.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 4096


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], desc_last: bool = False) -> DataFrame:
    """One row per key, the least by ``order`` (or greatest): an aggregate, so combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = (F.max_by if desc_last else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in rest]), rank)
    return (df.groupBy(*keys).agg(pick.alias("__row"))
              .select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, slices: int = 16) -> DataFrame:
    """The first ``n`` rows of every key by ``order``, which must be total; ``spread`` names a column that tells rows apart.

    Ranks are taken in slices of a key first, so a key with a third of all rows is not sorted in one task: the second ranking
    sees at most ``slices`` * ``n`` rows of a key.
    """
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
    first = Window.partitionBy(*keys, "__slice").orderBy(*order)
    few = sliced.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= n).drop("__rank", "__slice")
    return few.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def _chunked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(order) / F.lit(width)))


def _join_chunks(rows: DataFrame, carried: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """Summary rows back to their chunk.  Plain equality keeps the rows where the window has put them; the null-safe
    form moves them once more and is only for keys that may be null."""
    def same(k: str) -> Column:
        a, b = rows[k], carried[f"__k_{k}"]
        return a.eqNullSafe(b) if null_safe else a == b
    on = [same(k) for k in keys] + [rows["__chunk"] == carried["__kc"]]
    return rows.join(carried, on, "left").drop("__chunk", "__kc", *[f"__k_{k}" for k in keys])


def _rename(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        summary = summary.withColumnRenamed(k, f"__k_{k}")
    return summary.withColumnRenamed("__chunk", "__kc")


def number_rows(df: DataFrame, keys: Sequence[str], order: str, out: str, ties: Sequence[str] = (),
                width: int = WIDTH) -> DataFrame:
    """Exact ``row_number()`` over non-null ``keys`` by the integer column ``order`` (then ``ties``), from 1."""
    rows = _chunked(df, order, width)
    local = Window.partitionBy(*keys, "__chunk").orderBy(order, *ties)
    rows = rows.withColumn("__local", F.row_number().over(local))
    sizes = _chunked(df.select(*keys, order), order, width).groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return (_join_chunks(rows, _rename(offsets, keys), keys, False)
            .withColumn(out, F.col("__local") + F.col("__before")).drop("__local", "__before"))


def previous_row(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], out: str,
                 width: int = WIDTH, null_safe: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """``lag(struct(cols))`` over ``keys`` by ``order`` (then ``ties``); null on the first row of a key.

    ``width`` is the span of one slice in the units of ``order``: for a time in microseconds, say, an hour of them.
    """
    rows = _chunked(df, order, width)
    image = F.struct(*cols)
    rows = rows.withColumn("__lag", F.lag(image).over(Window.partitionBy(*keys, "__chunk").orderBy(order, *ties)))
    tails = (_chunked(df.select(*dict.fromkeys([*keys, order, *ties, *cols])), order, width)
             .groupBy(*keys, "__chunk").agg(F.max_by(image, F.struct(order, *ties)).alias("__tail")))
    carried = tails.withColumn("__prev", F.lag("__tail").over(Window.partitionBy(*keys).orderBy("__chunk"))).drop("__tail")
    return (_join_chunks(rows, _rename(carried, keys), keys, null_safe)
            .withColumn(out, F.coalesce("__lag", "__prev")).drop("__lag", "__prev"))


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
                include_current: bool = False, width: int = WIDTH) -> DataFrame:
    """Greatest ``value`` among the earlier rows of the key (and this one, if asked), null when none."""
    end = 0 if include_current else -1
    rows = _chunked(df.withColumn("__v", value), order, width)
    local = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    rows = rows.withColumn("__local", F.max("__v").over(local))
    peaks = (_chunked(df.select(*keys, order, value.alias("__v")), order, width)
             .groupBy(*keys, "__chunk").agg(F.max("__v").alias("__peak")))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = peaks.withColumn("__before", F.max("__peak").over(before)).drop("__peak")
    return (_join_chunks(rows, _rename(carried, keys), keys, False)
            .withColumn(out, F.greatest("__local", "__before")).drop("__v", "__local", "__before"))


STEP = 4  # how much wider the cells of the next level are


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int = 256,
                  self_order: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of boxes of one key which overlap, without pairing a whole key.

    ``left`` needs ``lx1, ly1, lx2, ly2`` and ``right`` needs ``rx1, ry1, rx2, ry2`` (exclusive ends) besides the
    keys.  A box lives on the level whose cells are at least as wide as its longer side, so it covers at most four, whatever
    its size; cells of level 0 are ``cell`` wide, each next level's are ``STEP`` times as wide.  Two boxes meet on the higher of
    their levels: a box also visits those levels above its own on which the other side has boxes of its key.  The equi-join key
    is ``(keys, level, cell)``; a pair is reported only in the cell of its intersection's upper left corner, hence once.
    """
    def levelled(df: DataFrame, p: str) -> DataFrame:
        side = F.greatest(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"))
        level = F.when(side <= cell, 0).otherwise(F.ceil(F.log(float(STEP), side / cell) - 1e-9)).cast("int")
        return df.filter((F.col(f"{p}x2") > F.col(f"{p}x1")) & (F.col(f"{p}y2") > F.col(f"{p}y1"))).withColumn("__own", level)

    def cells(df: DataFrame, p: str, level: str) -> DataFrame:
        wide = F.lit(float(cell)) * F.pow(F.lit(float(STEP)), F.col(level))

        def span(lo: str, hi: str) -> Column:
            return F.sequence(F.floor(F.col(lo) / wide), F.floor((F.col(hi) - 1) / wide))
        return (df.withColumn("__level", F.col(level)).withColumn("__wide", wide).withColumn("__cx", F.explode(span(f"{p}x1", f"{p}x2")))
                  .withColumn("__cy", F.explode(span(f"{p}y1", f"{p}y2"))).drop("__own", *({level} - {"__own"})))

    def visits(df: DataFrame, p: str, hosts: DataFrame) -> DataFrame:
        there = hosts.filter("__own > 0").select(*keys, F.col("__own").alias("__up")).distinct()
        return cells(df.join(there, list(keys)).filter(F.col("__up") > F.col("__own")), p, "__up")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b.drop("__wide"), [*keys, "__level", "__cx", "__cy"])
        corner_x, corner_y = F.greatest("lx1", "rx1"), F.greatest("ly1", "ry1")
        return pairs.filter(
            (F.least("lx2", "rx2") > corner_x) & (F.least("ly2", "ry2") > corner_y)
            & (F.floor(corner_x / F.col("__wide")) == F.col("__cx")) & (F.floor(corner_y / F.col("__wide")) == F.col("__cy")))
    lefts, rights = levelled(left, "l"), levelled(right, "r")
    at_home, hosts = cells(lefts, "l", "__own"), cells(rights, "r", "__own")
    pairs = met(at_home.unionByName(visits(lefts, "l", rights)), hosts).unionByName(met(at_home, visits(rights, "r", lefts)))
    if self_order:
        pairs = pairs.filter(F.col(self_order[0]) < F.col(self_order[1]))
    return pairs.drop("__level", "__wide", "__cx", "__cy")
