"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's target is its weight's share of the wanted total, but at most ``epochs`` times its size; what a clamped source
cannot use is shared again by weight.  With sources ordered by cap / weight the fixed point is closed: the first sources are
clamped, the others get ``level * weight``.  One row per source is all this looks at.

A target is then sampled as whole repetitions of every document plus a fractional one: documents in seeded hash order up to
the prefix whose words come nearest to the rest.  The prefix ends in one of 65,536 hash buckets per source, and only that
bucket's documents are ordered one by one, so no source, however large, is sorted whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlattice.session import materialise

BUCKET_BITS = 16
HASH_BITS = 52


def words(text: str) -> Column:
    """Number of words of ``text``; null counts as empty."""
    flat = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, epochs: float) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``target``.

    Weights repeat over the sources in code point order, null last.  ``factor`` times all sizes is shared.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = (w.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(factor)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
          .withColumn("share", F.col("left") / F.col("open")))
    # the level is the first share, in filling order, that its own source can take
    level = F.min_by(F.when(F.col("share") * F.col("weight") < F.col("cap"), F.col("share")),
                     F.when(F.col("share") * F.col("weight") < F.col("cap"), F.col("cap") / F.col("weight"))).over(everything)
    return (w.withColumn("level", level)
             .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")))


def seeded(key: Column, seed: str) -> Column:
    """A draw of 52 bits from seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def plan(narrow: DataFrame, weights, factor, epochs) -> DataFrame:
    """One row per source of ``narrow`` (key, source, size, draw): of, source_size, target, whole, last, takes; written, so its size is known."""
    narrow = narrow.withColumn("bucket", F.shiftright("draw", HASH_BITS - BUCKET_BITS))
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    shares = targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    shares = shares.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = buckets.withColumn("before", F.coalesce(F.sum("size").over(by_bucket), F.lit(0)))
    edge = (filled.join(shares.select("source", "rest"), filled["source"].eqNullSafe(shares["source"])).select(filled["source"], "bucket", "size", "before", "rest")
            .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))))
    inside = (narrow.join(edge.select(F.col("source").alias("es"), F.col("bucket").alias("eb"), "before", "rest"),
                          F.col("source").eqNullSafe(F.col("es")) & (F.col("bucket") == F.col("eb")))
              .groupBy("source", "draw", "key").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest")))
    by_draw = Window.partitionBy("source").orderBy("draw", F.col("key").asc_nulls_last())
    run = inside.withColumn("upto", F.col("before") + F.sum("size").over(by_draw.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("earlier", F.col("upto") - F.col("size"))
    # the document that crosses the rest is in if that brings the sum nearer to it
    crossing = run.where((F.col("earlier") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    crossing = (crossing.withColumn("place", F.struct("draw", F.col("key").isNull().alias("none"), "key"))
                .groupBy("source").agg(F.min("place").alias("last"), F.min_by(F.col("upto") - F.col("rest") <= F.col("rest") - F.col("earlier"), "place").alias("takes")))
    ends = (shares.join(crossing, same(shares, crossing), "left")
            .select(shares["source"].alias("of"), "source_size", "target", "whole", "last", F.coalesce("takes", F.lit(False)).alias("takes")))
    return materialise(ends)


def times(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` (key, source, draw, ...) with source_size, target and ``times``, how often each is taken.

    One row per source meets the documents: sent to all tasks while Spark finds it small, else in slices of a source.
    """
    slices = 32
    spread = ends.withColumn("part_of", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = rows.withColumn("slice", F.pmod("draw", F.lit(slices)).cast("int"))
    met = met.join(spread, met["source"].eqNullSafe(spread["of"]) & (met["slice"] == spread["part_of"]))
    place = F.struct("draw", F.col("key").isNull().alias("none"), "key")
    extra = F.when(F.col("takes"), place <= F.col("last")).otherwise(place < F.col("last"))
    return met.withColumn("times", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("bigint"))


def sized(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    return materialise(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size"), seeded(F.col(key), seed).alias("draw")))


def mix(docs: DataFrame, key="doc_id", text="text", source="source", weights=(3, 1, 2), factor=1.5, epochs=2.0, seed="mix") -> DataFrame:
    """One row per document: ``key``, size, source_size, target, taken (words, repeats counted).

    Null texts have size 0, a null source is a source of its own (last in order), null keys draw like an empty one and come
    last among equal draws, repeated rows share their draw and so their fate.  An empty table gives no rows; if all texts are
    empty, all targets are 0.  Reruns agree: the draw is a hash of seed and key.
    """
    narrow = sized(docs, key, text, source, seed)
    out = times(narrow, plan(narrow, weights, factor, epochs))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, key="doc_id", text="text", source="source", weights=(3, 1, 2), factor=1.5, epochs=2.0, seed="mix") -> DataFrame:
    """The mix itself: each document's row as often as it is taken, all columns kept."""
    ends = plan(sized(docs, key, text, source, seed), weights, factor, epochs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), seeded(F.col(key), seed).alias("draw"))
    return times(rows, ends).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS open FROM w
      WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(room / open, cap / weight) AS level FROM f WHERE room / open * weight < cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM w LEFT JOIN l ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, doc_id, draw, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
c AS (SELECT g.source, g.doc_id, draw, g.size, target - whole * source_size AS rest,
             sum(g.size) OVER (PARTITION BY g.source ORDER BY draw, g.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
x AS (SELECT source, doc_id, draw, (upto <= rest OR (upto - size < rest AND upto - rest <= rest - (upto - size))) AND upto - size < rest AS extra FROM c)
SELECT d.doc_id, d.size, r.source_size, r.target, d.size * (r.whole + x.extra::BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.draw = x.draw"""
