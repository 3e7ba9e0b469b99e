"""Rows of a table with a stable place, so that decisions find their row without moving texts.

A row's place is (``part``, ``pos``): the task that wrote it and its number there.  The table is bucketed by ``part``,
so grouping or joining by ``part`` reads whole files and shuffles only the other side.
"""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adlattice.session import scratch

SPACE = " \t\n\x0b\f\r"


def place(df: DataFrame, **more: Column) -> DataFrame:
    """``row`` (all columns of ``df``, whatever their names), ``part``, ``pos`` and ``more``, written to the shared folder.

    ``more`` are expressions over ``df``.  The bucket count is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    cells = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    at = F.monotonically_increasing_id()
    out = df.select(cells.alias("row"), *[c.alias(n) for n, c in more.items()], at.alias("at"))
    out = out.withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("pos", F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")
    name = f"llm_rows_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out.write.format("parquet").option("path", scratch(spark, "llm-rows", name)).bucketBy(buckets, "part").saveAsTable(name)
    return spark.table(name)


def bitmaps(places: DataFrame) -> DataFrame:
    """One row per ``part``: ``words``, an array of longs whose bit ``pos`` is set for each of the places."""
    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "words": [bit_words(pdf["pos"].to_numpy())]})
    return places.select("part", "pos").groupBy("part").applyInPandas(fold, "part int, words array<bigint>")


def bit_words(positions: np.ndarray) -> np.ndarray:
    size = (int(positions.max()) // 64 + 1) * 64 if len(positions) else 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def is_set(words: str, pos: str) -> Column:
    """Whether ``words`` (null: none) has bit ``pos``."""
    bit = f"shiftrightunsigned(get({words}, cast(shiftright({pos}, 6) as int)), cast({pos} % 64 as int)) & 1"
    return F.coalesce(F.expr(f"({bit}) = 1"), F.lit(False))


def keep(table: DataFrame, places: DataFrame, marked: bool = True) -> DataFrame:
    """The rows of a placed table whose place is among ``places`` (or is not, with ``marked=False``)."""
    out = table.join(bitmaps(places), "part", "inner" if marked else "left")
    hit = is_set("words", "pos")
    return out.where(hit if marked else ~hit).drop("words")


def stripped(text: str | Column) -> Column:
    """``text`` (null: empty) without ASCII white space."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out
