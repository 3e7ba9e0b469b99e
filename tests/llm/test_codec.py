"""Codec, placed rows and components against plain Python."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlattice.llm import codec
from adlattice.llm.graph import components
from adlattice.llm.rows import keep, place


@pytest.mark.parametrize("top", [1, 7, 1 << 20, (1 << 63) - 1, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_sorted_integers_come_back(top, n):
    rng = random.Random(n)
    values = np.array(sorted(rng.randint(0, top) for _ in range(n)), dtype=np.uint64)
    assert (codec.decode(codec.encode(values), n) == values).all()


@pytest.mark.parametrize("width", [0, 1, 7, 8, 13, 41, 63, 64])
def test_packing(width):
    values = np.array([random.Random(width).getrandbits(64) for _ in range(77)], dtype=np.uint64) & np.uint64((1 << width) - 1)
    data = codec.pack(values, width)
    assert len(data) == codec.packed_size(77, width) and (codec.unpack(data, 77, width) == values).all()


def test_code_is_near_the_entropy():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 20_000, dtype=np.uint64))
    assert len(codec.encode(values)) * 8 / len(values) < 48 - np.log2(len(values)) + 3


def test_keep_by_place(spark):
    table = place(spark.range(0, 1000, 1, 7).withColumn("part", F.lit("clash")))
    hit = table.where(F.col("row.id") % 3 == 0)
    assert {r["id"] for r in keep(table, hit).select("row.*").collect()} == set(range(0, 1000, 3))
    assert {r["id"] for r in keep(table, hit, marked=False).select("row.*").collect()} == {i for i in range(1000) if i % 3}
    assert keep(table, table.where("false"), marked=False).count() == 1000


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
