"""Run algebra against pixel sets."""
import random

from pyspark.sql import functions as F

from adlattice.operators import masks as M

W, H = 40, 24


def rand_runs(seed, n=60):
    r = random.Random(seed)
    return [(k, r.randrange(H), x, min(W, x + r.randrange(1, 9))) for k in ("a", "b") for _ in range(n) for x in [r.randrange(W - 1)]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, y int, x0 int, x1 int")


def px(rows):
    return {(r[0], r[1], x) for r in rows for x in range(r[2], r[3])}


def out(df):
    rows = [tuple(r) for r in df.select("k", "y", "x0", "x1").collect()]
    by = {}
    for k, y, a, b in rows:
        by.setdefault((k, y), []).append((a, b))
    for spans in by.values():
        spans.sort()
        assert all(p[1] < q[0] for p, q in zip(spans, spans[1:])), "runs must be disjoint and apart"
    return px(rows)


def canvas(spark):
    return spark.createDataFrame([("a", W, H), ("b", W, H)], "k string, canvas_w int, canvas_h int")


def test_algebra(spark):
    ra, rb = rand_runs(1), rand_runs(2)
    a, b = M.mask_union(frame(spark, ra), ["k"]), M.mask_union(frame(spark, rb), ["k"])
    pa, pb = px(ra), px(rb)
    assert out(a) == pa and out(M.mask_and(a, b, ["k"])) == pa & pb and out(M.mask_minus(a, b, ["k"])) == pa - pb
    full = {(k, y, x) for k in "ab" for y in range(H) for x in range(W)}
    c = M.complement(a, canvas(spark), ["k"])
    assert out(c) == full - pa and out(M.mask_and(a, c, ["k"])) == set()
    area = {r.k: r.area for r in M.mask_area(a, ["k"]).collect()}
    assert area == {k: sum(p[0] == k for p in pa) for k in "ab"}


def test_dilate(spark):
    ra = rand_runs(3, 12)
    want = {(k, y + dy, x + dx) for k, y, x in px(ra) for dy in range(-3, 4) for dx in range(-3, 4) if 0 <= y + dy < H and 0 <= x + dx < W}
    assert out(M.dilate(M.mask_union(frame(spark, ra), ["k"]), ["k"], 3, F.lit(W), F.lit(H))) == want


def pieces(pixels, diagonal):
    left, found = set(pixels), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            k, y, x = todo.pop()
            seen.add((k, y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (k, y + dy, x + dx)
                    if n in left and (diagonal or dy == 0 or dx == 0):
                        left.discard(n)
                        todo.append(n)
        found.append(seen)
    return found


def test_fragments_and_long_snake(spark):
    ra = rand_runs(4, 45)
    snake = [("s", y, 0 if y % 4 else 0, 30) if y % 2 == 0 else ("s", y, 29 if y % 4 == 1 else 0, 30 if y % 4 == 1 else 1) for y in range(H)]
    u = M.mask_union(frame(spark, ra + snake), ["k"])
    got = {r.k: r.fragments for r in M.fragments(u, ["k"]).collect()}
    want = {k: len(pieces({p for p in px(ra + snake) if p[0] == k}, True)) for k in ("a", "b", "s")}
    assert got == want and got["s"] == 1


def test_clean_mask(spark):
    """Closing with the disk, holes below the limit filled, pieces below the limit gone."""
    ra = [r for r in rand_runs(5, 40)] + [("a", y, 3, 25) for y in range(4, 16)]
    pa = px(ra)
    disk = [(dy, dx) for dy in range(-5, 6) for dx in range(-5, 6) if dy * dy + dx * dx <= 25]
    grown = {(k, y + dy, x + dx) for k, y, x in pa for dy, dx in disk if 0 <= y + dy < H and 0 <= x + dx < W}
    full = {(k, y, x) for k in "ab" for y in range(H) for x in range(W)}
    outside = full - grown
    closed = full - {(k, y + dy, x + dx) for k, y, x in outside for dy, dx in disk}
    for hole in pieces(full - closed, False):
        if len(hole) < 64:
            closed |= hole
    want = set().union(*[p for p in pieces(closed, False) if len(p) >= 128], set())
    assert out(M.clean_mask(M.mask_union(frame(spark, ra), ["k"]), canvas(spark), ["k"])) == want


def test_polygon(spark):
    tri = spark.createDataFrame([("t", [[0, 0], [10, 0], [0, 10]], 20, 20), ("two", [[0, 0], [5, 5]], 20, 20)], "k string, polygon array<array<int>>, canvas_w int, canvas_h int")
    got = out(M.polygon_runs(tri, ["k"]))
    assert got == {("t", y, x) for y in range(10) for x in range(20) if (x + 0.5) + (y + 0.5) < 10}


def test_empty_masks(spark):
    z = frame(spark, [])
    assert M.mask_union(z, ["k"]).count() == 0 and M.overlap_ratio(z, z, ["k"]).count() == 0


def test_large_and_small_masks_go_the_same_way(spark):
    """Closing, labels and cleaning of a mask taken as one row equal those by joins; runs off the canvas and without a row included."""
    ra = rand_runs(6, 40) + [("a", y, 3, 25) for y in range(4, 16)]
    odd = [("a", -2, 5, 9), ("b", H + 3, -4, 6), ("b", 7, -6, -3), ("a", 9, W + 2, W + 5), (None, 3, 1, 9), ("a", None, 1, 9)]
    u = M.mask_union(frame(spark, ra + odd), ["k"])
    rows = {n: sorted(tuple(r) for r in M.clean_mask(u, canvas(spark), ["k"], at_once=n).select("k", "y", "x0", "x1").collect()) for n in (0, 35, 1000)}
    assert rows[0] == rows[35] == rows[1000] != []
    gaps = {n: sorted(tuple(r) for r in M.close_gaps(u, canvas(spark), ["k"], at_once=n).select("k", "y", "x0", "x1").collect()) for n in (0, 1000)}
    assert gaps[0] == gaps[1000]
    for diagonal in (True, False):
        found = {}
        for n in (0, 1000):
            groups = {}
            for r in M.components(u, ["k"], diagonal, at_once=n).collect():
                groups.setdefault((r.k, r.label), set()).add((r.y, r.x0, r.x1))
            found[n] = sorted(sorted(map(str, g)) for g in groups.values())
        assert found[0] == found[1000]


def test_many_small_masks_are_cleaned_without_rounds(spark):
    """The number of jobs doesn't grow with the pieces: no mask here is large enough for rounds of joins."""
    rows = [(f"m{i}", y, 0, 20) for i in range(50) for y in range(3, 14)] + [(f"m{i}", y, 20, 21) for i in range(50) for y in range(0, 24, 2)]
    sizes = spark.createDataFrame([(f"m{i}", W, H) for i in range(50)], "k string, canvas_w int, canvas_h int")
    tracker, ids = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("clean", "clean")
    try:
        got = M.clean_mask(M.mask_union(frame(spark, rows), ["k"]), sizes, ["k"])
        assert got.select("k").distinct().count() == 50
        ids = tracker.getJobIdsForGroup("clean")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(ids) < 60


def test_small_masks_are_cleaned_as_one_row(spark, monkeypatch):
    """All steps of small masks in one batch give what the steps one by one give; a mask on two canvases or on none of any size goes by these."""
    import random
    r = random.Random(12)
    size = {k: (r.randrange(20, 120), r.randrange(12, 40)) for k in range(12)}
    rows = [(k, r.randrange(-6, h + 6), x := r.randrange(-9, w), x + r.randrange(1, 30)) for k, (w, h) in size.items() for _ in range(r.randrange(1, 150))] + [(20, 1, 0, 9), (None, 1, 0, 9), (0, None, 0, 9)]
    runs = M.mask_union(spark.createDataFrame(rows, "k int, y int, x0 int, x1 int"), ["k"])
    canvas = spark.createDataFrame([(k, *s) for k, s in size.items()] + [(11, 70, 30), (20, None, 5), (21, 9, 9)], "k int, canvas_w int, canvas_h int")
    out = lambda df: sorted(map(tuple, df.select("k", "y", "x0", "x1").collect()))
    alone = canvas.filter("k < 11")
    want = out(M._clean_runs(runs.filter("k < 11"), alone, ["k"], 1000))
    written, materialise = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df: written.append(df) or materialise(df))
    assert out(M.clean_mask(runs.filter("k < 11"), alone, ["k"])) == want and len(written) == 2 and len(want) > 100
    assert out(M.clean_mask(runs, canvas, ["k"], at_once=60)) == out(M._clean_runs(runs, canvas, ["k"], 60))
