"""Layout geometry, greedy placement against a plain loop, and the blocked path for large groups."""
import random

import pytest
from pyspark.sql import functions as F

from adlattice.functions import geometry as G
from adlattice.operators import layout as LO, layers as LY
from adlattice import vocab


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_contain_keeps_ratio_and_centres(spark):
    r = one(spark, G.contain(F.lit(200), F.lit(150), F.lit(300), F.lit(200)).alias("t")).t
    assert (r.proj_w, r.proj_h, r.off_x, r.off_y) == (267, 200, 16, 0)


def test_first_violation_order(spark):
    rows = [("j", 1, True, 10, 10, 80, 60), ("j", 2, True, 250, 80, 100, 30), ("j", 3, True, 0, 0, 5, 5)]
    d = spark.createDataFrame(rows, "job string, ord int, required boolean, px int, py int, pw int, ph int").selectExpr(
        "*", "300 AS tgt_w", "200 AS tgt_h", "15 AS safe_top", "20 AS safe_right", "15 AS safe_bottom", "20 AS safe_left")
    r = LO.first_violation(d, ["job"]).first()
    assert (r.first_code, r.first_ord, r.faults) == ("SAFE_ZONE_VIOLATION", 1, 3)
    r = LO.first_violation(d.filter("ord > 1"), ["job"]).first()
    assert r.first_code == "CANVAS_OVERFLOW"


def greedy(cands):
    order = sorted(cands, key=lambda c: (not c["required"], vocab.ROLE_PRIORITY.get(c["role"], 99), c["object_id"], c["cand"]))
    placed = []
    for c in order:
        if any(p["object_id"] == c["object_id"] for p in placed):
            continue
        def clash(p):
            dx = min(c["cx"] + c["cw"], p["cx"] + p["cw"]) - max(c["cx"], p["cx"])
            dy = min(c["cy"] + c["ch"], p["cy"] + p["ch"]) - max(c["cy"], p["cy"])
            return dx > 0 and dy > 0 and dx * dy / min(c["cw"] * c["ch"], p["cw"] * p["ch"]) > 0.30
        if not any(map(clash, placed)):
            placed.append(c)
    return {(c["object_id"], c["cand"]) for c in placed}


def make(seed, n):
    r = random.Random(seed)
    roles = [*vocab.ROLE_PRIORITY, "other"]
    out = []
    for o in range(n):
        role, req = r.choice(roles), r.random() < 0.5
        for c in range(4):
            out.append(dict(g=f"g{seed}", object_id=f"o{o:03d}", role=role, required=req, cand=c, cx=r.randrange(500), cy=r.randrange(400),
                            cw=r.randrange(5, 120), ch=r.randrange(5, 120), anchor="a", cand_scale=1.0))
    return out


SCHEMA = "g string, object_id string, role string, required boolean, cand int, cx int, cy int, cw int, ch int, anchor string, cand_scale double"


def test_place_equals_plain_loop_in_one_block_and_in_many(spark):
    groups = {f"g{s}": make(s, n) for s, n in ((1, 6), (2, 25), (5, 1250))}
    df = spark.createDataFrame([c for g in groups.values() for c in g], SCHEMA)
    want = {(g, *x) for g, c in groups.items() for x in greedy(c)}
    for block in (5000, LO.BLOCK, 17):
        got = {(r.g, r.object_id, r.cand) for r in LO.place(df, ["g"], block=block).collect()}
        assert got == want


@pytest.mark.parametrize("at_once", [LO.PROTECTED_AT_ONCE, 4], ids=["arrays", "grid"])
def test_static_filter_equals_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(LO, "PROTECTED_AT_ONCE", at_once)
    df = spark.createDataFrame(make(3, 20), SCHEMA).selectExpr("*", "600 AS canvas_w", "500 AS canvas_h", "0 AS zone_left", "0 AS zone_top", "600 AS zone_right", "500 AS zone_bottom")
    r = random.Random(8)
    prot = spark.createDataFrame([("g3", r.randrange(500), r.randrange(400), r.randrange(5, 90), r.randrange(5, 90)) for _ in range(12)], "g string, qx int, qy int, qw int, qh int")
    got = {(x.object_id, x.cand) for x in LO.valid_static(df, prot, ["g"]).collect()}

    def covered(c, q):
        dx, dy = min(c.cx + c.cw, q.qx + q.qw) - max(c.cx, q.qx), min(c.cy + c.ch, q.qy + q.qh) - max(c.cy, q.qy)
        return dx > 0 and dy > 0 and dx * dy / (q.qw * q.qh) > 0.30
    boxes = prot.collect()
    want = {(c.object_id, c.cand) for c in df.collect() if c.cx + c.cw <= 600 and c.cy + c.ch <= 500 and not any(covered(c, q) for q in boxes)}
    assert got == want and 0 < len(want) < 80


def test_layouts_know_their_outcome(spark):
    """One fold per key gives what placing and judging give in two steps, for small groups and, with tiny blocks, for large ones."""
    rows = [c for s, n in ((1, 6), (2, 25), (3, 60)) for c in make(s, n)]
    objects = LO.gathered(spark.createDataFrame(rows, SCHEMA), ["g"])
    bare = objects.limit(1).selectExpr("'g1' AS g", "'logo' AS role", "'none' AS object_id", "true AS required", "slice(cands, 1, 0) AS cands")
    objects = objects.unionByName(bare)
    placed = LO.place(objects, ["g"])
    want = {r.g: (r.code, r.unmet, r.placed) for r in LO.placement_outcome(objects, placed, ["g"]).collect()}
    for block in (LO.BLOCK, 7):
        got = LO.layouts(objects, ["g"], block=block)
        assert {r.g: (r.code, r.unmet, r.placed) for r in got.select("g", "code", "unmet", "placed").collect()} == want
        kept = {(r.g, r.object_id, r.cand) for r in got.select("g", F.inline("kept")).collect()}
        assert kept == {(r.g, r.object_id, r.cand) for r in placed.collect()}


def test_no_valid_candidates(spark):
    objects = spark.createDataFrame([("j", "a", True), ("j", "b", False)], "g string, object_id string, required boolean")
    placed = spark.createDataFrame([("j", "b")], "g string, object_id string")
    assert LO.placement_outcome(objects, placed, ["g"]).first().code == "NO_VALID_CANDIDATES"


def test_group_boxes_from_nested_leaves(spark):
    rows = [(1, 1, 0, "g", True, None, None, None, None), (1, 2, 1, "a", False, 10, 10, 20, 20), (1, 3, 1, "h", True, None, None, None, None),
            (1, 4, 2, "b", False, 5, 30, 50, 60), (1, 5, 0, "c", False, 0, 0, 1, 1)]
    d = spark.createDataFrame(rows, "psd_id int, ord int, depth int, name string, is_group boolean, x1 int, y1 int, x2 int, y2 int")
    got = {r.ord: (r.x1, r.y1, r.x2, r.y2) for r in LY.fill_group_bboxes(d).collect()}
    assert got[1] == (5, 10, 50, 60) and got[3] == (5, 30, 50, 60) and got[5] == (0, 0, 1, 1)


def test_candidates_and_their_text_are_computed_once(spark):
    """Anchors of a role and side are literals, places along an axis come by size, and the text reads each candidate once."""
    import contextlib
    import io

    from adlattice.operators import layout as LO
    from adlattice.plans.layout import per_object
    rows = [(1, 1, "o1", "product", 10, 20, 100, 80, 600, 0.5, 7, 3, 293, 197), (1, 1, "o2", "logo", 500, 20, 31, 17, 600, 0.5, 7, 3, 293, 197),
            (1, 1, "o3", "other", 0, 0, 40, 20, 600, 0.5, None, 3, 293, 197)]
    df = spark.createDataFrame(rows, "job_id int, ordinal int, object_id string, role string, x int, y int, w int, h int, image_w int, scale double, "
                                     "zone_left int, zone_top int, zone_right int, zone_bottom int")
    out = per_object(LO.candidates(df), "cand", "anchor", "cx", "cy", "cw", "ch")
    got = {r.object_id: r.candidates.split(";") for r in out.collect()}
    assert [len(got[k]) for k in ("o1", "o2", "o3")] == [36, 10, 5]
    assert got["o2"][:2] == ["0:top-right:277:3:16:8", "1:top-right:279:3:14:7"]
    # 36 of 300 is below a quarter of 600: the first scale makes it 150 wide; a third of the zone is at 7 + 95
    assert got["o1"][0] == "0:left-center:7:40:150:120" and got["o1"][6].startswith("6:center-left:27:")
    assert got["o3"][0] == "0:top-center:null:3:20:10"
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain()
    assert "Contains(" not in text.getvalue() and "contains(" not in text.getvalue() and "replace(" not in text.getvalue()


def test_job_layouts_equal_their_parts_and_move_no_candidate(spark):
    """Objects as one array per job give what candidate rows and their fold give, whatever is large, repeated or null."""
    r, roles = random.Random(11), [*vocab.ROLE_PRIORITY, LO.PROTECTED, LO.PROTECTED, "other", None]
    objects = [(j, f"o{i % 40}", r.choice(roles), r.choice([True, False, None]), r.randrange(300), r.randrange(200), r.randrange(10, 200), r.randrange(10, 150))
               for j, n in ((1, 5), (2, 9), (3, 30), (4, 60), (None, 3), (6, 4)) for i in range(n)] + [(7, "o0", LO.PROTECTED, True, 1, 1, 9, 9)]
    sizes = [(j, o, r.randrange(120, 900), r.randrange(90, 800)) for j in (1, 2, 3, 4, 5, 7, None) for o in (1, 2, None)] + [(6, 1, 300, 200), (6, 1, 200, 300), (6, 2, 640, 480)]
    pieces = spark.createDataFrame(objects, "j int, object_id string, role string, required boolean, x int, y int, w int, h int")
    targets = spark.createDataFrame(sizes, "j int, o int, tgt_w int, tgt_h int").selectExpr(
        "j", "o", "600 AS image_w", "least(tgt_w / 600, tgt_h / 400) AS scale", "5 AS zone_left", "7 AS zone_top", "tgt_w - 5 AS zone_right", "tgt_h - 7 AS zone_bottom",
        "tgt_w AS canvas_w", "tgt_h AS canvas_h", "600 AS src_w", "400 AS src_h", "tgt_w", "tgt_h")
    every = pieces.join(targets, "j")
    valid = LO.valid_candidates(every.filter(F.col("role") != LO.PROTECTED), LO.protected_boxes(every, ["j", "o"]), ["j", "o"])
    for block in (LO.BLOCK, 20):
        want, got = (sorted(map(repr, df.withColumn("kept", F.array_sort("kept")).collect())) for df in (
            LO.layouts(valid, ["j", "o"], block), LO.job_layouts(pieces, targets, ["j", "o"], "j", block)))
        assert got == want and len(want) == 14
    assert any("DUPLICATE_OBJECT" in w for w in want) and any("NO_VALID_CANDIDATES" in w for w in want)
    plain = LO.job_layouts(pieces.filter("j < 3"), targets.filter("j < 3"), ["j", "o"], "j").explain
    import contextlib
    import io
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        plain()
    assert "Generate" not in plan.getvalue() and plan.getvalue().count("collect_list(") == 2 and "cands" not in plan.getvalue().split("collect_list(")[1]


def test_batches_equal_a_plain_loop(spark):
    """Candidates and those that may stay, made by the batch, against one object and one candidate at a time; nothing per candidate is left to the plan."""
    import contextlib
    import io

    r, roles = random.Random(5), [*vocab.ROLE_ANCHORS, "other", None]
    pieces = [(o, r.choice(roles), r.choice([True, False, None]), r.randrange(500), r.randrange(5, 220), r.randrange(5, 170), r.choice([600, 1401, None]),
               r.choice([0.2, 0.5, 1.3]), r.choice([0, 7, None]), 5, r.randrange(120, 900), r.randrange(90, 700),
               [(r.randrange(300), r.choice([3, None]), r.randrange(1, 200), r.randrange(1, 200)) for _ in range(r.randrange(3))] or None) for o in range(300)]
    df = spark.createDataFrame(pieces, "o int, role string, required boolean, x int, w int, h int, image_w int, scale double, zone_left int, zone_top int, zone_right int, zone_bottom int, "
                                       "_boxes array<struct<qx:int,qy:int,qw:int,qh:int>>").selectExpr("*", "zone_right + 9 AS canvas_w", "zone_bottom + 4 AS canvas_h")

    def loop(p):
        names = vocab.ROLE_ANCHORS.get(p.role, vocab.DEFAULT_ANCHORS)
        if p.image_w:
            names = sorted(names, key=lambda n: ("right" if p.x + p.w / 2 > p.image_w / 2 else "left") not in n)
        ow, oh, scales = max(1, round(p.w * p.scale)), max(1, round(p.h * p.scale)), vocab.SCALES
        if p.role == "product" and p.image_w and ow < round(p.image_w * 0.25):
            scales = [round(round(p.image_w * 0.25) / ow * 100) / 100, *scales]
        for i, (a, s) in enumerate((a, s) for a in names for s in scales):
            cw, ch = max(1, round(ow * s)), max(1, round(oh * s))
            zl, zr, cx = p.zone_left, p.zone_right, None
            if a in ("top-right", "right-center", "bottom-right"):
                cx = zr - cw
            elif zl is not None:
                third = {"center-left": 1, "center-right": 2}.get(a)
                cx = zl + (zr - zl) * third // 3 - cw // 2 if third else (zl + zr - cw) // 2 if a in ("top-center", "bottom-center") else zl
            cy = p.zone_top if a.startswith("top") else p.zone_bottom - ch if a.startswith("bottom") else (p.zone_top + p.zone_bottom - ch) // 2
            yield i, cx, cy, cw, ch, a, s

    def stays(p, c):
        _, x, y, w, h, _, _ = c
        if x is None or x < 0 or y < 0 or x + w > p.canvas_w or y + h > p.canvas_h:
            return False
        if p.required is not False and (p.zone_left is None or x < p.zone_left or y < p.zone_top or x + w > p.zone_right or y + h > p.zone_bottom):
            return False
        for qx, qy, qw, qh in p._boxes or []:
            dx, dy = min(x + w, qx + qw) - max(x, qx), h if qy is None else min(y + h, qy + qh) - max(y, qy)
            if dx > 0 and dy > 0 and dx * dy / (qw * qh) > 0.30:
                return False
        return True
    got = {p.o: (p, [tuple(c) for c in p.cands]) for p in LO.candidates(df).collect()}
    want = {o: list(loop(p)) for o, (p, _) in got.items()}
    assert {o: c for o, (_, c) in got.items()} == want and sum(map(len, want.values())) > 4000
    kept = {p.o: [tuple(c) for c in p.cands] for p in LO._valid(df).collect()}
    may = {o: [c for c in want[o] if stays(p, c)] for o, (p, _) in got.items()}
    assert kept == may and 500 < sum(map(len, may.values())) < 4000
    targets = spark.range(3).selectExpr("id AS j", "id AS o", "600 AS image_w", "1.0D AS scale", "0 AS zone_left", "0 AS zone_top", "300 AS zone_right", "300 AS zone_bottom", "300 AS canvas_w",
                                        "300 AS canvas_h", "600 AS src_w", "400 AS src_h", "300 AS tgt_w", "300 AS tgt_h")
    objects = df.selectExpr("o AS j", "concat('o', o) AS object_id", "role", "required", "x", "x AS y", "w", "h")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        LO.job_layouts(objects, targets, ["j", "o"], "j").explain()
    assert "greedy(" in plan.getvalue() and "aggregate(" not in plan.getvalue() and "flatten(" not in plan.getvalue()


def test_job_candidates_equal_their_rows_and_move_no_pair(spark):
    """A job's objects meet its targets in a row; jobs that are full or have a target twice go by rows."""
    import contextlib
    import io

    from adlattice.plans.layout import per_object
    r, roles = random.Random(4), [*vocab.ROLE_PRIORITY, LO.PROTECTED, LO.PROTECTED, "other", None]
    objects = [(j, f"o{i}", r.choice(roles), r.choice([True, False, None]), r.randrange(300), r.randrange(200), r.randrange(10, 200), r.randrange(10, 150))
               for j, n in ((1, 5), (2, 9), (3, 30), (None, 3), (6, 4)) for i in range(n)]
    sizes = [(j, o, r.randrange(120, 900), r.randrange(90, 800)) for j in (1, 2, 3, 5, None) for o in (1, None)] + [(6, 1, 300, 200), (6, 1, 200, 300)]
    pieces = spark.createDataFrame(objects, "job_id int, object_id string, role string, required boolean, x int, y int, w int, h int")
    targets = spark.createDataFrame(sizes, "job_id int, ordinal int, tgt_w int, tgt_h int").selectExpr(
        "job_id", "ordinal", "600 AS image_w", "least(tgt_w / 600, tgt_h / 400) AS scale", "5 AS zone_left", "7 AS zone_top", "tgt_w - 5 AS zone_right", "tgt_h - 7 AS zone_bottom",
        "tgt_w AS canvas_w", "tgt_h AS canvas_h", "600 AS src_w", "400 AS src_h", "tgt_w", "tgt_h")
    keys = ["job_id", "ordinal"]
    every = pieces.join(targets, "job_id")
    want = LO.valid_candidates(every.filter(F.col("role") != LO.PROTECTED), LO.protected_boxes(every, keys), keys).select(*keys, "object_id", "cands")
    for block in (LO.BLOCK, 20):
        got = LO.job_candidates(pieces, targets, keys, "job_id", block)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.schema == want.schema
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        per_object(LO.job_candidates(pieces.filter("job_id < 3"), targets.filter("job_id < 3"), keys, "job_id"), "cand", "cx").explain()
    above = plan.getvalue().split("Generate inline")[0]
    assert "text(valid(" in above and "Exchange" not in above and "Join" not in above
