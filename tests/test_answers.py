"""Literal model answers and scores."""
import json

import pytest
from pyspark.sql import functions as F

from adlattice.functions import answers as A, scoring as S
from adlattice.operators import compare as K, objects as O
from adlattice.plans import objects as P

SCENE = {"objects": [
    {"id": "product", "role": "product", "required": True, "movable": True, "removableFromScene": True, "bbox": {"x": 10, "y": 10, "width": 80, "height": 100},
     "polygon": [[10, 10], [90, 10], [90, 110], [10, 110]], "confidence": 0.95, "groupId": None, "zIndex": 1, "textContent": "", "description": "bottle"},
    {"id": "cta", "role": "cta_group", "required": True, "movable": True, "removableFromScene": True, "bbox": {"x": 10, "y": 120, "width": 100, "height": 20},
     "polygon": [[10, 120], [110, 120], [110, 140], [10, 140]], "confidence": 0.9, "zIndex": 2, "textContent": "Buy", "description": "button"}]}


def manifest(spark, doc):
    raw = spark.createDataFrame([(1, doc if isinstance(doc, str) else json.dumps(doc))], "image_id int, raw string")
    m = raw.select("image_id", A.build_manifest(F.col("raw")).alias("m"))
    return m.first().m, m.select("image_id", F.posexplode("m.objects").alias("ord", "o")).select("image_id", "ord", F.col("o.id").alias("object_id"), *[f"o.{c}" for c in ("role", "required", "movable", "removable", "x", "y", "w", "h", "polygon")])


def code(spark, doc, w=200, h=150):
    _, objs = manifest(spark, doc)
    images = spark.createDataFrame([(1, w, h)], "image_id int, image_w int, image_h int")
    return O.validate_manifest(objs, images).first().code


def changed(**kw):
    doc = json.loads(json.dumps(SCENE))
    doc["objects"][0].update(kw)
    return doc


def test_manifest_codes(spark):
    assert code(spark, SCENE) is None
    assert code(spark, {"objects": []}) == "MANIFEST_EMPTY"
    assert code(spark, changed(id="cta")) == "DUPLICATE_IDS"
    assert code(spark, changed(role="protected_subject")) == "PROTECTED_SUBJECT_VIOLATION"
    assert code(spark, changed(polygon=[])) == "REQUIRED_POLYGON_MISSING"
    assert code(spark, SCENE, w=60) == "COORDINATES_OUT_OF_BOUNDS"
    none = {"objects": [dict(o, removableFromScene=False) for o in SCENE["objects"]]}
    assert code(spark, none) == "NO_REMOVABLE_OBJECTS"


def test_manifest_fences_and_errors(spark):
    m, objs = manifest(spark, "```json\n" + json.dumps(SCENE) + "\n```")
    assert m.error is None and objs.count() == 2
    assert manifest(spark, "oops")[0].error == "JSON_PARSE_FAILED"
    assert manifest(spark, '{"objects": {"a": 1}}')[0].error == "OBJECTS_NOT_A_LIST"


def test_wrong_types_in_elements(spark):
    raw = json.dumps([{"id": "a", "type": "alien", "bbox": {"x": "7", "y": 2.9, "width": 3}}])
    e = spark.createDataFrame([(raw,)], "r string").select(F.explode(A.parse_elements(F.col("r"))).alias("e")).first().e
    assert (e.type, e.group, e.importance, e.bbox.x, e.bbox.y, e.bbox.w, e.bbox.h) == ("decoration", "decorations", "optional", 0, 2, 3, 0)


BASE = dict(role="product", x=100, y=100, w=100, h=100, canvas_w=500, canvas_h=500, detection_conf=0.9, mask_conf=0.9, mask_pixels=6000, edge_sharpness=1.0, fragments=1,
            hand_overlap=0.0, person_overlap=0.0, native_iou=None, top_cov=1.0, bottom_cov=1.0, continuity=1.0, top_clipped=False, bottom_clipped=False)
TYPES = ("role string, x int, y int, w int, h int, canvas_w int, canvas_h int, detection_conf double, mask_conf double, mask_pixels long, edge_sharpness double, fragments int, hand_overlap double, "
         "person_overlap double, native_iou double, top_cov double, bottom_cov double, continuity double, top_clipped boolean, bottom_clipped boolean")


def score(spark, **kw):
    row = {**BASE, **kw}
    return spark.createDataFrame([tuple(row.values())], TYPES).select(S.mask_score().alias("s")).first().s


def test_good_mask(spark):
    s = score(spark)
    # 22.5 + 18 + 15 + 8 + 6 + 8 + 5 + 15
    assert s.fail_reason is None and s.total == pytest.approx(97.5)


@pytest.mark.parametrize("kw, reason", [
    (dict(detection_conf=0.05), "confidence_too_low"), (dict(mask_pixels=0), "empty_mask"), (dict(mask_pixels=100), "mask_too_small"),
    (dict(mask_pixels=240000), "mask_too_large_canvas_fill"), (dict(fragments=21), "too_many_fragments"), (dict(w=0), "invalid_bbox"), (dict(x=450), "invalid_bbox")])
def test_hard_fails(spark, kw, reason):
    s = score(spark, **kw)
    assert s.fail_reason == reason and s.total == 0.0 and s.leak_risk == 1.0


def test_penalties(spark):
    full = score(spark).total
    assert score(spark, hand_overlap=0.5).total == pytest.approx(full - 25)
    assert score(spark, person_overlap=0.08).total == pytest.approx(full - 4)
    assert score(spark, top_clipped=True).total == pytest.approx(full - 4)
    assert score(spark, fragments=10).total == pytest.approx(full - 8 - 8)
    assert score(spark, mask_pixels=9800).total == pytest.approx(full - 6 - 8)


def test_call_outcomes(spark):
    rows = [(1, 0, None), (2, 0, "unsupported_parameter"), (2, 1, None), (3, 0, "model_not_found"), (3, 1, None), (4, 0, "rate_limit"), (5, 0, "unknown_parameter"), (5, 1, "rate_limit")]
    got = {r.call_id: (r.outcome, r.used_model, r.token_parameter) for r in K.call_outcome(spark.createDataFrame(rows, "call_id int, attempt int, error_code string"), "gpt-5-mini", "gpt-4.1-mini").collect()}
    assert got == {1: ("ok", "gpt-5-mini", "max_completion_tokens"), 2: ("param_corrected", "gpt-5-mini", "max_tokens"), 3: ("fallback", "gpt-4.1-mini", "max_tokens"),
                   4: ("error", None, None), 5: ("param_retry_failed", None, None)}


def test_union_pairs_equal_all_pairs_with_many_copies(spark):
    """Copies of one box far above the pair limit do not change the outcome."""
    import random
    r = random.Random(2)
    dets = [(1, i, 50, 50, 20, 20, r.randrange(30), 1) for i in range(40)] + [(1, 40 + i, r.randrange(300), r.randrange(300), r.randrange(5, 40), r.randrange(5, 40), r.randrange(40), 1) for i in range(30)]
    want = []
    for a in dets:
        for b in dets:
            if a[1] < b[1] and abs((a[3] + a[5] / 2) - (b[3] + b[5] / 2)) < max(a[5], b[5], 1) * 2.0 and abs((a[2] + a[4] / 2) - (b[2] + b[4] / 2)) < max(a[4], b[4], 1) * 1.5:
                want.append((a[6] + b[6], a[1], b[1]))
    want = [(i, j) for _, i, j in sorted(want, reverse=True)[:5]]
    df = spark.createDataFrame(dets, "image_id int, i int, x int, y int, w int, h int, conf int, mask_conf int")
    for block in (1024, 12, 30):
        assert [(x.i, x.j) for x in O.union_candidates(df, block=block).orderBy("pair_rank").collect()] == want


def test_iou_match_in_stages_equals_all_pairs(spark):
    import random
    r = random.Random(7)

    def boxes(n):
        return [(1, i, "product", True, True, r.randrange(200), r.randrange(150), r.randrange(4, 90), r.randrange(4, 70)) for i in range(n)]
    objs, dets = boxes(120), [(k, i, x, y, w, h, r.randrange(30, 100)) for k, i, _, _, _, x, y, w, h in boxes(150)]
    dets += [(1, 150 + n, o[5] + r.randrange(-2, 3), o[6] + r.randrange(-2, 3), o[7] + 1, max(1, o[8] - 1), 90) for n, o in enumerate(objs[::3])]

    def best(o):
        scored = []
        for d in dets:
            if d[6] < 50:
                continue
            dx, dy = min(o[5] + o[7], d[2] + d[4]) - max(o[5], d[2]), min(o[6] + o[8], d[3] + d[5]) - max(o[6], d[3])
            inter = max(dx, 0) * max(dy, 0)
            v = inter / (o[7] * o[8] + d[4] * d[5] - inter)
            if v >= 0.25:
                scored.append((-v, d[1]))
        return min(scored)[1] if scored else None
    want = {o[1]: best(o) for o in objs}
    od = spark.createDataFrame(objs, "image_id int, ord int, role string, movable boolean, removable boolean, x int, y int, w int, h int")
    dd = spark.createDataFrame(dets, "image_id int, det int, x int, y int, w int, h int, quality int")
    assert {x.ord: x.det for x in O.iou_match(od, dd).collect()} == want


def test_swallowed_titles_same_when_crowded(spark):
    import random
    r = random.Random(3)
    rows = [(1, i, r.choice(["product", "logo", "title_group", "badge"]), r.randrange(200), r.randrange(150), r.randrange(4, 60), r.randrange(4, 60)) for i in range(160)]
    df = spark.createDataFrame(rows, "image_id int, ord int, role string, x int, y int, w int, h int")

    def swallowed(o):
        return o[2] in ("logo", "title_group") and any(
            max(0, min(o[3] + o[5], p[3] + p[5]) - max(o[3], p[3])) * max(0, min(o[4] + o[6], p[4] + p[6]) - max(o[4], p[4])) / (o[5] * o[6]) > 0.6 for p in rows if p[2] == "product")
    want = {o[1] for o in rows if not swallowed(o)}
    assert 0 < len(want) < len(rows)
    assert {x.ord for x in O.drop_product_titles(df).collect()} == want


def test_raw_answers_are_read_once(spark):
    """A list taken out of an answer is cut out and parsed a single time, and verdicts are parsed before their ids are compared."""
    import contextlib
    import io

    from adlattice.operators import objects as O

    def plan(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        return out.getvalue()
    raw = '{"contentBands":[{"id":"b1","role":"headline","y1":3,"y2":9}],"remainingObjectIds":["o1","o2"],"adObjectsRemaining":true}'
    df = spark.range(2).select("id", F.concat(F.lit(raw), F.when(F.col("id") > 5, "x").otherwise("")).alias("raw"))
    bands = df.select("id", F.explode(A.parse_bands(F.get_json_object("raw", "$.contentBands"))).alias("b"))
    assert plan(bands).split("Generate")[1].count("get_json_object(") == 1
    assert [(r.b.id, r.b.role, r.b.y1, r.b.y2) for r in bands.collect()] == [("b1", "headline", 3, 9)] * 2
    roles = spark.createDataFrame([(" HERO ",), ("badge",), ("nonsense",), (None,)], "r string").select(A.normalise_role(F.col("r")).alias("role"))
    assert plan(roles).count("lower(") == 1
    v = df.select("id", A.parse_validation(F.col("raw")).alias("v")).selectExpr("id AS image_id", "v.remaining_ids", "v.ad_objects_remaining")
    man = spark.createDataFrame([(0, "o1", "protected_subject"), (0, "o2", "protected_subject"), (1, "o2", "protected_subject")], "image_id long, object_id string, role string")
    out = O.purge_protected(v, man)
    assert "from_json" not in plan(out)
    assert sorted((r.image_id, tuple(r.remaining_ids), r.ad_objects_remaining) for r in out.collect()) == [(0, (), False), (1, ("o1",), True)]


def _some_images(full):
    """Images of few boxes, one of ``full``, and boxes without an image, a place or a size."""
    import random
    r = random.Random(11)
    rows = [(k, i, r.randrange(200), r.randrange(150), r.randrange(4, 90), r.randrange(4, 70), r.randrange(30, 100)) for k in range(1, 9) for i in range(full if k == 8 else k)]
    return rows + [(None, 0, 1, 1, 9, 9, 90), (3, 90, None, 5, 9, 9, 90), (3, 91, 5, 5, None, 9, 90), (4, 92, 5, 5, 0, 9, 90), (4, 0, *rows[6][2:]), (4, 93, *rows[6][2:])]


def test_iou_match_of_listed_boxes_equals_match_by_cells(spark):
    """An image's boxes give the same match as an array and by cells, and the array's plan moves no row per cell."""
    rows = _some_images(100)
    objs = spark.createDataFrame([(k, i, "product", True, True, *b[:4]) for k, i, *b in rows], "image_id int, ord int, role string, movable boolean, removable boolean, x int, y int, w int, h int")
    dets = spark.createDataFrame([(k, i, x + i % 3, y, w, h, q) if x is not None else (k, i, x, y, w, h, q) for k, i, x, y, w, h, q in rows], "image_id int, det int, x int, y int, w int, h int, quality int")
    got = {n: sorted(map(str, (tuple(x) for x in O.iou_match(objs, dets, at_once=n).select("image_id", "ord", "det", "iou").collect()))) for n in (0, 5, 64, 1000)}
    assert got[0] == got[5] == got[64] == got[1000] and sum("None" not in g for g in got[0]) > 50 and len(got[0]) == len(rows)
    plan = O.iou_match(objs, dets, at_once=1000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_union_pairs_of_listed_boxes_equal_pairs_by_cells(spark):
    """An image's pairs are the same from an array and by cells, and the array's plan joins nothing."""
    rows = _some_images(90)
    dets = spark.createDataFrame([(*r, r[1] % 7) for r in rows], "image_id int, i int, x int, y int, w int, h int, conf int, mask_conf int")
    got = {n: sorted(tuple(x) for x in O.union_candidates(dets, block=n).collect()) for n in (2, 64, 1000)}
    assert got[2] == got[64] == got[1000] and len(got[2]) > 20
    assert "Join" not in O.union_candidates(dets, block=1000)._jdf.queryExecution().executedPlan().toString()


def test_analysis_lists_are_parsed_only_where_wanted(spark):
    raw = ['{"creativeType":"poster_info","edgeRisk":5,"confidence":"sure","warnings":["a"],"reflowRecommended":"TRUE",'
           '"detectedElements":[{"id":"e1","type":"logo","bbox":{"x":1,"y":"bad"}}],"elementGroups":"x","contentBands":[{"id":"b","y1":1,"y2":9}]}',
           '{"creativeType":"nonsense","confidence":3,"warnings":"none","elementGroups":[{"id":"g","elementIds":["e1"]}]}', "sorry", '{"creativeType":"poster', None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    rows = df.select("i", A.read_analysis(F.col("raw")).alias("r")).withColumns(A.analysis(F.col("r"))).drop("r")
    assert sorted(rows.collect(), key=lambda r: r.i) == sorted(df.select("i", A.parse_analysis(F.col("raw")).alias("a")).select("i", "a.*").collect(), key=lambda r: r.i)
    assert rows.filter("i = 0").select("creative_type", "edge_risk", "confidence", "warnings", "elements.id", "groups").first() == ("poster_info", "medium", None, ["a"], ["e1"], None)
    t = type("T", (), {"spark": spark, "fx_object": spark.createDataFrame([], "image_id long, ord int, role string, required boolean, conf_pct int, x int, y int, w int, h int")})
    plan = P.f_parse_analysis(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and "elementIds,ArrayType" not in plan
