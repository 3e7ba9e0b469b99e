"""The 68-row catalog: seeding twice, counts, deactivation, literal lookups."""
import json

from pyspark.sql import functions as F

from adlattice.operators import catalog as C, jobs as J
from adlattice.sources.tables import read_specs


def raw_rows():
    rows = [{"id": i + 1, "media": "naver", "placementName": f"p{i}", "slug": f"naver-slot-{i}", "width": 300 + i, "height": 250, "ratio": "6:5",
             "safeZoneParseStatus": "diagram_unreadable", "needsReview": i == 5} for i in range(65)]
    rows += [{"id": 66 + i, "media": "naver", "placementName": "z", "slug": s, "width": 1250, "height": 560, "safeZoneParseStatus": "parsed_text", "safeTop": 50, "safeRight": 240,
              "safeBottom": 35, "safeLeft": 240, "safeZoneWidth": 770, "safeZoneHeight": 475, "fileFormats": ["jpg", "png"], "maxFileSizeKb": 500, "needsReview": False}
             for i, s in enumerate(["naver-gfa-mobile-da-image-banner-1250x560", "naver-b", "naver-c"])]
    return rows


def load(spark, tmp_path, rows, name="naver.json"):
    path = tmp_path / name
    path.write_text(json.dumps(rows), encoding="utf-8")
    return read_specs(spark, str(path)).withColumn("batch_ord", F.col("sort_order"))


def test_seed_twice(spark, tmp_path):
    incoming = load(spark, tmp_path, raw_rows())
    empty = incoming.drop("batch_ord", "safe_zone").withColumn("spec_id", F.lit("x")).limit(0)
    merged, status = C.upsert_specs(empty, incoming)
    s = C.seed_summary(status).first()
    assert (s.loaded, s.inserted, s.updated, s.unchanged) == (68, 68, 0, 0)
    _, again = C.upsert_specs(merged, incoming)
    s = C.seed_summary(again).first()
    assert (s.inserted, s.updated, s.unchanged, s.total) == (0, 0, 68, 68)
    v = C.verify_catalog(merged, "naver").first()
    assert (v.total, v.parsed_text, v.diagram_unreadable, v.needs_review, v.duplicate_slugs, v.bad_dims, v.null_slug) == (68, 3, 65, 1, 0, 0, 0)
    one = C.spec_one(incoming, "naver", "naver-gfa-mobile-da-image-banner-1250x560").first()
    assert (one.width, one.height, one.safe_zone_width, one.safe_zone_height) == (1250, 560, 770, 475)
    assert one.safe_zone == {"top": 50, "right": 240, "bottom": 35, "left": 240}


def test_changes_and_ignored_fields(spark, tmp_path):
    rows = raw_rows()
    base = load(spark, tmp_path, rows)
    merged, _ = C.upsert_specs(base.drop("batch_ord", "safe_zone").withColumn("spec_id", F.lit("x")).limit(0), base)
    rows[0]["width"] = 999
    rows[1]["sourceUrl"] = "changed but not compared"
    _, status = C.upsert_specs(merged, load(spark, tmp_path, rows, "again.json"))
    got = {r.slug: r.status for r in status.collect()}
    assert got["naver-slot-0"] == "UPDATED" and got["naver-slot-1"] == "UNCHANGED" and list(got.values()).count("UNCHANGED") == 67


def test_duplicates_inside_one_batch_act_in_order(spark):
    inc = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3)], "slug string, width int, batch_ord int")
    merged, status = C.upsert_specs(spark.createDataFrame([], "slug string, spec_id string, width int"), inc, compared=["width"])
    assert [r.status for r in status.orderBy("batch_ord").collect()] == ["INSERTED", "UNCHANGED", "UPDATED"]
    assert [tuple(r) for r in merged.select("slug", "width").collect()] == [("a", 2)]


def test_wrong_types_become_defaults(spark, tmp_path):
    r = load(spark, tmp_path, [{"id": "x", "slug": "s", "width": "300", "height": 250.9, "isVideo": "yes", "safeTop": 1}]).first()
    assert (r.sort_order, r.width, r.height, r.is_video, r.safe_top) == (10000, 0, 250, None, 1)


def test_default_specs(spark):
    d = C.default_specs(spark)
    assert d.count() == 64 and d.select("media", "slug").distinct().count() == 64
    assert {r.media: r["count"] for r in d.groupBy("media").count().collect()} == {"google": 23, "meta": 5, "criteo": 15, "mobion": 12, "kakao": 5, "linkedin": 3, "tiktok": 1}
    assert C.init_specs(d, d, reset=False).count() == 128 and C.init_specs(d, d, reset=True).count() == 64


def test_lookup_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "specs")
    C.default_specs(spark).write.parquet(path)
    plan = C.specs_by_media(spark.read.parquet(path), "meta").select("slug")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(media,meta)" in plan and "ReadSchema: struct<media:string,slug:string,active:boolean>" in plan


def test_refused_deactivation_changes_nothing(spark):
    specs = spark.createDataFrame([(f"s{i}", "naver", i % 3 > 0) for i in range(9)] + [("x", "meta", True)], "slug string, media string, active boolean")
    listed = specs.select("slug")
    for limit, refused in ((3, True), (9, False)):
        off, counts = C.deactivate(specs, "naver", listed, limit)
        row = counts.first()
        assert (row["found"], row["refused"], row["modified"]) == (9, refused, 0 if refused else 6)
        want = {r["slug"]: r["active"] if refused or r["media"] == "meta" else False for r in specs.collect()}
        assert {r["slug"]: r["active"] for r in off.collect()} == want


def test_names_of_many_results_are_distinct(spark):
    rows = [(1, i, "a", 10, 10, "/o/r.png") for i in range(150)]
    named = J.name_results(spark.createDataFrame(rows, "job_id int, ordinal int, slug string, width int, height int, file_path string")).collect()
    assert sorted(r["new_name"] for r in named) == sorted(f"{i:02d}_a_10x10.png" for i in range(150))


def _request(spark):
    """400 jobs that name a media with 300 specs, besides jobs that name ids or nothing that is there."""
    specs = spark.range(600).selectExpr("concat('s', id) AS slug", "CASE WHEN id < 300 THEN 'big' WHEN id < 400 THEN 'off' ELSE concat('m', id % 7) END AS media",
                                        "CAST(CASE WHEN id % 5 > 0 THEN 1000 - id END AS INT) AS sort_order", "id < 300 OR id >= 400 AS active")
    messages = spark.range(500).selectExpr(
        "CASE WHEN id <> 499 THEN id END AS job_id", "CASE WHEN id % 10 = 1 THEN array(concat('s', id), 's350', 'gone') WHEN id % 10 = 2 THEN array('gone') END AS spec_ids",
        "CASE WHEN id % 10 = 3 THEN array('off') WHEN id % 10 = 4 THEN CAST(NULL AS ARRAY<STRING>) WHEN id % 10 = 5 THEN array('big', 'm3', CAST(NULL AS STRING)) ELSE array('big') END AS target_media")
    return messages, specs


def _most_rows(df):
    """The rows that any one operator put out while ``df`` ran."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        if plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
        kids = plan.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_jobs_without_specs_make_no_pairs(spark):
    messages, specs = _request(spark)
    failed = C.resolve_specs(messages, specs)[1]
    found = {r[0] for r in C.resolve_specs(messages, specs)[0].select("job_id").distinct().collect()} - {None}
    want = sorted((r[0] or -1) for r in messages.select("job_id").collect() if r[0] not in found)
    assert sorted((r[0] or -1) for r in failed.select("job_id").collect()) == want and len(want) > 100
    assert _most_rows(failed) <= 2000


def test_media_of_jobs_make_no_pairs(spark):
    messages, specs = _request(spark)
    short = C.job_media(C.resolve_specs(messages, specs, first_of_media=True)[0])
    whole = C.job_media(C.resolve_specs(messages, specs)[0])
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect())) and short.count() > 300
    assert _most_rows(short) <= 2000
