"""Every registered query runs on the smallest tables and equals its oracle there (a sample of families), names and plans."""
import duckdb
import pytest

import __spark_entry__ as entry
from adlattice.plans.fixtures import BASE

SF = "/root/testdata/sf0.001"
SAMPLE = ["entry_layout_violations", "j01_upsert_status", "j05_resolve_safe_zone", "a07_job_outcome", "w07_fail_closed", "f06_parse_objects", "j17_iou_match",
          "j18_union_candidates", "x03_mask_union", "x08_mask_minus", "c02_mask_score", "k03_job_state_batch", "g10_edge_anchoring", "q01_validate_manifest"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for n in BASE:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols

    def norm(v):
        return round(v, 6) if isinstance(v, float) else str(v)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["j16_drop_product_titles", "j17_iou_match", "j18_union_candidates", "x08_mask_and", "entry_layout_violations", "g02_letterbox_projection", "f16_scan_terms"])
def test_no_cartesian_plans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
