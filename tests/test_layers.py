"""Layer roles against plain Python, and layouts that compute their targets once."""
import contextlib
import io

import pytest

from adlattice import vocab
from adlattice.functions.text import layer_role
from adlattice.operators import layers as LY

LAYER = "psd_id int, ord int, depth int, name string, role string, is_group boolean, visible boolean, x1 int, y1 int, x2 int, y2 int, src_w int, src_h int, tgt_w int, tgt_h int"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def layers(spark):
    rows = [(1, 0, 0, "product 1", "product", False, True, 10, 10, 60, 80, 600, 400, 160, 600),
            (1, 1, 0, "logo", "logo", False, True, 5, 5, 25, 15, 600, 400, 160, 600),
            (1, 2, 0, "title", "title", False, True, 100, 20, 300, 60, 600, 400, 160, 600),
            (2, 0, 0, "person", "person", False, True, 0, 0, 50, 100, 600, 400, 160, 600)]
    return spark.createDataFrame(rows, LAYER)


def test_layer_role(spark):
    names = ["[title-group] a", "\t[ Title", "product-group", "Product 1", "logo]", "bgx", " body", "x title", "", None, "person\n", "\ntitle"]

    def plain(name):
        bare = (name or "").lower().lstrip("[] \t")
        return next((role for prefix, role in vocab.LAYER_PREFIXES if bare.startswith(prefix)), "unknown")
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = {r.i: r.role for r in df.select("i", layer_role(df.name).alias("role")).collect()}
    assert got == {i: plain(n) for i, n in enumerate(names)}


@pytest.mark.parametrize("operator", [LY.edge_layout, LY.vertical_layout, LY.expand_groups])
def test_input_is_computed_once(spark, operator):
    """Slots, blocks and pieces come from what was written, so no branch computes the layers again."""
    out = operator(layers(spark))
    assert "LocalTableScan" not in plan_of(out) and "Scan ExistingRDD" not in plan_of(out)
    assert out.count() > 0


def test_slots_leave_out_what_a_file_lacks(spark):
    got = {(r.psd_id, r.ord, r.slot) for r in LY.vertical_layout(layers(spark)).collect()}
    assert got == {(1, 0, "prod"), (1, 1, "logo"), (1, 2, "text"), (2, 0, "model")}
    got = {(r.psd_id, r.ord, r.slot) for r in LY.edge_layout(layers(spark)).collect()}
    assert got == {(1, 0, "prod"), (1, 1, "logo"), (1, 2, "text"), (2, 0, "model")}
