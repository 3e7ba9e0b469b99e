"""Fill-in-middle: outputs against plain slicing, and the way back."""
import hashlib
import random

import numpy as np
import pytest

from adlattice.llm import infill
from tests.llm.helpers import docs

ODD = ["", None, "a", "ab", "é", "🙂🙂ok", "日本語テスト", "x<P>y", "<S>", "a<M", ">b", "<", "P>", "<<S", "S>", "<P", "naïve—dash " * 40, "x" * 300_000, "é🙂" * 200_000, "same", "same"]


def plain(key, text):
    text = text or ""
    s = hashlib.sha256(b"1:" + str("" if key is None else key).encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, e = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{e}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{e}<M>{m}"


def check(rows, texts):
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == sorted((k is None, k) for k, _ in texts)
    want = {}
    for k, t in texts:
        want.setdefault(k, set()).add((*plain(k, t), t or ""))
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) in want[r["doc_id"]]


def test_outputs_and_way_back(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("<PSM>aé🙂 \n") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    rows = infill.restore(infill.transform(docs(spark, texts).repartition(3))).collect()
    check(rows, list(enumerate(texts)))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_empty_null_keys_and_repeated_rows(spark):
    assert infill.digests(docs(spark, [])).count() == 0
    ids, texts = [None, 5, 5, 7], ["some text", "again", "again", None]
    check(infill.restore(infill.transform(docs(spark, texts, ids=ids))).collect(), list(zip(ids, texts)))


@pytest.mark.parametrize("size", [1, 7, 64])
def test_runs_hold_every_row_once(size):
    lengths = [0, 3, 100, 0, 0, 5, 1, 1, 64]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    got = list(infill.runs(offsets, size))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == len(lengths)
    assert all(offsets[b] - offsets[a] <= size or b == a + 1 for a, b in got)


def test_broken_outputs_are_null(spark):
    rows = [("psm", "<P>a<S>b"), ("psm", "<S>b<P>a<M>c"), ("spm", "<S>b<P>a<M>c"), ("psm", "x<P>a<S>b<M>c"), ("psm", "<P>a<P>b<M>c"), ("plain", "<P>"), (None, "t"), ("psm", None), ("psm", "<P><S><M>")]
    made = spark.createDataFrame([(i, f, o, "kept") for i, (f, o) in enumerate(rows)], "i int, form string, output string, c0 string")
    got = {r["i"]: r["restored"] for r in infill.restore(made).collect()}
    assert got == {0: None, 1: None, 2: "acb", 3: None, 4: None, 5: "<P>", 6: "t", 7: None, 8: ""}
    assert {r["c0"] for r in infill.restore(made).collect()} == {"kept"}
