"""Exact deduplication against a dictionary."""
import hashlib
import re

import pytest

from adlattice.llm import dedup
from tests.llm.helpers import docs

TEXTS = ["a b", "ab", "a\tb\n", None, "", " ", "x" * 70_000, "x " * 70_000, "é é", "é é", "éé", "same", "same", "same"] + [f"t{i % 40}" for i in range(300)]


def expected(texts, ids):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    out = {}
    for body, rows in groups.items():
        best = min(rows, key=lambda i: (-len(texts[i] or ""), ids[i] is None, ids[i] or 0))
        for i in rows:
            out[i] = (ids[i], ids[best], len(rows), i == best, hashlib.sha256(body.encode()).hexdigest())
    return out


@pytest.mark.parametrize("fp_bits", [48, 6])
def test_groups(spark, fp_bits):
    ids = [None if i == 3 else i * 7 % 1009 for i in range(len(TEXTS))]
    got = sorted((tuple(r) for r in dedup.exact_duplicates(docs(spark, TEXTS, ids=ids).repartition(5), fp_bits=fp_bits).collect()), key=repr)
    assert got == sorted(expected(TEXTS, ids).values(), key=repr)


def test_repeated_rows_keep_one(spark):
    got = dedup.exact_duplicates(docs(spark, ["a", "a", "a"], ids=[5, 5, 5])).collect()
    assert [r["group_size"] for r in got] == [3, 3, 3] and sum(r["kept"] for r in got) == 1


def test_drop(spark):
    source = docs(spark, TEXTS)
    left = dedup.drop_duplicates(source)
    assert left.columns == source.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, x in expected(TEXTS, list(range(len(TEXTS)))).items() if x[3])


def test_empty(spark):
    assert dedup.exact_duplicates(docs(spark, [])).count() == 0 and dedup.drop_duplicates(docs(spark, [])).count() == 0
