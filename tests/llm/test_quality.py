"""Quality rules: counts against brute force, cutoffs against exact binomial tails."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adlattice.llm import quality
from tests.llm.helpers import docs, words


def counts(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a", "a b c d e a b c d e", "a b c d e f a b c d", "x " * 30_000, "é# ü*\n\né# ü*\n \x0b\n", "l\nl\nl", "a\tb\x0cc\rd"]
    texts += ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "c "]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, texts), docs(spark, []).select("doc_id", F.lit(1).alias("quality"))).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["kept"] == (not r["base_failed"])


@pytest.mark.parametrize("n, p", [(50, 0.1), (2000, 0.01), (400_000, 0.002)])
def test_tail_is_exact(spark, n, p):
    ks = [0, 1, int(n * p / 2), int(n * p)]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k in ks], "k bigint, n bigint").select(quality.tail(F.col("k"), F.col("n"), p)).collect()]
    for k, x in zip(ks, got):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert x == pytest.approx(want, rel=1e-6)


def test_tail_of_many_labels(spark):
    """Millions of labels: few terms, and the whole tail; the reference sums every term."""
    n, p = 5_000_000, 0.01
    ks = [1, 40_000, 49_500, 50_000]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k in ks], "k bigint, n bigint").select(quality.tail(F.col("k"), F.col("n"), p)).collect()]
    for k, x in zip(ks, got):
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert x == pytest.approx(want, rel=1e-6, abs=1e-300)


def corpus(n):
    rng = random.Random(n)
    texts, marks = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(40)]
        bad = i % 4 == 0
        texts.append(" ".join(x + "###" if bad else x for x in w))
        marks.append((i, 0 if bad else 1))
    return texts, marks


def test_cutoffs_need_enough_labels(spark):
    for n, rejects in ((3000, True), (300, False)):
        texts, marks = corpus(n)
        got = quality.judge(docs(spark, texts), spark.createDataFrame(marks + [(None, 1), (7, None), (10**9, 0)], "doc_id bigint, quality int")).collect()
        assert all(r["kept"] for r in got if r["doc_id"] % 4)
        assert all(r["kept"] != rejects for r in got if r["doc_id"] % 4 == 0)
        if rejects:
            assert all("symbols" in r["reasons"] for r in got if not r["kept"])


def test_all_labels_count(spark):
    """A small stratum keeps its cutoff however many labels the table has for other documents."""
    texts, marks = corpus(3000)
    others = spark.range(10_000, 4_010_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = quality.judge(docs(spark, texts), spark.createDataFrame(marks, "doc_id bigint, quality int").unionByName(others)).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)


def test_risk_is_kept_in_every_stratum(spark):
    """Good documents with symbols make a stratum lose its cutoff; the other one keeps it."""
    texts, marks = corpus(4000)
    langs = ["en" if i % 8 < 4 else "de" for i in range(4000)]
    texts = [t + "".join(f" ###{k}" for k in range(40)) if langs[i] == "de" and i % 4 == 1 else t for i, t in enumerate(texts)]
    got = quality.judge(docs(spark, texts, langs=langs), spark.createDataFrame(marks, "doc_id bigint, quality int")).collect()
    assert all(r["kept"] for r in got if langs[r["doc_id"]] == "de" and r["doc_id"] % 4)
    assert not any(r["kept"] for r in got if langs[r["doc_id"]] == "en" and r["doc_id"] % 4 == 0)


def test_no_python_and_empty(spark):
    empty = docs(spark, [])
    df = quality.judge(empty, empty.select("doc_id", F.lit(1).alias("quality")))
    assert df.count() == 0
    plan = quality.features(docs(spark, ["a"]), "doc_id", "text", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
