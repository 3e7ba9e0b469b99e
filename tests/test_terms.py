"""Term scan against plain containment."""
import random
import time

import numpy as np
import pytest

from adlattice.operators import terms as T


def plain(texts, terms):
    return {(k, i + 1, t, line.strip(" ")) for k, text in texts if text is not None for i, line in enumerate(text.split("\n")) for t in set(terms) if t and t in line}


@pytest.mark.parametrize("how", [{}, {"slice_bytes": 40}, {"slice_bytes": 5, "max_slices": 1}], ids=["one", "slices", "join"])
def test_rows_equal_containment(spark, how):
    rng = random.Random(1)
    terms = ["a", "ab", "abab", "bab", "é", "日本", "本", "x y", "", None, "aa", "aaa", "line", "b\na"]
    texts = [(0, None), (1, ""), (2, "ab"), (3, "ab\nab"), (4, "\n\n a日本ab \n"), (None, "xa"), (5, "a" * 50)]
    texts += [(10 + i, "".join(rng.choice("abé日本x \n") for _ in range(rng.randint(0, 80)))) for i in range(150)]
    frame = spark.createDataFrame(texts, "k int, text string").repartition(3)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    rows = T.scan_term_table(frame, table, "k", max_slices=how.get("max_slices", 100), slice_bytes=how.get("slice_bytes", 1000)).collect()
    want = plain([x for x in texts if x[0] is not None or "max_slices" not in how], [t for t in terms if t])
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == want


def test_no_terms(spark):
    frame = spark.createDataFrame([(1, "x")], "k int, text string")
    assert T.scan_term_table(frame, spark.createDataFrame([], "term string"), "k").count() == 0


def test_many_terms_and_a_long_line():
    rng = random.Random(2)
    letters = "abcdefgh"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(10_000)})
    line = bytearray("".join(rng.choice(letters) for _ in range(1_000_000)).encode())
    planted = {rng.randrange(0, 999_000): rng.choice(terms) for _ in range(300)}
    for at, t in planted.items():
        line[at:at + len(t)] = t.encode()
    auto = T.Automaton([t.encode() for t in terms])
    start = time.perf_counter()
    ends, found = auto.find(np.frombuffer(bytes(line), np.uint8))
    assert time.perf_counter() - start < 3
    got = {terms[i] for i in found}
    whole = line.decode()
    assert got == {t for t in terms if t in whole} and len(got) > 200
    for e, i in list(zip(ends, found))[:2000]:
        assert whole[e - len(terms[i]):e] == terms[i]
