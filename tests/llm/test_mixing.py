"""Mixing: targets against iterated water-filling, draws against their own definition."""
import pytest

from adlattice.llm import mixing
from tests.llm.helpers import docs, words


def filled(sizes, weights, total, epochs):
    open_, target, left = set(sizes), {}, total
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= epochs * sizes[s]}
        if not over:
            target.update({s: level * weights[s] for s in open_})
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("counts", [[200, 3, 9, 40, 1, 12], [5, 5, 5], [1], [300, 1, 1]])
def test_targets_and_draws(spark, counts):
    texts, sources = [], []
    for k, c in enumerate(counts):
        texts += ["w " * (i % 17 + 1) for i in range(c)]
        sources += [None if k == len(counts) - 1 else f"s{k}"] * c
    got = mixing.mix(docs(spark, texts, sources=sources)).collect()
    sizes = {s: sum(len(words(t)) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes)  # half of the longest document
    again = mixing.mix(docs(spark, texts, sources=sources).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_no_source_above_its_cap_is_reshared(spark):
    got = mixing.mix(docs(spark, ["a"] * 10 + ["b"] * 990, sources=["s0"] * 10 + ["s1"] * 990)).collect()
    assert {(r["source_size"], r["target"]) for r in got} == {(10, 20.0), (990, 1480.0)}


def test_awkward(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.repeat(docs(spark, [])).count() == 0
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(docs(spark, [None, "", " \n"])).collect()] == [(0, 0, 0.0)] * 3
    source = docs(spark, ["a b", " c\x0bd\x0c", "x" * 5000], ids=[None, 1, 1])
    assert sorted(r["size"] for r in mixing.mix(source).collect()) == [1, 2, 2]
    left = mixing.repeat(source)
    assert left.columns == source.columns and 7 <= sum(len(words(r["text"])) for r in left.collect()) + 1 <= 10
