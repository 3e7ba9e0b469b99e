"""Code compression: trees against plain distances, codes against a plain search."""
import hashlib
from collections import Counter

import numpy as np
import pytest

from adlattice.llm import anchors

SCHEMA = "vec_id bigint, embedding array<double>, label int, key string, code string, slot int"


def frame(spark, vectors, ids=None, labels=None):
    rows = [(ids[i] if ids else i, v, labels[i] if labels else i % 3, "k", "c", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, ids, labels, parts=16, entries=64, rounds=2):
    good = [(i, v, l) for i, v, l in zip(ids, vectors, labels) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return Counter(), None
    dim = -(-max(len(v) for _, v, _ in good) // parts) * parts
    rows = np.array([[*np.floor(256 * np.array(v)), *[0] * (dim - len(v))] for _, v, _ in good]).astype(np.int64)
    pieces = rows.reshape(len(rows), parts, -1)
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, list(good[i][1])))[:entries]
    book = pieces[first].copy()

    def near():
        d = ((pieces[:, None] - book[None]) ** 2).sum(3)
        return d.argmin(1), d.min(1).sum(1)
    for _ in range(rounds):
        best, _ = near()
        for p in range(parts):
            for e in range(len(book)):
                if (best[:, p] == e).any():
                    book[e, p] = pieces[best[:, p] == e, p].sum(0) // (best[:, p] == e).sum()
    best, error = near()
    by_label = Counter()
    for (_, _, l), e in zip(good, error):
        by_label[l] += int(e)
    digest = hashlib.sha256(",".join(map(str, book.transpose(1, 0, 2).ravel())).encode()).hexdigest()
    return Counter((i, "".join(f"{x:02x}" for x in b), int(e), by_label[l]) for (i, _, l), b, e in zip(good, best, error)), digest


def check(spark, vectors, ids=None, labels=None, **how):
    ids, labels = ids or list(range(len(vectors))), labels or [i % 3 for i in range(len(vectors))]
    want, digest = plain(vectors, ids, labels)
    got = anchors.compress(frame(spark, vectors, ids, labels).repartition(3), **how).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == ({digest} if want else set())


def test_codes_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    spread = rng.normal(0, .125, (700, 64))
    heaps = rng.integers(-2, 3, (700, 64)) / 256  # many equal parts and equal distances
    check(spark, [*spread.tolist(), *heaps.tolist()], block=200)


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [None, [], [float("nan")] * 32, [0.5, None] * 16, [float("inf")] * 32, *rng.normal(0, 1, (90, 32)).tolist(), *[[.25] * 32] * 40, [1.0] * 20]
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(vectors))]
    labels = [None if i % 4 == 0 else 7 for i in range(len(vectors))]
    check(spark, vectors, ids, labels)


@pytest.mark.parametrize("vectors", [[], [None], [[.1] * 16], [[-.3] * 16] * 5, [[1e300, -1e300] * 8, [0.0] * 16][:0]])
def test_few_rows(spark, vectors):
    check(spark, vectors)


def test_huge_components_are_bounded(spark):
    got = anchors.compress(frame(spark, [[1e300] * 16, [-1e300] * 16, [0.0] * 16])).collect()
    assert sorted(r["code"][:2] for r in got) == ["00", "01", "02"] and {r["error"] for r in got} == {0}


def shapes():
    rng = np.random.default_rng(6)
    yield rng.integers(-40, 40, (500, 4))
    yield np.repeat(rng.integers(-9, 9, (20, 3)), 30, axis=0)
    yield np.zeros((65, 2), np.int64)
    yield np.arange(3)[:, None]
    yield np.concatenate([np.zeros((900, 4), np.int64), rng.integers(-9, 9, (100, 4))])


@pytest.mark.parametrize("points", list(shapes()), ids=str)
def test_trees(points):
    tree = anchors.grow(points)
    assert sorted(tree["order"]) == list(range(len(points)))
    own = points[tree["order"]]
    assert tree["start"][0] == 0 and tree["end"][0] == len(points)
    seen = []
    stack = [0]
    while stack:
        i = stack.pop()
        a, b, n = tree["start"][i], tree["end"][i], tree["children"][i]
        assert (tree["sum"][i] == own[a:b].sum(0)).all()
        assert np.sqrt(((own[a:b] - tree["centre"][i]) ** 2).sum(1)).max() <= tree["radius"][i] * (1 + 1e-12)
        kids = list(range(tree["child"][i], tree["child"][i] + n))
        if kids:
            assert sorted((tree["start"][k], tree["end"][k]) for k in kids)[0][0] == a and sum(tree["end"][k] - tree["start"][k] for k in kids) == b - a
        else:
            seen.append((a, b))
        stack += kids
    seen.sort()
    assert [a for a, _ in seen] == [0, *[b for _, b in seen[:-1]]] and seen[-1][1] == len(points)


def test_balls_are_owned_whole():
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (8, 16))
    vectors = centres[rng.integers(0, 8, 2000)] + rng.integers(-3, 4, (2000, 16))
    forest = anchors.Forest.read([c.tobytes() for c in anchors.Forest.build(vectors, 4)], 4, 4)
    book = np.ascontiguousarray(centres.reshape(8, 4, 4).transpose(1, 0, 2))
    walked = list(forest.owned(book))
    whole = sum(int((forest.end - forest.start)[nodes].sum()) for nodes, _, live in walked if live is None)
    assert whole > .9 * 4 * 2000
    assert sum(len(nodes) for nodes, _, live in walked if live is None) < 400
