"""The n-gram join against all pairs."""
import random

import pytest

from adlattice.llm import ngrams
from tests.llm.helpers import docs, lower, words


def brute(texts):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            if label[i] != m or label[j] != m:
                label[i] = label[j] = m
                changed = True
    return {(i, len(s), label[i]) for i, s in enumerate(sets)}


def corpus(seed, families, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = [None, "", " \n\t", "One", "one", "two words", "Two  Words", "a b c d", "a b c d e", "A b c d E"]
    shared = rng.choices(vocabulary, k=60)
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(5, 150))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w + (shared if rng.random() < 0.2 else [])))
    return out


@pytest.mark.parametrize("families, copies, edits", [(25, 8, 4), (2, 130, 5), (120, 2, 2)])
def test_against_all_pairs(spark, families, copies, edits):
    texts = corpus(families, families, copies, edits)
    # small blocks, so that copies meet across blocks as well
    got = ngrams.jaccard_components(docs(spark, texts).repartition(3), block_grams=2000)
    assert {tuple(r) for r in got.collect()} == brute(texts)


def test_keep_one_of_each(spark):
    texts = corpus(1, 6, 6, 2)
    source = docs(spark, texts).repartition(2)
    left = ngrams.drop_near_duplicates(source)
    label = {i: c for i, _, c in brute(texts)}
    kept = [label[r["doc_id"]] for r in left.collect()]
    assert left.columns == source.columns and sorted(kept) == sorted(set(label.values()))


def test_null_and_repeated_keys_and_empty(spark):
    got = ngrams.jaccard_components(docs(spark, ["a b", "a b", "x", None], ids=[None, 4, None, 9])).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, 1, 4), (4, 1, 4), (None, 1, None), (9, 0, 9)]))
    assert ngrams.jaccard_components(docs(spark, [])).count() == 0


def test_near_copies_without_their_centre(spark):
    """Copies of one text, some words changed in each: most pairs lie just below the threshold, a few link."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    base, texts = rng.choices(vocabulary, k=300), []
    for _ in range(250):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngrams.jaccard_components(docs(spark, texts).repartition(3)).collect()}
    assert got == brute(texts)
