"""Length histogram against encoded lengths."""
import public_tokenizers
import pytest

from adlattice.llm import lengths
from adlattice.llm.queries import BYTE_PATTERN
from tests.llm.helpers import docs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "a b", "hello world " * 40, "é" * 500, "same text", "same text", " " * 300, "<|endoftext|>"]


def test_pattern():
    assert BYTE_PATTERN == public_tokenizers.PATTERN


def test_answers(spark):
    enc = lengths.encoding(lengths.read_ranks(PATH), BYTE_PATTERN)
    n = [len(enc.encode_ordinary(t or "")) for t in TEXTS]
    sources = [None if i % 3 == 0 else f"s{i % 2}" for i in range(len(TEXTS))]
    rows = lengths.histogram(docs(spark, TEXTS, sources=sources), PATH, BYTE_PATTERN).cache()
    for overall, source in [(True, None), *[(False, s) for s in (None, "s0", "s1")]]:
        own = [x for x, s in zip(n, sources) if overall or s == source]
        got = {r["length"]: r for r in rows.collect() if r["overall"] == overall and r["source"] == source}
        assert set(got) == set(own)
        for at, r in got.items():
            assert r["documents"] == own.count(at) and r["docs_ge"] == sum(x >= at for x in own) and r["tokens_ge"] == sum(x for x in own if x >= at)
            assert r["truncated"] == sum(min(x, at) for x in own) and r["total"] == sum(own) and r["share"] == pytest.approx(sum(x <= at for x in own) / len(own))
    for limit in (0, 1, 2, 50, 10**6):
        assert lengths.truncated_total(rows, limit).first()["tokens"] == sum(min(x, limit) for x in n)
    for q in (0.1, 0.5, 1.0):
        assert lengths.quantile(rows, q).first()["length"] == sorted(n)[max(0, -(-int(q * len(n) * 1000) // 1000) - 1)]


def test_empty(spark):
    assert lengths.histogram(docs(spark, []), PATH, BYTE_PATTERN).count() == 0
