"""Best-two-fit packing: pieces against the tokenizer itself, plans against filling bin after bin."""
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from adlattice.llm import twofit
from adlattice.llm.lengths import read_ranks
from adlattice.llm.queries import BYTE_PATTERN
from tests.llm.helpers import docs

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", None, "it's we'll DON'T", "<|endoftext|> x", "a<|endoftext|>b", "tab\tand\x0bvt\x85nel em \x1c\x1d", "é é É ß ẞ İ ı Σ ς", "ªº µ ÷ × ½ ²", "12345 3.14 4,5",
       "日本語 テスト", "!!! ?!.. --", "x" * 30_000, "word " * 6000, "\x00\x00 a\x00b", "naïve—dash", "̀combining", "🙂🙂 ok", "l'été d’été", "same", "same", "\n\n  \n x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(5)
    alphabet = "abcdeéèüßABÉ .,!?'-<|>0189\n\t\"@œ½²€…日ſ"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = twofit.ByteEncoder(f.read(), read_ranks(RANKS), BYTE_PATTERN, ["<|endoftext|>"])
    assert [encoder.encode(t) for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, tokenizer, window):
    wanted, bins = Counter(), {}
    for key, text in texts:
        ids, start = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        first = len(ids) % window or window
        for piece, end in enumerate([*range(first, len(ids) + 1, window)] if len(ids) > window else [len(ids)]):
            wanted[key, piece, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())] += 1
            start = end
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return bins


@pytest.mark.parametrize("window", [1024, 8])
def test_pieces(spark, tokenizer, window):
    texts = ODD if window > 100 else [t for t in ODD if len(t or "") < 5000]
    rows = twofit.pack(docs(spark, texts).repartition(3), TOKENIZER, RANKS, BYTE_PATTERN, window=window, with_ids=True).collect()
    bins = check(rows, list(enumerate(texts)), tokenizer, window)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert len(bins) <= -(-sum(r["length"] for r in rows) // window) + 2


def test_empty_and_repeated(spark, tokenizer):
    assert twofit.pack(docs(spark, []), TOKENIZER, RANKS, BYTE_PATTERN).count() == 0
    ids, texts = [1, 1, None], ["a", "a", None]
    check(twofit.pack(docs(spark, texts, ids=ids), TOKENIZER, RANKS, BYTE_PATTERN).collect(), list(zip(ids, texts)), tokenizer, 1024)


def one_by_one(counts, window):
    """Best-two-fit without repetition: every bin filled by itself from a list of pieces."""
    left, bins = Counter(counts), []
    while +left:
        free, own, gap = Counter(+left), [], window
        while fits := [s for s in +free if s <= gap]:
            own.append(max(fits))
            free[own[-1]] -= 1
            gap -= own[-1]
        if gap:
            room, items = gap + own[-1], sorted((+free).elements(), reverse=True)
            pairs = [(a + b, a, b) for i, a in enumerate(items) for b in items[i + 1:] if a + b <= room]
            if pairs and max(pairs)[0] > own[-1]:
                own[-1:] = max(pairs)[1:]
        left -= Counter(own)
        bins.append(tuple(own))
    return bins


def test_plan_equals_filling_bin_after_bin():
    rng = random.Random(9)
    for _ in range(150):
        window = rng.randint(1, 40)
        counts = Counter(rng.randint(1, window) for _ in range(rng.randint(0, 60)))
        got = twofit.plan(counts, window)
        assert [tuple(b) for b, n in got for _ in range(n)] == one_by_one(counts, window)


def test_plan_is_short_and_tight():
    counts = {length: 10**9 + length for length in range(1, 1025)}
    got = twofit.plan(counts, 1024)
    used = Counter()
    for own, n in got:
        assert sum(own) <= 1024
        for size in own:
            used[size] += n
    assert used == counts and len(got) < 5000
    assert sum(n for _, n in got) < 1.001 * sum(s * n for s, n in counts.items()) / 1024


def test_two_smaller_pieces_replace_one():
    assert twofit.plan({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
