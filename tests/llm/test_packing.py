"""Packing: pieces against the tokenizer itself."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from adlattice.llm import packing
from tests.llm.helpers import docs

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", None, "it's we'll DON'T", "<|endoftext|> x", "a<|startoftext|>b", "tab\tand\x0bvt\x85nel em", "é é É ß ẞ İ ı Σ ς", "ªº µ ÷ ×", "12345 3.14 4,5", "日本語 テスト",
       "!!! ?!.. --", "word.word,(x) a.b.c", "x" * 3000, "\x00\x00 a\x00b", "naïve—dash", "̀combining", "🙂🙂 ok", "l'été d’été", "Straße ŒUVRE"]


def reference(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(5)
    alphabet = "abcdeéèüßABÉ .,!?'-<|>0189\n\t\"@œ"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(PATH)
    for size in (400_000, 50):
        got = packing.WordEncoder(PATH, packing.word_ranks(PATH), size).encode(texts)
        assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("window", [4096, 8])
def test_pieces(spark, window):
    rows = packing.pack(docs(spark, ODD).repartition(3), PATH, window=window).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(ODD)))
    for i, pieces in by_doc.items():
        ids, at = reference(ODD[i]), 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for k, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or k == max(by_sequence) and at <= window
    assert set(by_sequence) == set(range(len(by_sequence)))


def test_empty_and_repeated(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0
    got = packing.pack(docs(spark, ["a", "a", None], ids=[1, 1, None]), PATH).collect()
    assert sorted((r["doc_tokens"], r["doc_id"]) for r in got if r["doc_id"]) == [(2, 1), (2, 1)] and len(got) == 3
