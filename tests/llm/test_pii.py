"""Base spans against the contract's patterns, sums over segmentations against all of them."""
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from adlattice.llm import pii
from tests.llm.helpers import docs

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CARD = "4111 1111 1111 1111"
TEXTS = [None, "", "mail a.b@c.de, x@y and z@w.co.uk.", "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", f"card {CARD} and 4111111111111112", "+49 (30) 1234-5678 +1 2", "call (411) 555-1507 soon",
         "it is 2024-01-15 10:30, page 12 of 300", "ü" * 50 + " q@w.ee", "7536784127813050 4845168114407329", "x" * 100_000 + " 10.0.0.1", "9" * 20_000, "1 " * 20_000, "@" * 500, "a@" * 500]


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        double = [int(c) for c in d[::-1]]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(double)) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def test_base_spans():
    rng = random.Random(8)
    texts = [t for t in TEXTS if t and len(t) < 2000] + ["".join(rng.choice("a1.2@+- (5)") for _ in range(rng.randint(1, 40))) for _ in range(30_000)]
    for t in texts:
        assert pii.base_spans(t) == brute(t)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)

    def d(n):
        return "".join(rng.choice("0123456789") for _ in range(n))
    given = [(f"+1 ({d(3)}) 555-{d(4)}", " ", " ") for _ in range(60)] + [(f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", " ", " ") for _ in range(60)]
    given += [(s, " ", " ") for s in (d(16) for _ in range(400))] + [(f"u{d(2)}@mail{d(1)}.example.com", " ", " ") for _ in range(60)]
    return pii.fit(given)


def test_marginals_are_sums_over_all_segmentations(field):
    rng = np.random.default_rng(0)
    n, segs = 5, [(i, j, rng.normal(size=4)) for i, j in [(0, 2), (1, 3), (2, 5), (3, 4), (0, 5)]]
    total, mass = 0.0, np.zeros((len(segs), 4))
    for chosen in itertools.chain.from_iterable(itertools.combinations(range(len(segs)), k) for k in range(len(segs) + 1)):
        if any(segs[a][0] < segs[b][1] and segs[b][0] < segs[a][1] for a, b in itertools.combinations(chosen, 2)):
            continue
        for kinds in itertools.product(range(4), repeat=len(chosen)):
            p = math.exp(sum(segs[k][2][c] for k, c in zip(chosen, kinds)))
            total += p
            for k, c in zip(chosen, kinds):
                mass[k, c] += p
    got, z = field.marginals(n, segs)
    assert z == pytest.approx(math.log(total)) and got == pytest.approx(mass / total)


def test_method_finds_what_rules_miss(field):
    assert field.decode("(411) 555-1507") == [("phone", 0, 14)] and field.decode("411-555-1507") == [("phone", 0, 12)]
    for other in ("2024-01-15", "1999", "1 234 567", "15.01.2024", "123456789"):
        assert field.decode(other) == []


def test_long_islands_are_read_whole(field):
    """A one-line list has every number, wherever 400 characters or a block of tokens end."""
    numbers = [f"(212) 555-{k}" for k in range(1000, 1400)]
    text = "call " + " ".join(numbers)
    (a, island, left, right), = pii.islands_of(text)
    assert island == text[5:]
    got = field.decode(island, left, right)
    assert [island[i:j] for _, i, j in got] == numbers and {k for k, _, _ in got} == {"phone"}
    # the same chances as by all segments at once
    cuts, found = pii.segments(island, left, right)
    chance, _ = field.marginals(len(cuts) - 1, [(i, j, field.score(f)) for i, j, f in found])
    sure = {(pii.KINDS[k], cuts[i], cuts[j]) for (i, j, _), p in zip(found, chance) for k in range(4) if p[k] >= 0.9}
    assert set(got) == sure


def test_rows(spark):
    got = {r["doc_id"]: r for r in pii.find(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        base = brute(t) if t is None or len(t) < 2000 else pii.base_spans(t)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(map(tuple, spans)) and len(spans) == len(base) + r["n_added"]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_every_kind_has_its_share_of_the_sample(spark):
    """Where nearly all islands are e-mails, phones and cards are fitted all the same."""
    texts = [" ".join(f"u{i}x{k}@mail.example.com" for k in range(20)) for i in range(200)]
    texts += [f"call +1 (212) 555-{1000 + i} now" for i in range(30)] + [f"card {CARD}", f"no {7654321}"]
    got = pii.sample_islands(docs(spark, texts), "text", 60)
    kinds = [pii.stratum(s) for s, _, _ in got]
    assert len(got) == 60 and kinds.count("phone") >= 12 and kinds.count("card") == 1 and kinds.count("none") == 1 and kinds.count("email") >= 12
    assert pii.shares([0, 5, 100, 100], 60) == [0, 5, 27, 28] and pii.shares([1, 2], 60) == [1, 2]


def test_empty(spark):
    assert pii.find(docs(spark, [])).count() == 0
    assert {r["spans"] for r in pii.find(docs(spark, ["no data", None])).collect()} == {""}
