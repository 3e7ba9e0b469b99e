"""Personal data: fixed rules plus a semi-Markov conditional random field over whole candidate spans.

The rules give the base spans.  Around digits and "@" a text has islands, runs of characters that personal data is made of; all
else is outside.  In an island the field scores whole segments, not characters: digit count, group lengths, separators, check
digit, number ranges, neighbours.  Dynamic programming over segments of bounded length chooses boundaries and types jointly; a
segment whose type is certain enough is added where it meets no base span.

The field is trained at run time on a bounded sample of islands, labelled by the rules, half of them rewritten to forms the
rules do not know (numbers without country code, other separators), so that span features rather than one marker carry the type.
"""
from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlattice.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment; tokens whose segments are held at a time; characters of a piece that is fitted.
MAX_TOKENS, BLOCK_TOKENS, PIECE_CHARS = 16, 256, 400
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
ISLAND = re.compile(r"[^\s@]{1,64}@[^\s@]{1,255}|[+(]*[0-9][0-9 ().+-]*")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: a local part reaches back from its "@" as far as its characters or the last match go."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            m = DOMAIN.match(text, at + 1)
            if m is not None:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or int(p[-20:]) <= 255 and not p[:-20].strip("0") for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def features(s: str, left: str, right: str) -> list[str]:
    """Features of a whole span; ``left`` and ``right`` are its neighbours."""
    d, groups = digits_of(s), re.findall("[0-9]+", s)
    lengths = [str(len(g)) for g in groups]
    seps = "".join(sorted(set(re.findall("[^0-9A-Za-z]", s))))
    out = ["bias", f"digits={min(len(d), 20)}", f"groups={min(len(groups), 6)}", "tail=" + "-".join(lengths[-3:]), "seps=" + seps[:6],
           "first=" + ("d" if s[0].isdigit() else "a" if s[0].isalpha() else s[0]), "last=" + ("d" if s[-1].isdigit() else "a" if s[-1].isalpha() else s[-1])]
    if "@" in s:
        out.append("at=" + str(bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s))))
    if 13 <= len(d) <= 19 and not re.search("[^0-9 -]", s):
        out.append(f"luhn={luhn(d)}")
    if s.count("(") != s.count(")"):
        out.append("open parenthesis")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
        out.append(f"quad={all(int(g) <= 255 for g in groups)}")
    if "  " in s or "--" in s or ".." in s:
        out.append("double separator")
    if left.isalnum() or right.isalnum():
        out.append("glued")
    return out


def candidate(s: str) -> bool:
    """Spans worth scoring: they start and end like an entity, and hold "@" or 7 to 19 digits."""
    if "@" in s:
        return s[0] in LOCAL and s[-1].isalnum()
    return (s[0].isdigit() or s[0] in "+(") and s[-1].isdigit() and 7 <= len(digits_of(s)) <= 19


def tokens_of(island: str) -> list[int]:
    """Token starts, and the end."""
    return [m.start() for m in TOKEN.finditer(island)] + [len(island)]


def segments(island: str, left: str, right: str, cuts: list[int] | None = None, first: int = 0, last: int | None = None) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """``cuts``, and (first token, end token, features) of all candidates of at most ``MAX_TOKENS`` that start in [first, last)."""
    cuts = tokens_of(island) if cuts is None else cuts
    n, plain, out = len(cuts) - 1, "@" not in island, []
    for i in range(first, n if last is None else min(last, n)):
        if plain and not (island[cuts[i]].isdigit() or island[cuts[i]] in "+("):
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
            s = island[cuts[i]:cuts[j]]
            if candidate(s):
                out.append((i, j, features(s, island[cuts[i] - 1] if i else left, island[cuts[j]] if j < n else right)))
    return cuts, out


class Field:
    """Weights of (feature, kind); a token outside of all segments scores 0."""

    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.index, self.weights = index, weights

    def score(self, feats: list[str]) -> np.ndarray:
        return self.weights[[self.index[f] for f in feats if f in self.index]].sum(axis=0)

    def marginals(self, n: int, segs: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, float]:
        """Probability of every (segment, kind), by sums over all segmentations."""
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        ends: dict[int, list] = {}
        starts: dict[int, list] = {}
        for k, (i, j, s) in enumerate(segs):
            total = float(np.logaddexp.reduce(s))
            ends.setdefault(j, []).append((i, total))
            starts.setdefault(i, []).append((j, total))
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[i] + t for i, t in ends.get(j, ())]])
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *[back[j] + t for j, t in starts.get(i, ())]])
        z = float(ahead[n])
        return np.array([np.exp(np.minimum(ahead[i] + s + back[j] - z, 0.0)) for i, j, s in segs]).reshape(len(segs), len(KINDS)), z

    def decode(self, island: str, left: str = " ", right: str = " ", sure: float = 0.9) -> list[tuple[str, int, int]]:
        """The best segmentation's segments whose probability is at least ``sure``, over the whole island.

        Sums and best scores run through all tokens, forward and then backward; only segments are made a block of starts at a
        time, so an island of any length has no boundary inside and needs a few numbers a token.
        """
        cuts = tokens_of(island)
        n = len(cuts) - 1
        held: tuple[int, list] = (-1, [])

        def block(at: int) -> list[tuple[int, int, np.ndarray]]:
            nonlocal held
            if held[0] != at:
                held = at, [(i, j, self.score(f)) for i, j, f in segments(island, left, right, cuts, at, at + BLOCK_TOKENS)[1]]
            return held[1]

        # forward: a segment adds to its end once all that end at its start are known
        ahead, best, pick, any_found = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), {}, False
        ahead[0] = best[0] = 0.0
        starts = range(0, n, BLOCK_TOKENS)
        for at in starts:
            by: dict[int, list] = {}
            for i, j, s in block(at):
                by.setdefault(i, []).append((j, s))
                any_found = True
            for i in range(at, min(at + BLOCK_TOKENS, n)):
                if best[i] >= best[i + 1]:
                    best[i + 1] = best[i]
                    pick.pop(i + 1, None)
                ahead[i + 1] = np.logaddexp(ahead[i + 1], ahead[i])
                for j, s in by.get(i, ()):
                    ahead[j] = np.logaddexp(ahead[j], ahead[i] + np.logaddexp.reduce(s))
                    top = int(s.argmax())
                    if best[i] + s[top] > best[j]:
                        best[j], pick[j] = best[i] + s[top], (i, top)
        if not any_found:
            return []
        chosen, j = {}, n
        while j > 0:
            if j in pick:
                i, kind = pick[j]
                chosen[i] = j, kind
                j = i
            else:
                j -= 1
        back, out = np.full(n + 1, -np.inf), []
        back[n] = 0.0
        for at in reversed(starts):
            by = {}
            for i, j, s in block(at):
                by.setdefault(i, []).append((j, s))
            for i in range(min(at + BLOCK_TOKENS, n) - 1, at - 1, -1):
                back[i] = back[i + 1]
                for j, s in by.get(i, ()):
                    back[i] = np.logaddexp(back[i], back[j] + np.logaddexp.reduce(s))
                    if i in chosen and chosen[i][0] == j:
                        kind = chosen[i][1]
                        if math.exp(min(ahead[i] + s[kind] + back[j] - ahead[n], 0.0)) >= sure:
                            out.append((KINDS[kind], cuts[i], cuts[j]))
        return out[::-1]


def rewritten(island: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]] | None:
    """The island's only span in another form, alone."""
    kind, a, b = spans[0]
    s = island[a:b]
    if kind == "phone":
        s = re.sub(r"^\+[0-9]{1,3}[ .-]?(?=.*[0-9]{3})", "", s)
        s = rng.choice([s, s.replace("(", "").replace(")", ""), re.sub(r"[()]", "", s).replace(" ", "-"), re.sub(r"[() -]+", ".", s).strip(".")])
        if not 10 <= len(digits_of(s)) <= 15:
            return None
    elif kind == "card":
        d = digits_of(s)
        s = rng.choice([" ", "-"]).join(d[i:i + 4] for i in range(0, len(d), 4))
    else:
        return None
    return s, [(kind, 0, len(s))]


def other_numbers(rng: random.Random) -> str:
    """A number that is nobody's: a date, a time, an amount, years, an article number."""
    def n(lo: int, hi: int) -> int:
        return rng.randint(lo, hi)
    year, month, day = n(1900, 2099), n(1, 12), n(1, 28)
    return rng.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year}-{month:02}-{day:02} {n(0, 23):02}", f"{year}{month:02}{day:02}",
                       f"{year}-{year + n(1, 9)}", f"{n(1, 99)}.{n(100, 999)}.{n(100, 999)}", f"{n(1, 99)} {n(100, 999)} {n(100, 999)}", f"{year} {year + 1} {year + 2}",
                       f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{n(1000000, 999999999)}", f"({year}) {n(10, 99)}-{n(100, 999)}"])


def fit(islands: list[tuple[str, str, str]], passes: int = 12, rate: float = 0.5, decay: float = 1e-3, seed: int = 7) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps, in a fixed order from ``seed``."""
    rng, examples = random.Random(seed), []
    for text, left, right in islands:
        spans = base_spans(text)
        examples.append((text, left, right, spans))
        if len(spans) == 1 and (other := rewritten(text, spans, rng)):
            examples.append((other[0], " ", " ", other[1]))
    if examples:
        examples += [(other_numbers(rng), " ", " ", []) for _ in range(300)]
    index: dict[str, int] = {}
    data = []
    for text, left, right, spans in examples:
        cuts, found = segments(text, left, right)
        gold = {(a, b): KINDS.index(k) for k, a, b in spans}
        rows = [(i, j, np.array([index.setdefault(f, len(index)) for f in feats]), gold.get((cuts[i], cuts[j]), -1)) for i, j, feats in found]
        if rows:
            data.append((len(cuts) - 1, rows))
    field = Field(index, np.zeros((max(len(index), 1), len(KINDS))))
    squares = np.full_like(field.weights, 1e-6)
    for _ in range(passes):
        rng.shuffle(data)
        for n, rows in data:
            chance, _ = field.marginals(n, [(i, j, field.weights[f].sum(axis=0)) for i, j, f, _ in rows])
            for (_, _, f, kind), p in zip(rows, chance):
                g = -p
                if kind >= 0:
                    g[kind] += 1.0
                if np.abs(g).max() > 1e-3:
                    step = g - decay * field.weights[f]
                    squares[f] += step ** 2
                    field.weights[f] += rate * step / np.sqrt(squares[f] + 1.0)
    return field


def islands_of(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, island, left and right neighbour) of whole islands."""
    if DIGIT.search(text) is None and "@" not in text:
        return
    for m in ISLAND.finditer(text):
        a, b = m.span()
        yield a, m[0], text[a - 1:a] or " ", text[b:b + 1] or " "


def pieces_of(text: str) -> Iterator[tuple[str, str, str]]:
    """(piece, left and right neighbour) to learn from: islands, long ones cut at a blank of the last ``PIECE_CHARS`` or inside a token."""
    for start, island, _, _ in islands_of(text):
        a, b = start, start + len(island)
        while a < b:
            end = min(b, a + PIECE_CHARS)
            if end < b:
                space = text.rfind(" ", a + 1, end)
                end = space if space > a else end
            yield text[a:end], text[a - 1:a] or " ", text[end:end + 1] or " "
            a = end


def stratum(piece: str) -> str:
    """The kind a piece is drawn as: the first of these that the rules find in it, or none."""
    kinds = {k for k, _, _ in base_spans(piece)}
    return next((k for k in ("phone", "card", "ip", "email") if k in kinds), "none")


def shares(sizes: list[int], total: int) -> list[int]:
    """How many to take of each: alike, and what a small one leaves goes to the others."""
    out, left = [0] * len(sizes), total
    for k, at in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[at] = min(sizes[at], left // (len(sizes) - k))
        left -= out[at]
    return out


def sample_islands(docs: DataFrame, text: str, size: int) -> list[tuple[str, str, str]]:
    """At most ``size`` distinct pieces of islands with 7 digits or "@", from all documents: of every kind the rules find, and of
    pieces without one, those whose hashes are least."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for at in range(0, rb.num_rows, 500):
                found = {(s, left, right) for t in rb.slice(at, 500).column(0).to_pylist() for s, left, right in pieces_of(t or "") if "@" in s or len(digits_of(s)) >= 7}
                ranked = sorted((hashlib.blake2b("\0".join(x).encode("utf-8", "replace"), digest_size=8).hexdigest(), stratum(x[0]), *x) for x in found)
                if ranked:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*ranked)], ["rank", "kind", "island", "before", "after"])
    found = materialise(docs.select(F.col(text)).mapInArrow(work, "rank string, kind string, island string, before string, after string").distinct())
    order = ["rank", "island", "before", "after"]
    drawn = [[(r["island"], r["before"], r["after"]) for r in found.where(F.col("kind") == k).orderBy(*order).limit(size).collect()] for k in (*KINDS, "none")]
    return [x for some, n in zip(drawn, shares([len(d) for d in drawn], size)) for x in some[:n]]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 1_500, sure: float = 0.9) -> DataFrame:
    """One row per document: ``key``, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans and n_added of all.

    A null or empty text has no spans: counts 0, the hash of an empty string, spans ''.  Keys may repeat or be null; an empty
    table gives no rows.  At most ``sample`` islands are fitted, of every kind alike.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(sample_islands(docs, text, sample)))
    kind = docs.schema[key].dataType.simpleString()

    def joined(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for rb in rows:
            for at in range(0, rb.num_rows, 1000):
                part = rb.slice(at, 1000)
                out = []
                for t in part.column(1).to_pylist():
                    base = base_spans(t) if t else []
                    added = []
                    if t:
                        taken = sorted((a, b) for _, a, b in base)
                        # the furthest end of the spans up to each
                        reach = list(accumulate((b for _, b in taken), max))

                        def free(i: int, j: int) -> bool:
                            before = bisect_left(taken, (j,))
                            return not before or reach[before - 1] <= i
                        for a, s, left, right in islands_of(t):
                            added += [(k, a + i, a + j) for k, i, j in model.decode(s, left, right, sure) if free(a + i, a + j)]
                    n = [sum(k == x for k, _, _ in base) for x in KINDS]
                    spans = sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1]))
                    out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(added)))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4]), pa.array(cols[5]), pa.array(cols[6], pa.int64())],
                                                 [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
