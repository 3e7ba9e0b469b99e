"""Term scan: an automaton over a term table runs once along every text.

All terms of a slice form one trie over UTF-8 bytes.  Failure links are folded into the transition table level by level, so a
step is one look-up whatever the number of terms.  Text is cut into strips that overlap by the longest term, and all strips
of a run advance together, a column of bytes at a time; a line of any length is many strips.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SLICE_BYTES = 100_000  # of terms in one automaton: its table has at most this many rows of 256 steps
MAX_SLICES = 8
RUN_BYTES = 1 << 20
STRIP = 2048


class Automaton:
    """Distinct, non-empty terms without a line feed, as bytes."""

    def __init__(self, terms: list[bytes]):
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        used = sorted(set(b"".join(terms)))
        self.kind = np.zeros(256, np.uint8 if len(used) < 256 else np.int16)  # 0: a byte of no term
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, term in enumerate(terms):
            node = 0
            for byte in term:
                step = children[node]
                if byte not in step:
                    step[byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = step[byte]
            ends[node] = number
        self.ends = np.array(ends, np.int64)
        self.table = np.zeros((len(children), len(used) + 1), np.int32)
        self.link = np.zeros(len(children), np.int32)  # the longest proper suffix that is a term, 0 if none
        fail, level = np.zeros(len(children), np.int32), [0]
        while level:
            edges = [(a, self.kind[byte], b) for a in level for byte, b in children[a].items()]
            level = [b for _, _, b in edges]
            if not edges:
                break
            above, kind, below = (np.array(c, np.int64) for c in zip(*edges))
            # a node's row is its suffix's row, with its own children on top
            fail[below] = np.where(above == 0, 0, self.table[above, kind])
            self.table[above, kind] = below
            self.link[below] = np.where(self.ends[fail[below]] >= 0, fail[below], self.link[fail[below]])
            self.table[below] = self.table[fail[below]]
        self.hit = (self.ends >= 0) | (self.link > 0)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, term) of every occurrence in ``data``, ends exclusive."""
        warm = self.longest - 1
        strip = max(STRIP, 4 * warm)
        rows = -(-len(data) // strip)
        kinds = np.zeros(warm + rows * strip, self.kind.dtype)
        kinds[warm:warm + len(data)] = self.kind[data]
        columns = np.lib.stride_tricks.as_strided(kinds, (rows, warm + strip), (strip * kinds.itemsize, kinds.itemsize)).T
        state, seen = np.zeros(rows, np.int32), np.empty((strip, rows), np.int32)
        for i, column in enumerate(np.ascontiguousarray(columns)):
            state = self.table[state, column]
            if i >= warm:
                seen[i - warm] = state
        at = np.flatnonzero(self.hit[seen.T.ravel()])
        state = seen.T.ravel()[at]
        ends, terms = [], []
        while len(at):
            here = self.ends[state] >= 0
            ends.append(at[here] + 1)
            terms.append(self.ends[state[here]])
            state = self.link[state]
            at, state = at[state > 0], state[state > 0]
        return np.concatenate(ends or [np.zeros(0, np.int64)]), np.concatenate(terms or [np.zeros(0, np.int64)])


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(sizes):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), RUN_BYTES, "right")))
        yield a, b
        a = b


def _hits(auto: Automaton, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, line from 0, term, line's start, line's end) of every line that holds a term, once each."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    end, term = auto.find(data)
    text = np.searchsorted(first, end - 1, "right") - 1
    # a match may have begun in the text before
    own = end - auto.lengths[term] >= first[text]
    end, term, text = end[own], term[own], text[own]
    feeds = np.flatnonzero(data == 10)
    before = np.searchsorted(feeds, end)
    line = before - np.searchsorted(feeds, first[text])
    _, keep = np.unique(np.stack([text, line, term], axis=1), axis=0, return_index=True)
    text, line, term, before = text[keep], line[keep], term[keep], before[keep]
    start = np.maximum(first[text], np.append(feeds, 0)[before - 1] + 1 if len(feeds) else 0)
    start = np.where(before > 0, start, first[text])
    stop = np.minimum(first[text + 1], np.append(feeds, len(data))[before])
    return text, line, term, start, stop


def _scan(texts: DataFrame, key: str, terms: list[str], with_line: bool) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    words = sorted(t for t in set(terms) if "\n" not in t)

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, names = Automaton([w.encode() for w in words]), pa.array(words, pa.string())
        for rb in rows:
            sizes = pc.binary_length(rb.column(1)).to_numpy(zero_copy_only=False)
            for a, b in _runs(sizes):
                own = [t.as_py() for t in rb.column(1).slice(a, b - a)]
                text, line, term, start, stop = _hits(auto, own)
                whole = b"".join(own) if with_line else b""
                lines = [whole[i:j].decode() for i, j in zip(start.tolist(), stop.tolist())] if with_line else None
                columns = [rb.column(0).take(pa.array(text + a)), pa.array(line + 1, pa.int32()), names.take(pa.array(term))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.string()) if with_line else pa.nulls(len(text), pa.string())], ["key", "line_no", "term", "line"])
    if not words:
        return texts.sparkSession.createDataFrame([], f"`{key}` {kind}, line_no int, term string, line string")
    given = texts.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = given.mapInArrow(scan, f"key {kind}, line_no int, term string, line string")
    return found.select(F.col("key").alias(key), "line_no", "term", F.trim("line").alias("line"))


def _lines(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _scan_seeds(texts: DataFrame, terms: DataFrame, key: str, seed: int = 12) -> DataFrame:
    """For term tables beyond a few automata: an equi-join on a term's first characters, then the exact test."""
    seeded = terms.withColumn("_seed", F.substring("term", 1, seed))
    lengths = [r[0] for r in seeded.select(F.length("_seed")).distinct().collect()]  # at most ``seed`` numbers
    lines = _lines(texts, key)

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("line") - n + 1)
        cut = F.transform(starts, lambda i: F.substring(F.col("line"), i, F.lit(n)))
        return F.when(F.length("line") >= n, cut).otherwise(F.array().cast("array<string>"))
    runs = F.flatten(F.array(*[runs_of(n) for n in lengths]))
    offered = lines.select(key, "pos", F.explode(F.array_distinct(runs)).alias("_seed"))
    near = offered.join(seeded, "_seed").select(key, "pos", "term")
    return (near.join(lines, [key, "pos"]).filter(F.contains("line", F.col("term")))
            .select(key, (F.col("pos") + 1).alias("line_no"), "term", F.trim("line").alias("line")))


def scan_term_table(texts: DataFrame, terms: DataFrame, key: str, with_line: bool = True, slice_bytes: int = SLICE_BYTES, max_slices: int = MAX_SLICES) -> DataFrame:
    """Lines that contain a term of a table: key, line number from 1, term, trimmed line (null without ``with_line``).

    Terms are dealt to automata of about ``slice_bytes``, each of which travels with the scan; a table that needs more than
    ``max_slices`` of them meets the lines in a join instead, with the same rows.  Empty and null terms, and null texts, match
    nothing; a term with a line feed is in no line.
    """
    known = terms.filter(F.length("term") > 0).select("term").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    if slices > max_slices:
        return _scan_seeds(texts, known, key)
    out = None
    for i in range(slices):
        own = [r["term"] for r in known.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == i).collect()]
        part = _scan(texts, key, own, with_line)
        out = part if out is None else out.unionByName(part)
    return out
