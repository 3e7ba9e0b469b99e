"""Packing by concatenating and cutting: two passes of prefix sums and fixed windows.

Pass 1 tokenises every partition once and writes each document's ids with its offset inside the partition.  The totals of the
partitions (one row per task) are summed up to global offsets; pass 2 reads the ids again, adds its partition's offset and cuts
at multiples of the window.  A document over a boundary leaves one record per window.  No token moves between tasks, and only
the very last sequence is not full, so padding is below one window in all.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from adlattice.session import materialise

WINDOW = 4096
SEPARATOR = 2


def word_ranks(path: str) -> tuple[list[bytes], list[int], list[bool]]:
    """The vocabulary for the fast path: tokens in order of merging (single symbols first), their ids, and which end a word.

    A token is left out unless the merges, applied to its own text, end in it alone.  Then merging by the rank of the result
    and merging by the rank of the pair agree: wherever two symbols could form a token, its text lies between boundaries that
    were never crossed, so the merges inside went as they go in the token's text, and its own two parts are what is there.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab, pair = model["vocab"], {m: i for i, m in enumerate(merges)}
    rank = {a + b: i for (a, b), i in pair.items()}
    # the usual printable names of the 256 bytes
    named = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in named} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in named)}

    def raw(token: str) -> bytes:
        return bytes(value[c] for c in token.removesuffix("</w>")) + (b"\0" if token.endswith("</w>") else b"")

    def own(token: str) -> bool:
        symbols = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            symbols[-1] += "</w>"
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: pair.get((symbols[i], symbols[i + 1]), len(pair)))
            if (symbols[best], symbols[best + 1]) not in pair:
                return False
            symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols[0] == token
    tokens = [t for t in vocab if len(t.removesuffix("</w>")) == 1 or t in rank and own(t)]
    tokens.sort(key=lambda t: (rank.get(t, -1), not t.endswith("</w>"), vocab[t]))
    return [raw(t) for t in tokens], [vocab[t] for t in tokens], [t.endswith("</w>") for t in tokens]


class WordEncoder:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as little-endian unsigned 32-bit bytes.

    For vocabularies that drop white space, lower the case and end words with ``</w>``.  A text is cut at blanks and line
    feeds, which no id crosses, and each chunk is encoded once while the memo lasts.  Chunks of Latin-1 letters, perhaps with
    plain punctuation behind, are merged by ``tiktoken`` (see ``word_ranks``): the last byte and an end mark form one symbol.
    All other chunks go through the tokenizer itself.
    """

    PUNCTUATION = ".,!?;:*$%&#|()-"

    def __init__(self, path: str, ranks: tuple[list[bytes], list[int], list[bool]], memo_size: int = 400_000):
        self.path, self.memo_size = path, memo_size
        self.memo: dict[str, bytes] = {"": b""}
        self.tokenizer = None
        tokens, ids, ends = ranks
        table = {t: i for i, t in enumerate(tokens)} | {b"\0": len(tokens)}
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=table, special_tokens={})
        self.ids, self.ends = np.array([*ids, 0], dtype="<u4"), np.array([*ends, False])

    def _slow(self, chunk: str) -> bytes:
        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain, stems, tails = [], {}, {"": b""}
        for c in chunks:
            stem = c if c.isalpha() else c.rstrip(self.PUNCTUATION)
            if stem.isalpha() and latin(stem):
                tail = c[len(stem):]
                if tail not in tails:
                    tails[tail] = self._slow(tail)
                low = stem.lower()
                stems[low] = b""
                plain.append((c, low, tail))
            else:
                out[c] = self._slow(c)
        if stems:
            got = np.array(self.fast.encode_ordinary("\0".join(stems) + "\0"), dtype=np.int64)
            ids = self.ids[got].tobytes()
            cut = (np.flatnonzero(self.ends[got]) * 4 + 4).tolist()
            stems = dict(zip(stems, map(ids.__getitem__, map(slice, [0, *cut[:-1]], cut))))
        out.update([(c, stems[low] + tails[tail]) for c, low, tail in plain])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [(t.lower() if latin(t) else t).replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.memo.get, ws)) for ws in split]
        fresh = {w for ws, got in zip(split, found) if None in got for w, b in zip(ws, got) if b is None}
        if fresh:
            learnt = self._learn(fresh)
            for i, (ws, got) in enumerate(zip(split, found)):
                if None in got:
                    found[i] = [learnt[w] if b is None else b for w, b in zip(ws, got)]
            if len(self.memo) + len(learnt) > self.memo_size:
                self.memo = {"": b""}
            self.memo.update(learnt)
        return [b"".join(got) for got in found]


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where lowering the case is one to one and nothing composes."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def batches(column: list, chars: int = 1_000_000) -> Iterator[list]:
    """Runs of (index, text) of bounded length in all; a longer text comes alone."""
    run, size = [], 0
    for i, t in enumerate(column):
        if run and size + len(t or "") > chars:
            yield run
            run, size = [], 0
        run.append((i, t or ""))
        size += len(t or "")
    if run:
        yield run


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", separator: int = SEPARATOR) -> DataFrame:
    """(key, part, start in its partition, ids as bytes) of every document, the separator included."""
    kind = docs.schema[key].dataType.simpleString()
    last = separator.to_bytes(4, "little")
    ranks = word_ranks(path)

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part, start = WordEncoder(path, ranks), TaskContext.get().partitionId(), 0
        for rb in rows:
            # a few texts at a time, so a batch of long ones is never held as Python objects at once
            for row, run in ((at, run) for at in range(0, rb.num_rows, 256) for run in batches(rb.column(1).slice(at, 256).to_pylist())):
                ids = [b + last for b in encoder.encode([t for _, t in run])]
                starts = []
                for b in ids:
                    starts.append(start)
                    start += len(b) // 4
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(row + run[0][0], len(run)), pa.array([part] * len(run), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                    ["key", "part", "start", "ids"])
        pa.default_memory_pool().release_unused()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, f"key {kind}, part int, start bigint, ids binary")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and leaves its separator only, so every document has a piece.  Keys are carried as they are, null and
    repeated ones too; repeated rows are packed as often as they come.  An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    written = materialise(tokenised(docs, path, key, text, separator))
    totals = written.groupBy("part").agg(F.max(F.col("start") + F.length("ids") / 4).cast("bigint").alias("total"))
    # one row per task of pass 1, which the driver tracks as well: bounded, so the sums may meet in one task and be broadcast
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(run), F.lit(0)).alias("base"))
    placed = written.join(F.broadcast(offsets), "part").select("key", (F.col("base") + F.col("start")).alias("at"), "ids")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            take, cols = [], [[] for _ in range(6)]
            for i, (at, ids) in enumerate(zip(rb.column(1).to_pylist(), rb.column(2).to_pylist())):
                n, start = len(ids) // 4, 0
                while start < n:
                    seq, offset = divmod(at + start, window)
                    size = min(window - offset, n - start)
                    take.append(i)
                    for c, v in zip(cols, (start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), n, seq, offset)):
                        c.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]],
                                             [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    longs = ", ".join(f"{c} bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return placed.mapInArrow(cut, f"`{key}` {kind}, {longs}")
