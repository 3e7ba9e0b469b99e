"""Best-fit packing by best-two-fit, planned over the histogram of piece lengths.

Pieces of one length are alike, so a plan needs only how many there are of each length: at most ``window`` numbers, however
many documents.  A bin is filled greedily, the longest piece that fits first; then its smallest piece gives way to the two
unpacked pieces that fill the widened gap more tightly, if there are such.  The bin repeats as long as its pieces last, so the
plan has a few thousand lines at any size and equals filling bin after bin.  Pieces find their line by exact rank within their
length, from two passes of counts over partitions; no token moves between tasks and no group meets in one.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from adlattice.llm.lengths import encoding, read_ranks
from adlattice.llm.packing import batches
from adlattice.session import materialise

WINDOW = 1024
SEPARATOR = 2
RANK_BITS = 44


class ByteEncoder:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)`` for a byte-level vocabulary.

    ``tiktoken`` with the same vocabulary as ranks encodes texts of Latin letters and general punctuation, whose classes no
    version of Unicode moves; others, and texts that spell a special token, go through the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: dict[bytes, int], pattern: str, special: list[str]):
        self.tokenizer, self.fast, self.slow = tokenizer, encoding(ranks, pattern), None
        self.other = re.compile("|".join(["[^\u0000-ɏ‐-⁞€]", *map(re.escape, special)]))

    def encode(self, text: str) -> list[int]:
        if not self.other.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            self.slow = Tokenizer.from_str(self.tokenizer)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, crc, part, local) of every piece and, if asked, its ids; ``local`` numbers the pieces of one
    length in a task.

    A document's ids end with the separator.  Longer ones are cut into pieces of ``window``, the first one may be shorter.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = read_ranks(ranks)
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    special = [t.content for t in Tokenizer.from_str(content).get_added_tokens_decoder().values()]
    shape = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part, seen = ByteEncoder(content, table, pattern, special), TaskContext.get().partitionId(), Counter()
        for rb in rows:
            for at in range(0, rb.num_rows, 256):
                for run in batches(rb.column(1).slice(at, 256).to_pylist()):
                    take, out = [], []
                    for i, t in run:
                        ids = np.array([*encoder.encode(t), separator], dtype="<u4")
                        n = len(ids)
                        ends = range(n % window or window, n + 1, window) if n > window else (n,)
                        start = 0
                        for piece, end in enumerate(ends):
                            own = ids[start:end].tobytes()
                            take.append(at + i)
                            out.append((piece, start, end - start, zlib.crc32(own), part, seen[end - start], *([own] if with_ids else [])))
                            seen[end - start] += 1
                            start = end
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*out), shape)]
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(take, pa.int64())), *columns], ["key", *shape.names])
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(cut, f"key {kind}, piece int, start bigint, length int, crc bigint, part int, local bigint{', ids binary' if with_ids else ''}"))


def plan(counts: dict[int, int], window: int) -> list[tuple[list[int], int]]:
    """Bins as (piece lengths, how often), from the number of pieces of each length up to ``window``."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths, out = np.arange(window + 1), []
    while left.any():
        free = left.copy()  # what is unpacked beside the bin that is filled
        longest = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        bin, gap = [], window
        while size := int(longest[gap]):
            n = min(gap // size, int(free[size]))
            bin += [size] * n
            free[size] -= n
            gap -= n * size
            longest = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        if gap and (pair := two_for_one(free, longest, bin[-1], gap)):
            free[list(pair)] -= 1 if pair[0] != pair[1] else 2
            free[bin[-1]] += 1
            bin[-1:] = pair
        uses = Counter(bin)
        times = min(int(left[size]) // n for size, n in uses.items())
        for size, n in uses.items():
            left[size] -= n * times
        out.append((bin, times))
    return out


def two_for_one(free: np.ndarray, longest: np.ndarray, smallest: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill the gap without ``smallest`` best, if they fill it better; of ties the longest first."""
    room = gap + smallest
    first = np.flatnonzero(free[:room + 1] > 0)
    if not len(first):
        return None
    reach = np.minimum(first, room - first)
    second = longest[reach]
    # a length that is there once can't be its own partner
    alone = (second == first) & (free[first] < 2)
    second[alone] = longest[first[alone] - 1]
    total = np.where(second > 0, first + second, 0)
    best = len(total) - 1 - int(total[::-1].argmax())
    return (int(first[best]), int(second[best])) if total[best] > smallest else None


def slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted lines: ranks of ``length`` from ``rank`` on take one sequence each from ``sequence`` on, at ``offset``."""
    used, sequence, rows = Counter(), 0, []
    for bin, times in bins:
        offset = 0
        for size in bin:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    rows.sort()
    size, rank, first, offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else ([],) * 4))
    return {"at": (size << RANK_BITS) | rank, "sequence": first, "offset": offset}


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` its ids as bytes.

    A null text is empty and leaves its separator only, so every document has a piece.  Keys are carried as they are, null and
    repeated ones too; repeated rows are packed as often as they come.  An empty table gives no rows.  Pieces of one length
    are told apart by the order in which pass 1 wrote them.
    """
    written = materialise(pieces(docs, tokenizer, ranks, pattern, key, text, window, separator, with_ids))
    by_part = materialise(written.groupBy("part", "length").agg(F.count("*").alias("n")))
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n"))
    # at most one row per length: the window bounds what the driver reads and what the plan holds
    lines = slots(plan({r["length"]: r["n"] for r in totals.collect()}, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = written.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("part", "base", "local")
    columns = [c for c in ranked.columns if c != "rank"]

    def seat(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            place = (rb.column("length").to_numpy().astype(np.int64) << RANK_BITS) | rb.column("rank").to_numpy()
            line = np.searchsorted(lines["at"], place, "right") - 1
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in columns], pa.array(lines["sequence"][line] + place - lines["at"][line]), pa.array(lines["offset"][line])],
                                             [*columns, "sequence_id", "offset"])
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    seated = ranked.mapInArrow(seat, f"{kinds}, sequence_id bigint, offset bigint")
    return seated.select(F.col("key").alias(key), "piece", "start", F.col("length").cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *(["ids"] if with_ids else []))
