"""Fill-in-middle transformation by displacement scatter.

A text is cut twice and its three pieces change places, each behind its mark.  For a run of texts, one scan over the bytes of
the Arrow batch finds the code points where the cuts fall; a difference array notes where the way of a byte to its place in
the output changes, its cumulative sum is that way for every byte, and one numpy scatter builds all outputs.  The inverse
reads the marks out of an output alone, makes the same kind of array for the way back, and gathers the text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
MARK = 3  # bytes of a mark
RUN_BYTES = 1 << 20


def draws(key: str, seed: str = "1") -> list[Column]:
    """h1 to h4 of a document: the first four groups of 8 hex digits of the SHA-256 of ``seed:key``; a null key reads as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls, as views of its buffers."""
    _, ends, values = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes in all; a longer text comes alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, row) of every mark that lies within one row."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], [m[1] for m in MARKS.values()])]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + MARK <= offsets[row + 1]
    return at[inside], row[inside]


def shifts(size: int, at: list[np.ndarray], way: list[np.ndarray]) -> np.ndarray:
    """The way of each of ``size`` bytes, from the ways that hold from the positions ``at`` on.

    ``at`` and ``way`` list a row's segments in order, so that of equal positions (an empty segment) the last one counts.
    """
    starts, ways = np.stack(at, axis=1).ravel(), np.stack(way, axis=1).ravel()
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(ways, prepend=0))
    return np.cumsum(change[:size])


def scatter(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs.  ``first`` and ``second`` are the byte positions of the cuts."""
    begin, end = offsets[:-1], offsets[1:]
    prefix, middle, suffix = first - begin, second - first, end - second
    moved = form != PLAIN
    out_offsets = np.concatenate([[0], np.cumsum(end - begin + 3 * MARK * moved)])
    out = np.empty(out_offsets[-1], np.uint8)
    base = out_offsets[:-1]
    # where each piece's mark stands, counted from the output's start
    mark_p, mark_s = np.where(form == SPM, MARK + suffix, 0), np.where(form == SPM, 0, MARK + prefix)
    mark_m = 2 * MARK + prefix + suffix
    way = [np.where(moved, base + mark + MARK, offset) - at for mark, at, offset in
           ((mark_p, begin, base), (mark_m, first, base + prefix), (mark_s, second, base + prefix + middle))]
    target = shifts(len(data), [begin, first, second], way)
    target += np.arange(len(data))
    out[target] = data
    for text, mark in zip(MARKS.values(), (mark_p, mark_s, mark_m)):
        for i, byte in enumerate(text):
            out[(base + mark + i)[moved]] = byte
    return out, out_offsets


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, whether it could be read) of the texts, from outputs and forms alone."""
    begin, end = offsets[:-1], offsets[1:]
    at, row = marks(data, offsets)
    moved = form != PLAIN
    at, row = at[moved[row]], row[moved[row]]
    count = np.bincount(row, minlength=len(form))
    good = ~moved | (count == 3)
    place = {}
    for letter, text in MARKS.items():
        place[letter] = begin.copy()
        hit = (data[at + 1] == text[1]) & good[row]
        good &= ~moved | (np.bincount(row[hit], minlength=len(form)) == 1)
        place[letter][row[hit]] = at[hit]
    p, s, m = (place[x] for x in "PSM")
    good &= np.select([form == PSM, form == SPM], [(p == begin) & (s < m), (s == begin) & (p < m)], True)
    read = moved & good
    prefix = np.where(read, np.where(form == SPM, m, s) - p - MARK, 0)
    suffix = np.where(read, np.where(form == SPM, p, m) - s - MARK, 0)
    middle = np.where(read, end - m - MARK, 0)
    size = np.where(read, prefix + middle + suffix, np.where(good, end - begin, 0))
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    base = out_offsets[:-1]
    here = [base, base + prefix, base + prefix + middle]
    way = [np.where(read, source, begin + h - base) - h for source, h in zip((p + MARK, m + MARK, s + MARK), here)]
    source = shifts(int(out_offsets[-1]), here, way)
    source += np.arange(len(source))
    return data[source], out_offsets, good


def _strings(data: np.ndarray, offsets: np.ndarray, good: np.ndarray | None = None) -> pa.Array:
    array = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    if good is not None and not good.all():
        array = pc.if_else(pa.array(good), array, pa.scalar(None, pa.large_string()))
    return array.cast(pa.string())


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """One row per row of ``docs``: the key, n (code points), form, prefix_chars, middle_chars, output.

    Cuts and form follow from the key and ``seed`` alone, so reruns agree, and rows of one key and text have one output.  A
    null text is empty; an empty text, and one that holds a mark already, stays plain.  Keys are carried as they are; an
    empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def move(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            data, offsets = text_bytes(rb.column("text"))
            for a, b in runs(offsets):
                own, ends = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                h = [rb.column(f"h{i}").slice(a, b - a).to_numpy() for i in (1, 2, 3, 4)]
                # the scan: where code points start, and one position behind the last
                leads = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
                base = np.searchsorted(leads[:-1], ends)
                n = np.diff(base)
                cuts = h[0] % (n + 1), h[1] % (n + 1)
                low, high = np.minimum(*cuts), np.maximum(*cuts)
                plain = (n == 0) | (h[2] % 100 >= 100 - plain_percent)
                plain[marks(own, ends)[1]] = True
                form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))
                out, out_ends = scatter(own, ends, leads[base[:-1] + low], leads[base[:-1] + high], form)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("key").slice(a, b - a), pa.array(n, pa.int64()), pa.array(FORMS).take(pa.array(form)),
                     pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), _strings(out, out_ends)],
                    ["key", "n", "form", "prefix_chars", "middle_chars", "output"])
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *draws(key, seed))
    made = given.mapInArrow(move, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("key", key)


def restore(made: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """Adds the text, rebuilt from output and form; null where the output doesn't hold its form's marks, each once, in order.

    A null output is empty, a null or unknown form is read as plain.
    """
    columns = [c for c in made.columns if c != restored]
    kinds = ", ".join(f"c{i} {made.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def back(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            data, offsets = text_bytes(rb.column("output"))
            code = rb.column("form").to_numpy()
            for a, b in runs(offsets):
                text, ends, good = gather(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], code[a:b])
                yield pa.RecordBatch.from_arrays([*[rb.column(f"c{i}").slice(a, b - a) for i in range(len(columns))], _strings(text, ends, good)],
                                                 [*[f"c{i}" for i in range(len(columns))], "restored"])
    code = F.when(F.col(form) == FORMS[PSM], PSM).when(F.col(form) == FORMS[SPM], SPM).otherwise(PLAIN)
    given = made.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.coalesce(F.col(output), F.lit("")).alias("output"), code.alias("form"))
    return given.mapInArrow(back, f"{kinds}, restored string").toDF(*columns, restored)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` and ``restore``, their texts as SHA-256."""
    done = restore(transform(docs))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{n}_sha256") for c, n in (("output", "output"), ("restored", "restored"))])


ORACLE = """
WITH given AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM given),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces"""
