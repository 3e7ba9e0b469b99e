"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Every partition sends the owners of the fingerprint space its distinct fingerprints, sorted and Golomb-Rice coded.
2. An owner merges the messages of its range and returns one bitmap per message: which fingerprints another partition has too.
3. Only rows that are marked so, or repeated within their partition, move: their normalised texts are compared byte by byte.

Each partition sends a fingerprint once and each text of a group once, however many copies it holds, so a group with a third
of all rows puts at most one row per partition into a task.  Short fingerprints only cost more suspects, never a wrong answer.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from adlattice.llm import codec
from adlattice.llm.rows import bit_words, bitmaps, is_set, keep, place, stripped
from adlattice.session import materialise


def suspects(table: DataFrame, fp_bits: int, owner_bits: int) -> DataFrame:
    """(``part``, ``words``): rows of the placed table whose fingerprint ``fp`` occurs on another row, as bitmaps."""
    shift = fp_bits - owner_bits

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy().astype(np.uint64))
        owners = (fps >> np.uint64(shift)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        ends = np.append(starts[1:], len(fps))
        low = fps & np.uint64((1 << shift) - 1)
        return pd.DataFrame({"owner": owners[starts], "part": np.int32(key[0]), "n": ends - starts,
                             "payload": [codec.encode(low[a:b]) for a, b in zip(starts, ends)]})

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        parts = [codec.decode(p, n) for p, n in zip(pdf["payload"], pdf["n"])]
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = (counts > 1)[inverse]
        cuts = np.cumsum(pdf["n"].to_numpy())[:-1]
        return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "n": pdf["n"],
                             "bits": [np.packbits(x).tobytes() for x in np.split(shared, cuts)]})

    def mark(key: tuple, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        _, inverse, counts = np.unique(rows["fp"].to_numpy().astype(np.uint64), return_inverse=True, return_counts=True)
        got = got.sort_values("owner")
        shared = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(got["bits"], got["n"])]
        hit = (np.concatenate(shared).astype(bool) | (counts > 1))[inverse]
        return pd.DataFrame({"part": [np.int32(key[0])], "words": [bit_words(rows["pos"].to_numpy()[hit])]})

    light = table.select("part", "pos", "fp")
    sent = light.groupBy("part").applyInPandas(send, "owner bigint, part int, n bigint, payload binary")
    back = sent.groupBy("owner").applyInPandas(answer, "part int, owner bigint, n bigint, bits binary")
    return light.groupBy("part").cogroup(back.groupBy("part")).applyInPandas(mark, "part int, words array<bigint>")


def place_texts(docs: DataFrame, text: str = "text", fp_bits: int = 48) -> DataFrame:
    """Placed rows with ``sha`` (of the normalised text), its first ``fp_bits`` bits ``fp``, and ``size`` in code points."""
    sha = F.sha2(stripped(text), 256)
    return place(docs, sha=F.unhex(sha), size=F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"),
                 fp=F.shiftrightunsigned(F.conv(F.substring(sha, 1, 12), 16, 10).cast("bigint"), 48 - fp_bits))


def groups(table: DataFrame, key: str, text: str = "text", fp_bits: int = 48) -> DataFrame:
    """Groups of equal texts, one row per group and partition: (part, sha, keep_key, keep_part, keep_pos, group_size).

    Groups of one row are left out.  The longest original text stays, then the smallest non-null ``key``, then the first
    place.  Two texts with one SHA-256 would fail the byte comparison and end the job with an error.
    """
    owner_bits = max(2, min(fp_bits - 1, (int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    marked = table.join(suspects(table, fp_bits, owner_bits), "part").where(is_set("words", "pos"))
    rank = F.struct((-F.col("size")).alias("short"), F.col(f"row.`{key}`").isNull().alias("none"), F.col(f"row.`{key}`").alias("key"), "part", "pos")
    local = (marked.select("part", "sha", stripped(F.col(f"row.`{text}`")).alias("body"), rank.alias("best"))
             .groupBy("part", "sha").agg(F.count("*").alias("n"), F.min("best").alias("best"), F.min("body").alias("low"), F.max("body").alias("high")))
    local = materialise(local)
    whole = local.groupBy("sha").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = whole.where(F.when(F.col("low") == F.col("high"), F.col("group_size") > 1).otherwise(F.raise_error(F.lit("different texts with one SHA-256"))))
    return (local.select("part", "sha").join(whole.select("sha", "group_size", "best"), "sha")
            .select("part", "sha", F.col("best.key").alias("keep_key"), F.col("best.part").alias("keep_part"), F.col("best.pos").alias("keep_pos"), "group_size"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", fp_bits: int = 48) -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting ASCII white space; a null text is empty, and empty texts are equal.  A null
    key is carried as it is.  Repeated rows count; exactly one row of a group is kept even if keys repeat.  Other columns
    may have any names.  An empty table gives no rows.
    """
    table = place_texts(docs.select(key, text), text, fp_bits)
    found = groups(table, key, text, fp_bits)
    out = table.select("part", "pos", F.col(f"row.`{key}`").alias("key"), "sha").join(found, ["part", "sha"], "left")
    own = F.col("group_size").isNull()
    return out.select(
        F.col("key").alias(key), F.when(own, F.col("key")).otherwise(F.col("keep_key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (own | ((F.col("part") == F.col("keep_part")) & (F.col("pos") == F.col("keep_pos")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", fp_bits: int = 48) -> DataFrame:
    """The documents without their exact copies, all columns kept."""
    table = place_texts(docs, text, fp_bits)
    found = groups(table, key, text, fp_bits)
    rest = (table.select("part", "pos", "sha").join(found, ["part", "sha"])
            .where((F.col("part") != F.col("keep_part")) | (F.col("pos") != F.col("keep_pos"))))
    return keep(table, rest, marked=False).select("row.*")


def oracle(docs: str = "documents") -> str:
    return rf"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM {docs}),
w AS (SELECT *, first_value(doc_id) OVER v AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER v AS rn
      FROM t WINDOW v AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w"""
