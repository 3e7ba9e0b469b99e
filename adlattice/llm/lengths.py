"""Token counts as an exact length histogram: documents per encoded length, and suffix sums that answer every context limit.

Tasks encode whole texts and send only how many documents have which length.  For a limit L the tokens left after truncation
are the sum over lengths below L of length x documents, plus L x the documents of length L or more, so one row per occurring
length answers totals, quantiles and truncated totals for all limits.
"""
from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F


def encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def length_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", group: str = "source") -> DataFrame:
    """(group, length, documents): the histogram of encoded lengths.  A null text has length 0; a null group is one."""
    ranks = read_ranks(path)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for rb in rows:
            seen: Counter = Counter()
            for g, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                seen[g, len(enc.encode_ordinary(t)) if t else 0] += 1
            if seen:
                keys, n = zip(*seen.items())
                g, length = zip(*keys)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["grp", "length", "documents"])
    found = docs.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("text")).mapInArrow(count, "grp string, length bigint, documents bigint")
    return found.groupBy("grp", "length").agg(F.sum("documents").alias("documents"))


def histogram(docs: DataFrame, path: str, pattern: str, text: str = "text", group: str = "source") -> DataFrame:
    """One row per group and occurring length, for each group and, with ``overall``, for all of them.

    ``group``, overall, length, documents, docs_ge and tokens_ge (documents of at least this length and their tokens),
    truncated (tokens left if every document is cut at this length), total, share (of documents with at most this length).
    An empty table gives no rows.
    """
    by_group = length_counts(docs, path, pattern, text, group).withColumn("overall", F.lit(False))
    everything = by_group.groupBy("length").agg(F.sum("documents").alias("documents")).select(F.lit(None).cast("string").alias("grp"), "length", "documents", F.lit(True).alias("overall"))
    both = by_group.unionByName(everything)
    # a partition holds one row per length that occurs, however many documents there are
    down = Window.partitionBy("overall", "grp").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("overall", "grp")
    tokens = F.col("length") * F.col("documents")
    out = both.select("grp", "overall", "length", "documents", F.sum("documents").over(down).alias("docs_ge"), F.sum(tokens).over(down).alias("tokens_ge"),
                      F.sum(tokens).over(whole).alias("total"), F.sum("documents").over(whole).alias("all_docs"))
    return out.select(F.col("grp").alias(group), "overall", "length", "documents", "docs_ge", "tokens_ge",
                      (F.col("total") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated"), "total",
                      ((F.col("all_docs") - F.col("docs_ge") + F.col("documents")) / F.col("all_docs")).alias("share"))


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """Tokens left at any ``limit``, from the rows of ``histogram`` for all groups: one row ``tokens``."""
    rows = answers.where("overall")
    reach = rows.where(F.col("length") >= limit).agg(F.coalesce(F.max("docs_ge"), F.lit(0)).alias("docs"), F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("above"))
    total = rows.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    return total.withColumn("one", F.lit(1)).join(reach.withColumn("one", F.lit(1)), "one").select((F.col("total") - F.col("above") + F.lit(limit) * F.col("docs")).alias("tokens"))


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of all documents does not exceed: one row ``length``."""
    return answers.where(F.col("overall") & (F.col("share") >= q)).agg(F.min("length").alias("length"))
