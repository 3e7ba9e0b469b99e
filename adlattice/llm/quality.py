"""Quality rules with risk-controlled thresholds, DataFrame functions only.

Signals of a text are compared with cutoffs from fixed grids.  On labelled documents every (stratum, signal, cutoff) is tested:
the chance of as few rejected good documents as were seen, if the true rate were the allowed one, is the exact binomial lower
tail; a cutoff is certified if that is at most ``error`` divided by the number of tests (Bonferroni).  The allowed rate of a
stratum is shared by the signals, so with probability 1 - ``error`` no stratum loses more good documents than ``risk`` to all
its cutoffs together.  Of the certified cutoffs a signal takes the one that separates best; a signal that hardly separates
takes none, and neither does a stratum with too few labels: its documents are kept.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlattice.session import materialise

SPAN = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(hashes: Column, span: int = SPAN) -> Column:
    """Positions covered by windows whose hash occurs twice or more, from the hashes of all windows in order."""
    def of_sorted(s: Column) -> Column:
        same = F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]))
        return let(F.array_sort(F.transform(same, lambda e: e["i"])), of_starts)

    def of_starts(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(span), F.coalesce(F.get(p, k + 1) - v, F.lit(span))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def features(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    """key, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text (null: empty)."""
    t = docs.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.withColumn("flat", F.translate("t", "\t\n\x0b\f\r", "     "))
    t = t.withColumn("words", F.array_remove(F.split("flat", " "), ""))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select("key", "stratum", F.size("words").cast("bigint").alias("n_words"), F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
                 (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"), lines.alias("lines"),
                 F.when(F.size("words") >= SPAN, F.transform(F.sequence(F.lit(1), F.size("words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("words", i, SPAN))))
                  .otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    return t.select("key", "stratum", "n_words", "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                    F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("bigint")).otherwise(covered(F.col("hashes"))).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Signal: (value of a document with words, grid of cutoffs); a document above its cutoff is rejected.
SIGNALS: dict[str, tuple[Callable[[], Column], list[float]]] = {
    "symbols": (lambda: F.col("n_symbols") / F.col("n_words"), [i / 20 for i in range(1, 21)]),
    "repeated_lines": (lambda: F.col("n_dup_lines") / F.col("n_lines"), [i / 20 for i in range(1, 20)]),
    "repeated_words": (lambda: F.col("n_repeat_words") / F.col("n_words"), [i / 100 for i in range(1, 21)]),
    "long_words": (lambda: (F.col("word_chars") - F.col("n_symbols")) / F.col("n_words"), [i / 2 for i in range(10, 31)]),
    "short_words": (lambda: -F.col("word_chars") / F.col("n_words"), [-i / 4 for i in range(4, 21)][::-1]),
}


def stirling_error(n: Column) -> Column:
    """log(n!) less Stirling's formula: exact for small n, else the series."""
    exact = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i or 1) + i - (0.5 * math.log(2 * math.pi) if i else 0.0)) for i in range(20)])
    x = n.cast("double")
    return F.when(n < 20, F.get(exact, n.cast("int"))).otherwise((F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / (x * x)) / (x * x)) / x)


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), for k up to n * p; 1 above.

    The greatest term, that of k, comes from its deviances; the smaller ones follow downward as ratios.  The product of the
    first j ratios is at most exp(-j (j - 1) / 2k), so after ``sqrt(200 k) + 2`` terms all others are below e-100 of the first.
    """
    def deviance(x: Column, mean: Column) -> Column:
        return x * F.log(x / mean) + mean - x
    rest = n - k
    first = F.when(k == 0, n * F.lit(math.log1p(-p))).otherwise(
        stirling_error(n) - stirling_error(k) - stirling_error(rest) - deviance(k, n * F.lit(p)) - deviance(rest, n * F.lit(1 - p))
        + F.log(n / (F.lit(2 * math.pi) * k * rest)) / 2)
    terms = F.least(k, F.ceil(F.sqrt(200 * k)).cast("bigint") + 2)
    # ratio of the term of i - 1 to that of i
    chained = F.aggregate(
        F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), terms - 1), lambda j: k - j)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: let(a["term"] * i / (n - i + 1) * F.lit((1 - p) / p), lambda x: F.struct(x.alias("term"), (a["sum"] + x).alias("sum"))), lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(first + F.log(chained)))


def thresholds(seen: DataFrame, labels: DataFrame, key: str, risk: float, error: float, least_gain: float) -> DataFrame:
    """(stratum, cutoffs: map of signal to cutoff) certified on the labelled documents that pass the base rules.

    ``labels``: ``key`` and quality (1 good, 0 bad); a key labelled twice counts as bad if any label says so, null labels are
    left out.  All labels count, however many there are.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("of")).agg(F.min("quality").alias("quality"))
    known = seen.where(~base_failed()).join(marks, F.col("key") == F.col("of"))
    tests = sum(len(grid) for _, grid in SIGNALS.values())
    allowed = risk / len(SIGNALS)
    # the bin of a value: how many cutoffs it exceeds
    def passed(value: Column, grid: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in grid]), lambda c: c < value))
    bins = F.array(*[F.struct(F.lit(name).alias("signal"), passed(value(), grid).alias("bin")) for name, (value, grid) in SIGNALS.items()])
    good = (F.col("quality") == 1).cast("bigint")
    counts = (known.select("stratum", good.alias("good"), F.explode(bins).alias("b")).groupBy("stratum", "b.signal", "b.bin")
              .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    # one row per cutoff, found in the data or not
    grid = F.create_map(*[x for name, (_, g) in SIGNALS.items() for x in (F.lit(name), F.array(*[F.lit(float(c)) for c in g]))])
    held = counts.groupBy("stratum", "signal").agg(F.collect_list(F.struct("bin", "good", "bad")).alias("bins"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    strata = Window.partitionBy("signal")
    held = held.withColumn("m", F.lit(tests) * F.count("*").over(strata)).withColumn("cutoff", F.explode(F.transform(grid[F.col("signal")], lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))))

    def above(what: str) -> Column:
        return F.aggregate(F.filter("bins", lambda b: b["bin"] >= F.col("cutoff.i")), F.lit(0).cast("bigint"), lambda a, b: a + b[what])
    tried = held.select("stratum", "signal", "m", "n_good", "n_bad", F.col("cutoff.c").alias("c"), above("good").alias("k"), above("bad").alias("hits"))
    # a lost good document weighs as much as five bad ones caught; of cutoffs that separate alike the mildest is taken
    gain = F.round(F.col("hits") / F.greatest("n_bad", F.lit(1)) - 5 * F.col("k") / F.greatest("n_good", F.lit(1)), 2)
    certified = tried.withColumn("gain", gain).where((F.col("gain") > least_gain) & (tail(F.col("k"), F.col("n_good"), allowed) * F.col("m") <= error))
    best = certified.groupBy("stratum", "signal").agg(F.max(F.struct("gain", "c")).alias("best"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.col("best.c").alias("c")))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.05, error: float = 0.05,
          least_gain: float = 0.1) -> DataFrame:
    """One row per document: ``key``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons.

    A null text is empty (and fails the base rules), a null stratum is the stratum ''; documents with null keys are judged but
    never labelled.  Rows may repeat.  Without labels only the base rules reject; an empty table gives no rows.
    """
    seen = materialise(features(docs, key, text, stratum))
    limits = materialise(thresholds(seen, labels, key, risk, error, least_gain))
    judged = seen.join(limits.withColumnRenamed("stratum", "of_stratum"), F.col("stratum") == F.col("of_stratum"), "left").withColumn("base_failed", base_failed())
    over = F.array_compact(F.array(*[F.when(value() > F.col("cutoffs")[name], F.lit(name)) for name, (value, _) in SIGNALS.items()]))
    judged = judged.withColumn("reasons", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(over))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")
