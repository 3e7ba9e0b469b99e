"""Language identification: known words first, then shorter and shorter character n-grams.

Training counts words and character n-grams per language over a bounded sample of the labelled documents, drawn by language with
a hash of the key; the sample's size, the vocabulary's size and the n-gram lengths are parameters.  Prediction reads every whole text: a
word in the vocabulary scores its log frequency per language, any other word backs off to its n-grams of the greatest length at
which one of them is known, down to single letters.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlattice.llm.packing import batches
from adlattice.operators.scale import top_n
from adlattice.session import materialise

#: Runs of letters and of the numeric characters that ``\\w`` takes beside digits; ``text_words`` parts the two.
LETTERS = re.compile(r"[^\W\d_]+")
#: Latin-1 bytes to the lower case of letters, everything else to a blank.
LATIN = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
BEYOND_LATIN = re.compile(r"[^\x00-\xff]+")
UNDETERMINED = "und"
#: Documents that a language gives to the sample at least, if it has them.
LEAST = 20


def text_words(text: str) -> list[str]:
    """Runs of letters (``str.isalpha``), lower-cased."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def latin_words(text: str) -> list[bytes] | None:
    """The same as Latin-1 bytes, by table; None for a text with a letter beyond Latin-1."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        if any(c.isalpha() for c in set("".join(BEYOND_LATIN.findall(text)))):
            return None
        raw = BEYOND_LATIN.sub(" ", text).encode("latin-1")
    return raw.translate(LATIN).split()


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; single letters without them."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def held_out(key: str | Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text is divisible by ``folds``; a null key is not held out."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % folds == 0, F.lit(False))


class Model:
    """Log frequencies per language of the known words and n-grams, a bounded table."""

    def __init__(self, languages: list[str], words: dict[str, list[int]], ngrams: dict[int, dict[str, list[int]]],
                 word_totals: list[int], ngram_totals: dict[int, list[int]]):
        self.languages = languages
        self.orders = sorted(ngrams, reverse=True)
        self.words = self._logs(words, word_totals)
        self.ngrams = {n: self._logs(t, ngram_totals[n]) for n, t in ngrams.items()}

    def _logs(self, table: dict[str, list[int]], totals: list[int]) -> tuple[dict[str, int], np.ndarray]:
        counts = np.array(list(table.values()), dtype=np.float64).reshape(len(table), len(self.languages))
        smooth = np.log((counts + 0.5) / (np.array(totals, dtype=np.float64) + 0.5 * (len(table) + 1)))
        return {w: i for i, w in enumerate(table)}, smooth

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency over the known n-grams of the greatest length that has any; nothing if no letter is known."""
        return self.unseen_many([word])[0]

    def unseen_many(self, words: list[str]) -> np.ndarray:
        """``unseen`` of every word, a row each: one look-up of all n-grams per length, for the words still open."""
        out, rest = np.zeros((len(words), len(self.languages))), list(range(len(words)))
        for n in self.orders:
            index, logs = self.ngrams[n]
            if not rest or not index:
                continue
            own = [grams(words[i], n) for i in rest]
            of = np.repeat(np.arange(len(rest)), [len(g) for g in own])
            at = np.fromiter((index.get(g, -1) for gs in own for g in gs), np.int64, len(of))
            of, at = of[at >= 0], at[at >= 0]
            if len(of):
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                hit = of[starts]
                means = np.add.reduceat(logs[at], starts) / np.diff(np.append(starts, len(of)))[:, None]
                out[np.array(rest)[hit]] = means
                done = set(hit.tolist())
                rest = [i for k, i in enumerate(rest) if k not in done]
        return out


class Scorer:
    """Scores texts a run at a time: distinct words are looked up once, and a text is the sum over its words' rows."""

    def __init__(self, model: Model, memo_size: int = 100_000):
        self.model, self.memo_size = model, memo_size
        self._forget()

    def _forget(self) -> None:
        """Only the vocabulary's rows; words learnt since go."""
        words, logs = self.model.words
        self.known = len(words)
        self.rows = [logs.reshape(len(words), len(self.model.languages))]
        self.size = self.known
        # words are Latin-1 bytes if they can be, else text
        self.index: dict[bytes | str, int] = {}
        for w, at in words.items():
            self.index[_name(w)] = at

    def _learn(self, fresh: list[bytes | str]) -> None:
        self.rows.append(self.model.unseen_many([w.decode("latin-1") if isinstance(w, bytes) else w for w in fresh]))
        self.index.update(zip(fresh, range(self.size, self.size + len(fresh))))
        self.size += len(fresh)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and the share of its likelihood for each text, its words taken as independent evidence; ties go to the first."""
        model = self.model
        if not model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        lists = [_tokens(t) if t else [] for t in texts]
        flat = [w for ws in lists for w in ws]
        if not flat:
            return [(UNDETERMINED, 0.0)] * len(texts)
        distinct = set(flat)
        fresh = sorted(distinct.difference(self.index), key=_order)
        if self.size - self.known + len(fresh) > self.memo_size and self.size > self.known:
            self._forget()
            fresh = sorted(distinct.difference(self.index), key=_order)
        if fresh:
            self._learn(fresh)
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(ws) for ws in lists])
        worded = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[worded]
        total = np.add.reduceat(self.rows[0][at], starts)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(axis=1)
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for i, b, x in zip(worded.tolist(), best.tolist(), score.tolist()):
            out[i] = (model.languages[b], x)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _name(word: str) -> bytes | str:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return word


def _order(word: bytes | str) -> tuple[bool, bytes | str]:
    return isinstance(word, str), word


def _tokens(text: str) -> list[bytes | str]:
    words = latin_words(text)
    return [_name(w) for w in text_words(text)] if words is None else words


def quotas(sizes: dict[str, int], total: int) -> dict[str, float]:
    """Documents to take of each language: alike, and what a small one leaves goes to the others; ``LEAST`` even if that exceeds ``total``."""
    out, left = {}, float(total)
    for k, x in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[x] = min(float(sizes[x]), max(left / (len(sizes) - k), LEAST))
        left -= out[x]
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = 20_000,
          max_words: int = 50_000, max_grams: int = 50_000, orders: tuple[int, ...] = (4, 3, 2, 1)) -> Model:
    """Fit on about ``sample`` labelled documents outside the held-out fold, whole texts; fewer if there are fewer.

    Every language has its quota, and takes the documents with the smallest hashes of their key (of the text without a key), so
    reruns agree.  At most ``max_words`` words and, of every order, ``max_grams`` n-grams stay: each language's most frequent
    ones, rank by rank (ties: the more frequent one over all languages, then by text).
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("key", folds))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    chosen = own
    if sum(sizes.values()) > sample:
        mark = F.coalesce(F.concat(F.lit("sample:"), F.col("key").cast("string")), F.concat(F.lit("text:"), F.col("text")))
        draw = F.crc32(mark.cast("binary")) / F.lit(float(1 << 32))
        quota = quotas(sizes, sample)
        # languages that are taken whole are the default
        rates = {x: quota[x] / n for x, n in sizes.items() if quota[x] < n}
        rate = F.coalesce(F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[F.col("lang")], F.lit(1.0))
        chosen = own.where(draw < rate)

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch: counts of every word (order 0) and n-gram by language."""
        for rb in rows:
            for at in range(0, rb.num_rows, 200):
                part = rb.slice(at, 200)
                by: dict[str, Counter] = {}
                for t, tag in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(tag, Counter()).update(text_words(t))
                out = []
                for tag, counts in by.items():
                    ngrams: Counter = Counter()
                    for w, c in counts.items():
                        for o in orders:
                            for g in grams(w, o):
                                ngrams[o, g] += c
                    out += [(0, w, tag, c) for w, c in counts.items()] + [(o, g, tag, c) for (o, g), c in ngrams.items()]
                if out:
                    o, g, tag, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array(g), pa.array(tag), pa.array(c, pa.int64())], ["n", "piece", "lang", "c"])
    counted = materialise(chosen.select("text", "lang").mapInArrow(pieces, "n int, piece string, lang string, c bigint").groupBy("n", "piece", "lang").agg(F.sum("c").alias("c")))
    totals = counted.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect()
    languages = sorted({r["lang"] for r in totals})
    column = {x: i for i, x in enumerate(languages)}
    sums = {o: [0] * len(languages) for o in (0, *orders)}
    for r in totals:
        sums[r["n"]][column[r["lang"]]] = r["c"]
    tables: dict[int, dict[str, list[int]]] = {}
    for o in (0, *orders):
        most = max_grams if o else max_words
        by_piece = (counted.where(F.col("n") == o).groupBy("piece").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by")).where(F.col("all") > 1))
        order = [F.desc("c"), F.desc("all"), F.col("piece")]
        first = top_n(by_piece.select("piece", "all", "by", F.explode("by").alias("lang", "c")), ["lang"], order, most, "piece")
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        top = (ranked.groupBy("piece").agg(F.min("rank").alias("rank"), F.max("all").alias("all"), F.first("by").alias("by"))
               .orderBy("rank", F.desc("all"), "piece").limit(most).select("piece", "by"))
        rows = top.toArrow()
        tables[o] = {}
        for piece, by in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            line = tables[o][piece] = [0] * len(languages)
            for tag, c in by:
                line[column[tag]] = c
    return Model(languages, tables[0], {o: tables[o] for o in orders}, sums[0], {o: sums[o] for o in orders})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` (a struct of all columns, whatever their names) with lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cells = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(cells.alias("row"), F.col(text).alias("text"))

    @F.pandas_udf("lang_pred string, score double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        # the words' rows of a run stay within some 10 MB, however many languages there are
        chars = 8_000_000 // max(8, len(scorer.model.languages))
        for texts in parts:
            found = [x for run in batches(texts, chars) for x in scorer.predict_all([t for _, t in run])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
    # as an indeterminate function it runs once, whatever filters follow
    return packed.select("row", score.asNondeterministic()("text").alias("got")).select("row", "got.lang_pred", "got.score")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per document: ``key``, held_out, lang_pred, score.  Learns from ``docs`` outside the held-out fold.

    Repeated rows get equal rows; a null key is not held out, and such rows are learnt from.  An empty table gives no rows.
    """
    model = train(docs, key, text, lang, **options)
    got = predict(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    return got.select(F.col("row.key").alias(key), held_out("row.key", options.get("folds", 5)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language is known with at least ``least``, all columns kept."""
    return predict(docs, train(docs, **options)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
