"""Language identification: held-out accuracy on the given documents, and awkward texts."""
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from adlattice.llm import langid
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.identify(source).join(source.select(F.col("doc_id").alias("i"), "lang", "text"), F.col("doc_id") == F.col("i")).collect()


def test_fold_and_accuracy(judged):
    for r in judged:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in judged if r["held_out"] and any(c.isalpha() for c in r["text"])]
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_held_out_labels_are_not_learnt(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    wrong = source.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a = langid.identify(source).select("doc_id", "lang_pred", "score").collect()
    b = langid.identify(wrong).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_backoff_uses_the_longest_known_grams():
    model = langid.Model(["a", "b"], {"word": [9, 1]}, {2: {"<x": [1, 8], "xy": [1, 8]}, 1: {"z": [7, 1], "x": [1, 7]}}, [10, 10], {2: [10, 10], 1: [10, 10]})
    score = langid.Scorer(model)
    assert score.predict("WORD")[0] == "a" and score.predict("xy!")[0] == "b" and score.predict("z")[0] == "a"
    assert score.predict("q")[0] == "a" and score.predict("12 !")[0] == "und" and score.predict(None) == ("und", 0.0)
    assert (model.unseen("x") == model.ngrams[2][1][0]).all()  # "<x" is known, so single letters are not asked


def test_awkward(spark):
    rows = docs(spark, ["the and the of", "der die und", None, "", "123 ...", "the " * 50_000], langs=["en", "de", "en", "en", "de", None], ids=[1, 2, 3, 4, 5, None])
    got = {r["doc_id"]: r for r in langid.identify(rows).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[None]["held_out"] is False
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ["abc", "def"], langs=[None, None])).collect()} == {"und"}
    left = langid.keep_identified(rows)
    assert left.columns == rows.columns


def test_sample_is_bounded(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    small = langid.train(source, sample=50, max_words=100, max_grams=60)
    assert len(small.words[0]) <= 100 and all(len(t) <= 60 for t, _ in small.ngrams.values())


def test_rare_languages_are_learnt(spark):
    """A language with a thousandth of the documents is drawn, and keeps its words beside a large one's."""
    texts = [" ".join(f"{a}{b}ing" for a in ("war", "bed", "sol", "tun") for b in "bdfgk") + f" {chr(97 + i % 26)}om" for i in range(4000)] + ["zxqv qvzx vqxz zxqv"] * 4
    langs = ["en"] * 4000 + ["zz"] * 4
    ids = [5 * i + 1 for i in range(4004)]
    rows = docs(spark, texts, langs=langs, ids=ids)
    model = langid.train(rows, sample=100, max_words=6, max_grams=40)
    assert model.languages == ["en", "zz"] and {"zxqv", "qvzx", "vqxz"} & set(model.words[0]) and len(model.words[0]) == 6
    assert langid.Scorer(model).predict("zxqv qvzx")[0] == "zz" and langid.Scorer(model).predict("warbing bedding")[0] == "en"
    assert langid.quotas({"a": 3, "b": 1000, "c": 1000}, 103) == {"a": 3.0, "b": 50.0, "c": 50.0}


def test_rows_without_key_are_drawn(spark):
    """Null keys do not escape the bound of the sample."""
    words = [f"{a}{b}{c}" for a in "bcdfghklm" for b in "aeiou" for c in "nrst"]
    rows = docs(spark, [f"{words[i % 180]} {words[i // 180]}" for i in range(3000)], ids=[None] * 3000)
    model = langid.train(rows, sample=100)
    assert len(model.words[0]) < 120 and model.languages == ["en"]


def plain(model, text):
    """Word by word from dictionaries: the vocabulary's log frequencies, else the mean over the longest known n-grams."""
    total, words = [0.0] * len(model.languages), []
    run = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            words.append(run)
            run = ""
    for w in words:
        rows = [model.words[1][model.words[0][w]]] if w in model.words[0] else []
        for n in model.orders:
            if not rows:
                index, logs = model.ngrams[n]
                marked = w if n == 1 else f"<{w}>"
                rows = [logs[index[marked[i:i + n]]] for i in range(len(marked) - n + 1) if marked[i:i + n] in index]
        for k in range(len(total)):
            total[k] += sum(float(r[k]) for r in rows) / len(rows) if rows else 0.0
    if not words:
        return "und", 0.0
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return model.languages[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_batches_equal_a_plain_reading(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), max_words=300, max_grams=400)
    rng = random.Random(2)
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    odd = ["", None, "½ ² ①", "a½b²c", "naïve—dash “quoted” l’été", "日本語 und Straße", "ΣΑΣ ς", "İstanbul ı", "x_y 3.14 ÀÉÎ", "ª º µ ÿ ß", "zzzz " * 500, "🙂", "e" * 5000]
    made = ["".join(rng.choice("abeéß ½—Ω日1_-") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    texts = odd + made + given
    for memo in (100_000, 7):
        scorer, got = langid.Scorer(model, memo), []
        for i in range(0, len(texts), 13):
            got += scorer.predict_all(texts[i:i + 13])
        for t, (lang, score) in zip(texts, got):
            want = plain(model, t)
            assert score == pytest.approx(want[1], rel=1e-6), t[:40]
            assert lang == want[0] or want[1] < 0.51, t[:40]
        assert got == [scorer.predict(t) for t in texts]


def test_letters_only():
    assert langid.text_words("½ ² ①") == [] and langid.text_words("A½b²") == ["a", "b"] and langid.latin_words("½ ² _1") == []
    assert langid.latin_words("É—x") == ["é".encode("latin-1"), b"x"] and langid.latin_words("Ωx") is None
