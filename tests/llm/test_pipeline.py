"""The pipeline, each stage on what the one before kept."""
import re

import corpus_pipeline
import pytest
from adlattice import session
from adlattice.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import words
from tests.llm.test_ngrams import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(f"{folder}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns or name == "sequences"
        out.append(docs.collect())
    return out


def test_stages(stages):
    given, known, single, apart, mixed, pieces = stages
    letters = {r["doc_id"] for r in given if re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in known} <= letters and len(known) > 0.97 * len(letters)
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in known]
    assert len(single) == len(set(bodies)) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in single})
    assert len(apart) == len({c for _, _, c in brute([r["text"] for r in single])})
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in apart}
    total = sum(len(words(r["text"])) for r in apart)
    assert abs(sum(len(words(r["text"])) for r in mixed) - 1.5 * total) < 0.2 * total
    assert len({r["sequence_id"] for r in pieces}) == max(r["sequence_id"] for r in pieces) + 1
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in QUERIES if n.startswith("op")} and "pipeline" in QUERIES
    assert {re.match(r"op\d+", n)[0] for n in ORACLES} == {"op3", "op4", "op5", "op7", "op11", "op13"}


def test_stages_leave_others_results_and_remove_their_own(spark):
    mine = session.materialise(spark.range(5))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    before = len(session.MADE)
    stages = dict(corpus_pipeline.STAGES)
    stages["language"](spark, docs, SF).count()
    stages["copies"](spark, docs, SF).count()
    made = session.MADE[before:]
    assert any(table for _, table in made)
    stages["mixture"](spark, docs, SF).count()
    assert mine.count() == 5 and not any(x in session.MADE for x in made) and not spark.catalog.tableExists(next(t for _, t in made if t))
