"""The pipeline's stages on their own input, and end to end."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from stipendlens.llm import probminhash, toxicity
from stipendlens.llm.common import DOCUMENT_COLUMNS
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pipeline")
    docs, got = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(str(out / str(k)))
        docs = spark.read.parquet(str(out / str(k)))
        got.append(docs)
    return got


def test_stages_and_columns(steps):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "encoding"]
    assert all(s.columns == list(DOCUMENT_COLUMNS) for s in steps[:-1])
    for s in steps[:-1]:
        assert s.filter("n_chars is distinct from length(text)").count() == 0


def test_toxic_documents_go_and_only_they(documents, labels, steps):
    bad = {r["doc_id"] for r in toxicity.toxicity(documents, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in steps[0].collect()} == {r["doc_id"] for r in documents.collect()} - bad and bad


def test_no_line_stays_twice_and_clean_documents_stay(steps):
    lines = Counter(x for r in steps[1].collect() for x in (r["text"] or "").split("\n") if any(c.isalnum() for c in x))
    assert max(lines.values()) == 1
    before = [r["text"] or "" for r in steps[0].collect()]
    assert Counter(x for t in before for x in t.split("\n")).keys() >= lines.keys()


def test_one_document_of_each_group_stays(steps):
    classes = probminhash.near_duplicates(steps[1]).select("class_id").distinct().count()
    assert steps[2].count() == classes and probminhash.near_duplicates(steps[2]).filter("class_id != doc_id").count() == 0


def test_mix_takes_whole_documents_but_one_cut_a_source(steps):
    whole = {(r["doc_id"], r["text"]) for r in steps[2].collect()}
    cut = [r for r in steps[3].collect() if (r["doc_id"], r["text"]) not in whole]
    assert max(Counter(r["source"] for r in cut).values(), default=0) <= 1
    assert max(Counter(r["doc_id"] for r in steps[3].collect()).values()) <= 3


def test_run_equals_its_stages_and_round_trips(spark, steps):
    got = C.run(spark, SF)
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in got.collect()) == Counter(
        (r["doc_id"], tuple(r["tokens"])) for r in steps[4].collect())
    assert got.filter(~F.col("round_trip")).count() == 0
