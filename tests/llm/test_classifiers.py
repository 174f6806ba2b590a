"""Learned operators: held-out accuracy, folds, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipendlens.llm import quality_bt, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("run, label, least", [(quality_bt.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.93)])
def test_held_out_accuracy_and_folds(spark, run, label, least):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    got = run(docs, labels).cache()
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = got.join(labels, "doc_id").filter("held_out").select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= least
    # labels of the held-out fold are never read
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert sorted(map(tuple, run(docs, flipped).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("run, alone", [(quality_bt.quality, 1), (toxicity.toxicity, 0)])
def test_odd_rows_and_missing_labels(make_docs, spark, documents, labels, run, alone):
    odd = make_docs([(None, "null id"), (10**9, None), (10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n"), (10**9 + 3, "word " * 60_000)])
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = run(docs, labels)
    assert got.count() == docs.count() and got.filter("score is null or predicted is null or held_out is null").count() == 0
    assert run(odd.filter("false"), labels).count() == 0
    none = run(odd, labels.filter("false")).collect()
    assert len(none) == 6 and {r["predicted"] for r in none} == {alone}
    one_class = labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))
    assert {r["predicted"] for r in run(documents, one_class).collect()} == {alone}


def test_folding_and_the_automaton():
    assert toxicity.fold("1D10T  Ѕсum $cum ＬＯＳＥＲ") == "idiot  scum scum loser"
    scan = toxicity.Scanner({"idiot": 3.0, "trash ": 2.0, "low": 1.0}, ("trash can",))
    assert scan.hits("An 1d10t, IDIOTIC! trash.") == [3.0, 3.0, 2.0]
    assert scan.hits("a trash can, TRASH CAN; trashy slow") == []
    assert scan.hits("lower trash cans") == [1.0, 2.0]
    assert scan.features("") == scan.features(None) == (0.0,) * 4


def test_ranking_prefers_labelled_ones_to_zeros(documents, labels):
    scored = quality_bt.quality(documents, labels).join(labels, "doc_id")
    means = {r["quality"]: r["m"] for r in scored.groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.5


def test_quality_weights_are_the_optimum_over_all_pairs(documents, labels):
    """Every pair of a document labelled 1 and one labelled 0 counts, not a sample of them: the loss has no slope left."""
    m = quality_bt.learn(documents, labels)
    train = documents.join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").collect()
    x = np.array([quality_bt.text_features(r["text"]) for r in train])
    assert np.allclose(m["mean"], x.mean(0), atol=1e-6) and np.allclose(m["std"], x.std(0) + 1e-6, atol=1e-6)
    z = np.clip((x - m["mean"]) / m["std"], -6, 6)
    z = np.hstack([z, z * z])
    y = np.array([r["quality"] for r in train])
    diff = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    slope = -(diff / (1 + np.exp(diff @ m["w"]))[:, None]).mean(0) + 1e-3 * m["w"]
    assert np.abs(slope).max() < 1e-6
    s = z @ m["w"]
    assert ((s >= m["cut"]) == (y == 1)).all()
