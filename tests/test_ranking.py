"""rank_within / dense_ids against Spark's own window functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stipendlens.plans.ranking import dense_ids, rank_within


def _data(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        part = rnd.choice([2020, 2021, 2022, None]) if rnd.random() < 0.95 else 2020
        val = None if rnd.random() < 0.05 else rnd.choice([rnd.randint(0, 30), 7, 7, 7])
        rows.append((i, part, val))
    return spark.createDataFrame(rows, "id long, p int, v int")


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_rank_matches_window(spark, descending, buckets):
    df = _data(spark, buckets * 10 + int(descending))
    got = rank_within(df, "v", by=["p"], descending=descending, out="r", buckets=buckets)
    order = F.col("v").desc_nulls_first() if descending else F.col("v").asc_nulls_last()
    want = df.withColumn("r", F.rank().over(Window.partitionBy("p").orderBy(order)).cast("long"))
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, want.select("id", "r").collect()))


def test_rank_without_partition(spark):
    df = _data(spark, 99)
    got = rank_within(df, "v", by=[], descending=True, out="r", buckets=4)
    want = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_first())).cast("long"))
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, want.select("id", "r").collect()))


def test_dense_ids(spark):
    df = spark.createDataFrame([(k,) for k in [50, 10, 30, 20, 40]], "k long")
    got = sorted(map(tuple, dense_ids(df, "k", 100, "id").select("k", "id").collect()))
    assert got == [(10, 101), (20, 102), (30, 103), (40, 104), (50, 105)]
