"""Targets against iterative resharing, exact words, the cap, reruns and the shard quotas."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stipendlens.llm import mixing


def reshared(sizes):
    """Targets by handing the excess on until none is above its stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = {}
    while True:
        free = [s for s in names if s not in stopped]
        left = sum(sizes.values()) - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return stopped | share
        stopped |= over


def check(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    got = mixing.mixed_words(docs).collect()
    assert len(got) == len(rows)
    words = {}
    sizes = defaultdict(int)
    for r in rows:
        n = len((r["text"] or "").encode().split())
        words.setdefault(r["doc_id"], (n, r["source"]))
        sizes[r["source"]] += n
    target, taken = reshared(sizes), defaultdict(int)
    for r in got:
        n, source = words[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 3 * n
        taken[source] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: round(t + 1e-9) if abs(t % 1 - .5) > 1e-6 else taken[s] for s, t in target.items()}
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed_words(docs.repartition(3)).collect()))


def test_given_documents(documents):
    check(documents)


def test_hot_source_null_source_and_empty_texts(make_docs):
    rows = [(i, "w " * (i % 17), "hot") for i in range(300)] + [(1000 + i, "a b c", f"s{i % 5}") for i in range(20)]
    rows += [(2000, None, "none"), (2001, "", "none"), (2002, "x y", None), (2003, "é" * 9, "Z"), (2004, "z " * 5000, "long")]
    check(make_docs(rows))


def test_repeated_rows_are_documents(make_docs):
    got = mixing.mixed_words(make_docs([(1, "a b c", "s")] * 4 + [(None, "d", "s")])).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == 13


def test_blocks_are_disjoint_and_quotas_exact(documents):
    mixed = mixing.mix(documents, blocks=64, shards=5).filter("words > 0")
    assert mixed.filter("shard is null").count() == 0
    owners = mixed.groupBy("row_key.sk", "epoch", "block").agg(F.countDistinct("shard").alias("n"))
    assert owners.filter("n > 1").count() == 0
    assert {r["shard"] for r in mixed.select("shard").distinct().collect()} == set(range(5))


def test_splitting_tree_keeps_quotas_and_even_shards(spark):
    quotas = spark.createDataFrame([(("a",), 50), (("b",), 13), (("c",), 1), (("d",), 0)], "sk struct<source:string>, quota bigint")
    got = mixing.split_quotas(quotas, 6, 3).collect()
    by = Counter()
    shard = Counter()
    for r in got:
        by[r["sk"]["source"]] += r["quota"]
        shard[r["shard"]] += r["quota"]
    assert by == {"a": 50, "b": 13, "c": 1} and len(shard) == 6 and max(shard.values()) - min(shard.values()) <= 2


def test_empty_table(make_docs):
    assert mixing.mixed_words(make_docs([(1, "a")]).filter("false")).count() == 0
    assert mixing.mixed_words(make_docs([(1, ""), (2, None)])).agg(F.sum("taken")).first()[0] == 0


def test_the_drawn_blocks_decide_what_is_taken(documents):
    """Another seed takes other documents, targets hold; whole blocks are taken but one a source and epoch."""
    def taken(seed):
        return {r["doc_id"]: r["taken"] for r in mixing.mixed_words(documents, seed=seed, blocks=64).collect()}

    a, b = taken(1), taken(2)
    assert a == taken(1) and sum(a.values()) == sum(b.values()) and len(a) == len(b)
    assert sum(a[d] != b[d] for d in a) > len(a) // 20
    mixed = mixing.mix(documents, blocks=1024)
    per = mixed.groupBy("row_key.sk", "epoch", "block").agg(F.sum("words").alias("words"), F.sum("size").alias("size"), F.min("words").alias("least"))
    cut = per.filter("words > 0 and words < size").groupBy("sk").count()
    assert cut.filter("count > 1").count() == 0
    last = per.withColumn("last", F.max("epoch").over(mixing.Window.partitionBy("sk"))).filter("epoch = last and size > 0")
    assert last.filter("words > 0").count() > 0 and last.filter("words = 0").count() > 0
    # the blocks taken are not the first ones of the source
    some = last.filter("words > 0").groupBy("sk").agg(F.count("*").alias("n"), F.max("block").alias("top"))
    assert some.filter("top > n + 2").count() > 0


def test_shards_hold_hypergeometric_shares(spark):
    """Mean and spread of a shard's quota of a source over many seeds, against the distribution's."""
    quotas = spark.createDataFrame([(("a",), 30), (("b",), 10)], "sk struct<source:string>, quota bigint").cache()
    drawn = []
    for seed in range(60):
        got = {(r["sk"]["source"], r["shard"]): r["quota"] for r in mixing.split_quotas(quotas, 2, seed).collect()}
        assert got.get(("a", 0), 0) + got.get(("b", 0), 0) == 20
        drawn.append(got.get(("b", 0), 0))
    mean = sum(drawn) / 60
    spread = sum((x - mean) ** 2 for x in drawn) / 60
    assert abs(mean - 5) < 0.75 and 0.9 < spread < 4  # 20 of 40 tokens, 10 of them b: mean 5, variance 1.92


def test_a_cut_keeps_white_space(spark):
    text = "  one\ttwo\n\nthree  four "
    df = spark.createDataFrame([(text, n) for n in range(6)], "t string, n int")
    got = {r["n"]: r["x"] for r in df.select("n", mixing.cut_to_words(F.col("t"), F.col("n")).alias("x")).collect()}
    assert got == {0: "", 1: "  one", 2: "  one\ttwo", 3: "  one\ttwo\n\nthree", 4: "  one\ttwo\n\nthree  four", 5: "  one\ttwo\n\nthree  four"}
