"""Components and links against union-find over all pairs."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

from stipendlens.llm.common import written
from stipendlens.llm.linking import components, different_buckets, link
from stipendlens.plans.lineage import FREE_SHUFFLES, cut_lineage


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("pairs", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(9, 2), (2, 9), (2, 7), (-5, 7), (100, 101)],
    [(random.Random(5).randrange(60), random.Random(i).randrange(60)) for i in range(50)]])
def test_components(spark, pairs):
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == want


def links_of(spark, points, keys):
    where = spark.createDataFrame(list(points.items()), "id bigint, x double")

    def verify(pairs):
        return pairs.join(where.selectExpr("id as a", "x as xa"), "a").join(where.selectExpr("id as b", "x as xb"), "b").select(
            "a", "b", (1 - F.abs(F.col("xa") - F.col("xb"))).alias("similarity"))

    def compare(rows):
        x, y = rows.alias("x"), rows.alias("y")
        pairs = x.join(y, ["key", "i", "j"]).filter("x.root < y.root and (i = j or x.own != y.own)").selectExpr("x.id as a", "y.id as b")
        return verify(pairs.distinct()).filter("similarity >= 0.8")

    items = spark.createDataFrame([(i, keys[i]) for i in points], "id bigint, keys array<bigint>")
    return link(items, verify, compare, 0.8)


def test_links_join_what_all_pairs_would(spark):
    """Points on a line, linked within 0.2: buckets hold chains, a hot group and strays."""
    rng = random.Random(8)
    points = {i: round(rng.uniform(0, 6), 3) for i in range(150)} | {200 + i: 3.0 + i / 1000 for i in range(60)}
    keys = {i: sorted({int(x), int(x + 0.5) + 100, 999}) for i, x in points.items()}  # 999: everyone
    got = {r["id"]: r["root"] for r in components(links_of(spark, points, keys)).collect()}
    want = union_find([(a, b) for a in points for b in points if a < b and abs(points[a] - points[b]) <= 0.2 + 1e-9])
    assert got == want


def test_a_hot_group_costs_its_members_not_its_pairs(spark):
    points = {i: 3.0 + i / 1000 for i in range(150)} | {500: 9.0, 501: 9.1, 502: 20.0}
    links = links_of(spark, points, {i: [1, 2, 3] for i in points})
    assert links.count() <= 3 * 150 + 4, "members of the three buckets, not 11,175 pairs"
    assert {r["id"]: r["root"] for r in components(links).collect()} == {i: 0 for i in range(150)} | {500: 500, 501: 500}


def test_pairs_of_like_buckets_are_checked_once(spark):
    """Strays in 28 buckets of the same members: one hub a round, one bucket compared in the end."""
    rest = spark.createDataFrame([(k, i, i) for k in range(28) for i in range(40)] + [(99, i, i) for i in range(39)], "key bigint, id bigint, root bigint")
    assert {r["key"]: r["count"] for r in different_buckets(rest).groupBy("key").count().collect()} == {0: 40, 99: 39}
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.withColumn("similarity", F.lit(0.0))

    items = spark.createDataFrame([(i, list(range(28))) for i in range(40)], "id bigint, keys array<bigint>")
    assert link(items, verify, lambda rows: rows.selectExpr("id as a", "id as b").filter("false"), 0.8).count() == 0
    assert seen == [39, 39]


def test_components_grow_from_known_ones(spark):
    """Earlier components joined by later links, by any of their members, and with new ids."""
    rng = random.Random(4)
    first, later = ([(rng.randrange(90), rng.randrange(90)) for _ in range(n)] for n in (40, 25))
    old = components(spark.createDataFrame(first, "a bigint, b bigint"))
    got = components(spark.createDataFrame(later, "a bigint, b bigint"), old)
    assert {r["id"]: r["root"] for r in got.collect()} == union_find([p for p in first + later if p[0] != p[1]])
    assert got.count() == got.select("id").distinct().count()
    same = components(spark.createDataFrame(first[:9], "a bigint, b bigint"), old)
    assert {r["id"]: r["root"] for r in same.collect()} == {r["id"]: r["root"] for r in old.collect()}


def test_stored_steps_leave_no_shuffle_files(spark):
    """What is read back from storage has no use for the shuffles that made it."""
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}

    before, freed = files(), spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(5000).selectExpr("id % 700 as a", "id % 31 as b")
    stored = [cut_lineage(rows.groupBy("a").count()), written(rows.groupBy("b").count())]
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert [df.count() for df in stored] == [700, 31]
    assert spark.conf.get(FREE_SHUFFLES, None) == freed, "the session's setting is as before"
