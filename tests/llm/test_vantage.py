"""Vantage-point trees against all distances."""

import numpy as np
import pytest

from stipendlens.llm import vantage as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, vec int, score string, dim int, cell int, block string, id int"
BAD = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, float("-inf")]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "s", 2, 3, "b", 4) for i, v in rows], SCHEMA)


def expected(rows, k=10):
    """By definition, over the rows that take part."""
    own = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        own[(i, tuple(np.float32(x).item() for x in v))] = None
    out = []
    for i, v in own:
        if i % 100 == 0:
            near = sorted((float(V.exact_scores(np.array([w]), np.array([v]))[0]), j) for j, w in own if len(w) == len(v) and (j, w) != (i, v))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in V.nearest(df, **kw).collect())


def test_factor_one_is_exact_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = expected([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert got(df) == want
    assert got(df, shard_rows=40, query_block=2) == want


def clusters(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 5
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * 0.3).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard_rows,block", [(10_000, 10_000), (150, 5), (30, 3)])
def test_many_cells_and_blocks(spark, shard_rows, block):
    rows = clusters(3, 1500)
    assert got(frame(spark, rows), shard_rows=shard_rows, query_block=block) == expected(rows)


def test_recall_and_work_fall_with_the_factor():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(6000, 16))
    queries = points[::60]
    tree, order = V.Tree.build(points)
    full = {}
    for factor in (1.0, 2.0, 4.0):
        score, place, seen = tree.search(queries, order, 11, factor, np.full(len(queries), np.inf))
        full[factor] = ([set(order[p].tolist()) for p in place], seen)
    recall = {f: np.mean([len(a & b) / 11 for a, b in zip(full[f][0], full[1.0][0])]) for f in full}
    brute = [set(np.argsort(V.distances(points, q))[:11].tolist()) for q in queries]
    assert full[1.0][0] == brute
    assert recall[2.0] >= 0.9 and full[2.0][1] < full[1.0][1] and full[4.0][1] < full[2.0][1]


def test_recall_of_the_relaxed_search_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = {(r[0], r[2]) for r in got(df)}
    relaxed = {(r[0], r[2]) for r in got(df, factor=6.0, shard_rows=500)}
    assert len(exact & relaxed) / len(exact) >= 0.9


def test_close_groups_are_searched_without_seeing_most_points():
    rows = clusters(5, 4000)
    points = np.array([v for _, v in rows])
    tree, order = V.Tree.build(points)
    score, place, seen = tree.search(points[::100], order, 11, 1.0, np.full(40, np.inf))
    assert seen < 0.4 * 40 * len(points)


def test_unusable_vectors_ties_repeats_and_lengths(spark):
    rows = [(100 * i, v) for i, v in enumerate(BAD)] + [(None, [1.0, 2.0])]
    rows += [(1000 + i, [1.0, 1.0]) for i in range(40)] * 2  # 40 equal vectors, each row twice
    rows += [(2000, [1.0, 1.0]), (2000, [3.0, 1.0]), (2000, [1.0, 1.0, 1.0]), (2001, [5.0, 1.0, 1.0]), (-100, [2.0, 1.0]), (3, [2.0, -0.0])]
    df = frame(spark, rows)
    want = expected(rows)
    assert got(df) == want
    assert got(df, shard_rows=3, query_block=2) == want
    assert [r[2] for r in want if r[0] == 1000] == list(range(1001, 1011))


def test_one_vector_in_most_rows_is_one_point(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(1000 + i, [float(i), 0.5, 1.0]) for i in range(1, 60)]
    df = frame(spark, rows)
    index = V.Index.fit(V.usable(df), shard_rows=20)
    sizes = [len(r["ends"]) // 8 for r in index.shards.collect()]
    assert sum(sizes) == 60 and max(sizes) <= 40
    assert got(df, shard_rows=20) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(1, [1.0]), (2, [2.0])], [(100, [1.0]), (7, [2.0])], [(100, None)]])
def test_few_rows(spark, rows):
    df = frame(spark, rows)
    assert got(df) == expected(rows)


def test_k_beyond_the_index_is_refused(spark):
    index = V.Index.fit(V.usable(frame(spark, [(1, [1.0])])), k=3)
    with pytest.raises(ValueError):
        index.search(V.usable(frame(spark, [(1, [1.0])])), k=4)
