"""Nearest neighbours by vantage-point trees, one a shard of the vectors.

A vantage-point tree splits its points by their distance to one of them: the
near half, the far half, and so on down to leaves. By the triangle inequality a
half whose distances to the vantage point lie in [lo, hi] has no point nearer to
a query at distance d from it than max(d - hi, lo - d). It is skipped if that
bound times ``factor`` exceeds the distance of the query's k-th best so far:
``factor`` 1 skips nothing that counts, so the search is exact; a greater one
skips more and may miss some.

Shards are the cells of a first such tree. It is fitted on a bounded sample
(``SAMPLE_BYTES`` and ``SAMPLE_ROWS``, drawn by hash) and routes every row; a
cell of more than ``shard_rows`` rows is dealt by hash into several shards, so
that no task gets an unbounded one. Each shard's tree is a row of the index. A
query searches its own cell's shards first and then, with the distance found
there, those of the cells that the same bound does not rule out. Queries meet
shards by (shard, block of queries), about ``query_block`` of them at a time,
and each group returns its best only.

Equal vectors are one point with its smallest ids (as many as an answer can
hold), picked before the shuffle, and equal queries are searched once, so a
vector which fills a third of the rows costs as one.

Distances are Euclidean, computed in double precision from the differences.

Defined results: vectors that are NULL, empty, zero or hold a NULL or
non-finite number take no part, nor do NULL ids; vectors of different length
never meet; a repeated row (same id and vector) counts once; an id with several
vectors is several rows, and only a query's own row is not its neighbour; ties
go to the smaller id; fewer than k candidates: all; no rows: no rows. Columns
beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipendlens.llm.common import written

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
_CELL_SAMPLE = 16  # sampled vectors a cell, at least
_LEAF = 128
_SLACK = 1 - 1e-9  # bounds give way by this for rounding, so that exact stays exact
_INDEX = "dim int, cell int, sub int, vectors binary, ids binary, ends binary, nodes binary, reach binary"


def distances(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of ``points`` (n, d) to ``x`` (d) or, pairwise, (m, 1, d)."""
    return np.sqrt(((points - x) ** 2).sum(axis=-1))


def exact_scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances row by row, squares added from the first component to the
    last: the same in every group, and in SQL."""
    return np.sqrt(np.cumsum((points - queries) ** 2, axis=1)[:, -1])


def _vantage(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few points that whose distances to a few others spread most."""
    tried = points[rng.choice(len(points), min(len(points), 8), replace=False)]
    others = points[rng.choice(len(points), min(len(points), 64), replace=False)]
    return tried[int(np.argmax(distances(others[None, :, :], tried[:, None, :]).var(axis=1)))]


class Tree:
    """Points in the order of the leaves; ``nodes`` (from, to, near child, far
    child; children 0 at a leaf), ``reach`` the bounds (near lo, hi, far lo,
    hi) and ``at`` the vantage points."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, reach: np.ndarray, at: np.ndarray):
        self.points, self.nodes, self.reach, self.at = points, nodes, reach, at

    @staticmethod
    def build(points: np.ndarray, leaf: int = _LEAF) -> tuple["Tree", np.ndarray]:
        """The tree of ``points`` and their order in it."""
        rng = np.random.default_rng(len(points))
        order = np.arange(len(points))
        nodes, reach, at = [[0, len(points), 0, 0]], [[0.0] * 4], [np.zeros(points.shape[1])]
        todo = [0]
        while todo:
            n = todo.pop()
            lo, hi = nodes[n][:2]
            if hi - lo <= leaf:
                continue
            own = points[order[lo:hi]]
            v = _vantage(own, rng)
            d = distances(own, v)
            half = (hi - lo) // 2
            by = np.argpartition(d, half)
            order[lo:hi] = order[lo:hi][by]
            near, far = d[by[:half]], d[by[half:]]
            nodes[n][2:] = [len(nodes), len(nodes) + 1]
            reach[n] = [near.min(), near.max(), far.min(), far.max()]
            at[n] = v
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[lo, lo + half, 0, 0], [lo + half, hi, 0, 0]]
            reach += [[0.0] * 4] * 2
            at += [at[0] * 0] * 2
        return Tree(points[order], np.array(nodes, np.int64), np.array(reach), np.array(at)), order

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, factor: float,
               limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and places (inf, -1 where there is none) of the k best
        points a query, by score, then ``ids``, no farther than its ``limit``;
        and how many distances to points were computed."""
        m = len(queries)
        score, place = np.full((m, k), np.inf), np.full((m, k), -1, np.int64)
        rank = np.append(ids, np.iinfo(np.int64).max)  # the id of place -1
        seen = 0
        # depth first; queries that take the same way go together, each its nearer half first
        stack = [(0, np.arange(m), np.zeros(m))]
        while stack:
            n, who, bound = stack.pop()
            stay = bound * factor * _SLACK <= np.minimum(score[who, -1], limit[who])
            who = who[stay]
            if not len(who):
                continue
            lo, hi, near, far = self.nodes[n].tolist()
            if near:
                bound = bound[stay]
                d = distances(queries[who], self.at[n])
                r = self.reach[n]
                to_near = np.maximum(bound, np.maximum(d - r[1], r[0] - d))
                to_far = np.maximum(bound, np.maximum(d - r[3], r[2] - d))
                first = d <= (r[1] + r[2]) / 2
                stack += [(far, who[first], to_far[first]), (near, who[~first], to_near[~first]),
                          (near, who[first], to_near[first]), (far, who[~first], to_far[~first])]
                continue
            width = max(1, (1 << 21) // max(1, (hi - lo) * queries.shape[1]))
            for s in range(0, len(who), width):
                w = who[s:s + width]
                d = distances(self.points[None, lo:hi, :], queries[w][:, None, :])
                seen += d.size
                d[d * _SLACK > limit[w][:, None]] = np.inf
                better = (d <= score[w, -1][:, None]).any(axis=1)
                w, d = w[better], d[better]
                scores = np.concatenate([score[w], d], axis=1)
                places = np.concatenate([place[w], np.broadcast_to(np.arange(lo, hi), d.shape)], axis=1)
                places[np.isinf(scores)] = -1
                best = np.lexsort((rank[places], scores), axis=1)[:, :k]
                score[w] = np.take_along_axis(scores, best, 1)
                place[w] = np.take_along_axis(places, best, 1)
        return score, place, seen


class Cells:
    """The first tree: routes vectors to cells, and bounds the distance of a
    query to every cell. One for each length of vectors in the sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        rng = np.random.default_rng(7)
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []  # vantage point, radius, children: nodes, or ~cell
        self.count = 0
        self.root = self._grow(sample, cells, rng)

    def _grow(self, own: np.ndarray, cells: int, rng: np.random.Generator) -> int:
        if cells > 1 and len(own) >= 2 * _CELL_SAMPLE:
            v = _vantage(own, rng)
            d = distances(own, v)
            radius = float(np.median(d))
            near = d <= radius
            if near.any() and not near.all():
                n = len(self.nodes)
                self.nodes.append((v, radius, 0, 0))
                self.nodes[n] = (v, radius, self._grow(own[near], cells - cells // 2, rng), self._grow(own[~near], cells // 2, rng))
                return n
        self.count += 1
        return ~(self.count - 1)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of every row of ``x``, and lower bounds (rows, cells)."""
        own, low = np.zeros(len(x), np.int32), np.zeros((len(x), self.count))
        todo = [(self.root, np.ones(len(x), bool), np.zeros(len(x)))]
        while todo:
            n, here, bound = todo.pop()
            if n < 0:
                own[here] = ~n
                low[:, ~n] = bound
                continue
            v, radius, near, far = self.nodes[n]
            d = distances(x, v)
            todo += [(near, here & (d <= radius), np.maximum(bound, d - radius)),
                     (far, here & (d > radius), np.maximum(bound, radius - d))]
        return own, low


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec array<double>) of the rows that take part, repeated rows once."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")).distinct()


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


class Index:
    """Points dealt to shards, with a tree each."""

    def __init__(self, cells: dict[int, Cells], shards: DataFrame, query_block: int, answer: int):
        self.cells, self.shards, self.query_block, self.answer = cells, shards, query_block, answer

    @staticmethod
    def fit(rows: DataFrame, k: int = 10, shard_rows: int = 16_384, query_block: int = 8_192) -> "Index":
        """The index of ``rows(id, vec)`` for answers of up to ``k``."""
        few = Window.partitionBy("vec").orderBy("id")
        ids = rows.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1)
        points = written(ids.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        dims = points.groupBy(F.size("vec").alias("dim")).count()
        widest = dims.agg(F.max("dim"), F.sum("count")).first()
        size, total = widest[0] or 1, widest[1] or 0
        sample_rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size)))
        # the rows of smallest hash, at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes
        sample = points.select("vec").orderBy(F.xxhash64("vec")).limit(sample_rows).toPandas()["vec"]
        cells = {}
        for dim, own in sample.groupby(sample.map(len)):
            want = max(1, -(-total * len(own) // (len(sample) * shard_rows)))
            cells[int(dim)] = Cells(_matrix(own), want)
        routed = written(Index._routed(points, cells))
        counts = routed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
        parts = F.ceil(F.col("n") / shard_rows).cast("int")
        dealt = routed.join(counts, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec"), parts).cast("int"))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            tree, order = Tree.build(_matrix(pdf["vec"]))
            own = pdf["ids"].iloc[order]
            ends = np.cumsum(own.map(len).to_numpy(), dtype=np.int64)
            flat = np.concatenate(own.to_numpy()).astype(np.int64)
            reach = np.concatenate([tree.reach, tree.at], axis=1)
            return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "sub": [key[2]], "vectors": [tree.points.tobytes()],
                                 "ids": [flat.tobytes()], "ends": [ends.tobytes()], "nodes": [tree.nodes.tobytes()], "reach": [reach.tobytes()]})

        shards = dealt.select("dim", "cell", "sub", "vec", "ids").groupBy("dim", "cell", "sub").applyInPandas(build, _INDEX)
        return Index(cells, written(shards), query_block, k)

    @staticmethod
    def _routed(points: DataFrame, cells: dict[int, Cells]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                dim = pdf["vec"].map(len)
                for d, own in pdf.groupby(dim):
                    cell = cells[d].bounds(_matrix(own["vec"]))[0] if d in cells else 0
                    yield own.assign(dim=np.int32(d), cell=cell)

        return points.select("vec", "ids").mapInPandas(run, "vec array<double>, ids array<bigint>, dim int, cell int")

    def _targets(self, queries: DataFrame, factor: float, home: bool) -> DataFrame:
        """``queries(vec, limit, block)``, a row for every cell to search:
        the own one (``home``), or the others within the limit's reach."""
        cells = self.cells

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for d, own in pdf.groupby(pdf["vec"].map(len)):
                    if d not in cells:  # a length outside the sample: one cell
                        if home:
                            yield own.assign(dim=np.int32(d), cell=np.int32(0))
                        continue
                    here, low = cells[d].bounds(_matrix(own["vec"]))
                    if home:
                        yield own.assign(dim=np.int32(d), cell=here)
                        continue
                    limit = own["limit"].to_numpy()
                    for c in range(cells[d].count):
                        go = (here != c) & (low[:, c] * factor * _SLACK <= limit)
                        if go.any():
                            yield own[go].assign(dim=np.int32(d), cell=np.int32(c))

        return queries.select("vec", "limit", "block").mapInPandas(run, "vec array<double>, limit double, block int, dim int, cell int")

    def _found(self, targets: DataFrame, k: int, factor: float) -> DataFrame:
        """(vec, id, score): every group's k best for each of its queries."""
        targets = written(targets)
        meets = targets.select("dim", "cell", "block").distinct()
        shards = self.shards.join(meets, ["dim", "cell"])
        shards = shards.toDF(*shards.columns)
        asked = targets.join(self.shards.select("dim", "cell", "sub"), ["dim", "cell"])

        def run(key: tuple, shard: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(shard) or not len(asks):
                return pd.DataFrame({"vec": [], "id": [], "score": []})
            row, dim = shard.iloc[0], key[0]
            ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
            starts = np.append(0, ends[:-1])
            reach = np.frombuffer(row["reach"]).reshape(-1, 4 + dim)
            tree = Tree(np.frombuffer(row["vectors"]).reshape(-1, dim), np.frombuffer(row["nodes"], np.int64).reshape(-1, 4),
                        reach[:, :4], reach[:, 4:])
            wanted = _matrix(asks["vec"])
            place = tree.search(wanted, ids[starts], k, factor, asks["limit"].to_numpy())[1]
            q, c = np.nonzero(place >= 0)
            p = place[q, c]
            score = exact_scores(tree.points[p], wanted[q])
            n = (ends - starts)[p]
            which = np.repeat(np.arange(len(p)), n)  # every id of a point
            flat = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[p], n)]
            out = pd.DataFrame({"q": q[which], "score": score[which], "id": flat}).sort_values(["q", "score", "id"])
            out = out[out.groupby("q").cumcount() < k]
            return pd.DataFrame({"vec": asks["vec"].to_numpy()[out["q"].to_numpy()], "id": out["id"], "score": out["score"]})

        by = ["dim", "cell", "sub", "block"]
        return shards.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, "vec array<double>, id bigint, score double")

    def search(self, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
        """``queries(id, vec)`` -> query_id, rank, id, score: the k nearest rows of each but itself."""
        if not 1 <= k <= self.answer or factor < 1:
            raise ValueError(f"k must be 1 to {self.answer}, the index's answers, and factor at least 1")
        need = k + 1  # one may be the query's own row
        asked = queries.select("vec").distinct()
        blocks = max(1, -(-asked.count() // self.query_block))
        asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int")))
        start = asked.withColumn("limit", F.lit(float("inf")))
        first = written(self._found(self._targets(start, factor, True), need, factor))
        far = first.select("vec", F.row_number().over(Window.partitionBy("vec").orderBy("score", "id")).alias("n"), "score").filter(F.col("n") == need)
        limited = asked.join(far.select("vec", F.col("score").alias("limit")), "vec", "left").fillna(float("inf"), ["limit"])
        found = first.unionByName(self._found(self._targets(limited, factor, False), need, factor))
        nearest = Window.partitionBy("vec").orderBy("score", "id")
        found = found.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= need)
        found = found.groupBy("vec").agg(F.collect_list(F.struct("score", "id")).alias("found"))
        return _ranked(queries, found, k)


def _ranked(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Each query with the k best of its vector's ``found(vec, found)``, its own row left out."""
    met = queries.select(F.col("id").alias("query_id"), "vec").join(found, "vec")
    others = F.filter(F.array_sort("found"), lambda f: ~((f["id"] == F.col("query_id")) & (f["score"] == 0)))
    out = met.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "f"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score"))


def nearest(vectors: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 16_384, query_block: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of every row whose id is divisible by 100."""
    rows = written(usable(vectors))
    index = Index.fit(rows, k, shard_rows, query_block)
    return index.search(rows.filter(F.col("id") % 100 == 0), k, factor).withColumnRenamed("id", "vec_id")
