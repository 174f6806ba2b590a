"""Periodic runs of words: stretches that repeat a shorter stretch.

A run is a maximal stretch of words with smallest period q, at least twice q
long. Every run contains a Lyndon root: a stretch of q words, the longest
Lyndon word that begins at its place, in the order of the words or in the
opposite one. So each place gives two candidates, which are extended to the
right and to the left by longest common extensions (LCE):

* Ukkonen's suffix trees of the stretch and of its reversal, linear in its words;
* an Euler tour of each tree, kept at its leaves: the word depth of the lowest
  common ancestor of neighbouring leaves; a range minimum over it, by a sparse
  table, gives the depth of any two leaves' ancestor, their LCE, in constant time;
* the longest Lyndon word at a place ends where the next smaller suffix begins:
  next smaller values of the leaves' ranks, the tour taken in either order.

Documents are dealt to Arrow batches by Spark and nothing is shuffled. The
words of a batch are numbered by Arrow's dictionary. Trees are built only where
a run can be: a run of m words or more repeats each of its words inside some
m / 2 words that occur twice in it, so words outside such repeated passages
belong to no run and part the document (exact; found by hashes of passages,
whose collisions only keep more words; repeated until nothing parts any more).

Memory: about 8 million characters a slice, or one longer text, and some 400
bytes a word of the longest stretch of one document that is left for a tree.

Defined results: NULL and empty texts have no words, no runs and an empty
collapsed text; repeated rows are answered alike, one row each; NULL ids stay;
no rows: no rows. Columns beside the text and the kept ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import WORD, text_of

MIN_LENGTH = 12  # words of the shortest run that counts
_SLICE = 8_000_000
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


class SuffixTree:
    """Ukkonen's suffix tree of ``words`` (numbers from 1 on) and an end mark."""

    def __init__(self, words: list[int]):
        t = [*words, 0]
        n = len(t)
        self.size, self.width = n, max(t) + 1
        start, end, link = [0], [0], [0]  # of the edge that leads to a node; leaves end at n
        suffix = [-1]
        to: dict[int, int] = {}
        width = self.width
        node = edge = length = waiting = leaves = 0
        for i, c in enumerate(t):
            waiting += 1
            inner = 0  # the inner node made last, still without a suffix link
            while waiting:
                if length == 0:
                    edge = i
                key = node * width + t[edge]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(leaves)
                    leaves += 1
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    reach = min(end[child], i + 1) - start[child]
                    if length >= reach:
                        node, edge, length = child, edge + reach, length - reach
                        continue
                    at = start[child] + length
                    if t[at] == c:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    split = len(start)
                    to[key] = split
                    start += (start[child], i)
                    end += (at, n)
                    link += (0, 0)
                    suffix += (-1, leaves)
                    leaves += 1
                    start[child] = at
                    to[split * width + t[at]] = child
                    to[split * width + c] = split + 1
                    if inner:
                        link[inner] = split
                    inner = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.end, self.suffix = start, end, suffix
        keys = np.fromiter(to, np.int64, len(to))
        by = np.argsort(keys)
        self._child = np.fromiter(to.values(), np.int64, len(to))[by]  # children of a node side by side, by their first word
        owner = keys[by] // width
        self._from = np.searchsorted(owner, np.arange(len(start) + 1))

    def tour(self, opposite: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The Euler tour at the leaves: suffixes in order (``opposite``: words
        in the opposite order, the end first all the same) and the word depth of
        the lowest common ancestor of each and the one before it."""
        child, first, start, end, suffix = self._child.tolist(), self._from.tolist(), self.start, self.end, self.suffix
        order, depth = [], []
        stack = [(0, 0)]
        meet = 0
        while stack:
            node, above = stack.pop()
            if node < 0:  # a child that is not its parent's first: paths part at the parent
                node, meet = -node, above
            below = above + end[node] - start[node]
            if suffix[node] >= 0:
                order.append(suffix[node])
                depth.append(meet)
                continue
            kids = child[first[node]:first[node + 1]]
            if opposite:
                ends = start[kids[0]] == self.size - 1
                kids = kids[:1] + kids[:0:-1] if ends else kids[::-1]
            stack.extend((-k, below) for k in kids[:0:-1])
            stack.append((kids[0], below))
        return np.array(order, np.int64), np.array(depth, np.int64)


class Extensions:
    """Longest common extensions of the suffixes of one tour."""

    def __init__(self, order: np.ndarray, depth: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.levels = [depth.astype(np.int32)]
        while 2 ** len(self.levels) <= len(depth):
            half = 2 ** (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # depths lo .. hi - 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - 2 ** int(k)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    r = rank.tolist()
    out = np.arange(len(r), 0, -1)
    stack: list[int] = []
    for i, x in enumerate(r):
        while stack and r[stack[-1]] > x:
            j = stack.pop()
            out[j] = i - j
        stack.append(i)
    return out


def stretch_runs(words: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of at least ``min_length``."""
    n = len(words)
    t = np.unique(words, return_inverse=True)[1].ravel() + 1
    back = Extensions(*SuffixTree(t[::-1].tolist()).tour())
    tree = SuffixTree(t.tolist())
    order, depth = tree.tour()
    ahead = Extensions(order, depth)
    mirrored = np.empty(n + 1, np.int64)
    mirrored[tree.tour(opposite=True)[0]] = np.arange(n + 1)
    found = []
    for rank in (ahead.rank, mirrored):
        i, q = np.arange(n), lyndon_lengths(rank[:n])
        right, left = ahead(i, i + q), back(n - i, n - (i + q))  # place n is the end, which extends nothing
        start, length = i - left, left + q + right
        good = length >= np.maximum(min_length, 2 * q)
        found.append(np.stack([start[good], length[good], q[good]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_stretches(ids: np.ndarray, ends: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a batch's words, of documents that end
    at ``ends``, outside which there is no run of ``min_length``."""
    wide = max(1, (min_length + 1) // 2)
    odd = np.random.default_rng(11).integers(1, 2 ** 63, wide + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.append(0, ends[:-1]).astype(np.int64)
    stops = np.asarray(ends, np.int64)
    words = ids.astype(np.uint64) + np.uint64(1)
    while True:
        long = stops - starts >= min_length
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return []
        sizes = stops - starts
        heads = sizes - wide + 1  # places where a passage of ``wide`` words begins
        of = np.repeat(np.arange(len(starts)), heads)
        at = np.arange(len(of)) - np.repeat(np.cumsum(heads) - heads, heads) + starts[of]
        h = of.astype(np.uint64) * odd[wide]
        for j in range(wide):
            x = (words[at + j] + np.uint64(j)) * odd[j]
            h = (h ^ (x ^ (x >> np.uint64(29)))) * odd[wide]
        by = np.argsort(h, kind="stable")
        same = h[by][1:] == h[by][:-1]
        twice = np.zeros(len(h), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit, doc = at[twice], of[twice]
        # hits less than ``wide`` words apart, in one stretch, cover one stretch
        parts = np.flatnonzero((np.diff(hit) > wide) | (np.diff(doc) > 0)) if len(hit) else hit
        new_starts = hit[np.append(0, parts + 1)] if len(hit) else hit
        new_stops = hit[np.append(parts, len(hit) - 1)] + wide if len(hit) else hit
        if len(new_starts) == len(starts) and (new_starts == starts).all() and (new_stops == stops).all():
            return list(zip(starts.tolist(), stops.tolist()))
        starts, stops = new_starts, new_stops


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    part = np.cumsum(np.asarray(batch.column("size"), np.int64)) // _SLICE
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield batch.slice(a, b - a)


def _analyse(texts: pa.Array, min_length: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, owner = split.flatten(), np.asarray(pc.list_parent_indices(split))
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    ids = np.asarray(flat.dictionary_encode().indices)[real]
    counts = np.bincount(owner[real], minlength=len(texts))
    ends = np.cumsum(counts)
    rows: dict[int, list[np.ndarray]] = {}
    for a, b in repeated_stretches(ids, ends, min_length):
        runs = stretch_runs(ids[a:b], min_length)
        if len(runs):
            doc = int(np.searchsorted(ends, a, side="right"))
            runs[:, 0] += a - (ends[doc] - counts[doc])
            rows.setdefault(doc, []).append(runs)
    none = np.empty((0, 3), np.int64)
    by_doc = [np.concatenate(rows[d]) if d in rows else none for d in range(len(texts))]
    collapsed = []
    for runs, text in zip(by_doc, texts.to_pylist()):
        words = text.encode().split()
        if len(runs):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
        collapsed.append(b" ".join(words).decode())
    every = np.concatenate(by_doc) if len(by_doc) else none
    runs = pa.StructArray.from_arrays([pa.array(every[:, c], pa.int64()) for c in range(3)], ["start", "length", "period"])
    offsets = np.append(0, np.cumsum([len(r) for r in by_doc])).astype(np.int32)
    return counts, pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(collapsed, pa.string())


def find_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), min_length: int = MIN_LENGTH) -> DataFrame:
    """The ``keep`` columns of ``docs(text, ...)``, n_words, runs (array of
    start, length and period in words, by start and period) and collapsed, the
    words that no run holds after its first period, joined by blanks."""
    src = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], text_of().alias("text"), F.length(text_of()).alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                counts, runs, collapsed = _analyse(b.column("text"), min_length)
                yield pa.RecordBatch.from_arrays([*[b.column(f"keep_{c}") for c in keep], pa.array(counts, pa.int64()), runs, collapsed],
                                                 names=[*keep, "n_words", "runs", "collapsed"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, n_words bigint, runs array<{_RUN}>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth document's (by CRC-32 of its id) words made
    periodic from some word on. A NULL id leaves its text alone."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words").cast("long")
    hit = hit.withColumn("n", F.when(n > 0, n)).withColumn("a", F.col("g") % F.col("n"))
    hit = hit.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    places = F.concat(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    source = F.transform(places, lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    planted = F.array_join(F.transform(source, lambda i: F.get("words", i.cast("int"))), " ")
    return hit.select("doc_id", F.when(F.col("n").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and
    exponent_milli, and digests of all runs and of the collapsed text."""
    found = find_runs(with_planted_period(docs))
    length = F.array_max(F.transform("runs", lambda r: r["length"]))
    best = F.get(F.filter("runs", lambda r: r["length"] == length), F.lit(0))  # runs are in order of start and period
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text: Column = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
