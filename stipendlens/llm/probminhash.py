"""Near-duplicate documents by ProbMinHash.

A text is the weighted set of its five-word shingles (lower case; weight: how
often the shingle occurs; a text of fewer words is one shingle). For each
shingle a Poisson process of rate its weight sends arrivals to random
registers, a register keeps its earliest arrival's shingle, and a shingle
stops as soon as its next arrival comes after the latest register filled
(early termination). Two texts then agree in a register with probability
equal to their probability Jaccard similarity

    J_P = sum over common d of 1 / sum over d' of max(a_d'/a_d, b_d'/b_d),

which is the plain Jaccard similarity where all weights are equal. Registers
are cut into bands; texts that meet in a band are verified with the exact J_P
of their whole texts. 28 bands of 5 miss a pair at similarity 0.8 with
probability 1.5e-5; ``linking`` keeps large groups from being paired in full.

Equal texts are one row (128-bit key, combined map-side) before anything is
paired. Signatures and verification are numpy on Arrow batches inside tasks;
Spark shuffles band keys, then only the texts of candidates (fetched with a
broadcast of their keys where their number is within ``max_broadcast_rows``, else by a
shuffle join).

Defined results: a text without a word (NULL, empty, blank) resembles nothing
and is its own class; repeated rows share a class; ties cannot occur (a class
is named by its smallest doc_id, NULL only if it has no other); no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import key128
from stipendlens.llm.linking import grouped
from stipendlens.plans.joins import bounded_broadcast
from stipendlens.plans.lineage import cut_lineage

SHINGLE = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_BATCH_WORDS = 400_000


class _Hashes(dict):
    """Word -> 64-bit hash, kept while below a million entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their counts."""
    words = (text or "").lower().encode("utf-8").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = h * _P + w[i:n - size + 1 + i]
    return np.unique(_mix(h), return_counts=True)


def registers(doc: np.ndarray, h: np.ndarray, w: np.ndarray, docs: int, m: int) -> np.ndarray:
    """(docs, m) register contents of documents given as flat (doc, shingle
    hash, weight) rows; every document needs a shingle."""
    when = np.full(docs * m, np.inf)
    who = np.zeros(docs * m, np.uint64)
    latest = np.full(docs, np.inf)
    x, step = np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        while len(h):
            many = int(np.clip(300_000 // len(h), 1, 64))
            at = (np.arange(step, step + many, dtype=np.uint64) + np.uint64(1)) * _P
            bits = _mix(h[:, None] ^ _mix(at)[None, :])
            gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / w[:, None]
            times = x[:, None] + np.cumsum(gaps, axis=1)
            slot = doc[:, None] * m + (_mix(bits ^ _P) % np.uint64(m)).astype(np.int64)
            soon = times < latest[doc][:, None]
            t, s = times[soon], slot[soon]
            np.minimum.at(when, s, t)
            won = t == when[s]
            who[s[won]] = np.broadcast_to(h[:, None], times.shape)[soon][won]
            latest = when.reshape(docs, m).max(axis=1)
            x, step = times[:, -1], step + many
            alive = x < latest[doc]
            doc, h, w, x = doc[alive], h[alive], w[alive], x[alive]
    return who.reshape(docs, m)


def band_keys(texts: Iterable[str | None], bands: int, rows: int) -> list[np.ndarray]:
    """One int64 key per band for every text; none for a text without words."""
    hashes, out, pending, size = _Hashes(), [], [], 0

    def flush() -> None:
        full = [(i, h, c) for i, (h, c) in enumerate(pending) if len(h)]
        keys = [np.zeros(0, np.int64)] * len(pending)
        if full:
            doc = np.repeat(np.arange(len(full)), [len(h) for _, h, _ in full])
            sig = registers(doc, np.concatenate([h for _, h, _ in full]),
                            np.concatenate([c for _, _, c in full]).astype(np.float64), len(full), bands * rows)
            with np.errstate(over="ignore"):
                sig = sig.reshape(len(full), bands, rows)
                key = np.zeros((len(full), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _P
                for r in range(rows):
                    key = _mix(key * _P + sig[:, :, r])
            for (i, _, _), k in zip(full, key.view(np.int64)):
                keys[i] = k
        out.extend(keys)

    for text in texts:
        pending.append(shingles(text, hashes))
        size += len(pending[-1][0])
        if size > _BATCH_WORDS or len(pending) >= 4000:
            flush()
            pending, size = [], 0
    flush()
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets (sorted hashes, counts). Shingles of the
    same two counts contribute alike, so the sums run over pairs of counts."""
    (ha, ca), (hb, cb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    base = int(cb.max()) + 1
    pairs, n = np.unique(ca[ia] * base + cb[ib], return_counts=True)
    x, y = pairs // base, pairs % base
    only_a, only_b = ca.sum() - ca[ia].sum(), cb.sum() - cb[ib].sum()
    total = 0.0
    for alpha, beta, k in zip(x, y, n):
        total += k / (np.maximum(x / alpha, y / beta) @ n + only_a / alpha + only_b / beta)
    return float(total)


def text_classes(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per different text: k1, k2, doc_id (smallest), keys."""

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series(band_keys(texts, bands, rows))

    k1, k2 = key128(F.col("text"))
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), keys(F.col("text")).alias("keys")).groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))


def verifier(docs: DataFrame, max_broadcast_rows: int):
    """pairs (a, b) of text keys -> (a, b, similarity), from whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        last: tuple = (None, None)
        for p in batches:
            got = []
            for a, ta, tb in zip(p["a"], p["ta"], p["tb"]):
                if last[0] != a:
                    last = (a, shingles(ta, hashes))
                got.append(probability_jaccard(last[1], shingles(tb, hashes)))
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "similarity": np.array(got, float)})

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)

        def texts(side: str) -> DataFrame:
            wanted = cut_lineage(pairs.select(F.col(side).alias("k1")).distinct())
            rows = docs.select(F.xxhash64("text").alias("k1"), "text").join(
                bounded_broadcast(wanted, max_broadcast_rows), "k1", "left_semi")
            return rows.dropDuplicates(["k1"]).select(F.col("k1").alias(side), F.col("text").alias("t" + side))

        both = pairs.join(texts("b"), "b").join(texts("a"), "a")
        return both.select("a", "b", "ta", "tb").mapInPandas(run, "a bigint, b bigint, similarity double")

    return verify


def similar_pairs(sets: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, min_similarity: float) -> list[tuple[int, int]]:
    """Pairs of ``wanted`` (boolean matrix) whose J_P reaches the threshold:
    for sets of equal weights from shared counts, summed over blocks of
    shingles; for others one by one."""
    n = len(sets)
    where = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    every, column = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    where, column = where[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for start in range(0, len(every), 4096):
        lo, hi = np.searchsorted(column, (start, start + 4096))
        block = np.zeros((n, 4096), np.float32)
        block[where[lo:hi], column[lo:hi] - start] = 1
        shared += block @ block.T
    size = np.array([len(h) for h, _ in sets], np.float32)
    plain = np.array([c.min() == c.max() for _, c in sets])
    exact = plain[:, None] & plain[None, :]
    jaccard = shared / np.maximum(size[:, None] + size[None, :] - shared, 1)
    found = np.argwhere(wanted & exact & (jaccard >= min_similarity - 1e-6)).tolist()
    for i, j in np.argwhere(wanted & ~exact & (shared > 0)).tolist():
        if probability_jaccard(sets[i], sets[j]) >= min_similarity:
            found.append([i, j])
    return [(i, j) for i, j in found]


def comparer(docs: DataFrame, min_similarity: float, max_broadcast_rows: int):
    """``linking.chunk_pairs`` rows -> links (a, b) between different roots."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes = _Hashes()
        roots, own = group["root"].to_numpy(), group["own"].to_numpy()
        same_chunk = group["i"].iloc[0] == group["j"].iloc[0]
        wanted = np.triu(roots[:, None] != roots[None, :], 1)
        if not same_chunk:
            wanted &= own[:, None] != own[None, :]
        links = similar_pairs([shingles(t, hashes) for t in group["text"]], wanted, min_similarity) if wanted.any() else []
        ids = group["id"].to_numpy()
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    def compare(rows: DataFrame) -> DataFrame:
        wanted = cut_lineage(rows.select("id").distinct())
        texts = docs.select(F.xxhash64("text").alias("id"), "text").join(
            bounded_broadcast(wanted, max_broadcast_rows), "id", "left_semi").dropDuplicates(["id"])
        return rows.join(texts, "id").groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")

    return compare


def near_classes(docs: DataFrame, bands: int = 28, rows: int = 5, min_similarity: float = 0.8,
                 max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per different text: k1, k2, doc_id (its smallest), class_id
    (the smallest doc_id of its group)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    classes = cut_lineage(text_classes(docs, bands, rows))
    _, roots = grouped(classes.select(F.col("k1").alias("id"), "keys"), verifier(docs, max_broadcast_rows),
                       comparer(docs, min_similarity, max_broadcast_rows), min_similarity)
    groups = classes.drop("keys").join(roots.withColumnRenamed("id", "k1"), "k1", "left")
    linked = groups.filter(F.col("root").isNotNull())
    named = linked.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return linked.join(named, "root").select("k1", "k2", "doc_id", "class_id").unionByName(
        groups.filter(F.col("root").isNull()).select("k1", "k2", "doc_id", F.col("doc_id").alias("class_id")))


def has_word(text):
    return text.rlike(r"[^\x20\x09-\x0D]")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id for every document."""
    classes = near_classes(docs, **options)
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = key128(text)
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), has_word(text).alias("worded"))
    return rows.join(classes.select("k1", "k2", "class_id"), ["k1", "k2"]).select(
        "doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each class the row of its
    smallest doc_id (one, if that row is repeated); wordless texts all stay."""
    classes = near_classes(docs.select("doc_id", "text"), **options)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    row = F.struct(F.col("k1"), F.col("k2"), F.col("doc_id"))
    # a class of equal texts and smallest ids may have several text rows of that id: one text stays
    first = first.groupBy("class_id").agg(F.min(row).alias("row")).select("row")
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = key128(text)
    keyed = docs.withColumn("__row", F.struct(k1.alias("k1"), k2.alias("k2"), F.col("doc_id")))
    worded = keyed.filter(has_word(text)).join(first.withColumnRenamed("row", "__row"), "__row", "left_semi").dropDuplicates(["__row"])
    return worded.unionByName(keyed.filter(~has_word(text))).select(*columns)
