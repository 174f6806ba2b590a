"""Document fingerprints from closed syncmers.

A text is its sequence of words. A run of ``K`` words is an anchor when the
smallest hash among its inner runs of ``S`` words is that of the first or the
last (a closed syncmer): whether it is chosen depends on its own words only,
never on its surroundings, so equal passages give equal anchors wherever they
stand, and of any ``K - S + 1`` neighbouring runs at least one is chosen. ``anchors``
returns them with their word positions and 64-bit hashes.

Positions are matched by neighbours: two anchors in a row with the same gap in
words stand at one offset in both texts, wherever their passage moved. A
fingerprint is all different such pairs of the whole text (``BITS`` bits each, the
whole fingerprint as base64), and likeness is the Jaccard index of two of them.
Two words in five begin an anchor, so a fingerprint grows with the text, to
about half its length, and nothing of a text is left out.

DataFrame functions only. Every document is compared with the next one
(descending doc_id) and with its edited text, whose tail comes from the next
one: neighbours are found on a table of ids and lengths; the texts are
shuffled, and each travels once more to the document before it; nothing is sampled.

Defined results: NULL text: empty; fewer than ``K`` words: one anchor, the
whole text, which is its own pair; no word: an empty fingerprint (two of them are alike, 1.0);
the next of the last document is the first; equal ids order by text hash;
NULL ids come last; repeated rows (same id and text) are one document here
and answered alike; no rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import SPACE, key128
from stipendlens.plans.lineage import cut_lineage
from stipendlens.plans.ranking import dense_ids

K, S = 6, 2
BITS = 48  # of a pair of anchors; eight characters of base64


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _inner(h: Column) -> Column:
    """Hashes of the runs of S = 2 words (one per word, the last NULL)."""
    return F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))),
                      lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _closed(g: Column, make) -> Column:
    """``make(start, hash)`` of every closed syncmer, over inner hashes ``g``."""
    inner = range(K - S + 1)

    def at(i: Column) -> Column:
        first, *mid, last = (F.get(g, i + j) for j in inner)
        words = [F.get(g, i + j) for j in inner if j % S == 0 or j == K - S]
        return F.when(F.least(first, last) <= F.least(*mid), make(i, F.xxhash64(*words)))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(g) - K), at), lambda x: x.isNotNull())


def _chosen(text: Column, make, kind: str) -> Column:
    def of(h: Column) -> Column:
        whole = F.array(make(F.lit(0), F.xxhash64(h)))
        return F.when(F.size(h) >= K, _let(_inner(h), lambda g: _closed(g, make))).when(F.size(h) > 0, whole).otherwise(
            F.array().cast(f"array<{kind}>"))

    return _let(word_hashes(text), of)


def anchors(text: Column) -> Column:
    """array<struct<pos int, hash bigint>>: the anchors with their first word's position."""
    return _chosen(text, lambda i, h: F.struct(i.alias("pos"), h.alias("hash")), "struct<pos:int,hash:bigint>")


def signature(text: Column) -> Column:
    """array<bigint>: the different pairs of neighbouring anchors with their gap
    in words, ascending; a single anchor is its own pair."""

    def pair(x: Column, y: Column) -> Column:
        gap = F.coalesce(y["pos"] - x["pos"], F.lit(0))
        return F.xxhash64(x["hash"], y["hash"], gap).bitwiseAND(F.lit((1 << BITS) - 1))

    def pairs(a: Column) -> Column:
        n = F.greatest(F.size(a) - 1, F.least(F.size(a), F.lit(1)))
        return F.sort_array(F.array_distinct(F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), pair)))

    return _let(anchors(text), pairs)


def as_text(sig: Column) -> Column:
    """``BITS`` bits a pair, as base64 on one line; empty for no word."""
    digits = F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of different values; 1.0 of two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def neighbours(docs: DataFrame) -> DataFrame:
    """row (identity of a document), next_row, prev_row, prev_chars."""
    k1, k2 = key128(F.col("text"))
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.length("text").alias("n")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.col("doc_id")).alias("down"), "k1", "k2")
    at = cut_lineage(dense_ids(rows.withColumn("o", order), "o", 0, "at").select(
        F.struct("doc_id", "k1", "k2").alias("row"), "n", "at"))
    total = at.count()
    after = at.select(F.when(F.col("at") == 1, total).otherwise(F.col("at") - 1).alias("at"), F.col("row").alias("next_row"))
    before = at.select(F.when(F.col("at") == total, 1).otherwise(F.col("at") + 1).alias("at"), F.col("row").alias("prev_row"),
                       F.col("n").alias("prev_chars"))
    return at.select("row", "at").join(after, "at").join(before, "at").drop("at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for ``docs(doc_id bigint, text)``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    beside = cut_lineage(neighbours(docs).select("row", "prev_row", "prev_chars"))
    k1, k2 = key128(F.col("text"))
    placed = docs.select(F.struct("doc_id", k1.alias("k1"), k2.alias("k2")).alias("row"), "text").repartition("row")
    donors = placed.join(beside, "row").select(
        F.col("prev_row").alias("row"), "prev_chars", F.col("text").alias("next_text")).dropDuplicates(["row"])
    joined = placed.join(donors, "row")
    n = F.length("text")
    lent = F.substr("next_text", F.lit(1), F.floor(F.col("prev_chars") / 3).cast("int"))
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 3).cast("int")), lent)
    out = joined.select(F.col("row.doc_id").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"),
                        signature(F.col("text")).alias("sig"), signature(F.col("next_text")).alias("next_sig"))
    out = out.withColumn("edited_sig", signature(F.col("edited")))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
                      likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                      likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
