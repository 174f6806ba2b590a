"""Mixing sources to target weights.

Sources, ordered by code points with NULL last, weigh 5, 2, 1, repeating, and
share the corpus' words; a target stops at ``max_epochs`` times its source's
words and the excess is shared again by weight (the water level is the
largest of the levels that stop 0, 1, 2, ... sources in the order of their
stopping level).

Within a source the documents stand in hashed order, and their running words
cut the source into blocks of about equal words. A source's quota is as many
blocks as its target takes: whole epochs of all its blocks, then the blocks that
a random permutation of them puts first, until their words reach the target; the
last of them is cut there, within one document. Words taken are the rounded target.

Block quotas are dealt to output shards by a multivariate hypergeometric
splitting tree: at each node the node's tokens (one per block, known only by
source) are put in random order and the left child takes the share of its
leaves, which is the multivariate hypergeometric draw of the left child's
quotas; a shard then owns that many blocks of each source's permuted block
list, disjoint by position. The rows of a mix are the documents of the blocks so
drawn, and carry their shard and a key for the local shuffle.

DataFrame functions only. Running sums are two-level (per hashed bucket of a
source, then inside a bucket), so a source that holds a third of all rows is
spread over ``2**bucket_bits`` groups. Tokens number at most
``max_epochs * (blocks + sources)``, whatever the documents; no step needs a
document's text but counting its words (and the cut of one document a source).

Defined results: NULL or empty text: size 0, nothing taken; NULL source: a
source of its own; repeated rows are documents of their own; ties in the hashed
order fall to (doc_id, text hash); no rows: no rows. Reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipendlens.llm.common import SPACE, WORD
from stipendlens.plans.joins import bounded_broadcast
from stipendlens.plans.lineage import cut_lineage

WEIGHTS = (5, 2, 1)


#: Side tables hold one row per (source, bucket) or (source, block): broadcast up to so many rows, checked.
MAX_SIDE_ROWS = 200_000


def words_in(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` -> source, source_size, target double."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(total))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``quotas(sk, quota)`` -> sk, shard, quota: the splitting tree."""
    tokens = quotas.select("sk", F.explode(F.sequence(F.lit(1), F.greatest(F.col("quota"), F.lit(1)).cast("int"))).alias("k"),
                           "quota").filter(F.col("k") <= F.col("quota")).drop("quota")
    tokens = tokens.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    for depth in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        node = Window.partitionBy("lo", "hi")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.floor(F.count(F.lit(1)).over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        at = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(depth), "lo", "sk", "k"), "sk", "k"))
        # a node of one leaf stays (mid = lo, left = 0)
        tokens = tokens.withColumn("mid", mid).withColumn("left", at <= left).select(
            "sk", "k", F.when(F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"),
            F.when(F.col("left"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return tokens.groupBy("sk", F.col("lo").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def mix(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, max_epochs: int = 3,
        blocks: int = 4096, shards: int = 8, bucket_bits: int = 10, seed: int = 17) -> DataFrame:
    """``docs(doc_id, source, text)`` -> one row per document and epoch:
    doc_id, the ``keep`` columns (under names that start with ``keep_``), row_key (the document row's identity),
    size, source_size, target, epoch, words (taken in this epoch, 0 too),
    block, shard and shuffle_key (NULL shard where words is 0)."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    base = docs.select(
        "doc_id", F.struct(F.col("source").alias("source")).alias("sk"), words_in(F.col("text")).alias("size"),
        h.alias("h"), F.shiftrightunsigned(h, 64 - bucket_bits).cast("int").alias("bucket"),
        F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    buckets = cut_lineage(base.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = buckets.groupBy("sk").agg(F.sum("bucket_size").alias("source_size"))
    plan = source_targets(sizes.select(F.col("sk.source").alias("source"), "source_size"), weights, max_epochs)
    size, goal = F.col("source_size"), F.round("target").cast("long")
    share = size / F.greatest(F.sum("source_size").over(Window.partitionBy()), F.lit(1))
    plan = cut_lineage(plan.withColumn("blocks", F.ceil(share * blocks).cast("long"))
                       .withColumn("epochs", F.when(size > 0, F.floor(goal / size)).otherwise(0).cast("int"))
                       .withColumn("rest", goal - F.col("epochs") * size)
                       .select(F.struct("source").alias("sk"), "source_size", "target", "blocks", "epochs", "rest"))

    starts = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(starts), F.lit(0)))
    buckets = buckets.drop("bucket_size").join(bounded_broadcast(plan, MAX_SIDE_ROWS), "sk")
    inside = Window.partitionBy("sk", "bucket").orderBy("h", "doc_id", "tie", "size")
    placed = base.join(bounded_broadcast(buckets, MAX_SIDE_ROWS), ["sk", "bucket"]).withColumn(
        "n", F.row_number().over(inside)).withColumn(
        "start", F.col("bucket_start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("block", F.floor(F.col("start") * F.col("blocks") / F.greatest("source_size", F.lit(1))))

    drawn = bounded_broadcast(cut_lineage(_drawn(placed, plan, shards, seed)), MAX_SIDE_ROWS)
    rows = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).join(drawn, ["sk", "epoch", "block"], "left")
    room = F.col("room") - (F.col("start") - F.col("block_start"))
    words = F.when(F.col("room").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), room)))
    rows = rows.withColumn("words", words)
    return rows.select("doc_id", *[f"keep_{c}" for c in keep], F.struct("sk", "bucket", "n").alias("row_key"), "size", "source_size",
                       "target", "epoch", "words", "block", F.when(F.col("words") > 0, F.col("shard")).alias("shard"),
                       F.xxhash64(F.lit(seed + 2), "doc_id", "epoch", "n").alias("shuffle_key"))


def _drawn(placed: DataFrame, plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """The blocks of the mix: sk, epoch, block, block_start, room (words to take
    of it) and the shard that the tree's quotas give it to."""
    per = placed.groupBy("sk", "block").agg(F.sum("size").alias("held"), F.min("start").alias("block_start"))
    per = cut_lineage(per.join(bounded_broadcast(plan.select("sk", "epochs", "rest"), MAX_SIDE_ROWS), "sk"))
    permuted = F.xxhash64(F.lit(seed + 1), "sk", "epoch", "block")
    last = per.withColumn("epoch", F.col("epochs")).withColumn("order", permuted)
    before = Window.partitionBy("sk").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("held").over(before), F.lit(0))
    last = last.withColumn("room", F.least(F.col("held"), left)).filter(F.col("room") > 0)
    whole = per.filter((F.col("epochs") > 0) & (F.col("held") > 0)).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("epochs") - 1, F.lit(0))))).withColumn("order", permuted)
    cols = ["sk", "epoch", "block", "block_start", F.col("room").cast("long").alias("room"), "order"]
    taken = whole.withColumn("room", F.col("held")).select(*cols).unionByName(last.select(*cols))
    taken = taken.withColumn("at", F.row_number().over(Window.partitionBy("sk").orderBy("order", "epoch", "block")))
    owned = split_quotas(taken.groupBy("sk").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    upto = Window.partitionBy("sk").orderBy("shard")
    owned = owned.withColumn("last", F.sum("quota").over(upto)).select("sk", "shard", "last")
    owned = owned.groupBy("sk").agg(F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("ends"))  # <= shards
    return taken.join(owned, "sk").select("sk", "epoch", "block", "block_start", "room",
                                          F.get(F.filter("ends", lambda e: e["last"] >= F.col("at")), F.lit(0))["shard"].alias("shard"))


def shuffle_locally(mixed: DataFrame) -> DataFrame:
    """Mixed rows laid out for writing by shard, each task's rows in random order."""
    return mixed.filter(F.col("words") > 0).repartition("shard", F.pmod("shuffle_key", F.lit(64))).sortWithinPartitions(
        "shard", "shuffle_key")


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes."""
    return mix(docs, **options).groupBy("row_key", "doc_id", "size", "source_size", "target").agg(
        F.sum("words").cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def cut_to_words(text, words):
    """The first ``words`` words of a text, with the white space before and between them."""
    spaced = F.regexp_extract_all(text, F.lit(rf"({SPACE[:-1]}*{WORD})"), F.lit(1))
    return F.array_join(F.slice(spaced, F.lit(1), words.cast("int")), "")
