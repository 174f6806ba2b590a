"""Merkle manifest of a dataset: leaf, proof and root for every document.

A leaf is the SHA-256 of a document's fields. The leaves of a language,
ascending by doc_id, form a tree with ``fan_out`` children a node, the
languages' subroots, in the order of the languages, another one on top. Every
document gets its proof, the siblings to the left and right of its path level
by level, from which ``fold`` recomputes the root.

Levels are built with lag and lead windows. At level l a node is a stretch of
``fan_out ** l`` rows, and the row of its first leaf holds its hash; columns at
the fixed offsets ``o * fan_out ** l``, masked by the node's slot and by the
length of its run, are its siblings, and rows of first children hash the
parents. The windows are partitioned by (tree, block of ``fan_out ** height``
positions) and not by tree, so that a language which holds a third of all rows
is spread over many tasks of bounded size. ``height`` levels need one
shuffle; block roots are the leaves of the next round, and the number of rounds
is the logarithm of the largest tree to the base of the block size.

Positions come from a range-partitioned sort of narrow rows (ids and hashes;
texts are never shuffled), counted per sorted partition. Equal rows are one row
with a multiplicity until the blocks are dealt, so a row that is repeated any
number of times passes the sort once.

Defined results: a NULL field hashes as ``-``; NULL languages are a tree of
their own, first in order; NULL ids come first in their tree; rows of one
language and id are ordered by their leaf; repeated rows are leaves of their
own and all returned; one document alone: leaf = subroot = root and an empty
proof; no rows: no rows. Columns beside those of a document are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendlens.plans.lineage import cut_lineage

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row of documents, some of its columns ``changed``."""
    return digest(*[field(changed.get(c, F.col(c))) for c in LEAF_COLUMNS])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and ``proof`` lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def positions(rows: DataFrame, tree: str, order: Sequence[str], copies: str) -> DataFrame:
    """``rows`` plus ``pos``, the position of each row's first copy in its
    tree by ``order`` (NULLs first), and ``total``, the copies in the tree."""
    part, mark = "__part", "__mark"
    ordered = rows.orderBy(tree, *[F.col(c).asc_nulls_first() for c in order])
    # the checkpoint fixes the numbers of the sorted partitions and the rows' order in them
    tagged = cut_lineage(ordered.withColumn(part, F.spark_partition_id()).withColumn(mark, F.monotonically_increasing_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = before.partitionBy(tree, part).orderBy(mark)
    sizes = tagged.groupBy(tree, part).agg(F.sum(copies).alias("__size"))
    each = Window.partitionBy(tree)  # one row a sorted partition
    sizes = sizes.select(tree, part, F.coalesce(F.sum("__size").over(before.partitionBy(tree).orderBy(part)), F.lit(0)).alias("__first"),
                         F.sum("__size").over(each).alias("total"))
    placed = tagged.withColumn("pos", F.coalesce(F.sum(copies).over(inside), F.lit(0))).join(sizes, [tree, part])
    return placed.withColumn("pos", F.col("pos") + F.col("__first")).drop(part, mark, "__first")


def _expand(rows: DataFrame, copies: str, block: int) -> DataFrame:
    """One row a copy, with its block: first one row a block that the copies
    reach, dealt by block, then the copies inside."""
    last = F.col("pos") + F.col(copies) - 1
    dealt = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(last / block))))
    dealt = dealt.repartition("tree", "block")
    inside = F.sequence(F.greatest("pos", F.col("block") * block), F.least(last, F.col("block") * block + block - 1))
    return dealt.withColumn("pos", F.explode(inside)).drop(copies)


def _levels(nodes: DataFrame, fan_out: int, height: int, proofs: bool) -> DataFrame:
    """``nodes(tree, block, pos, total, hash, ...)`` plus ``top``, on rows that
    begin a block the hash of its node ``height`` levels up, and with
    ``proofs`` also ``proof``, the siblings on the way there."""
    block = Window.partitionBy("tree", "block").orderBy("pos")
    kept = list(nodes.columns)
    out = nodes.withColumn("__h", F.col("hash"))
    for level in range(height):
        width = fan_out ** level
        count = F.floor((F.col("total") + (width - 1)) / width)  # nodes of this level in the tree
        index = F.floor(F.col("pos") / width)
        slot = index % fan_out
        run = F.least(F.lit(fan_out).cast("long"), count - (index - slot))
        first = (F.col("pos") % width == 0) & (count > 1)
        none = F.lit("")
        left = [F.when(slot >= o, F.lag("__h", o * width).over(block)).otherwise(none) for o in range(fan_out - 1, 0, -1)]
        right = [F.when(slot + o < run, F.lead("__h", o * width).over(block)).otherwise(none) for o in range(1, fan_out)]
        cols = [F.when(first, F.concat(*right)).alias("__r")]
        if proofs:
            cols.append(F.when(first, F.concat(*left)).alias("__l"))
        out = out.select("*", *cols)
        parent = F.when(first & (slot == 0), digest(F.col("__h"), F.col("__r"))).when(count <= 1, F.col("__h"))
        if proofs:
            sib = F.when(first, F.struct(F.col("__l").alias("left"), F.col("__r").alias("right")))
            out = out.withColumn(f"__s{level}", sib)
        out = out.withColumn("__h", parent).drop("__l", "__r")
    if not proofs:
        return out.select(*kept, F.col("__h").alias("top"))
    # the row of a node's first leaf has its siblings; the rows after it, up to the next such row, take them over
    siblings = [F.col("__s0")] + [F.last(f"__s{i}", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0))
                                  for i in range(1, height)]
    out = out.select(*kept, F.col("__h").alias("top"), *[s.alias(f"__s{i}") for i, s in enumerate(siblings)])
    return out.select(*kept, "top", F.array_compact(F.array(*[f"__s{i}" for i in range(height)])).cast(_PROOF).alias("proof"))


def _paths(nodes: DataFrame, fan_out: int, height: int) -> DataFrame:
    """``nodes(tree, pos, total, hash, ...)``, one row a leaf, with ``block``
    and dealt by (tree, block) -> the same plus ``proof`` and ``peak``, the tree's root."""
    block = fan_out ** height
    tops = cut_lineage(_levels(nodes.select("tree", "block", "pos", "total", "hash"), fan_out, height, False)
                       .filter(F.col("pos") % block == 0)
                       .select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / block).alias("total"), F.col("top").alias("hash")))
    largest = tops.agg(F.max("total")).first()[0] or 0
    if largest <= 1:
        above = tops.select("tree", F.col("pos").alias("block"), F.array().cast(_PROOF).alias("above"), F.col("hash").alias("peak"))
    else:
        next_up = tops.withColumn("block", F.floor(F.col("pos") / block)).repartition("tree", "block")
        above = _paths(next_up, fan_out, height).select("tree", F.col("pos").alias("block"), F.col("proof").alias("above"), "peak")
    local = _levels(nodes, fan_out, height, True).drop("top")
    return local.join(above, ["tree", "block"]).withColumn("proof", F.concat("proof", "above")).drop("above")


def manifest(leaves: DataFrame, fan_out: int = 2, height: int = 12) -> DataFrame:
    """``leaves(doc_id, lang, leaf, ...)`` -> the same rows with ``subroot``
    (of the language), ``root`` (of the dataset) and ``proof``, an array of
    (left, right) siblings from the leaf's level up to the root's children."""
    extra = [c for c in leaves.columns if c not in ("doc_id", "lang", "leaf")]
    named = leaves.select(F.struct("lang").alias("tree"), "doc_id", F.col("leaf").alias("hash"), F.struct(F.lit(0).alias("none"), *extra).alias("extra"))
    rows = named.groupBy("tree", "doc_id", "hash", "extra").agg(F.count(F.lit(1)).alias("copies"))
    placed = cut_lineage(positions(cut_lineage(rows), "tree", ["doc_id", "hash", "extra"], "copies"))
    nodes = _expand(placed, "copies", fan_out ** height)
    below = _paths(nodes, fan_out, height)
    # the languages' subroots are the leaves of the upper tree
    subroots = cut_lineage(below.filter("pos = 0").select(F.col("tree").alias("of"), F.col("peak").alias("hash"), F.lit(1).alias("copies"),
                                                          F.struct(F.lit(0).alias("all")).alias("tree")))
    upper = _expand(positions(subroots, "tree", ["of"], "copies"), "copies", fan_out ** height)
    roots = cut_lineage(_paths(upper, fan_out, height).select(F.col("of").alias("tree"), F.col("proof").alias("upper"), F.col("peak").alias("root")))
    out = below.join(roots, "tree")
    return out.select("doc_id", F.col("tree.lang").alias("lang"), F.col("hash").alias("leaf"), F.col("peak").alias("subroot"), "root",
                      F.concat("proof", "upper").alias("proof"), *[F.col("extra")[c].alias(c) for c in extra])


def tampered_manifest(docs: DataFrame, fan_out: int = 2, height: int = 12) -> DataFrame:
    """The manifest's digests per document, and the verification of a copy of
    the documents in which every n_chars whose id's CRC-32 is divisible by 7
    is greater by 1: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified. A NULL id is not tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # beyond the largest long too
    rows = docs.select(*LEAF_COLUMNS).select("doc_id", "lang", leaf_hash().alias("leaf"), F.when(hit, leaf_hash(n_chars=more)).alias("claimed"))
    tree = manifest(rows, fan_out, height)
    folded = fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    out = tree.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
