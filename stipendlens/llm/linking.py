"""Linking items that share keys, without all pairs of a bucket.

``link`` takes items with candidate keys (bands) and a verifier and returns
verified links from which ``components`` gives the groups that all candidate
pairs would give:

1. in rounds, each bucket that holds several components draws a hub by hash
   (another one each round; buckets of much the same members draw the same one,
   so that a pair is checked once, not in every bucket), and every member of another component is checked
   against it: members, not pairs. Links found join components, so a bucket
   of one huge group soon holds one component, whatever its size, and a pair
   inside a component needs no check;
2. what is left, pairs of *different* components that still share a bucket, is
   checked in full: a bucket is dealt by hash into chunks of about ``CHUNK``
   members, and every two chunks meet in one group of bounded size, which
   compares its members in place and returns links, not pairs; of buckets of
   the same members one is compared.

No link between different components is lost. Shared keys are counted with a
map-side combine before members are joined to them, and the joins leave the
member side for AQE to split when a key is hot. Everything that is read twice
is checkpointed in the shared folder; counts and flags are all that reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendlens.plans.lineage import cut_lineage


def _flat(edges: DataFrame) -> bool:
    """Whether all edges lead straight to roots: of a star's ends none has two
    edges or is another one's root. Oriented edges make the root the smallest id."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return per.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty()


def _both(first: Column, second: Column) -> Column:
    """The edges ``first`` and ``second`` of a row, as rows."""
    return F.explode(F.array(first, second)).alias("e")


def _edge(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``links(a, b)`` -> id, root: the smallest id of every linked id's
    connected component, by alternating large-star and small-star steps
    (rounds grow with the logarithm of the longest path). Minima combine
    map-side and join back, so a star's centre is never gathered. ``known``
    are the components of earlier links: only what joins these is worked on."""
    if known is not None:
        return _joined(links, known)
    a, b = F.col("a"), F.col("b")
    edges = cut_lineage(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _flat(edges):
        both = edges.select(_both(_edge("u", "v"), _edge("v", "u"))).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(_both(_edge("v", "m"), _edge("u", "m"))).select("e.*")
        edges = cut_lineage(small.filter(F.col("u") != F.col("v")).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _joined(links: DataFrame, known: DataFrame) -> DataFrame:
    """The components of ``known`` (id, root) and ``links`` together."""
    for x in ("a", "b"):
        links = links.join(known.select(F.col("id").alias(x), F.col("root").alias("at")), x, "left").withColumn(x, F.coalesce("at", x)).drop("at")
    stars = cut_lineage(components(links.select("a", "b")))
    if stars.isEmpty():
        return known
    moved = known.join(stars.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left")
    new = stars.join(known.select("id"), "id", "left_anti").select("id", "root")
    return cut_lineage(moved.select("id", F.coalesce("to", "root").alias("root")).unionByName(new))


CHUNK = 512


def chunk_pairs(rest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rest(key, id, root)`` -> key, i, j, own (the member's chunk, i or j),
    id, root: every member once for each chunk that its own one meets."""
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dealt = rest.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root")


def different_buckets(rest: DataFrame) -> DataFrame:
    """``rest(key, id, root)`` with one bucket of those that have the same members."""
    sets = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    return cut_lineage(rest.join(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))


def link(items: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame],
         min_similarity: float, **options) -> DataFrame:
    """The verified links (a, b) of ``grouped``."""
    return grouped(items, verify, compare, min_similarity, **options)[0]


def grouped(items: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame],
            min_similarity: float, rounds: int = 2, known: DataFrame | None = None, chunk: int = CHUNK,
            hub_from: int = 2) -> tuple[DataFrame, DataFrame]:
    """``items(id bigint, keys array<bigint>)`` -> verified links (a, b), and
    the components (id, root) of them and of ``known`` ones, which are not compared.
    ``verify`` maps pairs (a, b) to (a, b, similarity); ``compare`` maps
    ``chunk_pairs`` to the links (a, b) between members of different roots.
    Buckets of fewer than ``hub_from`` members draw no hub."""
    members = items.select(F.explode("keys").alias("key"), "id")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key")
    members = cut_lineage(members.join(shared, "key", "left_semi"))
    links, roots = None, known

    def still_open() -> DataFrame:
        """Members (key, id, root) of the buckets that hold several components."""
        placed = members.select("key", "id", F.col("id").alias("root"))
        if roots is not None:
            placed = members.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
        return cut_lineage(placed.join(several.select("key"), "key", "left_semi").select("key", "id", "root"))

    def add(found: DataFrame) -> None:
        nonlocal links, roots
        found = cut_lineage(found.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        roots = components(found, roots)

    for r in range(rounds):
        members = still_open()
        drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)), "id", "root")).alias("hub"), F.count(F.lit(1)).alias("n"))
        drawn = drawn.filter(F.col("n") >= hub_from).drop("n")
        pairs = members.join(drawn, "key").filter(F.col("root") != F.col("hub.root")).select(
            F.col("hub.id").alias("a"), F.col("id").alias("b"))
        add(verify(pairs.distinct()).filter(F.col("similarity") >= min_similarity))
    add(compare(chunk_pairs(different_buckets(still_open()), chunk)).select("a", "b").distinct())
    return links, roots
