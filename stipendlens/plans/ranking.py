"""RANK() without a single-task window partition.

``Window.partitionBy(year).orderBy(desc(total))`` sends every row of a year
to one task; with one year holding a third of the data that task is the
job. ``rank_within`` computes the same SQL ``RANK()`` as a prefix count:

    rank(v) = 1 + (rows of the partition ordered before v)

1. collapse rows to distinct (partition, value) with their multiplicity
   (hash aggregate, combined map-side, so a hot value is one row), checkpointed;
2. range-partition those by (partition, value): Spark samples them, so the
   sorted partitions ("buckets") are balanced however the values lie, and a
   large year covers many of them; a second checkpoint fixes the order;
3. rows before v = rows of v's partition in earlier buckets (a window over
   at most ``buckets`` rows per partition) + rows before v in v's own bucket (a
   window partitioned by (partition, bucket));
4. join the rank back on (partition, value), NULL-safe.

NULL placement follows PostgreSQL: NULLs last ascending, first descending.
No side is broadcast by hand; AQE does where the sizes it measured allow it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipendlens.plans.lineage import cut_lineage


def _buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return max(1, int(buckets))
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        n = 200
    return max(2, min(n, 4096))


def rank_within(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = True,
                out: str = "rank", buckets: int | None = None) -> DataFrame:
    """``df`` plus column ``out`` = RANK() OVER (PARTITION BY by ORDER BY value).

    The partition columns travel as one struct column: struct equality
    treats NULL fields as equal, so NULL partitions join like any other,
    and every join and window below is keyed by the same expressions, so
    a side already partitioned by a window is not shuffled again."""
    by = list(by)
    v, k, bucket, mark = F.col(value), "__rk_k", "__rk_b", "__rk_m"
    base = df.withColumn(k, F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("p")))
    counts = cut_lineage(base.groupBy(k, value).agg(F.count(F.lit(1)).alias("__rk_n")))
    order = [F.col(k), v.desc_nulls_first() if descending else v.asc_nulls_last()]
    ordered = counts.repartitionByRange(_buckets(df, buckets), *order).sortWithinPartitions(*order)
    # the checkpoint fixes bucket and order, so ranks do not change when a task is recomputed
    placed = cut_lineage(ordered.withColumn(bucket, F.spark_partition_id()).withColumn(mark, F.monotonically_increasing_id()))

    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = placed.groupBy(k, bucket).agg(F.sum("__rk_n").alias("__rk_bn"))
    per_bucket = per_bucket.select(k, bucket, F.coalesce(
        F.sum("__rk_bn").over(earlier.partitionBy(k).orderBy(bucket)), F.lit(0)).alias("__rk_before_b"))
    before = F.coalesce(F.sum("__rk_n").over(earlier.partitionBy(k, bucket).orderBy(mark)), F.lit(0))
    ranked = placed.select(k, bucket, value, before.alias("__rk_before_v")).join(per_bucket, [k, bucket], "inner")

    j = "__rk_j"  # (partition, value) as one NULL-safe join key
    rank = F.lit(1) + F.col("__rk_before_b") + F.col("__rk_before_v")
    ranks = ranked.select(F.struct(k, value).alias(j), rank.cast("long").alias(out))
    return base.withColumn(j, F.struct(k, value)).join(ranks, j, "inner").drop(j, k)


def dense_ids(df: DataFrame, order_col: str, start, out: str) -> DataFrame:
    """Ids ``start + 1, start + 2, ...`` in the order of the unique, non-NULL
    column ``order_col``; ``start`` is a literal or a scalar Column (e.g. a
    scalar subquery over the stored table's max id).

    A range-partitioned ``zipWithIndex`` in DataFrame operators:
    ``orderBy`` range-partitions the rows (Spark samples the key, so the
    partitions are balanced and each holds a contiguous key range); every row
    is tagged with its partition and its position inside it, and the tagged
    rows are checkpointed, so the tags - and therefore the ids - never
    change when a task is recomputed. Per-partition counts (one row per
    partition, broadcast) give each partition its offset. One sort, one
    checkpoint, no task beyond one sort partition."""
    start_col = start if not isinstance(start, (int, float)) else F.lit(int(start))
    ordered = df.orderBy(F.col(order_col).asc())
    # partition index and in-partition position, fixed by the checkpoint
    tagged = cut_lineage(ordered.withColumn("__id_p", F.spark_partition_id())
                         .withColumn("__id_m", F.monotonically_increasing_id()))
    sizes = tagged.groupBy("__id_p").agg(F.count(F.lit(1)).alias("__id_n"), F.min("__id_m").alias("__id_m0"))
    wp = Window.orderBy("__id_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__id_p", "__id_m0", F.coalesce(F.sum("__id_n").over(wp), F.lit(0)).alias("__id_off"))
    numbered = tagged.join(F.broadcast(offsets), "__id_p", "inner")
    pos = F.col("__id_m") - F.col("__id_m0")
    return (numbered.withColumn(out, (F.coalesce(start_col, F.lit(0)) + F.col("__id_off") + pos + 1).cast("long"))
            .drop("__id_p", "__id_m", "__id_m0", "__id_off"))
