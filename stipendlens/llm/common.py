"""Shared helpers: reading the given tables, word patterns, beta priors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendlens.plans.lineage import ensure_checkpoint_dir, shuffles_freed

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: a
    lineage cut that stores columns compressed, for larger tables."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes the tables (of ``written``) that ``frames`` read: when nothing reads them any more."""
    for df in frames:
        jvm = getattr(df.sparkSession, "_jvm", None)  # Spark Connect has none: there they stay
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()} if jvm else ():
            if folder.rpartition("/")[2].startswith("table-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(key: str = "doc_id") -> Column:
    """Fold 0 of 5: never used to learn labels. A NULL id hashes as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def key128(*cols: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes; equal for equal values."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def session_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def beta_strength(groups: DataFrame, bad: str, n: str, lo: float = 1.0, hi: float = 1000.0) -> tuple[float, float]:
    """(mean, strength) of a beta prior over the groups' failure rates by the
    moment estimate of the beta-binomial: the intra-group correlation rho is
    what the spread of the rates exceeds binomial noise by; strength is
    1/rho - 1, held within [lo, hi]. One row of sums reaches the driver."""
    r = groups.filter(F.col(n) > 0).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).cast("double").alias("m"), F.sum(bad).cast("double").alias("x"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"),
        F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n)).alias("xx")).first()
    if not r["k"] or not r["m"]:
        return 0.0, hi
    p = r["x"] / r["m"]
    pq = p * (1 - p)
    spread = r["xx"] - r["m"] * p * p  # sum of n (rate - p)^2
    base = r["m"] - r["nn"] / r["m"] - (r["k"] - 1)
    if pq <= 0 or base <= 0:
        return p, hi
    rho = (spread - pq * (r["k"] - 1)) / (pq * base)
    return p, hi if rho <= 1 / (1 + hi) else max(lo, 1 / rho - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` training documents of each label (text, y): the
    ids of smallest hash outside the held-out fold. The chosen ids are the
    only thing broadcast, at most 2 * per_class longs."""
    known = (labels.filter(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id")
             .agg(F.max(label).cast("int").alias("y")).withColumn("__h", F.xxhash64("doc_id")))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy("__h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.drop("__h")), "doc_id").select(
        "doc_id", text_of().alias("text"), "y")
