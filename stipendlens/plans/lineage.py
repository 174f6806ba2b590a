"""Lineage cuts that survive executor loss.

Reliable ``checkpoint()`` into the shared folder named by the cluster in
``spark.checkpoint.dir``. Only when that is unset (tests, a laptop) do we
pick a scratch folder ourselves. Never ``localCheckpoint``: its blocks live
on executors and vanish with them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns spark.checkpoint.dir
        configured = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    # unset: fine on one machine; executors of a cluster could not read each other's /tmp
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="stipendlens-ckpt-")
    sc.setCheckpointDir(path)
    return path


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it ends, not when the
    driver happens to collect its garbage: for steps whose result is stored.
    A stage that the result turned out not to need (one side of a join was
    empty) is ended too, or it would look for files that are gone."""
    before, tag = spark.conf.get(FREE_SHUFFLES, None), f"stored-{uuid.uuid4().hex}"
    spark.conf.set(FREE_SHUFFLES, "true")
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.interruptTag(tag)
        spark.removeTag(tag)
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably and return a frame that reads it back."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        # planned anew: a frame that the caller has run keeps its own shuffles
        return df.select("*").checkpoint(eager=True)
