"""Session settings for tests, the bench and single-machine runs.

On a cluster the submitter owns the session; these are the settings our
jobs assume: AQE on (runtime coalescing, skew-join splitting, runtime
broadcast), UTC session zone, Arrow for pandas hand-off, UI off.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[*]", app: str = "stipendlens",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(shuffle_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large cluster, sized from the bytes the biggest shuffle
    moves and the cores available (e.g. 100 TB of ticks and payments on
    1000 executors x 8 cores):

    * initial shuffle partitions ~ bytes / 256 MB (at least 2 per core, at
      most 100k), coalesced at runtime by AQE to the advisory size, so each
      task's partition fits executor memory and spills little;
    * 512 MB scan splits: fewer, larger scan tasks over Parquet;
    * broadcast up to 64 MB (our size checks read this threshold too);
    * skew split above 1 GB and 5x the median partition.

    ``spark.checkpoint.dir`` is not set here: it must name the cluster's
    shared storage and comes from the submitter."""
    parts = max(2 * total_cores, min(100_000, shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.session.timeZone": "UTC",
    }
