"""Fixed-schema Parquet sources and sinks.

Raw tables are read with declared schemas (no inference, no footer sweep);
domain tables are stored partitioned by their period / day columns, so the
report filters prune directories, and committed in versions (``snapshots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipendlens.schemas import TABLES
from stipendlens.sources.snapshots import Change, Snapshot, commit, read_manifest, read_snapshot, read_table

_NTZ = T.TimestampNTZType()

RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = RAW_SCHEMAS.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_domain_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One stored domain table, as of the last committed version."""
    return read_table(spark, root, name)


def read_domain(spark: SparkSession, root: str) -> Snapshot:
    """All stored domain tables of the last committed version."""
    return read_snapshot(spark, root)


def write_domain_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", recreate: bool = False) -> None:
    """Commit one domain table: ``overwrite`` it whole, replace the
    ``partitions`` present in ``df``, or ``append``, which is the audit log's
    only mode after the initial load (M10) unless it is dropped and
    re-created (``recreate``)."""
    spark = df.sparkSession
    if name == "audit_logs" and mode != "append" and not recreate and read_manifest(spark, root)["tables"].get(name):
        raise ValueError("audit_logs is append only")
    commit(spark, root, [Change(name, "replace" if mode == "overwrite" else mode, df)])


def write_domain(tables: dict[str, DataFrame], root: str) -> None:
    """Drop-and-recreate load of the given tables (S7), all in one version:
    readers see the old load or the new one."""
    if tables:
        commit(next(iter(tables.values())).sparkSession, root, [Change(name, "replace", df) for name, df in tables.items()])


#: Columns that are INTEGER in the source, so JSON numbers there.
_NUMBERS = {f.name for t in TABLES.values() for f in t.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))}


def json_columns(df: DataFrame) -> DataFrame:
    """The columns as the source's JSON has them: INTEGER columns are numbers,
    counts (BIGINT) and NUMERIC text with their decimals, times and dates
    ISO text, NULLs present."""
    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif isinstance(f.dataType, (T.DecimalType, T.DateType)) or (isinstance(f.dataType, T.LongType) and f.name not in _NUMBERS):
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def to_json(df: DataFrame) -> DataFrame:
    """One column ``json``: a JSON object per row, every key present."""
    shown = json_columns(df)
    return shown.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON result sink (S8): one JSON object per row, like the REST payloads."""
    json_columns(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def result_changes(name: str, result, audit: DataFrame, audit_ids: int) -> list[Change]:
    """The changes of a workflow ``Result``: its new rows appended (inserts) or
    the partitions it touches replaced, and its audit rows numbered after
    ``audit_ids`` and appended."""
    from stipendlens.operators.workflows import append_audit, touched_partitions

    if getattr(result, "inserts", False):
        first = Change(name, "append", result.changed)
    else:
        first = Change(name, "partitions", touched_partitions(result.table, result.changed, name))
    _, numbered = append_audit(None, audit, audit_ids)
    return [first, Change("audit_logs", "append", numbered)]


def commit_result(spark: SparkSession, root: str, name: str, result, audit_rows: DataFrame | None = None,
                  base: Snapshot | None = None) -> dict:
    """Commit a workflow ``Result`` with its audit rows as one version: both
    are seen or neither. ``base`` is the snapshot the result was made from; if
    another run has committed since, ``ConcurrentCommit`` is raised and nothing
    changes. Returns row counts of what was written."""
    last = (base.ids if base is not None else read_manifest(spark, root)["ids"]).get("audit_logs", 0)
    changes = result_changes(name, result, result.audit if audit_rows is None else audit_rows, last)
    counts = commit(spark, root, changes, None if base is None else base.version)
    return {"rows_written": counts[name], "audit_appended": counts["audit_logs"]}


def commit_delete(spark: SparkSession, root: str, name: str, ids: DataFrame, base: Snapshot | None = None) -> dict:
    """Delete stored rows by primary key with the schema's referential actions
    (M12), all tables reached in one version. Only partitions that hold a row
    to delete or to change are rewritten. Returns the rows of what was
    rewritten by table, and how many ids were blocked."""
    from stipendlens.operators.workflows import delete_changes

    snap = read_snapshot(spark, root) if base is None else base
    reached, blocked = delete_changes(snap, name, ids)
    refused = blocked.count()
    changes = [Change(n, "partitions", rows, touched) for n, (rows, touched) in reached.items()]
    return {"rewritten": commit(spark, root, changes, snap.version) if changes else {}, "blocked": refused}


def postgres_options(url: str, table: str, user: str | None = None, password: str | None = None,
                     partition_column: str | None = None, lower_bound: int | None = None,
                     upper_bound: int | None = None, num_partitions: int | None = None,
                     fetch_size: int = 10000) -> dict[str, str]:
    """Options for a parallel JDBC read of one source table: with a numeric
    ``partition_column`` (the SERIAL key) and bounds, Spark issues
    ``num_partitions`` range queries instead of one full-table cursor."""
    opts = {"url": url, "dbtable": table, "driver": "org.postgresql.Driver", "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if partition_column is not None:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                     "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    return opts


def read_postgres_table(spark: SparkSession, name: str, **options) -> DataFrame:
    """One domain table from the source PostgreSQL database, cast to the
    domain schema (enums arrive as text, SERIAL as int). Needs the
    PostgreSQL JDBC driver on the classpath; ``password_hash`` is never
    selected."""
    schema = TABLES[name]
    cols = ", ".join(f.name for f in schema.fields)
    opts = postgres_options(table=f"(SELECT {cols} FROM {name}) AS src", **options)
    df = spark.read.format("jdbc").options(**opts).load()
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
