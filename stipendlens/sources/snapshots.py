"""Atomic commits over the domain tables: one small manifest per version.

A stored table is a list of Parquet folders, one for each partition (or for the
whole table) and run that wrote it: ``data/<table>/run=<id>/<partition>``. The
manifest of a version names them for all tables, together with the highest
primary key given out so far for each. Writers put their rows into folders of
a new run, which no manifest names yet, and publish the next manifest last, by
one rename that fails if that version exists. So readers see all of a commit
(several tables and the audit log) or nothing of it; a run that dies at any
point has changed nothing; and of two runs that started from the same version
one is refused (``ConcurrentCommit``) and starts again on what the other wrote.

Nothing stored is read to commit: ids continue from the manifest, appended rows
add folders, changed rows replace the partitions they touch. What passes
through the driver is the manifest and the names of the partitions written.

Folders that no manifest names (of refused or dead runs, or replaced ones) are
left alone until ``vacuum`` removes those that are old enough."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from typing import NamedTuple
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendlens.schemas import PARTITION_COLUMNS, PRIMARY_KEYS, TABLES

_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
SORT_COLUMNS = {"meal_attendance": ["student_id"], "cash_payments": ["student_id"], "audit_logs": ["logged_at"]}


class ConcurrentCommit(RuntimeError):
    """Another run published a version since this one read its tables."""


class Snapshot(dict):
    """The tables of one version, by name; ``version``, ``ids`` (highest
    primary key given out) and ``paths`` (folders) by table."""

    version: int = 0
    ids: dict[str, int]
    paths: dict[str, list[str]]


class Change(NamedTuple):
    """What a commit does to one table: ``append`` the rows, ``replace`` the
    whole table by them, or replace the ``partitions`` that the rows (and
    ``touched``, distinct partition values) lie in."""

    name: str
    mode: str
    rows: DataFrame
    touched: DataFrame | None = None


# ------------------------------------------------------------------ files
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _names(spark: SparkSession, pattern: str) -> list[str]:
    fs, p, _ = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or ()))


def _manifest_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifests/{version:012d}.json"


def _versions(spark: SparkSession, root: str) -> list[int]:
    found = (os.path.basename(n) for n in _names(spark, f"{root.rstrip('/')}/manifests/*.json"))
    return sorted(int(n[:-5]) for n in found if n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The manifest of ``version`` (the last one), or an empty one."""
    if version is None:
        version = max(_versions(spark, root), default=0)
    if not version:
        return {"version": 0, "tables": {}, "ids": {}}
    fs, p, jvm = _fs(spark, _manifest_path(root, version))
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """Write the manifest aside and give it its name, unless that is taken."""
    target = _manifest_path(root, manifest["version"])
    fs, to, jvm = _fs(spark, target)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.getScheme() == "file":  # a local rename would replace the file; a link fails if the name exists
        try:
            os.link(urlparse(draft.toString()).path, urlparse(to.toString()).path)
            done = True
        except FileExistsError:
            done = False
        fs.delete(draft, False)
    else:
        done = not fs.exists(to) and fs.rename(draft, to)
        if not done:
            fs.delete(draft, False)
    if not done:
        raise ConcurrentCommit(f"version {manifest['version']} of {root} was published by another run")


# ------------------------------------------------------------------ reading
def read_table(spark: SparkSession, root: str, name: str, manifest: dict | None = None) -> DataFrame:
    """One table as the manifest (of the last version) names it."""
    paths = (manifest or read_manifest(spark, root))["tables"].get(name) or []
    if not paths:
        return spark.createDataFrame([], TABLES[name])
    base = f"{root.rstrip('/')}/data/{name}"
    df = spark.read.schema(TABLES[name]).option("basePath", base).parquet(*[f"{base}/{p}" for p in paths])
    return df.select(*TABLES[name].fieldNames())


def read_snapshot(spark: SparkSession, root: str) -> Snapshot:
    """All tables of the last version."""
    manifest = read_manifest(spark, root)
    snap = Snapshot({name: read_table(spark, root, name, manifest) for name in TABLES})
    snap.version, snap.ids, snap.paths = manifest["version"], dict(manifest["ids"]), dict(manifest["tables"])
    return snap


# ------------------------------------------------------------------ writing
def _write(change: Change, root: str, run: str) -> list[str]:
    """The rows of a change into this run's folder; returns the folders made.

    Rows are rebalanced on the partition columns: AQE sizes the write tasks and
    splits a partition that holds a large share of the rows over several tasks
    and files. In the files rows are sorted by the usual join key, so that key
    lookups skip row groups by their statistics."""
    name, spark = change.name, change.rows.sparkSession
    out = change.rows.select(*TABLES[name].fieldNames())
    parts = PARTITION_COLUMNS.get(name) or []
    out = out.hint("rebalance", *parts) if parts else out.hint("rebalance")
    if SORT_COLUMNS.get(name):
        out = out.sortWithinPartitions(*parts, *SORT_COLUMNS[name])
    folder = f"{root.rstrip('/')}/data/{name}/run={run}"
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*parts) if parts else writer).parquet(folder)
    if not parts:
        return [f"run={run}"]
    made = _names(spark, folder + "/" + "/".join(f"{c}=*" for c in parts))
    return [f"run={run}/" + "/".join(m.split("/")[-len(parts):]) for m in made]


def _partition_names(touched: DataFrame, parts: list[str]) -> set[str]:
    """Folder names of the distinct partition values; no more than the table has partitions."""
    def text(v) -> str:
        return _NULL_PARTITION if v is None else quote(str(v), safe="-_. ")

    return {"/".join(f"{c}={text(r[c])}" for c in parts) for r in touched.select(*parts).distinct().collect()}


def _stored(spark: SparkSession, root: str, name: str, made: list[str]) -> tuple[int, int]:
    """(rows, highest key) of what this run wrote; footers and one column of new files only."""
    if not made:
        return 0, 0
    base = f"{root.rstrip('/')}/data/{name}"
    written = spark.read.schema(TABLES[name]).option("basePath", base).parquet(*[f"{base}/{p}" for p in made])
    rows, last = written.agg(F.count(F.lit(1)), F.max(PRIMARY_KEYS[name])).first()
    return rows, last or 0


def commit(spark: SparkSession, root: str, changes: Iterable[Change], base: int | None = None) -> dict[str, int]:
    """Publish ``changes`` as one version after ``base`` (the version their
    rows were made from; by default the last). Returns rows written by table."""
    manifest = read_manifest(spark, root)
    if base is not None and manifest["version"] != base:
        raise ConcurrentCommit(f"{root} is at version {manifest['version']}, the changes were made from {base}")
    tables, ids, counts = {n: list(p) for n, p in manifest["tables"].items()}, dict(manifest["ids"]), {}
    for change in changes:
        name, parts = change.name, PARTITION_COLUMNS.get(change.name) or []
        run = uuid.uuid4().hex
        made = _write(change, root, run)
        kept = tables.get(name, [])
        if change.mode == "replace" or (change.mode == "partitions" and not parts):
            kept = []
        elif change.mode == "partitions":
            gone = {m.split("/", 1)[1] for m in made}
            if change.touched is not None:
                gone |= _partition_names(change.touched, parts)
            kept = [p for p in kept if p.split("/", 1)[1] not in gone]
        elif change.mode != "append":
            raise ValueError(f"unknown mode {change.mode}")
        tables[name] = kept + made
        counts[name], last = _stored(spark, root, name, made)
        ids[name] = max(ids.get(name, 0), last)  # never falls, so a deleted row's id is not given out again
    _publish(spark, root, {"version": manifest["version"] + 1, "tables": tables, "ids": ids})
    return counts


def vacuum(spark: SparkSession, root: str, keep_versions: int = 2, older_than_s: int = 86_400) -> int:
    """Remove run folders that the last ``keep_versions`` manifests do not
    name and that were last written more than ``older_than_s`` seconds ago (a
    run under way may still publish younger ones), and older manifests.
    Returns how many folders went."""
    versions = _versions(spark, root)
    named = {f"{n}/{p.split('/')[0]}" for v in versions[-keep_versions:] for n, paths in read_manifest(spark, root, v)["tables"].items() for p in paths}
    before, removed = (time.time() - older_than_s) * 1000, 0
    for path in _names(spark, f"{root.rstrip('/')}/data/*/run=*"):
        fs, p, _ = _fs(spark, path)
        if "/".join(path.split("/")[-2:]) not in named and fs.getFileStatus(p).getModificationTime() <= before:
            removed += bool(fs.delete(p, True))
    for v in versions[:-keep_versions]:
        fs, p, _ = _fs(spark, _manifest_path(root, v))
        fs.delete(p, False)
    return removed
