"""Commits in versions: all or nothing at every write, two writers, ids from
the manifest, deletes over several tables, atomic reloads, JSON."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stipendlens import jobs
from stipendlens.operators import workflows as W
from stipendlens.sources import snapshots as S
from stipendlens.sources import tables as T
from stipendlens.sources.tables import commit_delete, commit_result, read_domain, write_domain
from tests.conftest import rows

COMMAND = "cmd_id long, payment_id long, kind string, admin_id long, ts timestamp_ntz"


@pytest.fixture
def root(seed):
    path = tempfile.mkdtemp(prefix="domain-")
    write_domain(seed, path)
    return path


def contents(spark, root):
    return {n: sorted(map(tuple, df.collect()), key=repr) for n, df in read_domain(spark, root).items()}


def confirm(spark, snap, payment=4):
    cmds = spark.createDataFrame([(1, payment, "confirm", 2, dt.datetime(2026, 4, 16))], COMMAND)
    return W.apply_payment_commands(snap["cash_payments"], cmds)


class Crash(OSError):
    pass


def test_a_crash_at_any_write_changes_nothing(spark, root, monkeypatch):
    """The commit dies before, between and after its writes: readers see the old version, and the run can be repeated."""
    before, snap = contents(spark, root), read_domain(spark, root)
    real_write, real_publish = S._write, S._publish
    for dies_at in (0, 1, 2):
        calls = []

        def write(change, *a):
            if len(calls) == dies_at:
                raise Crash(change.name)
            calls.append(change.name)
            return real_write(change, *a)

        def publish(*a):
            raise Crash("manifest")

        monkeypatch.setattr(S, "_write", write)
        monkeypatch.setattr(S, "_publish", publish)
        with pytest.raises(Crash):
            commit_result(spark, root, "cash_payments", confirm(spark, snap), base=snap)
        assert contents(spark, root) == before
    monkeypatch.setattr(S, "_write", real_write)
    monkeypatch.setattr(S, "_publish", real_publish)
    assert commit_result(spark, root, "cash_payments", confirm(spark, snap), base=snap)["audit_appended"] == 1
    after = read_domain(spark, root)
    assert after["audit_logs"].count() == len(before["audit_logs"]) + 1
    # the command once more: rejected, nothing more is audited
    assert commit_result(spark, root, "cash_payments", confirm(spark, after), base=after)["audit_appended"] == 0


def test_the_second_of_two_writers_is_refused(spark, root):
    one, two = read_domain(spark, root), read_domain(spark, root)
    commit_result(spark, root, "cash_payments", confirm(spark, one), base=one)
    seen = contents(spark, root)
    late = W.create_monthly_payments(two["cash_payments"], two["students"], dt.datetime(2026, 7, 1), 1, two.ids["cash_payments"])
    with pytest.raises(S.ConcurrentCommit):
        commit_result(spark, root, "cash_payments", late, base=two)
    assert contents(spark, root) == seen
    again = read_domain(spark, root)
    commit_result(spark, root, "cash_payments", W.create_monthly_payments(
        again["cash_payments"], again["students"], dt.datetime(2026, 7, 1), 1, again.ids["cash_payments"]), base=again)
    ids = [r[0] for r in read_domain(spark, root)["cash_payments"].select("payment_id").collect()]
    assert len(ids) == len(set(ids))


def test_two_writers_that_publish_at_once(spark, root):
    """Both read the same version and pass the check before either publishes: the name of the manifest decides."""
    manifest = S.read_manifest(spark, root)
    taken = {**manifest, "version": manifest["version"] + 1}
    S._publish(spark, root, taken)
    with pytest.raises(S.ConcurrentCommit):
        S._publish(spark, root, {**taken, "tables": {}})
    assert S.read_manifest(spark, root) == taken
    assert not [f for f in os.listdir(f"{root}/manifests") if f.startswith("draft")]


def test_ids_go_on_from_the_manifest_without_a_scan(spark, root, seed):
    snap = read_domain(spark, root)
    top = seed["cash_payments"].agg(F.max("payment_id")).first()[0]
    assert snap.ids["cash_payments"] == top
    res = W.create_monthly_payments(snap["cash_payments"], snap["students"], dt.datetime(2026, 7, 1), 1, snap.ids["cash_payments"])
    new = sorted(r[0] for r in res.changed.select("payment_id").collect())
    assert new == list(range(top + 1, top + 1 + len(new))) and new
    plan = res.changed._jdf.queryExecution().executedPlan().toString()
    assert "max(payment_id" not in plan
    _, audit = W.append_audit(None, res.audit, snap.ids["audit_logs"])
    assert "audit_logs" not in " ".join(audit.inputFiles())
    # an id is not given out again after its row is deleted
    commit_delete(spark, root, "students", spark.createDataFrame([(r[0],) for r in seed["students"].select("student_id").collect()], "student_id long"))
    assert read_domain(spark, root).ids["cash_payments"] == top and read_domain(spark, root)["cash_payments"].count() == 0


def test_an_append_reads_nothing_stored(spark, root, monkeypatch):
    snap = read_domain(spark, root)
    files = {n: set(df.inputFiles()) for n, df in snap.items()}
    res = W.create_monthly_payments(snap["cash_payments"], snap["students"], dt.datetime(2026, 7, 1), 1, snap.ids["cash_payments"])
    changes = T.result_changes("cash_payments", res, res.audit, snap.ids["audit_logs"])
    assert [(c.name, c.mode) for c in changes] == [("cash_payments", "append"), ("audit_logs", "append")]
    S.commit(spark, root, changes, snap.version)
    after = read_domain(spark, root)
    assert all(files[n] <= set(after[n].inputFiles()) for n in files), "stored files are left alone"


def test_delete_a_student_with_ticks_and_payments(spark, root, seed):
    snap = read_domain(spark, root)
    victim = seed["cash_payments"].select("student_id").first()[0]
    old = set(snap["cash_payments"].inputFiles()) | set(snap["meal_attendance"].inputFiles())
    touched = {f for n in ("cash_payments", "meal_attendance") for f in (
        r[0] for r in snap[n].filter(F.col("student_id") == victim).select(F.input_file_name()).distinct().collect())}
    out = commit_delete(spark, root, "students", spark.createDataFrame([(victim,), (victim,), (None,)], "student_id long"))
    assert out["blocked"] == 0 and set(out["rewritten"]) == {"students", "meal_attendance", "cash_payments"}
    after = read_domain(spark, root)
    want, _ = W.delete_rows(dict(seed), "students", spark.createDataFrame([(victim,)], "student_id long"))
    for n in ("students", "meal_attendance", "cash_payments"):
        assert sorted(rows(after[n]), key=repr) == sorted(rows(want[n].select(*after[n].columns)), key=repr) and after[n].filter(F.col("student_id") == victim).count() == 0
    kept = set(after["cash_payments"].inputFiles()) | set(after["meal_attendance"].inputFiles())
    assert {f.split("/")[-1] for f in old} - {f.split("/")[-1] for f in touched} <= {f.split("/")[-1] for f in kept}, "other partitions stay"


def test_a_crash_between_the_tables_of_a_delete(spark, root, monkeypatch, seed):
    before, real, calls = contents(spark, root), S._write, []

    def write(change, *a):
        calls.append(change.name)
        if len(calls) == 3:
            raise Crash(change.name)
        return real(change, *a)

    monkeypatch.setattr(S, "_write", write)
    with pytest.raises(Crash):
        commit_delete(spark, root, "students", seed["students"].select("student_id"))
    assert len(calls) == 3 and contents(spark, root) == before


def test_deletes_that_set_null_or_are_blocked(spark, root, seed):
    admin = seed["cash_payments"].filter("confirmed_by is not null").select("confirmed_by").first()[0]
    commit_delete(spark, root, "admins", spark.createDataFrame([(admin,)], "admin_id long"))
    after = read_domain(spark, root)
    assert after["admins"].filter(F.col("admin_id") == admin).count() == 0
    assert after["cash_payments"].filter(F.col("confirmed_by") == admin).count() == 0
    assert after["cash_payments"].count() == seed["cash_payments"].count()
    menu = seed["meal_attendance"].select("menu_id").first()[0]
    assert commit_delete(spark, root, "menus", spark.createDataFrame([(menu,)], "menu_id long"))["blocked"] == 1
    assert read_domain(spark, root)["menus"].filter(F.col("menu_id") == menu).count() == 1
    version = read_domain(spark, root).version
    assert commit_delete(spark, root, "audit_logs", spark.createDataFrame([(1,)], "log_id long"))["blocked"] == 1
    assert read_domain(spark, root).version == version


def test_a_reload_that_dies_leaves_the_old_load(spark, root, seed, monkeypatch):
    before, real, calls = contents(spark, root), S._write, []

    def write(change, *a):
        calls.append(change.name)
        if len(calls) == 5:
            raise Crash(change.name)
        return real(change, *a)

    monkeypatch.setattr(S, "_write", write)
    with pytest.raises(Crash):
        write_domain({n: df.limit(1) for n, df in seed.items()}, root)
    assert contents(spark, root) == before
    monkeypatch.setattr(S, "_write", real)
    write_domain({n: df.limit(1) for n, df in seed.items()}, root)
    assert all(len(v) == 1 for v in contents(spark, root).values())


def test_vacuum_removes_what_no_version_names(spark, root, seed, monkeypatch):
    snap = read_domain(spark, root)
    monkeypatch.setattr(S, "_publish", lambda *a: (_ for _ in ()).throw(Crash("manifest")))
    with pytest.raises(Crash):
        commit_result(spark, root, "cash_payments", confirm(spark, snap), base=snap)
    monkeypatch.undo()
    assert S.vacuum(spark, root) == 0, "a young folder may belong to a run under way"
    before = contents(spark, root)
    assert S.vacuum(spark, root, older_than_s=-5) == 2  # payments and audit of the dead run
    write_domain(seed, root)
    write_domain(seed, root)
    assert S.vacuum(spark, root, keep_versions=1, older_than_s=-5) == 16
    assert contents(spark, root) == before and S._versions(spark, root) == [3]


def test_partitions_without_a_value(spark, root, seed):
    odd = seed["meal_attendance"].limit(1).withColumn("meal_date", F.lit(None).cast("date"))
    S.commit(spark, root, [S.Change("meal_attendance", "append", odd)])
    assert read_domain(spark, root)["meal_attendance"].filter("meal_date is null").count() == 1
    gone = spark.createDataFrame([(None,)], "meal_date date")
    S.commit(spark, root, [S.Change("meal_attendance", "partitions", odd.limit(0), gone)])
    assert sorted(rows(read_domain(spark, root)["meal_attendance"]), key=repr) == sorted(rows(seed["meal_attendance"].select(*odd.columns)), key=repr)


def test_delete_force_status_and_login_jobs(spark, root, seed):
    ids, keys, logins = (f"{root}/in/{n}" for n in ("ids", "keys", "logins"))
    pay = seed["cash_payments"].first()
    spark.createDataFrame([(pay["student_id"], pay["payment_month"], pay["payment_year"])],
                          "student_id long, payment_month int, payment_year int").write.parquet(keys)
    jobs.main(["force-status", "--root", root, "--commands", keys, "--status", "SENT", "--as-of", "2026-05-01", "--admin", "1"], spark)
    assert read_domain(spark, root)["cash_payments"].filter(F.col("payment_id") == pay["payment_id"]).first()["status"] == "SENT"
    admin = seed["admins"].filter("is_active").first()["admin_id"]
    spark.createDataFrame([(admin, dt.datetime(2030, 1, 1))], "admin_id long, ts timestamp_ntz").write.parquet(logins)
    jobs.main(["logins", "--root", root, "--commands", logins], spark)
    assert read_domain(spark, root)["admins"].filter(F.col("admin_id") == admin).first()["last_login"] == dt.datetime(2030, 1, 1)
    spark.createDataFrame([(pay["student_id"],)], "student_id long").write.parquet(ids)
    out = jobs.main(["delete", "--root", root, "--table", "students", "--ids", ids], spark)
    assert out["blocked"] == 0 and read_domain(spark, root)["cash_payments"].filter(F.col("student_id") == pay["student_id"]).count() == 0
    assert jobs.main(["vacuum", "--root", root], spark)["removed"] == 0


def test_json_has_every_key_and_the_sources_types(spark, seed):
    out = tempfile.mkdtemp(prefix="json-") + "/o"
    counted = seed["cash_payments"].withColumn("payments", F.lit(7).cast("long"))
    T.write_json(counted, out)
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json") for x in open(f"{out}/{f}")]
    assert len(lines) == counted.count() and all(set(x) == set(counted.columns) for x in lines)
    one = next(x for x in lines if x["confirmed_at"] is None)
    assert one["amount"] == "3000.00" and one["payments"] == "7" and isinstance(one["payment_id"], int) and one["sent_at"] is None
    stamped = next(x for x in lines if x["confirmed_at"] is not None)
    assert dt.datetime.fromisoformat(stamped["confirmed_at"].rstrip("Z"))
    text = [json.loads(r["json"]) for r in T.to_json(counted).collect()]
    assert sorted(text, key=lambda x: x["payment_id"]) == sorted(lines, key=lambda x: x["payment_id"])
