"""Domain tables written partitioned and read back: same results, and the
period / day filters prune partitions at the scan."""

import datetime as dt
import tempfile

import pytest

from stipendlens.operators import reports as R
from tests.seed import SEED_TODAY
from stipendlens.sources.tables import read_domain, write_domain
from tests.conftest import rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_roundtrip_and_partition_pruning(spark, seed):
    root = tempfile.mkdtemp(prefix="domain-")
    write_domain(seed, root)
    t = read_domain(spark, root)
    for name, df in seed.items():
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, t[name].select(*df.columns).collect()))
    r2 = R.payment_status(t["students"], t["departments"], t["cash_payments"], SEED_TODAY)
    assert rows(r2, "student_name") == [("Soren Tamsin",), ("Hedda Mellow",)]
    r2.collect()
    plan = _plan(r2)
    assert "PartitionFilters: [isnotnull(payment_month" in plan or "PartitionFilters: [isnotnull(payment_year" in plan
    r8 = R.daily_attendance(t["meal_attendance"], SEED_TODAY)
    r8.collect()
    assert "PartitionFilters: [isnotnull(meal_date" in _plan(r8)


def test_commit_payment_commands(spark, seed):
    import datetime as dt

    from stipendlens.operators import workflows as W
    from stipendlens.sources.tables import commit_result

    root = tempfile.mkdtemp(prefix="domain-")
    write_domain(seed, root)
    t = read_domain(spark, root)
    march = {f for f in t["cash_payments"].inputFiles() if "payment_month=3" in f}
    assert march
    cmds = spark.createDataFrame([(1, 4, "confirm", 2, dt.datetime(2026, 4, 16)),
                                  (2, 4, "send", 2, dt.datetime(2026, 4, 17)),
                                  (3, 1, "send", 2, dt.datetime(2026, 4, 17))],
                                 "cmd_id long, payment_id long, kind string, admin_id long, ts timestamp_ntz")
    res = W.apply_payment_commands(t["cash_payments"], cmds)
    out = commit_result(spark, root, "cash_payments", res)
    assert out["audit_appended"] == 2
    after = read_domain(spark, root)
    assert rows(after["cash_payments"].filter("payment_id = 4"), "status", "confirmed_by") == [("SENT", 2)]
    assert after["cash_payments"].count() == 5
    # the untouched March partition was not rewritten
    assert {f for f in after["cash_payments"].inputFiles() if "payment_month=3" in f} == march
    log = rows(after["audit_logs"].orderBy("log_id"), "log_id", "new_value")
    assert log[-2:] == [(4, "Confirmed payment"), (5, "Marked payment as SENT")]


def _payments_and_commands(spark, seed):
    root = tempfile.mkdtemp(prefix="domain-")
    write_domain(seed, root)
    cmds = spark.createDataFrame([(1, 4, "confirm", 2, dt.datetime(2026, 4, 16))],
                                 "cmd_id long, payment_id long, kind string, admin_id long, ts timestamp_ntz")
    return root, cmds


def test_inserts_are_appended(spark, seed):
    from stipendlens.operators import workflows as W
    from stipendlens.sources.tables import commit_result

    root, _ = _payments_and_commands(spark, seed)
    t = read_domain(spark, root)
    n, files = t["cash_payments"].count(), set(t["cash_payments"].inputFiles())
    res = W.create_monthly_payments(t["cash_payments"], t["students"], dt.datetime(2026, 7, 1), 1)
    out = commit_result(spark, root, "cash_payments", res)
    after = read_domain(spark, root)["cash_payments"]
    assert out["rows_written"] > 0 and after.count() == n + out["rows_written"]
    assert files <= set(after.inputFiles()), "stored files are left alone"


def test_reload_replaces_old_partitions_and_updates_do_not(spark, seed):
    from stipendlens.sources.tables import write_domain_table

    root, _ = _payments_and_commands(spark, seed)
    two = seed["cash_payments"].filter("payment_id <= 2")
    write_domain({"cash_payments": two}, root)
    assert read_domain(spark, root)["cash_payments"].count() == 2
    write_domain_table(seed["cash_payments"].filter("payment_id = 4"), root, "cash_payments", mode="partitions")
    assert {r["payment_id"] for r in read_domain(spark, root)["cash_payments"].collect()} >= {4}


def test_the_audit_log_is_append_only(spark, seed):
    from stipendlens.sources.tables import write_domain_table

    root, _ = _payments_and_commands(spark, seed)
    with pytest.raises(ValueError):
        write_domain_table(seed["audit_logs"], root, "audit_logs")


def test_postgres_options():
    import pytest

    from stipendlens.sources.tables import postgres_options
    o = postgres_options("jdbc:postgresql://db/x", "students", user="u", partition_column="student_id",
                         lower_bound=1, upper_bound=2000, num_partitions=8)
    assert o["partitionColumn"] == "student_id" and o["numPartitions"] == "8" and o["dbtable"] == "students"
    with pytest.raises(ValueError):
        postgres_options("jdbc:postgresql://db/x", "students", partition_column="student_id")


def test_stored_domain_same_results(spark):
    import tempfile as _t

    from stipendlens.operators import reports as R
    from stipendlens.sources.mapping import Domain, load_stored_domain
    sf = "/root/testdata/sf0.001"
    lazy = Domain(spark, sf)
    stored = load_stored_domain(spark, sf, _t.mkdtemp(prefix="stored-"))
    for build in (lambda d: R.department_summary(d.cash_payments, d.students, d.departments),
                  lambda d: R.daily_attendance(d.meal_attendance, dt.date(2024, 1, 15))):
        assert rows(build(lazy)) == rows(build(stored))
    again = load_stored_domain(spark, sf, stored.root)  # a completed load is reused, not rewritten
    assert again.cash_payments.count() == lazy.cash_payments.count()
