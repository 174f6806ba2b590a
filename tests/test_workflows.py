"""Batch write workflows (M1-M12): goldens on the seed and properties."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stipendlens.operators import reports as R
from stipendlens.operators import workflows as W
from tests.seed import SEED_NOW
from tests.conftest import rows

APRIL = dt.datetime(2026, 4, 15, 9, 0)
MAY = dt.datetime(2026, 5, 1, 8, 0)


def test_m4_bulk_monthly(seed):
    r = W.create_monthly_payments(seed["cash_payments"], seed["students"], APRIL, 1)
    assert r.changed.count() == 0 and r.audit.count() == 1 and r.table.count() == 5
    r = W.create_monthly_payments(seed["cash_payments"], seed["students"], MAY, 1)
    assert sorted(rows(r.changed, "payment_id", "student_id", "payment_month", "status")) == [
        (6, 2, 5, "PENDING"), (7, 4, 5, "PENDING")]
    assert rows(r.audit, "actor_id", "action", "target_id", "new_value") == [
        (1, "INSERT", None, W.BULK_TEXT)]
    # idempotent: a second run adds nothing and leaves the same table
    again = W.create_monthly_payments(r.table, seed["students"], MAY, 1)
    assert again.changed.count() == 0
    assert again.table.exceptAll(r.table).count() == 0 and r.table.exceptAll(again.table).count() == 0


def test_m1_register(spark, seed):
    req = spark.createDataFrame([
        (1, "Liya", "Haile", "liya@example.org", "Passw0rdX", "Female", 1, 2026, "CAFE", 1, 1),
        (2, "Copy", "Cat", "arne@example.org", "Passw0rdX", "Male", 1, 2026, "CAFE", 1, 1),
        (3, "Sami", "Tolosa", "sami@example.org", "Passw0rdX", "Male", 2, 2025, "NON_CAFE", 2, None),
    ], "seq long, first_name string, last_name string, email string, password string, gender string, "
       "year_of_study int, year_enrolled int, student_type string, department_id long, dormitory_id long")
    r = W.register_students(seed["students"], req, seed["departments"], seed["dormitories"], SEED_NOW)
    assert sorted(rows(r.changed, "student_id", "email", "is_approved")) == [
        (6, "liya@example.org", False), (7, "sami@example.org", False)]
    assert rows(r.rejected, "seq", "message") == [(2, "Email already registered.")]
    assert sorted(rows(r.audit, "actor_id", "actor_type", "target_id", "new_value")) == [
        (6, "STUDENT", 6, "New student registered: Liya Haile"),
        (7, "STUDENT", 7, "New student registered: Sami Tolosa")]
    assert "password" not in r.changed.columns and "password" not in r.rejected.columns
    assert r.table.count() == 7


def test_m2_approve(spark, seed):
    cmd = spark.createDataFrame([(1, 5, 1, SEED_NOW), (2, 5, 2, SEED_NOW), (3, 99, 1, SEED_NOW)],
                                "cmd_id long, student_id long, admin_id long, ts timestamp_ntz")
    r = W.approve_students(seed["students"], cmd)
    assert rows(r.changed, "student_id", "is_approved") == [(5, True)]
    assert r.table.filter("is_approved").count() == 5
    assert sorted(rows(r.audit, "audit_seq", "new_value")) == [
        (1, "Approved student Arlo Kestrel"), (2, "Approved student Arlo Kestrel")]
    assert rows(r.rejected, "cmd_id", "message") == [(3, W.STUDENT_NOT_FOUND)]


def test_m3_create_payment(spark, seed):
    req = spark.createDataFrame([(1, 2, 5, 2026, 1), (2, 2, 5, 2026, 1), (3, 4, 4, 2026, 1), (4, 1, 5, 2026, 2)],
                                "seq long, student_id long, payment_month int, payment_year int, admin_id long")
    r = W.create_payments(seed["cash_payments"], req, seed["students"], SEED_NOW)
    # eligibility is not checked: the CAFE student 1 gets a payment too
    assert sorted(rows(r.changed, "payment_id", "student_id")) == [(6, 2), (7, 1)]
    assert sorted(rows(r.rejected, "seq", "message")) == [
        (2, "Payment already exists for this student/month."), (3, "Payment already exists for this student/month.")]
    assert sorted(rows(r.audit, "target_id", "new_value")) == [
        (6, "Created pending payment for student 2, month 5/2026"),
        (7, "Created pending payment for student 1, month 5/2026")]


def _sequential(status_by_id, commands):
    """Reference model: run the commands one by one in (ts, cmd_id) order."""
    st = dict(status_by_id)
    accepted = set()
    for ts, cmd_id, pid, kind in sorted((c[4], c[0], c[1], c[2]) for c in commands):
        cur = st.get(pid, "MISSING")
        if kind == "confirm" and cur == "PENDING":
            st[pid] = "CONFIRMED"
            accepted.add(cmd_id)
        elif kind == "send" and cur in ("PENDING", "CONFIRMED"):
            st[pid] = "SENT"
            accepted.add(cmd_id)
    return st, accepted


def test_m5_m6_fold_equals_sequential(spark):
    rnd = random.Random(7)
    statuses = ["PENDING", "CONFIRMED", "SENT", None]
    pays = [(i, i, "3000.00", 1 + i % 12, 2026, rnd.choice(statuses), None, None, None) for i in range(1, 60)]
    pdf = spark.createDataFrame(pays, "payment_id long, student_id long, amount string, payment_month int, "
                                      "payment_year int, status string, confirmed_by long, "
                                      "confirmed_at timestamp_ntz, sent_at timestamp_ntz")
    pdf = pdf.withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    base = dt.datetime(2026, 4, 1)
    cmds = [(k, rnd.randint(1, 64), rnd.choice(["confirm", "send"]), rnd.randint(1, 2),
             base + dt.timedelta(minutes=rnd.randint(0, 30))) for k in range(1, 300)]
    cdf = spark.createDataFrame(cmds, "cmd_id long, payment_id long, kind string, admin_id long, ts timestamp_ntz")
    r = W.apply_payment_commands(pdf, cdf)
    want_status, want_acc = _sequential({p[0]: p[5] for p in pays}, cmds)
    got = dict(rows(r.table, "payment_id", "status"))
    assert got == {k: v for k, v in want_status.items() if k in got}
    acc = {x[0] for x in rows(r.audit, "audit_seq")}
    assert acc == want_acc
    assert r.audit.count() + r.rejected.count() == len(cmds)


def test_m7_force(spark, seed):
    keys = spark.createDataFrame([(2, 4, 2026), (9, 4, 2026)], "student_id long, payment_month int, payment_year int")
    r = W.force_payment_status(seed["cash_payments"], keys, "CONFIRMED", SEED_NOW, 1)
    # unguarded: SENT goes back to CONFIRMED
    assert rows(r.changed, "payment_id", "status") == [(1, "CONFIRMED")]
    assert rows(r.rejected, "student_id") == [(9,)]
    assert r.audit.count() == 0


def test_m8_ticks(spark, seed):
    today = dt.date(2026, 4, 15)
    t = spark.createDataFrame([
        (1, 1, 7, "DINNER", today, dt.datetime(2026, 4, 15, 19)),
        (2, 1, 8, "DINNER", today, dt.datetime(2026, 4, 15, 18)),   # earlier: wins
        (3, 1, 1, "BREAKFAST", today, dt.datetime(2026, 4, 15, 7)),  # already stored
        (4, 42, 1, "LUNCH", today, dt.datetime(2026, 4, 15, 12)),   # unknown student
    ], "seq long, student_id long, menu_id long, meal_type string, meal_date date, recorded_at timestamp_ntz")
    r = W.record_ticks(seed["meal_attendance"], t, seed["students"], seed["menus"], SEED_NOW)
    assert rows(r.changed, "attendance_id", "menu_id") == [(4, 8)]
    assert sorted(rows(r.rejected, "seq", "first_reason")) == [(1, "UNIQUE"), (3, "UNIQUE"), (4, "FK")]
    # the dashboard over the new table sees one dinner
    assert rows(R.daily_attendance(r.table, today), "meal_type", "total_ticks")[-1] == ("DINNER", 1)


def test_m9_m10_audit_append_only(spark, seed):
    cmd = spark.createDataFrame([(10, 5, 1, SEED_NOW)], "cmd_id long, student_id long, admin_id long, ts timestamp_ntz")
    r = W.approve_students(seed["students"], cmd)
    table, appended = W.append_audit(seed["audit_logs"], r.audit)
    assert rows(appended, "log_id", "new_value") == [(4, "Approved student Arlo Kestrel")]
    assert W.audit_changes(seed["audit_logs"], table).count() == 0
    assert W.audit_changes(table, seed["audit_logs"]).count() == 1


def test_m11_last_login(spark, seed):
    admins = seed["admins"].withColumn("is_active", F.col("admin_id") == 1)
    logins = spark.createDataFrame([(1, dt.datetime(2026, 4, 1)), (1, dt.datetime(2026, 4, 2)),
                                    (2, dt.datetime(2026, 4, 3))], "admin_id long, ts timestamp_ntz")
    r = W.stamp_last_login(admins, logins)
    assert rows(r.table, "admin_id", "last_login") == [(1, dt.datetime(2026, 4, 2)), (2, None)]
    assert rows(r.rejected, "admin_id") == [(2,)]


def test_m12_delete(spark, seed):
    ids = spark.createDataFrame([(2,)], "id long")
    out, blocked = W.delete_rows(seed, "students", ids)
    assert out["students"].count() == 4 and out["cash_payments"].count() == 2
    assert blocked.count() == 0
    out, _ = W.delete_rows(seed, "departments", spark.createDataFrame([(1,)], "id long"))
    assert sorted(rows(out["students"].filter("department_id is null"), "student_id")) == [(1,), (5,)]
    out, blocked = W.delete_rows(seed, "menus", spark.createDataFrame([(1,), (3,)], "id long"))
    assert rows(blocked, "menu_id") == [(1,)] and out["menus"].count() == 8
    out, blocked = W.delete_rows(seed, "audit_logs", spark.createDataFrame([(1,)], "id long"))
    assert out["audit_logs"].count() == 3 and blocked.count() == 1
