"""Golden tests on the seed rows, clock pinned to 2026-04-15."""

from decimal import Decimal

from pyspark.sql import functions as F

from stipendlens.operators import reports as R
from tests.seed import SEED_TODAY
from tests.conftest import rows


def test_r01_attendance_detail(seed):
    out = R.attendance_detail(seed["meal_attendance"], seed["students"], seed["menus"])
    assert rows(out, "student_name", "item_name", "meal_type") == [
        ("Arne Tessel", "Kinche", "BREAKFAST"),
        ("Dorin Almar", "Firfir", "BREAKFAST"),
        ("Arne Tessel", "Shiro Wot", "LUNCH"),
    ]


def test_r02_payment_status(seed):
    out = R.payment_status(seed["students"], seed["departments"], seed["cash_payments"], SEED_TODAY)
    assert rows(out, "student_name", "department_name", "payment_month", "payment_year", "payment_status") == [
        ("Soren Tamsin", "Civil Engineering", 4, 2026, "PENDING"),
        ("Hedda Mellow", "Electrical & Computer Engineering", 4, 2026, "SENT"),
    ]


def test_r02_no_record(seed):
    out = R.payment_status(seed["students"], seed["departments"], seed["cash_payments"],
                           SEED_TODAY.replace(month=5))
    assert rows(out, "student_name", "payment_status") == [
        ("Hedda Mellow", "NO RECORD"), ("Soren Tamsin", "NO RECORD")]


def test_r03_menu_popularity(seed):
    out = rows(R.menu_popularity(seed["meal_attendance"], seed["menus"]))
    top = out[:3]
    assert sorted(top) == sorted([("Kinche", "BREAKFAST", 1, 1), ("Firfir", "BREAKFAST", 1, 1),
                                  ("Shiro Wot", "LUNCH", 1, 1)])
    assert len(out) == 9 and all(r[2:] == (0, 0) for r in out[3:])


def test_r04_unmatched(seed):
    out = R.unmatched_payments(seed["students"], seed["cash_payments"])
    assert sorted(rows(out, "student_name", "student_type", "payment_id")) == [
        ("Arlo Kestrel", "CAFE", None), ("Arne Tessel", "CAFE", None), ("Dorin Almar", "CAFE", None)]


def test_r05_r06_department_summary(seed):
    r5 = R.department_summary_for_year(seed["cash_payments"], seed["students"], seed["departments"], SEED_TODAY)
    assert rows(r5) == [
        ("Electrical & Computer Engineering", 3, Decimal("9000.00"), 0, 2),
        ("Civil Engineering", 2, Decimal("6000.00"), 1, 1),
    ]
    r6 = R.department_summary(seed["cash_payments"], seed["students"], seed["departments"])
    assert rows(r6, "department_name", "confirmed_count") == [
        ("Electrical & Computer Engineering", 1), ("Civil Engineering", 0)]


def test_r07_unpaid(seed):
    out = R.unpaid_students(seed["students"], seed["departments"], seed["cash_payments"], SEED_TODAY)
    assert rows(out, "student_name", "email", "department_name") == [
        ("Soren Tamsin", "soren@example.org", "Civil Engineering")]


def test_r07_null_aware_not_in(spark, seed):
    # one SENT payment of the period with a NULL student makes NOT IN unknown for everyone
    bad = spark.createDataFrame([(99, None, Decimal("1.00"), 4, 2026, "SENT", None, None, None)], _nullable(seed))
    payments = seed["cash_payments"].unionByName(bad)
    out = R.unpaid_students(seed["students"], seed["departments"], payments, SEED_TODAY)
    assert out.count() == 0


def _nullable(seed):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in seed["cash_payments"].schema.fields])


def test_r08_daily(seed):
    out = R.daily_attendance(seed["meal_attendance"], SEED_TODAY)
    assert rows(out) == [("BREAKFAST", 2, 2), ("LUNCH", 1, 1)]


def test_r09_enrolment(seed):
    out = R.enrolment_summary(seed["students"])
    assert rows(out) == [
        (2026, 0, 1, 1, Decimal("0.0")), (2025, 0, 1, 1, Decimal("0.0")),
        (2024, 1, 0, 1, Decimal("100.0")), (2023, 1, 0, 1, Decimal("100.0")),
    ]


def test_r10_history(seed):
    out = R.payment_history(seed["cash_payments"], seed["students"], seed["departments"])
    assert rows(out) == [
        ("Hedda Mellow", "Electrical & Computer Engineering", 2026, 3, Decimal("9000.00"), 2, 0, 1),
        ("Soren Tamsin", "Civil Engineering", 2026, 2, Decimal("6000.00"), 1, 1, 2),
    ]


def test_r11_to_r13_lists(seed):
    assert [r[1] for r in rows(R.list_departments(seed["departments"]))][0] == "Chemical Engineering"
    assert [r[2] for r in rows(R.list_dormitories(seed["dormitories"]))] == ["A", "B", "C", "D"]
    menu = rows(R.available_menu(seed["menus"]), "item_name", "meal_type")
    assert [m[1] for m in menu] == ["BREAKFAST"] * 3 + ["LUNCH"] * 3 + ["DINNER"] * 3
    assert [m[0] for m in menu[:3]] == ["Chechebsa", "Firfir", "Kinche"]


def test_r14_to_r17(seed):
    assert rows(R.pending_students(seed["students"], seed["departments"]), "student_id", "department_name") == [
        (5, "Software Engineering")]
    assert rows(R.approved_non_cafe(seed["students"]), "first_name") == [("Hedda",), ("Soren",)]
    assert rows(R.pending_payments(seed["cash_payments"], seed["students"]), "payment_id", "first_name") == [
        (4, "Soren")]
    assert rows(R.sent_count(seed["cash_payments"])) == [(3,)]


def test_r18_recent_audit(seed):
    out = R.recent_audit(seed["audit_logs"], 2)
    assert rows(out, "log_id") == [(3,), (2,)]


def test_r19_to_r21(seed):
    prof = R.student_profiles(seed["students"], seed["departments"], seed["dormitories"])
    assert "password_hash" not in prof.columns
    assert rows(prof.filter("student_id = 2"), "department_name", "dorm_name", "block") == [
        ("Electrical & Computer Engineering", "Dorm Block C", "C")]
    pay = R.student_payments(seed["students"], seed["cash_payments"])
    assert rows(pay, "student_id", "payment_year", "payment_month") == [
        (2, 2026, 4), (2, 2026, 3), (2, 2026, 2), (4, 2026, 4), (4, 2026, 3)]
    meals = R.student_recent_meals(seed["students"], seed["meal_attendance"], seed["menus"], 30)
    assert rows(meals, "student_id", "meal_type", "item_name") == [
        (1, "BREAKFAST", "Kinche"), (1, "LUNCH", "Shiro Wot"), (3, "BREAKFAST", "Firfir")]
    one = R.student_recent_meals(seed["students"], seed["meal_attendance"], seed["menus"], 1)
    assert rows(one, "student_id", "meal_type") == [(1, "BREAKFAST"), (3, "BREAKFAST")]


def test_r22_kpis(seed):
    assert rows(R.dashboard_kpis(seed["students"], seed["cash_payments"])) == [(1, 2, 1, 3)]


def test_q1_dual_claims(spark, seed):
    out = R.dual_claims(seed["students"], seed["meal_attendance"], seed["cash_payments"])
    assert out.count() == 0
    # a NON_CAFE student with a tick in a paid month and a CAFE student with a payment
    ticks = seed["meal_attendance"].unionByName(spark.createDataFrame(
        [(10, 2, 1, SEED_TODAY, "LUNCH", None)], seed["meal_attendance"].schema))
    pays = seed["cash_payments"].unionByName(spark.createDataFrame(
        [(10, 1, Decimal("3000.00"), 1, 2026, "PENDING", None, None, None)], seed["cash_payments"].schema))
    got = rows(R.dual_claims(seed["students"], ticks, pays), "claim", "student_id", "claim_year", "claim_month")
    assert got == [("a", 2, None, None), ("b", 1, None, None), ("c", 2, 2026, 4)]


def test_plain_window_agrees(seed):
    a = R.payment_history(seed["cash_payments"], seed["students"], seed["departments"])
    b = R.payment_history_window(seed["cash_payments"], seed["students"], seed["departments"])
    assert rows(a) == rows(b)
    assert a.filter(F.col("rank_by_year") > 0).count() == 2


def test_student_portal(spark, seed):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    prof, pays, meals = R.student_portal(ids, seed["students"], seed["departments"], seed["dormitories"],
                                         seed["cash_payments"], seed["meal_attendance"], seed["menus"])
    assert sorted(rows(prof, "student_id")) == [(1,), (2,)]
    assert rows(pays, "student_id", "payment_month") == [(2, 4), (2, 3), (2, 2)]
    assert rows(meals, "student_id", "item_name") == [(1, "Kinche"), (1, "Shiro Wot")]
