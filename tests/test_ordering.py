"""Row-order tests: enum order (O2/O4) and PostgreSQL NULL placement.
The driver's hash ignores order, so these are the only guard."""

import datetime as dt
from decimal import Decimal

from stipendlens.operators import reports as R
from tests.seed import SEED_NOW, SEED_TODAY, seed_tables
from tests.conftest import rows

EXTRA = {
    # NULL department, NULL approval, a CAFE student with a payment
    "students": [
        (6, "Meron", "Ayele", "meron@example.org", "Female", 1, 2026, "NON_CAFE", None, None, True, SEED_NOW),
        (7, "Yonas", "Bekele", "yonas@example.org", "Male", 1, 2026, "NON_CAFE", 5, 1, None, SEED_NOW),
        (8, "Lidya", "Girma", "lidya@example.org", "Female", 2, 2024, "NON_CAFE", 5, 2, True,
         dt.datetime(2026, 4, 1)),
    ],
    # NULL status for student 8 this month; orphan payment of student 42
    "cash_payments": [
        (6, 8, Decimal("3000.00"), 4, 2026, None, None, None, None),
        (7, 42, Decimal("3000.00"), 4, 2026, "PENDING", None, None, None),
        (8, 1, Decimal("3000.00"), 4, 2026, "PENDING", None, None, None),
    ],
    "meal_attendance": [
        (4, 1, 7, SEED_TODAY, "DINNER", SEED_NOW),
        (5, 3, 5, SEED_TODAY - dt.timedelta(days=1), "LUNCH", SEED_NOW),
    ],
}


def test_status_enum_then_nulls_last(spark):
    t = seed_tables(spark, EXTRA)
    out = rows(R.payment_status(t["students"], t["departments"], t["cash_payments"], SEED_TODAY),
               "student_name", "payment_status")
    # PENDING < SENT by declaration order; NULL status and no record last, by last_name
    assert out == [("Soren Tamsin", "PENDING"), ("Hedda Mellow", "SENT"),
                   ("Meron Ayele", "NO RECORD"), ("Lidya Girma", "NO RECORD")]


def test_department_nulls_last(spark):
    t = seed_tables(spark, EXTRA)
    out = rows(R.unpaid_students(t["students"], t["departments"], t["cash_payments"], SEED_TODAY),
               "student_name", "department_name")
    assert out == [("Soren Tamsin", "Civil Engineering"), ("Lidya Girma", "Mechanical Engineering"),
                   ("Meron Ayele", None)]


def test_meal_enum_order_and_date_desc(spark):
    t = seed_tables(spark, EXTRA)
    out = rows(R.attendance_detail(t["meal_attendance"], t["students"], t["menus"]), "meal_date", "meal_type")
    assert out == [(SEED_TODAY, "BREAKFAST"), (SEED_TODAY, "BREAKFAST"), (SEED_TODAY, "LUNCH"),
                   (SEED_TODAY, "DINNER"), (SEED_TODAY - dt.timedelta(days=1), "LUNCH")]


def test_null_approval_is_neither_pending_nor_approved(spark):
    t = seed_tables(spark, EXTRA)
    assert 7 not in [r[0] for r in rows(R.pending_students(t["students"], t["departments"]), "student_id")]
    assert 7 not in [r[0] for r in rows(R.approved_non_cafe(t["students"]), "student_id")]
    k = rows(R.dashboard_kpis(t["students"], t["cash_payments"]))[0]
    # pending payments with a student: 4 and 8 (7 is an orphan)
    assert k == (1, 4, 2, 3)


def test_unmatched_both_sides_and_type_order(spark):
    t = seed_tables(spark, EXTRA)
    out = rows(R.unmatched_payments(t["students"], t["cash_payments"]), "student_type", "payment_id")
    assert out[:2] == [("CAFE", None), ("CAFE", None)]
    assert (None, 7) == out[-1]
    assert ("NON_CAFE", None) in out


def test_recent_meals_order(spark):
    t = seed_tables(spark, EXTRA)
    out = rows(R.student_recent_meals(t["students"], t["meal_attendance"], t["menus"], 30),
               "student_id", "meal_type", "meal_rank")
    assert out == [(1, "BREAKFAST", 1), (1, "LUNCH", 2), (1, "DINNER", 3), (3, "BREAKFAST", 1), (3, "LUNCH", 2)]
