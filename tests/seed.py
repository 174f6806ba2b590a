"""Inline-rows source (S2): the source system's seed data as DataFrames.

``NOW()`` and ``CURRENT_DATE`` are pinned to ``SEED_NOW`` / ``SEED_TODAY``
so results are reproducible. The first audit row is an approval and is
logged as ``UPDATE`` like the approval workflow does.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from stipendlens.schemas import TABLES

# --- fixed values: seed rows ------------------------------------------------
SEED_TODAY = dt.date(2026, 4, 15)
SEED_NOW = dt.datetime(2026, 4, 15, 9, 0, 0)
STIPEND = Decimal("3000.00")
FREE = Decimal("0.00")

DEPARTMENT_ROWS = [
    (1, "Software Engineering", "CTBE"),
    (2, "Electrical & Computer Engineering", "CTBE"),
    (3, "Civil Engineering", "CTBE"),
    (4, "Chemical Engineering", "CTBE"),
    (5, "Mechanical Engineering", "CTBE"),
]

DORMITORY_ROWS = [
    (1, "Dorm Block A", "A", "Male", 60),
    (2, "Dorm Block B", "B", "Male", 60),
    (3, "Dorm Block C", "C", "Female", 50),
    (4, "Dorm Block D", "D", "Female", 50),
]

ADMIN_ROWS = [
    (1, "Kit Arden", "kit@example.org", "SUPER_ADMIN", None, True),
    (2, "Cafe Manager", "cafe@example.org", "CAFE_MANAGER", None, True),
]

MENU_ROWS = [
    (1, "Kinche", "Traditional barley porridge", "BREAKFAST", FREE, True),
    (2, "Firfir", "Shredded injera with spiced butter", "BREAKFAST", FREE, True),
    (3, "Chechebsa", "Flatbread with spiced butter", "BREAKFAST", FREE, True),
    (4, "Shiro Wot", "Chickpea stew with injera", "LUNCH", FREE, True),
    (5, "Injera with Tibs", "Sautéed meat with injera", "LUNCH", FREE, True),
    (6, "Beyaynetu", "Mixed vegetable platter", "LUNCH", FREE, True),
    (7, "Pasta", "Spaghetti with tomato sauce", "DINNER", FREE, True),
    (8, "Rice with Chicken", "Steamed rice with chicken stew", "DINNER", FREE, True),
    (9, "Misir Wot", "Red lentil stew with injera", "DINNER", FREE, True),
]

STUDENT_ROWS = [
    (1, "Arne", "Tessel", "arne@example.org", "Male", 4, 2023, "CAFE", 1, 1, True, SEED_NOW),
    (2, "Hedda", "Mellow", "hedda@example.org", "Female", 2, 2025, "NON_CAFE", 2, 3, True, SEED_NOW),
    (3, "Dorin", "Almar", "dorin@example.org", "Male", 3, 2024, "CAFE", 4, 2, True, SEED_NOW),
    (4, "Soren", "Tamsin", "soren@example.org", "Female", 1, 2026, "NON_CAFE", 3, 4, True, SEED_NOW),
    (5, "Arlo", "Kestrel", "arlo@example.org", "Male", 2, 2025, "CAFE", 1, 1, False, SEED_NOW),
]

PAYMENT_ROWS = [
    (1, 2, STIPEND, 4, 2026, "SENT", 1, SEED_NOW, SEED_NOW),
    (2, 2, STIPEND, 3, 2026, "SENT", 1, SEED_NOW, SEED_NOW),
    (3, 2, STIPEND, 2, 2026, "CONFIRMED", 1, SEED_NOW, None),
    (4, 4, STIPEND, 4, 2026, "PENDING", None, None, None),
    (5, 4, STIPEND, 3, 2026, "SENT", 1, SEED_NOW, SEED_NOW),
]

ATTENDANCE_ROWS = [
    (1, 1, 1, SEED_TODAY, "BREAKFAST", SEED_NOW),
    (2, 1, 4, SEED_TODAY, "LUNCH", SEED_NOW),
    (3, 3, 2, SEED_TODAY, "BREAKFAST", SEED_NOW),
]

AUDIT_ROWS = [
    (1, 1, "ADMIN", "UPDATE", "Students", 1, None, "Approved student Arne Tessel", SEED_NOW),
    (2, 1, "ADMIN", "INSERT", "Cash_Payments", 1, None, "Created monthly payment for Hedda Mellow", SEED_NOW),
    (3, 1, "ADMIN", "UPDATE", "Cash_Payments", 1, None, "Confirmed payment and marked as SENT", SEED_NOW),
]

SEED_ROWS = {
    "departments": DEPARTMENT_ROWS,
    "dormitories": DORMITORY_ROWS,
    "admins": ADMIN_ROWS,
    "menus": MENU_ROWS,
    "students": STUDENT_ROWS,
    "cash_payments": PAYMENT_ROWS,
    "meal_attendance": ATTENDANCE_ROWS,
    "audit_logs": AUDIT_ROWS,
}


def seed_tables(spark: SparkSession, extra: dict[str, list] | None = None) -> dict[str, DataFrame]:
    """All eight seed tables; ``extra`` appends hand-made rows per table."""
    out = {}
    for name, rows in SEED_ROWS.items():
        rows = list(rows) + list((extra or {}).get(name, []))
        out[name] = spark.createDataFrame(rows, TABLES[name])
    return out
