"""Domain schemas and enum domains.

Fixed values that must match the source system's declarations: enum
labels in declaration order (PostgreSQL sorts enums by this order, not
alphabetically), column lengths and the stipend amount.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enum domains in declaration order ----------------------
STUDENT_TYPES = ("CAFE", "NON_CAFE")
MEAL_TYPES = ("BREAKFAST", "LUNCH", "DINNER")
PAYMENT_STATUSES = ("PENDING", "CONFIRMED", "SENT")
ADMIN_ROLES = ("SUPER_ADMIN", "CAFE_MANAGER")
GENDERS = ("Male", "Female", "Other")
ACTOR_TYPES = ("STUDENT", "ADMIN")
AUDIT_ACTIONS = ("INSERT", "UPDATE", "DELETE")

# --- fixed values: defaults -------------------------------------------------
MONTHLY_STIPEND = "3000.00"  # decimal(10,2) default amount
DEFAULT_ADMIN_ROLE = "CAFE_MANAGER"
DEFAULT_PAYMENT_STATUS = "PENDING"

# --- fixed values: VARCHAR lengths per table.column -------------------------
MAX_LENGTHS = {
    "departments": {"department_name": 120, "college": 120},
    "dormitories": {"dorm_name": 100, "block": 20},
    "students": {"first_name": 80, "last_name": 80, "email": 150},
    "admins": {"full_name": 150, "email": 150},
    "menus": {"item_name": 120},
    "audit_logs": {"actor_type": 20, "action": 20, "target_table": 60},
}

TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
PRICE = T.DecimalType(8, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


DEPARTMENTS = T.StructType([
    _f("department_id", T.LongType(), False),
    _f("department_name", T.StringType(), False),
    _f("college", T.StringType()),
])

DORMITORIES = T.StructType([
    _f("dormitory_id", T.LongType(), False),
    _f("dorm_name", T.StringType(), False),
    _f("block", T.StringType()),
    _f("gender_type", T.StringType()),
    _f("total_rooms", T.IntegerType()),
])

# password_hash is never part of our frames (it leaked through SELECT * in
# the source system).
STUDENTS = T.StructType([
    _f("student_id", T.LongType(), False),
    _f("first_name", T.StringType(), False),
    _f("last_name", T.StringType(), False),
    _f("email", T.StringType(), False),
    _f("gender", T.StringType()),
    _f("year_of_study", T.IntegerType()),
    _f("year_enrolled", T.IntegerType(), False),
    _f("student_type", T.StringType(), False),
    _f("department_id", T.LongType()),
    _f("dormitory_id", T.LongType()),
    _f("is_approved", T.BooleanType()),
    _f("created_at", TS),
])

ADMINS = T.StructType([
    _f("admin_id", T.LongType(), False),
    _f("full_name", T.StringType(), False),
    _f("email", T.StringType(), False),
    _f("role", T.StringType()),
    _f("last_login", TS),
    _f("is_active", T.BooleanType()),
])

MENUS = T.StructType([
    _f("menu_id", T.LongType(), False),
    _f("item_name", T.StringType(), False),
    _f("description", T.StringType()),
    _f("meal_type", T.StringType(), False),
    _f("price", PRICE, False),
    _f("is_available", T.BooleanType()),
])

MEAL_ATTENDANCE = T.StructType([
    _f("attendance_id", T.LongType(), False),
    _f("student_id", T.LongType(), False),
    _f("menu_id", T.LongType(), False),
    _f("meal_date", T.DateType(), False),
    _f("meal_type", T.StringType(), False),
    _f("recorded_at", TS),
])

CASH_PAYMENTS = T.StructType([
    _f("payment_id", T.LongType(), False),
    _f("student_id", T.LongType(), False),
    _f("amount", MONEY, False),
    _f("payment_month", T.IntegerType(), False),
    _f("payment_year", T.IntegerType(), False),
    _f("status", T.StringType()),
    _f("confirmed_by", T.LongType()),
    _f("confirmed_at", TS),
    _f("sent_at", TS),
])

AUDIT_LOGS = T.StructType([
    _f("log_id", T.LongType(), False),
    _f("actor_id", T.LongType()),
    _f("actor_type", T.StringType()),
    _f("action", T.StringType()),
    _f("target_table", T.StringType()),
    _f("target_id", T.LongType()),
    _f("old_value", T.StringType()),
    _f("new_value", T.StringType()),
    _f("logged_at", TS),
])

TABLES = {
    "departments": DEPARTMENTS,
    "dormitories": DORMITORIES,
    "students": STUDENTS,
    "admins": ADMINS,
    "menus": MENUS,
    "meal_attendance": MEAL_ATTENDANCE,
    "cash_payments": CASH_PAYMENTS,
    "audit_logs": AUDIT_LOGS,
}

PRIMARY_KEYS = {
    "departments": "department_id",
    "dormitories": "dormitory_id",
    "students": "student_id",
    "admins": "admin_id",
    "menus": "menu_id",
    "meal_attendance": "attendance_id",
    "cash_payments": "payment_id",
    "audit_logs": "log_id",
}

# Physical layout for the growing fact tables: partition columns let the
# period / day filters of the reports prune whole directories.
PARTITION_COLUMNS = {
    "meal_attendance": ["meal_date"],
    "cash_payments": ["payment_year", "payment_month"],
    "audit_logs": [],
}
