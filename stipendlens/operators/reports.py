"""Named reports (R1-R22) and the dual-claim check (Q1).

Conventions shared by every report:

* the clock is an explicit ``as_of`` date, turned into Python literals so
  the period filters fold to constants and prune partitions;
* NULL placement follows PostgreSQL (ASC -> NULLs last, DESC -> NULLs
  first), which is the opposite of Spark's default, so every sort key
  spells it out;
* enums sort by declaration order (``enum_ordinal``);
* the primary key is the last sort key wherever a limit or row_number
  picks rows, so results are deterministic;
* aggregates over a fact are computed *before* joining dimensions
  (the hash aggregate combines map-side, so a hot key never reaches the
  join or the shuffle as more than one row per task);
* dimensions are broadcast only after ``bounded_broadcast`` proved their
  size; otherwise the join stays a shuffle join that AQE can split.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipendlens.functions.enums import meal_ordinal, status_ordinal, type_ordinal
from stipendlens.functions.scalars import full_name, period_of
from stipendlens.plans.joins import bounded_broadcast, distinct_keys, present_keys
from stipendlens.plans.ranking import rank_within

STUDENT_COLUMNS = ["student_id", "first_name", "last_name", "email", "gender", "year_of_study",
                   "year_enrolled", "student_type", "department_id", "dormitory_id", "is_approved",
                   "created_at"]
PAYMENT_COLUMNS = ["payment_id", "student_id", "amount", "payment_month", "payment_year", "status",
                   "confirmed_by", "confirmed_at", "sent_at"]
MENU_COLUMNS = ["menu_id", "item_name", "description", "meal_type", "price", "is_available"]


def _count_if(cond) -> F.Column:
    # COUNT(*) FILTER (WHERE cond): NULL conditions do not count
    return F.count(F.when(cond, F.lit(1)))


def _approved_non_cafe(students: DataFrame) -> DataFrame:
    return students.filter((F.col("student_type") == "NON_CAFE") & (F.col("is_approved") == True))  # noqa: E712


# --------------------------------------------------------------------------- R1
def attendance_detail(attendance: DataFrame, students: DataFrame, menus: DataFrame) -> DataFrame:
    """Every tick with student name and menu item; newest day first, then
    meal order. Inner joins: ticks whose student or menu is missing drop out."""
    a = attendance.select("attendance_id", "student_id", "menu_id", "meal_type", "meal_date")
    s = students.select("student_id", full_name().alias("student_name"))
    m = bounded_broadcast(menus.select("menu_id", "item_name"))
    j = a.join(bounded_broadcast(s), "student_id", "inner").join(m, "menu_id", "inner")
    return (j.orderBy(F.col("meal_date").desc_nulls_first(), meal_ordinal().asc_nulls_last(),
                      F.col("attendance_id").asc())
             .select("student_name", "item_name", "meal_type", "meal_date"))


# --------------------------------------------------------------------------- R2
def payment_status(students: DataFrame, departments: DataFrame, payments: DataFrame,
                   as_of: dt.date) -> DataFrame:
    """Approved NON_CAFE students with this month's payment or NO RECORD.
    The period test sits on the payment side before the outer join (it is
    part of the ON clause, not the WHERE clause)."""
    month, year = period_of(as_of)
    s = _approved_non_cafe(students).select("student_id", "first_name", "last_name", "department_id")
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    p = payments.filter((F.col("payment_month") == month) & (F.col("payment_year") == year)).select(
        "student_id", "payment_month", "payment_year", "status", "sent_at")
    j = s.join(d, "department_id", "left").join(p, "student_id", "left")
    return (j.orderBy(status_ordinal().asc_nulls_last(), F.col("last_name").asc_nulls_last(),
                      F.col("student_id").asc())
             .select(full_name().alias("student_name"), "department_name", "payment_month", "payment_year",
                     F.coalesce(F.col("status").cast("string"), F.lit("NO RECORD")).alias("payment_status"),
                     "sent_at"))


# --------------------------------------------------------------------------- R3
def menu_popularity(attendance: DataFrame, menus: DataFrame) -> DataFrame:
    """Ticks and distinct students per menu, menus without ticks kept with
    zeros. The right outer join of the source becomes: aggregate the ticks
    per menu first, then left-join the (small) aggregate onto the menus."""
    per_menu = attendance.groupBy("menu_id").agg(
        F.count("attendance_id").alias("total_ticks"),
        F.count_distinct("student_id").alias("unique_students"))
    m = menus.select("menu_id", "item_name", "meal_type")
    j = m.join(per_menu, "menu_id", "left")
    return (j.select("menu_id", "item_name", "meal_type",
                     F.coalesce("total_ticks", F.lit(0)).alias("total_ticks"),
                     F.coalesce("unique_students", F.lit(0)).alias("unique_students"))
             .orderBy(F.col("total_ticks").desc(), F.col("menu_id").asc())
             .drop("menu_id"))


# --------------------------------------------------------------------------- R4
def unmatched_payments(students: DataFrame, payments: DataFrame) -> DataFrame:
    """Students without any payment and payments without a student.

    Same rows as the full outer join filtered on missing partners, but as
    two anti joins: the student side tests against the *distinct* paying
    student ids (a student with a third of all payments is one row), and
    the payment side is a left anti join whose skewed side AQE can split
    (it cannot split a full outer join)."""
    s = students.select("student_id", "first_name", "last_name", "student_type")
    p = payments.select("payment_id", "student_id", "status")
    lonely_students = s.join(distinct_keys(p, ["student_id"]), "student_id", "left_anti").select(
        full_name().alias("student_name"), "student_type",
        F.lit(None).cast("long").alias("payment_id"), F.lit(None).cast("string").alias("status"))
    orphans = p.join(present_keys(s, ["student_id"]), "student_id", "left_anti").select(
        F.lit(None).cast("string").alias("student_name"), F.lit(None).cast("string").alias("student_type"),
        "payment_id", "status")
    return lonely_students.unionByName(orphans).orderBy(
        type_ordinal().asc_nulls_last(), F.col("payment_id").asc_nulls_first(), F.col("student_name").asc())


# ------------------------------------------------------------------- R5 / R6
def _payments_per_student(payments: DataFrame) -> DataFrame:
    st = F.col("status")
    return payments.groupBy("student_id").agg(
        F.count("payment_id").alias("n"),
        F.sum("amount").alias("amt"),
        F.count(F.lit(1)).alias("rows"),
        _count_if(st == "PENDING").alias("pending"),
        _count_if(st == "CONFIRMED").alias("confirmed"),
        _count_if(st == "SENT").alias("sent"),
    )


def department_summary(payments: DataFrame, students: DataFrame, departments: DataFrame,
                       as_of: dt.date | None = None) -> DataFrame:
    """Payments per department (inner joins: students without department
    drop out). With ``as_of`` only that year's payments count (R5), else all
    years (R6). Payments are pre-aggregated per student before the joins."""
    p = payments
    if as_of is not None:
        p = p.filter(F.col("payment_year") == as_of.year)
    per_student = _payments_per_student(p)
    s = students.select("student_id", "department_id")
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    j = per_student.join(s, "student_id", "inner").join(d, "department_id", "inner")
    out = j.groupBy("department_name").agg(
        F.sum("n").alias("total_payments"),
        F.sum("amt").alias("total_amount"),
        F.sum("pending").alias("pending_count"),
        F.sum("confirmed").alias("confirmed_count"),
        F.sum("sent").alias("sent_count"),
    )
    cols = ["department_name", "total_payments", "total_amount", "pending_count", "confirmed_count", "sent_count"]
    if as_of is not None:
        cols.remove("confirmed_count")
    return out.orderBy(F.col("total_amount").desc_nulls_first(), F.col("department_name").asc()).select(*cols)


def department_summary_for_year(payments: DataFrame, students: DataFrame, departments: DataFrame,
                                as_of: dt.date) -> DataFrame:
    """The department summary for the year of ``as_of``."""
    return department_summary(payments, students, departments, as_of)


# --------------------------------------------------------------------------- R7
def unpaid_students(students: DataFrame, departments: DataFrame, payments: DataFrame,
                    as_of: dt.date) -> DataFrame:
    """Approved NON_CAFE students with no SENT payment this month.

    ``NOT IN (subquery)`` is null-aware: one NULL student_id among the SENT
    payments of the period makes the predicate unknown for every student.
    Written as a left anti join on the distinct paid ids (a shuffle or
    broadcast hash join, not Spark's broadcast-only null-aware plan) plus an
    EXISTS guard that reproduces the NULL case exactly."""
    month, year = period_of(as_of)
    sent = payments.filter((F.col("payment_month") == month) & (F.col("payment_year") == year)
                           & (F.col("status") == "SENT")).select("student_id")
    has_null = sent.filter(F.col("student_id").isNull()).exists()
    s = _approved_non_cafe(students).select("student_id", "first_name", "last_name", "email", "department_id")
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    j = (s.join(distinct_keys(sent, ["student_id"]), "student_id", "left_anti")
          .filter(~has_null)
          .join(d, "department_id", "left"))
    return (j.orderBy(F.col("department_name").asc_nulls_last(), F.col("last_name").asc_nulls_last(),
                      F.col("student_id").asc())
             .select(full_name().alias("student_name"), "email", "department_name"))


# --------------------------------------------------------------------------- R8
def daily_attendance(attendance: DataFrame, as_of: dt.date) -> DataFrame:
    """Per meal on the day: distinct students and ticks. Meals without a
    tick produce no row; breakfast, lunch, dinner order."""
    if isinstance(as_of, dt.datetime):
        as_of = as_of.date()
    day = attendance.filter(F.col("meal_date") == F.lit(as_of))
    out = day.groupBy("meal_type").agg(
        F.count_distinct("student_id").alias("students_attended"),
        F.count("attendance_id").alias("total_ticks"))
    return out.orderBy(meal_ordinal().asc_nulls_last(), F.col("meal_type").asc())


# --------------------------------------------------------------------------- R9
def enrolment_summary(students: DataFrame) -> DataFrame:
    """Approved students per enrolment year with the CAFE share in percent,
    rounded half-up to one decimal on exact decimals (never on doubles)."""
    s = students.filter(F.col("is_approved") == True)  # noqa: E712
    g = s.groupBy("year_enrolled").agg(
        _count_if(F.col("student_type") == "CAFE").alias("cafe_users"),
        _count_if(F.col("student_type") == "NON_CAFE").alias("non_cafe_users"),
        F.count(F.lit(1)).alias("total_students"))
    pct = F.round(F.col("cafe_users").cast("decimal(20,0)") / F.col("total_students") * 100, 1)
    return (g.withColumn("cafe_pct", pct)
             .orderBy(F.col("year_enrolled").desc_nulls_first()))


# -------------------------------------------------------------------------- R10
def payment_history(payments: DataFrame, students: DataFrame, departments: DataFrame) -> DataFrame:
    """Per student and year: months recorded, amount received, months paid
    and pending, and RANK() of the amount within the year.

    Aggregate per (student, year) first, then join the names; the rank is
    computed by ``rank_within`` so a year with very many students is spread
    over many tasks instead of one window partition."""
    st = F.col("status")
    per = payments.groupBy("student_id", "payment_year").agg(
        F.count("payment_id").alias("months_recorded"),
        F.sum("amount").alias("total_received"),
        _count_if(st == "SENT").alias("months_paid"),
        _count_if(st == "PENDING").alias("months_pending"))
    s = students.select("student_id", "first_name", "last_name", "department_id")
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    j = per.join(s, "student_id", "inner").join(d, "department_id", "inner")
    ranked = rank_within(j, "total_received", by=["payment_year"], descending=True, out="rank_by_year")
    return (ranked.orderBy(F.col("payment_year").desc_nulls_first(), F.col("rank_by_year").asc(),
                           F.col("student_id").asc())
                  .select(full_name().alias("student_name"), "department_name", "payment_year",
                          "months_recorded", "total_received", "months_paid", "months_pending",
                          "rank_by_year"))


def payment_history_window(payments: DataFrame, students: DataFrame, departments: DataFrame) -> DataFrame:
    """R10 with a plain window (one task per year); for small inputs and as
    the reference the skew-safe version is tested against."""
    st = F.col("status")
    per = payments.groupBy("student_id", "payment_year").agg(
        F.count("payment_id").alias("months_recorded"),
        F.sum("amount").alias("total_received"),
        _count_if(st == "SENT").alias("months_paid"),
        _count_if(st == "PENDING").alias("months_pending"))
    s = students.select("student_id", "first_name", "last_name", "department_id")
    d = departments.select("department_id", "department_name")
    j = per.join(s, "student_id", "inner").join(d, "department_id", "inner")
    w = Window.partitionBy("payment_year").orderBy(F.col("total_received").desc_nulls_first())
    return (j.withColumn("rank_by_year", F.rank().over(w).cast("long"))
             .orderBy(F.col("payment_year").desc_nulls_first(), "rank_by_year", "student_id")
             .select(full_name().alias("student_name"), "department_name", "payment_year",
                     "months_recorded", "total_received", "months_paid", "months_pending", "rank_by_year"))


# -------------------------------------------------------------- R11 - R13
def list_departments(departments: DataFrame) -> DataFrame:
    return departments.select("department_id", "department_name", "college").orderBy(
        F.col("department_name").asc_nulls_last(), "department_id")


def list_dormitories(dormitories: DataFrame) -> DataFrame:
    return dormitories.select("dormitory_id", "dorm_name", "block", "gender_type").orderBy(
        F.col("block").asc_nulls_last(), "dormitory_id")


def available_menu(menus: DataFrame) -> DataFrame:
    return (menus.filter(F.col("is_available") == True)  # noqa: E712
                 .orderBy(meal_ordinal().asc_nulls_last(), F.col("item_name").asc_nulls_last(), "menu_id")
                 .select(*MENU_COLUMNS))


# -------------------------------------------------------------- R14 - R17
def pending_students(students: DataFrame, departments: DataFrame) -> DataFrame:
    """``is_approved = FALSE``: NULL approval is not pending."""
    s = students.filter(F.col("is_approved") == False)  # noqa: E712
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    return (s.join(d, "department_id", "left")
             .orderBy(F.col("created_at").asc_nulls_last(), "student_id")
             .select("student_id", "first_name", "last_name", "email", "student_type", "year_of_study",
                     "year_enrolled", "department_name"))


def approved_non_cafe(students: DataFrame) -> DataFrame:
    return (_approved_non_cafe(students)
            .orderBy(F.col("first_name").asc_nulls_last(), "student_id")
            .select("student_id", "first_name", "last_name", "email"))


def pending_payments(payments: DataFrame, students: DataFrame) -> DataFrame:
    """PENDING payments with the student's names (inner join)."""
    p = payments.filter(F.col("status") == "PENDING").select(*PAYMENT_COLUMNS)
    s = students.select("student_id", "first_name", "last_name")
    return (p.join(s, "student_id", "inner")
             .orderBy(F.col("payment_year").asc_nulls_last(), F.col("payment_month").asc_nulls_last(),
                      "payment_id")
             .select(*PAYMENT_COLUMNS, "first_name", "last_name"))


def sent_count(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("status") == "SENT").agg(F.count(F.lit(1)).alias("sent_count"))


# -------------------------------------------------------------------------- R18
def recent_audit(audit: DataFrame, n: int = 50) -> DataFrame:
    """Latest ``n`` audit rows (a top-k: TakeOrderedAndProject, no global sort)."""
    return audit.orderBy(F.col("logged_at").desc_nulls_first(), F.col("log_id").desc()).limit(n)


# -------------------------------------------------------------- R19 - R21
def student_profiles(students: DataFrame, departments: DataFrame, dormitories: DataFrame) -> DataFrame:
    """Every student with department and dormitory names (left joins)."""
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    r = bounded_broadcast(dormitories.select("dormitory_id", "dorm_name", "block"))
    return (students.select(*STUDENT_COLUMNS)
            .join(d, "department_id", "left").join(r, "dormitory_id", "left")
            .select(*STUDENT_COLUMNS, "department_name", "dorm_name", "block"))


def student_payments(students: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment history of NON_CAFE students: newest period first per student.
    A semi join: payments keep their own columns and are never duplicated."""
    non_cafe = present_keys(students.filter(F.col("student_type") == "NON_CAFE"), ["student_id"])
    return (payments.select(*PAYMENT_COLUMNS).join(non_cafe, "student_id", "left_semi")
            .orderBy("student_id", F.col("payment_year").desc_nulls_first(),
                     F.col("payment_month").desc_nulls_first(), "payment_id"))


def student_recent_meals(students: DataFrame, attendance: DataFrame, menus: DataFrame,
                         n: int = 30) -> DataFrame:
    """Up to ``n`` latest ticks per CAFE student (newest day first, then meal
    order, then tick id). ``row_number() <= n`` is planned with a partial
    WindowGroupLimit before the shuffle, so a student with a third of all
    ticks sends at most ``n`` rows per map task."""
    cafe = present_keys(students.filter(F.col("student_type") == "CAFE"), ["student_id"])
    a = attendance.select("attendance_id", "student_id", "menu_id", "meal_date", "meal_type", "recorded_at")
    a = a.join(cafe, "student_id", "left_semi")
    w = Window.partitionBy("student_id").orderBy(F.col("meal_date").desc_nulls_first(),
                                                 meal_ordinal().asc_nulls_last(), F.col("attendance_id").asc())
    top = a.withColumn("meal_rank", F.row_number().over(w)).filter(F.col("meal_rank") <= n)
    m = bounded_broadcast(menus.select("menu_id", "item_name"))
    return (top.join(m, "menu_id", "left")
               .orderBy("student_id", "meal_rank")
               .select("student_id", "meal_date", "meal_type", "recorded_at", "item_name",
                       F.col("meal_rank").cast("long").alias("meal_rank")))


# -------------------------------------------------------------------------- R22
def dashboard_kpis(students: DataFrame, payments: DataFrame) -> DataFrame:
    """One row: pending students, approved NON_CAFE students ("Approved" on
    the dashboard), pending payments that have a student, sent payments.
    Each count is one aggregate; the payment counts are scalar subqueries
    attached to the student aggregate, so there is no join of frames."""
    s_keys = present_keys(students, ["student_id"])
    pend = payments.filter(F.col("status") == "PENDING").groupBy("student_id").agg(
        F.count(F.lit(1)).alias("c"))
    pending_pay = pend.join(s_keys, "student_id", "left_semi").agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long")).scalar()
    sent = payments.filter(F.col("status") == "SENT").agg(F.count(F.lit(1))).scalar()
    return students.agg(
        _count_if(F.col("is_approved") == False).alias("pending_students"),  # noqa: E712
        _count_if((F.col("student_type") == "NON_CAFE") & (F.col("is_approved") == True)).alias(  # noqa: E712
            "approved_non_cafe"),
    ).select("pending_students", "approved_non_cafe",
             pending_pay.alias("pending_payments"), sent.alias("sent_payments"))


# --------------------------------------------------------------------------- Q1
def dual_claims(students: DataFrame, attendance: DataFrame, payments: DataFrame) -> DataFrame:
    """Students who draw on both systems, which the schema does not prevent.

    claim ``a``: NON_CAFE students with meal ticks; ``b``: CAFE students with
    payments; ``c``: students with a tick and a payment in the same month
    (one row per student-month). Semi joins test against distinct keys, so
    every side is combined map-side before it shuffles."""
    s = students.select("student_id", "first_name", "last_name", "student_type")
    tick_students = distinct_keys(attendance, ["student_id"])
    paid_students = distinct_keys(payments, ["student_id"])
    a = (s.filter(F.col("student_type") == "NON_CAFE").join(tick_students, "student_id", "left_semi")
         .select(F.lit("a").alias("claim"), "student_id", "student_type",
                 F.lit(None).cast("int").alias("claim_year"), F.lit(None).cast("int").alias("claim_month"),
                 full_name().alias("student_name")))
    b = (s.filter(F.col("student_type") == "CAFE").join(paid_students, "student_id", "left_semi")
         .select(F.lit("b").alias("claim"), "student_id", "student_type",
                 F.lit(None).cast("int").alias("claim_year"), F.lit(None).cast("int").alias("claim_month"),
                 full_name().alias("student_name")))
    tick_months = attendance.select("student_id", F.year("meal_date").alias("claim_year"),
                                    F.month("meal_date").alias("claim_month")).distinct()
    pay_months = payments.select("student_id", F.col("payment_year").alias("claim_year"),
                                 F.col("payment_month").alias("claim_month")).distinct()
    both = tick_months.join(pay_months, ["student_id", "claim_year", "claim_month"], "inner")
    c = (both.join(s, "student_id", "inner")
         .select(F.lit("c").alias("claim"), "student_id", "student_type", "claim_year", "claim_month",
                 full_name().alias("student_name")))
    return a.unionByName(b).unionByName(c).orderBy("claim", "student_id", "claim_year", "claim_month")


# ------------------------------------------------------------ S3 / E3
def student_portal(student_ids: DataFrame, students: DataFrame, departments: DataFrame, dormitories: DataFrame,
                   payments: DataFrame, attendance: DataFrame, menus: DataFrame,
                   n: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The student portal for a set of students (point lookups re-aimed as a
    semi join with a key frame; Parquet pushes nothing per key, but the
    join touches only the rows of those students): profile, payments (NON_CAFE
    students only) and the latest ``n`` meals (CAFE students only)."""
    keys = distinct_keys(student_ids.select(F.col(student_ids.columns[0]).alias("student_id")), ["student_id"])
    s = students.join(keys, "student_id", "left_semi")
    return (student_profiles(s, departments, dormitories),
            student_payments(s, payments.join(keys, "student_id", "left_semi")),
            student_recent_meals(s, attendance.join(keys, "student_id", "left_semi"), menus, n))
