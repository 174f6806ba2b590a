"""Write workflows as batch transformations over command tables.

The source system applied one HTTP request at a time (UPDATE ... RETURNING,
then a separate audit INSERT, no transaction). Here a whole batch of
requests or commands is one plan that returns a ``Result``:

* ``table``    the new version of the touched table (old rows + changes);
* ``changed``  the inserted / updated rows (``RETURNING``);
* ``rejected`` the requests that the source would have refused, with the
  message it would have answered;
* ``audit``    the audit rows, derived from the changed rows in the same
  plan (so table and log always agree), ``log_id`` unset until
  ``append_audit`` numbers them.

Ids are dense and deterministic (``dense_ids``), so a task recomputed after
an executor loss yields the same ids; nothing is collected to the driver.
Parquet tables have no UPDATE/MERGE: a job writes ``table`` (or only the
partitions touched, see ``touched_partitions``) to a new location or with
dynamic partition overwrite from a materialized result.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipendlens.functions.scalars import ntz_literal, period_of
from stipendlens.operators import quality as Q
from stipendlens.plans.joins import distinct_keys, present_keys
from stipendlens.plans.lineage import cut_lineage
from stipendlens.plans.ranking import dense_ids
from stipendlens.schemas import AUDIT_LOGS, CASH_PAYMENTS, MEAL_ATTENDANCE, PARTITION_COLUMNS, PRIMARY_KEYS, STUDENTS

# --- fixed values: audit texts and API answers -----------------------------
REGISTERED_TEXT = "New student registered: "
APPROVED_TEXT = "Approved student "
BULK_TEXT = "Bulk monthly payment records created for NON_CAFE students"
CONFIRMED_TEXT = "Confirmed payment"
SENT_TEXT = "Marked payment as SENT"
STUDENT_NOT_FOUND = "Student not found"
PENDING_NOT_FOUND = "Pending payment not found"
NOT_FOUND_OR_SENT = "Payment not found or already sent"
INVALID_CREDENTIALS = "Invalid credentials"
STUDENTS_TABLE = "Students"
PAYMENTS_TABLE = "Cash_Payments"

FORM_NUMBERS = ["year_of_study", "year_enrolled", "department_id", "dormitory_id"]
REGISTRATION_FIELDS = ["first_name", "last_name", "email", "gender", "year_of_study", "year_enrolled",
                       "student_type", "department_id", "dormitory_id"]


class Result(NamedTuple):
    table: DataFrame
    changed: DataFrame
    rejected: DataFrame
    audit: DataFrame
    inserts: bool = False  # ``changed`` holds new rows only: a commit appends them


def _ts(value: dt.datetime) -> Column:
    return ntz_literal(value)


def _cast_to(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def audit_rows(df: DataFrame, actor_id: Column, actor_type: str, action: str, target_table: str,
               target_id: Column, new_value: Column, logged_at: Column, seq: Column) -> DataFrame:
    """Audit rows (``log_id`` NULL) plus ``audit_seq``, the unique order key
    ``append_audit`` numbers them by."""
    return df.select(
        F.lit(None).cast("long").alias("log_id"), actor_id.cast("long").alias("actor_id"),
        F.lit(actor_type).alias("actor_type"), F.lit(action).alias("action"),
        F.lit(target_table).alias("target_table"), target_id.cast("long").alias("target_id"),
        F.lit(None).cast("string").alias("old_value"), new_value.cast("string").alias("new_value"),
        logged_at.cast("timestamp_ntz").alias("logged_at"), seq.cast("long").alias("audit_seq"))


def _no_audit(df: DataFrame) -> DataFrame:
    return audit_rows(df, F.lit(None), "ADMIN", "UPDATE", "", F.lit(None), F.lit(None), F.lit(None),
                      F.lit(None)).limit(0)


def touched_partitions(table: DataFrame, changed: DataFrame, name: str) -> DataFrame:
    """Rows of ``table`` in the partitions that ``changed`` touches: what a
    dynamic-partition-overwrite write of the new version needs to rewrite.
    The touched partition values are bounded by the table's partition
    directories (days, or year-months), so they are broadcast without a
    count job (which would recompute ``changed``)."""
    parts = PARTITION_COLUMNS.get(name) or []
    if not parts:
        return table
    return table.join(F.broadcast(distinct_keys(changed, parts)), parts, "left_semi")


# ------------------------------------------------------------------ M1
def register_students(students: DataFrame, requests: DataFrame, departments: DataFrame,
                      dormitories: DataFrame, as_of: dt.datetime, last_id: int | None = None) -> Result:
    """Registration requests (``seq`` unique, the request order; fields as the
    registration form, ``password`` included). Checks: required email and
    password, password strength, then the table's rules; a duplicate email
    within the batch loses to the earlier request. New students get
    ``is_approved = FALSE`` and ``created_at = as_of`` whatever the request
    says; the password is validated and dropped (never stored)."""
    req = requests
    for c in REGISTRATION_FIELDS + ["password"]:
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast("string"))
    req = req.select("seq", "password", *REGISTRATION_FIELDS)
    numbers = [c for c in FORM_NUMBERS if isinstance(req.schema[c].dataType, T.StringType)]
    for c in numbers:  # form text: a malformed number is a rejected row, not a failed batch
        req = req.withColumn(f"{c}_text", F.col(c))
    req = Q.coerce_form_numbers(req, numbers)
    req = req.withColumn("is_approved", F.lit(False)).withColumn("created_at", _ts(as_of))
    rules = [Q.form_number(f"{c}_text", c) for c in numbers]
    rules += Q.student_rules(req, students, departments, dormitories, order_col="seq", ingest=True)
    valid, rejected = Q.split_valid(req, rules, "seq", materialize=True)
    new = Q.assign_ids(valid, "student_id", students, "seq", last_id)
    inserted = _cast_to(new, STUDENTS)
    table = _cast_to(students, STUDENTS).unionByName(inserted)
    audit = audit_rows(new, F.col("student_id"), "STUDENT", "INSERT", STUDENTS_TABLE, F.col("student_id"),
                       F.concat(F.lit(REGISTERED_TEXT), F.col("first_name"), F.lit(" "), F.col("last_name")),
                       _ts(as_of), F.col("seq"))
    return Result(table, inserted, rejected.drop("password", *[f"{c}_text" for c in numbers]), audit, True)


# ------------------------------------------------------------------ M2
def approve_students(students: DataFrame, commands: DataFrame) -> Result:
    """Approval commands ``cmd_id, student_id, admin_id, ts``. No guard:
    approving an approved student succeeds and is audited again, one audit
    row per command. Unknown students are rejected."""
    names = students.select("student_id", "first_name", "last_name")
    known = commands.join(names, "student_id", "inner")
    rejected = (commands.join(present_keys(students, ["student_id"]), "student_id", "left_anti")
                .withColumn("message", F.lit(STUDENT_NOT_FOUND)))
    hit = distinct_keys(known, ["student_id"]).withColumn("__hit", F.lit(True))
    table = (students.join(hit, "student_id", "left")
             .withColumn("is_approved", F.when(F.col("__hit"), F.lit(True)).otherwise(F.col("is_approved")))
             .select(*students.columns))
    changed = table.join(hit.select("student_id"), "student_id", "left_semi")
    audit = audit_rows(known, F.col("admin_id"), "ADMIN", "UPDATE", STUDENTS_TABLE, F.col("student_id"),
                       F.concat(F.lit(APPROVED_TEXT), F.col("first_name"), F.lit(" "), F.col("last_name")),
                       F.col("ts"), F.col("cmd_id"))
    return Result(table, changed, rejected, audit)


# ------------------------------------------------------------------ M3
def create_payments(payments: DataFrame, requests: DataFrame, students: DataFrame, as_of: dt.datetime,
                    last_id: int | None = None) -> Result:
    """Single payment requests ``seq, student_id, payment_month, payment_year,
    admin_id``: 3000.00, PENDING. A period that already has a payment (stored
    or earlier in the batch) is an error, not a skip; eligibility is not
    checked (as in the source)."""
    req = (requests.withColumn("amount", F.lit("3000.00").cast("decimal(10,2)"))
           .withColumn("status", F.lit("PENDING")))
    rules = Q.payment_rules(req, payments, students, order_col="seq")
    valid, rejected = Q.split_valid(req, rules, "seq", materialize=True)
    new = Q.assign_ids(valid, "payment_id", payments, "seq", last_id)
    for c in ("confirmed_by", "confirmed_at", "sent_at"):
        new = new.withColumn(c, F.lit(None))
    inserted = _cast_to(new, CASH_PAYMENTS)
    table = _cast_to(payments, CASH_PAYMENTS).unionByName(inserted)
    text = F.concat(F.lit("Created pending payment for student "), F.col("student_id").cast("string"),
                    F.lit(", month "), F.col("payment_month").cast("string"), F.lit("/"),
                    F.col("payment_year").cast("string"))
    audit = audit_rows(new, F.col("admin_id"), "ADMIN", "INSERT", PAYMENTS_TABLE, F.col("payment_id"), text,
                       _ts(as_of), F.col("seq"))
    return Result(table, inserted, rejected, audit, True)


# ------------------------------------------------------------------ M4
def create_monthly_payments(payments: DataFrame, students: DataFrame, as_of: dt.datetime,
                            admin_id: int, last_id: int | None = None) -> Result:
    """One PENDING 3000.00 payment for every approved NON_CAFE student that
    has none in the month of ``as_of`` (``ON CONFLICT DO NOTHING``: existing
    periods are skipped, listed in ``rejected``). Exactly one audit row per
    run, with no target. Running it twice gives the same table."""
    month, year = period_of(as_of)
    eligible = distinct_keys(students.filter((F.col("student_type") == "NON_CAFE")
                                             & (F.col("is_approved") == True)), ["student_id"])  # noqa: E712
    existing = distinct_keys(payments.filter((F.col("payment_month") == month) & (F.col("payment_year") == year)),
                             ["student_id"])
    todo = eligible.join(existing, "student_id", "left_anti")
    start = payments.select(F.max("payment_id")).scalar() if last_id is None else last_id
    new = dense_ids(todo, "student_id", start, "payment_id").select(
        "payment_id", "student_id", F.lit("3000.00").cast("decimal(10,2)").alias("amount"),
        F.lit(month).alias("payment_month"), F.lit(year).alias("payment_year"), F.lit("PENDING").alias("status"),
        F.lit(None).alias("confirmed_by"), F.lit(None).alias("confirmed_at"), F.lit(None).alias("sent_at"))
    inserted = _cast_to(new, CASH_PAYMENTS)
    table = _cast_to(payments, CASH_PAYMENTS).unionByName(inserted)
    skipped = eligible.join(existing, "student_id", "left_semi").withColumn(
        "message", F.lit("Payment already exists for this student/month."))
    spark = payments.sparkSession
    one = spark.createDataFrame([(int(admin_id),)], "admin_id long")
    audit = audit_rows(one, F.col("admin_id"), "ADMIN", "INSERT", PAYMENTS_TABLE, F.lit(None), F.lit(BULK_TEXT),
                       _ts(as_of), F.lit(0))
    return Result(table, inserted, skipped, audit, True)


# -------------------------------------------------------------- M5 / M6
def apply_payment_commands(payments: DataFrame, commands: DataFrame) -> Result:
    """Confirm / send commands ``cmd_id, payment_id, kind ('confirm'|'send'),
    admin_id, ts`` with the result of running them one by one in (ts, cmd_id)
    order:

    * a confirm succeeds only from PENDING: the earliest confirm of a payment
      wins if the payment is PENDING and no send came before it;
    * a send succeeds from PENDING or CONFIRMED: the earliest send wins
      (from PENDING it leaves confirmed_by / confirmed_at NULL);
    * every other command is rejected (a NULL status matches no guard).

    One aggregate per payment (two ``min`` over (ts, cmd_id, admin_id),
    combined map-side), a narrow join with the payments' status that
    decides which commands win, and one join that applies the winners; no
    per-command loop. Payments without commands pass through unchanged."""
    kind = F.lower(F.col("kind"))
    ev = F.struct(F.col("ts"), F.col("cmd_id"), F.col("admin_id"))
    firsts = commands.groupBy("payment_id").agg(
        F.min(F.when(kind == "confirm", ev)).alias("__c"),
        F.min(F.when(kind == "send", ev)).alias("__s"))
    # decisions need only (payment_id, status): a narrow join, one row per commanded payment
    status = payments.select("payment_id", F.col("status").alias("__st"))
    st, c, s = F.col("__st"), F.col("__c"), F.col("__s")
    decisions = firsts.join(status, "payment_id", "inner").select(
        "payment_id", "__c", "__s",
        F.coalesce(c.isNotNull() & (st == "PENDING") & (s.isNull() | (c < s)), F.lit(False)).alias("__c_ok"),
        F.coalesce(s.isNotNull() & st.isin("PENDING", "CONFIRMED"), F.lit(False)).alias("__s_ok"),
    ).filter(F.col("__c_ok") | F.col("__s_ok"))
    c_ok, s_ok = F.col("__c_ok"), F.col("__s_ok")
    j = payments.join(decisions, "payment_id", "left")
    hit_c, hit_s = F.coalesce(c_ok, F.lit(False)), F.coalesce(s_ok, F.lit(False))
    updated = j.select(
        *[F.col(x) for x in payments.columns if x not in ("status", "confirmed_by", "confirmed_at", "sent_at")],
        F.when(hit_s, F.lit("SENT")).when(hit_c, F.lit("CONFIRMED")).otherwise(F.col("status")).alias("status"),
        F.when(hit_c, c["admin_id"]).otherwise(F.col("confirmed_by")).alias("confirmed_by"),
        F.when(hit_c, c["ts"]).otherwise(F.col("confirmed_at")).alias("confirmed_at"),
        F.when(hit_s, s["ts"]).otherwise(F.col("sent_at")).alias("sent_at"),
        (hit_c | hit_s).alias("__changed"))
    table = _cast_to(updated, CASH_PAYMENTS)
    changed = _cast_to(updated.filter("__changed"), CASH_PAYMENTS)
    accepted = decisions.select(F.explode(F.array(F.when(c_ok, c["cmd_id"]), F.when(s_ok, s["cmd_id"]))).alias(
        "cmd_id")).filter(F.col("cmd_id").isNotNull())
    done = commands.join(accepted, "cmd_id", "left_semi")
    rejected = commands.join(accepted, "cmd_id", "left_anti").withColumn(
        "message", F.when(kind == "confirm", F.lit(PENDING_NOT_FOUND)).otherwise(F.lit(NOT_FOUND_OR_SENT)))
    audit = audit_rows(done, F.col("admin_id"), "ADMIN", "UPDATE", PAYMENTS_TABLE, F.col("payment_id"),
                       F.when(kind == "confirm", F.lit(CONFIRMED_TEXT)).otherwise(F.lit(SENT_TEXT)),
                       F.col("ts"), F.col("cmd_id"))
    return Result(table, changed, rejected, audit)


# ------------------------------------------------------------------ M7
def force_payment_status(payments: DataFrame, keys: DataFrame, status: str, as_of: dt.datetime,
                         admin_id: int) -> Result:
    """The unguarded period update: every payment of the given
    (student_id, payment_month, payment_year) keys becomes CONFIRMED
    (stamping confirmed_by / confirmed_at) or SENT (stamping sent_at),
    whatever its status. No audit. Keys without a payment are listed in
    ``rejected`` (the UPDATE matched no row)."""
    status = status.upper()
    if status not in ("CONFIRMED", "SENT"):
        raise ValueError("status must be CONFIRMED or SENT")
    k = ["student_id", "payment_month", "payment_year"]
    hit = distinct_keys(keys, k).withColumn("__hit", F.lit(True))
    j = payments.join(hit, k, "left")
    h = F.coalesce(F.col("__hit"), F.lit(False))
    j = j.withColumn("status", F.when(h, F.lit(status)).otherwise(F.col("status")))
    if status == "CONFIRMED":
        j = (j.withColumn("confirmed_by", F.when(h, F.lit(int(admin_id))).otherwise(F.col("confirmed_by")))
              .withColumn("confirmed_at", F.when(h, _ts(as_of)).otherwise(F.col("confirmed_at"))))
    else:
        j = j.withColumn("sent_at", F.when(h, _ts(as_of)).otherwise(F.col("sent_at")))
    table = _cast_to(j, CASH_PAYMENTS)
    changed = _cast_to(j.filter(h), CASH_PAYMENTS)
    rejected = keys.join(present_keys(payments, k), k, "left_anti")
    return Result(table, changed, rejected, _no_audit(payments))


# ------------------------------------------------------------------ M8
def record_ticks(attendance: DataFrame, ticks: DataFrame, students: DataFrame, menus: DataFrame,
                 as_of: dt.datetime, last_id: int | None = None) -> Result:
    """Meal ticks ``seq, student_id, menu_id, meal_type[, meal_date,
    recorded_at]``; missing date / time default to the clock. One tick per
    (student, day, meal): the earliest by (recorded_at, seq) wins within the
    batch, and a key already stored rejects the tick. Unknown students or
    menus are rejected. The tick's meal_type need not equal the menu's."""
    t = Q.apply_defaults(ticks, Q.table_defaults("meal_attendance", as_of))
    rules = Q.attendance_rules(t, attendance, students, menus, order_col=("recorded_at", "seq"))
    valid, rejected = Q.split_valid(t, rules, "seq", materialize=True)
    new = Q.assign_ids(valid, "attendance_id", attendance, "seq", last_id)
    inserted = _cast_to(new, MEAL_ATTENDANCE)
    table = _cast_to(attendance, MEAL_ATTENDANCE).unionByName(inserted)
    return Result(table, inserted, rejected, _no_audit(attendance), True)


# -------------------------------------------------------------- M9 / M10
def append_audit(audit: DataFrame | None, new_rows: DataFrame, last_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Number new audit rows after ``last_id``, the stored high-water mark
    (by default the stored log's maximum), in ``audit_seq`` order and append
    them: returns ``(new_table, appended)``. Stored rows are never rewritten;
    write ``appended`` with mode ``append``."""
    start = audit.select(F.max("log_id")).scalar() if last_id is None else last_id
    numbered = dense_ids(new_rows.drop("log_id"), "audit_seq", start, "log_id")
    appended = _cast_to(numbered, AUDIT_LOGS)
    return (appended if audit is None else _cast_to(audit, AUDIT_LOGS).unionByName(appended)), appended


def audit_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old log missing from the new one (changed or deleted).
    Empty for every legal new version: UPDATE and DELETE on the log are
    no-ops."""
    return _cast_to(old, AUDIT_LOGS).exceptAll(_cast_to(new, AUDIT_LOGS))


# ------------------------------------------------------------------ M11
def stamp_last_login(admins: DataFrame, logins: DataFrame) -> Result:
    """Logins ``admin_id, ts``: active admins get ``last_login`` = the later
    of the stored stamp and their latest login; logins of inactive or unknown
    admins are rejected."""
    latest = logins.groupBy("admin_id").agg(F.max("ts").alias("__ts"))
    j = admins.join(latest, "admin_id", "left")
    ok = (F.col("is_active") == True) & F.col("__ts").isNotNull()  # noqa: E712
    ok = F.coalesce(ok, F.lit(False))
    table = j.withColumn("last_login", F.when(ok, F.greatest(F.col("last_login"), F.col("__ts")))
                         .otherwise(F.col("last_login"))).withColumn("__ok", ok)
    changed = table.filter("__ok").select(*admins.columns)
    active = present_keys(admins.filter(F.col("is_active") == True), ["admin_id"])  # noqa: E712
    rejected = logins.join(active, "admin_id", "left_anti").withColumn("message", F.lit(INVALID_CREDENTIALS))
    return Result(table.select(*admins.columns), changed, rejected, _no_audit(admins))


# ------------------------------------------------------------------ M12
def delete_rows(tables: dict[str, DataFrame], table_name: str, ids: DataFrame) -> tuple[dict, DataFrame]:
    """Delete rows by primary key (``ids`` has one column, the key) with the
    schema's referential actions:

    * students -> CASCADE to meal ticks and payments;
    * departments / dormitories -> SET NULL on students;
    * admins -> SET NULL on payments.confirmed_by;
    * menus -> RESTRICT: menus with ticks are kept and returned as blocked;
    * audit_logs -> nothing happens (the log ignores DELETE), all blocked.

    Returns the dict of new tables and the blocked ids."""
    pk = PRIMARY_KEYS[table_name]
    ids = ids.select(F.col(ids.columns[0]).alias(pk))
    key, given = distinct_keys(ids, [pk]), present_keys(ids, [pk])  # semi / anti joins take repeated ids
    out = dict(tables)
    blocked = key.sparkSession.createDataFrame([], key.schema)
    if table_name == "audit_logs":
        return out, key
    if table_name == "menus":
        blocked = key.join(distinct_keys(tables["meal_attendance"], ["menu_id"]), "menu_id", "left_semi")
        key = key.join(blocked, "menu_id", "left_anti")
        given = key
    out[table_name] = tables[table_name].join(given, pk, "left_anti")

    def set_null(name: str, col: str) -> None:
        if name not in tables:
            return
        t, hit = tables[name], given.withColumnRenamed(pk, col)
        # semi and anti join instead of one with an aggregated key: AQE can split a hot key's rows
        cleared = t.join(hit, col, "left_semi").withColumn(col, F.lit(None).cast(t.schema[col].dataType)).select(*t.columns)
        out[name] = cleared.unionByName(t.join(hit, col, "left_anti").select(*t.columns))

    if table_name == "students":
        for child in ("meal_attendance", "cash_payments"):
            if child in tables:
                out[child] = tables[child].join(given, "student_id", "left_anti")
    elif table_name == "departments":
        set_null("students", "department_id")
    elif table_name == "dormitories":
        set_null("students", "dormitory_id")
    elif table_name == "admins":
        set_null("cash_payments", "confirmed_by")
    return out, blocked


#: Child tables and their columns that a delete from a table reaches.
REFERENCES = {"students": [("meal_attendance", "student_id"), ("cash_payments", "student_id")],
              "departments": [("students", "department_id")], "dormitories": [("students", "dormitory_id")],
              "admins": [("cash_payments", "confirmed_by")], "menus": []}


def delete_changes(tables: dict[str, DataFrame], table_name: str, ids: DataFrame) -> tuple[dict[str, tuple], DataFrame]:
    """``delete_rows`` as changes to stored tables: per table reached, the new
    rows of the partitions that hold a row it deletes or changes and those
    partitions' values (the whole table and None where it has no
    partitions), and the blocked ids."""
    new, blocked = delete_rows(tables, table_name, ids)
    pk = PRIMARY_KEYS[table_name]
    given = present_keys(ids.select(F.col(ids.columns[0]).alias(pk)), [pk])
    out: dict[str, tuple] = {}
    if table_name == "audit_logs":
        return out, blocked
    for name, col in [(table_name, pk), *REFERENCES[table_name]]:
        parts = PARTITION_COLUMNS.get(name) or []
        if not parts:
            out[name] = (new[name], None)
            continue
        hit = tables[name].join(given.withColumnRenamed(pk, col), col, "left_semi")
        touched = cut_lineage(distinct_keys(hit, parts))  # no more rows than the table has partitions
        out[name] = (new[name].join(F.broadcast(touched), parts, "left_semi"), touched)
    return out, blocked
