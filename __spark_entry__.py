"""

``entry(spark)`` runs the flagship report on sf0.001; ``queries()`` maps
each implemented operator to a callable ``(spark, sf_dir) -> DataFrame``
over the domain tables mapped from the driver's parquet files (see
``stipendlens.sources.mapping``); ``oracle_sql()`` holds the equivalent
DuckDB SQL (``oracle_queries.py``). Money columns are exact decimals in the
library and cast to DOUBLE here, after aggregation, to match the oracle.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracle_queries  # noqa: E402
from stipendlens.operators import quality as Q  # noqa: E402
from stipendlens.operators import reports as R  # noqa: E402
from stipendlens.operators import views as V  # noqa: E402
from stipendlens.operators import workflows as W  # noqa: E402
from stipendlens.plans.lineage import ensure_checkpoint_dir  # noqa: E402
from stipendlens.sources.tables import to_json  # noqa: E402
from stipendlens.streaming.ticks import (current_ticks, event_tick_stream, read_dashboard, run_tick_streams,  # noqa: E402
                                         start_tick_ingest)
from stipendlens.sources.mapping import (ATTENDANCE_AS_OF, PAYMENTS_AS_OF, WORKFLOW_ADMIN,  # noqa: E402
                                         WORKFLOW_AS_OF, Commands, Domain, Faulty)

try:
    from stipendlens.llm import queries as _llm  # noqa: E402
except ModuleNotFoundError as missing:  # the subpackage may be absent; errors inside it are not hidden
    if missing.name not in ("stipendlens.llm", "corpus_pipeline"):
        raise
    _llm = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _money_as_double(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


_DOMAINS: dict[tuple[int, str], Domain] = {}


def _domain(spark: SparkSession, sf_dir: str) -> Domain:
    """One lazily mapped set of domain tables per (session, directory), like
    temp views registered once: the plans are reused, the data is re-read by
    every query."""
    key = (id(spark), sf_dir)
    d = _DOMAINS.get(key)
    if d is None or d.spark is not spark:
        d = _DOMAINS[key] = Domain(spark, sf_dir)
    return d


def _q(build: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _money_as_double(build(_domain(spark, sf_dir)))
    run.__doc__ = build.__doc__
    return run


def _shift_years(payments: DataFrame, years: int) -> DataFrame:
    return payments.withColumn("payment_year", (F.col("payment_year") + years).cast("int"))


def _payment_violations(d: Domain) -> DataFrame:
    raw = d.cash_payments_raw
    return Q.violations(raw, Q.payment_rules(raw, None, d.students, d.admins, order_col="payment_id"), "payment_id")


def _attendance_rules(d: Domain):
    raw = d.meal_attendance_raw
    return raw, Q.attendance_rules(raw, None, d.students, d.menus, order_col="attendance_id")


def _attendance_violations(d: Domain) -> DataFrame:
    raw, rules = _attendance_rules(d)
    return Q.violations(raw, rules, "attendance_id")


def _student_violations(d: Domain) -> DataFrame:
    s = d.students
    return Q.violations(s, Q.student_rules(s, None, d.departments, d.dormitories, order_col="student_id"),
                        "student_id")


def _faulty_students(d: Domain) -> DataFrame:
    df = Faulty(d).students
    return Q.violations(df, Q.student_rules(df, None, d.departments, d.dormitories, order_col="seq"), "seq")


def _faulty_payments(d: Domain) -> DataFrame:
    df = Faulty(d).payments
    return Q.violations(df, Q.payment_rules(df, None, d.students, d.admins, order_col="seq"), "seq")


def _faulty_ticks(d: Domain) -> DataFrame:
    df = Faulty(d).ticks
    return Q.violations(df, Q.attendance_rules(df, None, d.students, d.menus, order_col="seq"), "seq")


def _faulty_menus(d: Domain) -> DataFrame:
    df = Faulty(d).menus
    return Q.violations(df, Q.menu_rules(df), "seq")


def _faulty_audit(d: Domain) -> DataFrame:
    df = Faulty(d).audit_logs
    return Q.violations(df, Q.audit_rules(df), "seq")


def _attendance_split(d: Domain, side: int) -> DataFrame:
    raw, rules = _attendance_rules(d)
    out = Q.split_valid(raw, rules, "attendance_id")[side]
    if side == 1:
        out = out.select("attendance_id", "student_id", "first_reason", "message")
    return out


def _payments_clock() -> dt.datetime:
    return dt.datetime.combine(PAYMENTS_AS_OF, dt.time())


def _register(d: Domain) -> W.Result:
    return W.register_students(d.students, Commands(d).registrations(), d.departments, d.dormitories,
                               WORKFLOW_AS_OF)


def _approve(d: Domain) -> W.Result:
    return W.approve_students(d.students, Commands(d).approvals())


def _create_payments(d: Domain) -> W.Result:
    return W.create_payments(d.cash_payments, Commands(d).payment_requests(), d.students, WORKFLOW_AS_OF)


def _commands(d: Domain) -> W.Result:
    return W.apply_payment_commands(d.cash_payments, Commands(d).payment_commands())


def _ticks(d: Domain) -> W.Result:
    c = Commands(d)
    return W.record_ticks(c.stored_ticks(), c.new_ticks(), d.students, d.menus, WORKFLOW_AS_OF)


def _delete_unapproved(d: Domain) -> DataFrame:
    tables = {"students": d.students, "cash_payments": d.cash_payments, "meal_attendance": d.meal_attendance}
    ids = d.students.filter(F.col("is_approved") == False).select("student_id")  # noqa: E712
    out, _ = W.delete_rows(tables, "students", ids)
    return out["cash_payments"]


def _delete_unavailable_menus(d: Domain) -> DataFrame:
    tables = {"menus": d.menus, "meal_attendance": d.meal_attendance}
    ids = d.menus.filter(F.col("is_available") == False).select("menu_id")  # noqa: E712
    _, blocked = W.delete_rows(tables, "menus", ids)
    return blocked


def _delete(d: Domain, table: str, every: int, child: str) -> DataFrame:
    """``child`` after deleting the rows of ``table`` whose key is divisible by ``every``."""
    tables = {n: getattr(d, n) for n in (table, child)}
    pk = f"{table.rstrip('s').replace('dormitorie', 'dormitory')}_id"
    ids = tables[table].filter(F.col(pk) % every == 0).select(pk)
    return W.delete_rows(tables, table, ids)[0][child]


def _form_violations(d: Domain) -> DataFrame:
    """F18, F19, C10 over registration forms: every number, password and required field that fails."""
    forms = Commands(d).registration_forms()
    numbers = ["year_of_study", "year_enrolled"]
    typed = Q.coerce_form_numbers(forms.select("*", *[F.col(c).alias(f"{c}_text") for c in numbers]), numbers)
    rules = [Q.form_number(f"{c}_text", c) for c in numbers] + Q.student_rules(
        typed, d.students, d.departments, d.dormitories, order_col="seq", ingest=True)
    return Q.violations(typed, rules, "seq").select("seq", "rule_id", "reason", "message")


def _form_numbers(d: Domain) -> DataFrame:
    """the numbers that the forms' text stands for."""
    forms = Commands(d).registration_forms().select("seq", "year_of_study", "year_enrolled")
    return Q.coerce_form_numbers(forms, ["year_of_study", "year_enrolled"])


def _with_defaults(d: Domain) -> DataFrame:
    """Payments given without amount and status, which are filled in."""
    given = d.cash_payments.select("payment_id", "student_id", "payment_month", "payment_year")
    return Q.apply_defaults(given, Q.table_defaults("cash_payments", WORKFLOW_AS_OF)).select(
        "payment_id", "student_id", "payment_month", "payment_year", "amount", "status")


def _audit_tampered(d: Domain) -> DataFrame:
    """Rows of the log that a version with changed and deleted rows no longer has."""
    new = d.audit_logs.filter(F.col("log_id") % 19 != 1).withColumn(
        "new_value", F.when(F.col("log_id") % 17 == 2, F.lit("edited")).otherwise(F.col("new_value")))
    return W.audit_changes(d.audit_logs, new)


def _portal(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: the portal of every seventh student, by key."""
    keys = d.students.filter(F.col("student_id") % 7 == 3).select("student_id")
    return R.student_portal(keys, d.students, d.departments, d.dormitories, d.cash_payments, d.meal_attendance, d.menus)


def _monthly(d: Domain) -> W.Result:
    return W.create_monthly_payments(d.cash_payments, d.students, _payments_clock(), WORKFLOW_ADMIN)


def _json_payments(d: Domain) -> DataFrame:
    """Payments with their student's number of payments, as JSON rows read back by key."""
    counted = d.cash_payments.groupBy("student_id").agg(F.count(F.lit(1)).alias("payments"))
    rows = d.cash_payments.select("payment_id", "student_id", "amount", "confirmed_by", "confirmed_at").join(counted, "student_id")
    kinds = "payment_id long, student_id long, amount string, payments string, confirmed_by long, confirmed_at string"
    text = to_json(rows)
    shown = text.select("json", F.from_json("json", kinds).alias("r"), F.json_object_keys("json").alias("k"))
    return shown.select("r.*", F.size("k").cast("long").alias("n_keys"))


def _stream_dashboard(d: Domain) -> DataFrame:
    """T1 + T2 run to completion over the events file as a stream source."""
    n_parts = d.raw("part").count()
    source = event_tick_stream(d.spark, f"{d.sf_dir.rstrip('/')}/events.parquet*", n_parts)
    _, dash, _ = run_tick_streams(d.spark, source)
    return read_dashboard(d.spark, dash)


def _stream_ticks(d: Domain) -> DataFrame:
    """T1 run to completion over the events file as a stream source: all of its ticks."""
    n_parts = d.raw("part").count()
    base = f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/ticks-{uuid.uuid4().hex}"
    source = event_tick_stream(d.spark, f"{d.sf_dir.rstrip('/')}/events.parquet*", n_parts)
    start_tick_ingest(source, f"{base}/ticks", f"{base}/marks").awaitTermination()
    return current_ticks(d.spark, f"{base}/ticks", f"{base}/marks")


_REGISTRY: dict[str, Callable[[Domain], DataFrame]] = {
    "r01_attendance_detail": lambda d: R.attendance_detail(d.meal_attendance, d.students, d.menus),
    "r02_payment_status": lambda d: R.payment_status(d.students, d.departments, d.cash_payments, PAYMENTS_AS_OF),
    "r03_menu_popularity": lambda d: R.menu_popularity(d.meal_attendance, d.menus),
    # every student has a payment: payments keyed by twice their student leave unmatched rows on both sides
    "r04_unmatched_payments": lambda d: R.unmatched_payments(
        d.students, d.cash_payments.withColumn("student_id", F.col("student_id") * 2)),
    "r05_department_summary_year": lambda d: R.department_summary_for_year(
        d.cash_payments, d.students, d.departments, PAYMENTS_AS_OF),
    "r06_department_summary": lambda d: R.department_summary(d.cash_payments, d.students, d.departments),
    "r07_unpaid_students": lambda d: R.unpaid_students(d.students, d.departments, d.cash_payments, PAYMENTS_AS_OF),
    "r08_daily_attendance": lambda d: R.daily_attendance(d.meal_attendance, ATTENDANCE_AS_OF),
    "r09_enrolment_summary": lambda d: R.enrolment_summary(d.students),
    "r10_payment_history": lambda d: R.payment_history(d.cash_payments, d.students, d.departments),
    "r11_list_departments": lambda d: R.list_departments(d.departments),
    "r12_list_dormitories": lambda d: R.list_dormitories(d.dormitories),
    "r13_available_menu": lambda d: R.available_menu(d.menus),
    "r14_pending_students": lambda d: R.pending_students(d.students, d.departments),
    "r15_approved_non_cafe": lambda d: R.approved_non_cafe(d.students),
    "r16_pending_payments": lambda d: R.pending_payments(d.cash_payments, d.students),
    "r17_sent_count": lambda d: R.sent_count(d.cash_payments),
    "r18_recent_audit": lambda d: R.recent_audit(d.audit_logs, 50),
    "r19_student_profiles": lambda d: R.student_profiles(d.students, d.departments, d.dormitories),
    "r20_student_payments": lambda d: R.student_payments(d.students, d.cash_payments),
    "r21_student_recent_meals": lambda d: R.student_recent_meals(d.students, d.meal_attendance, d.menus, 30),
    "r22_dashboard_kpis": lambda d: R.dashboard_kpis(d.students, d.cash_payments),
    "q1_dual_claims": lambda d: R.dual_claims(d.students, d.meal_attendance, d.cash_payments),
    "q1_dual_claims_shifted": lambda d: R.dual_claims(d.students, d.meal_attendance,
                                                      _shift_years(d.cash_payments, 26)),
    "v01_payment_tracker": lambda d: V.payment_tracker(R.student_payments(d.students, d.cash_payments)),
    "v02_audit_feed": lambda d: V.audit_feed(R.recent_audit(d.audit_logs, 50)),
    "v03_profile_card": lambda d: V.profile_card(R.student_profiles(d.students, d.departments, d.dormitories)),
    "v04_meal_feed": lambda d: V.meal_feed(R.student_recent_meals(d.students, d.meal_attendance, d.menus, 30)),
    "c01_payment_violations": _payment_violations,
    "c02_attendance_violations": _attendance_violations,
    "c03_student_violations": _student_violations,
    "c04_attendance_split_valid": lambda d: _attendance_split(d, 0),
    "c05_attendance_rejected": lambda d: _attendance_split(d, 1),
    "c06_faulty_students": _faulty_students,
    "c07_faulty_payments": _faulty_payments,
    "c08_faulty_ticks": _faulty_ticks,
    "c09_faulty_menus": _faulty_menus,
    "c10_faulty_audit_rows": _faulty_audit,
    "m01_register_students": lambda d: _register(d).changed,
    "m01_register_rejected": lambda d: _register(d).rejected.select("seq", "first_reason", "message"),
    "m02_approve_students": lambda d: _approve(d).changed,
    "m03_create_payments": lambda d: _create_payments(d).changed,
    "m03_create_payments_rejected": lambda d: _create_payments(d).rejected.select("seq", "first_reason",
                                                                                    "message"),
    "m04_monthly_payments": lambda d: W.create_monthly_payments(d.cash_payments, d.students, _payments_clock(),
                                                                WORKFLOW_ADMIN).changed,
    "m05_payment_commands": lambda d: _commands(d).table,
    "m05_payment_commands_rejected": lambda d: _commands(d).rejected.select("cmd_id", "payment_id", "kind",
                                                                             "message"),
    "m07_force_confirm": lambda d: W.force_payment_status(d.cash_payments, Commands(d).period_keys(), "CONFIRMED",
                                                          _payments_clock(), WORKFLOW_ADMIN).changed,
    "m07_force_sent": lambda d: W.force_payment_status(d.cash_payments, Commands(d).period_keys(), "SENT", _payments_clock(),
                                                       WORKFLOW_ADMIN).changed,
    "m08_record_ticks": lambda d: _ticks(d).changed,
    "m01_register_audit": lambda d: W.append_audit(d.audit_logs, _register(d).audit)[1],
    "m03_create_payments_audit": lambda d: W.append_audit(d.audit_logs, _create_payments(d).audit)[1],
    "m09_append_audit": lambda d: W.append_audit(d.audit_logs, _approve(d).audit)[1],
    "m11_stamp_last_login": lambda d: W.stamp_last_login(d.admins, Commands(d).admin_logins()).table,
    "m12_delete_students_cascade": _delete_unapproved,
    "m12_delete_students_ticks": lambda d: _delete(d, "students", 3, "meal_attendance"),
    "m12_delete_departments_set_null": lambda d: _delete(d, "departments", 5, "students"),
    "m12_delete_dormitories_set_null": lambda d: _delete(d, "dormitories", 4, "students"),
    "m12_delete_admins_set_null": lambda d: _delete(d, "admins", 3, "cash_payments"),
    "m12_delete_menus_restrict": _delete_unavailable_menus,
    "t01_stream_daily_dashboard": _stream_dashboard,
    "t02_stream_ticks": _stream_ticks,
    "c11_form_violations": _form_violations,
    "c12_form_numbers": _form_numbers,
    "c13_payment_defaults": _with_defaults,
    "m04_monthly_payments_audit": lambda d: W.append_audit(d.audit_logs, _monthly(d).audit)[1],
    "m05_payment_commands_audit": lambda d: W.append_audit(d.audit_logs, _commands(d).audit)[1],
    "m10_audit_tampered": _audit_tampered,
    "s03_portal_profiles": lambda d: _portal(d)[0],
    "s03_portal_payments": lambda d: _portal(d)[1],
    "s03_portal_meals": lambda d: _portal(d)[2],
    "s08_json_payments": _json_payments,
}


def entry(spark: SparkSession) -> DataFrame:
    """
    summary (two inner joins, filtered counts, exact decimal sum, sort)."""
    return queries()["r06_department_summary"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(build) for name, build in _REGISTRY.items()} | (_llm.QUERIES if _llm else {})


def oracle_sql() -> dict[str, str]:
    sql = oracle_queries.all_oracles()
    return {k: v for k, v in sql.items() if k in _REGISTRY} | (_llm.ORACLES if _llm else {})
