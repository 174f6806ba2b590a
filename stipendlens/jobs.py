"""Batch jobs for ``spark-submit``: the library's operators wired to
storage. Every job reads one version of the domain tables under ``--root``,
writes only what changed (touched partitions, appended rows, audit rows),
publishes it as the next version and prints a one-line JSON summary. A job that
finds another version published meanwhile fails with ``ConcurrentCommit`` and
has changed nothing: run it again.

    zip -r stipendlens.zip stipendlens
    S="spark-submit --py-files stipendlens.zip stipendlens/jobs.py"
    $S load --sf-dir /data/sf1 --root /lake/stipend
    $S register --root /lake/stipend --requests /in/signups.parquet --as-of 2026-05-01
    $S approve --root /lake/stipend --commands /in/approvals.parquet
    $S create-payments --root /lake/stipend --requests /in/payments.parquet --as-of 2026-05-01
    $S monthly-payments --root /lake/stipend --as-of 2026-05-01 --admin 1
    $S payment-commands --root /lake/stipend --commands /in/cmds.parquet
    $S force-status --root /lake/stipend --commands /in/keys.parquet --status SENT --as-of 2026-05-01 --admin 1
    $S logins --root /lake/stipend --commands /in/logins.parquet
    $S delete --root /lake/stipend --table students --ids /in/ids.parquet
    $S vacuum --root /lake/stipend
    $S ticks --root /lake/stipend --ticks /in/ticks.parquet --as-of 2026-05-01
    $S report --root /lake/stipend --name department_summary --out /out/r6
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from stipendlens.operators import reports as R
from stipendlens.operators import workflows as W
from stipendlens.schemas import PRIMARY_KEYS
from stipendlens.sources.mapping import Domain
from stipendlens.sources.snapshots import vacuum
from stipendlens.sources.tables import commit_delete, commit_result, read_domain, write_domain, write_json

REPORTS = {
    "attendance_detail": lambda t, a: R.attendance_detail(t["meal_attendance"], t["students"], t["menus"]),
    "payment_status": lambda t, a: R.payment_status(t["students"], t["departments"], t["cash_payments"], a),
    "menu_popularity": lambda t, a: R.menu_popularity(t["meal_attendance"], t["menus"]),
    "unmatched_payments": lambda t, a: R.unmatched_payments(t["students"], t["cash_payments"]),
    "department_summary_for_year": lambda t, a: R.department_summary_for_year(
        t["cash_payments"], t["students"], t["departments"], a),
    "department_summary": lambda t, a: R.department_summary(t["cash_payments"], t["students"], t["departments"]),
    "unpaid_students": lambda t, a: R.unpaid_students(t["students"], t["departments"], t["cash_payments"], a),
    "daily_attendance": lambda t, a: R.daily_attendance(t["meal_attendance"], a),
    "enrolment_summary": lambda t, a: R.enrolment_summary(t["students"]),
    "payment_history": lambda t, a: R.payment_history(t["cash_payments"], t["students"], t["departments"]),
    "dual_claims": lambda t, a: R.dual_claims(t["students"], t["meal_attendance"], t["cash_payments"]),
    "list_departments": lambda t, a: R.list_departments(t["departments"]),
    "list_dormitories": lambda t, a: R.list_dormitories(t["dormitories"]),
    "available_menu": lambda t, a: R.available_menu(t["menus"]),
    "pending_students": lambda t, a: R.pending_students(t["students"], t["departments"]),
    "approved_non_cafe": lambda t, a: R.approved_non_cafe(t["students"]),
    "pending_payments": lambda t, a: R.pending_payments(t["cash_payments"], t["students"]),
    "sent_count": lambda t, a: R.sent_count(t["cash_payments"]),
    "recent_audit": lambda t, a: R.recent_audit(t["audit_logs"], 50),
    "student_profiles": lambda t, a: R.student_profiles(t["students"], t["departments"], t["dormitories"]),
    "student_payments": lambda t, a: R.student_payments(t["students"], t["cash_payments"]),
    "student_recent_meals": lambda t, a: R.student_recent_meals(t["students"], t["meal_attendance"], t["menus"], 30),
    "dashboard_kpis": lambda t, a: R.dashboard_kpis(t["students"], t["cash_payments"]),
}


#: Write jobs: the table they change and the workflow, from a snapshot and the arguments. Ids go on from the snapshot's.
WRITES = {
    "monthly-payments": ("cash_payments", lambda s, t, a: W.create_monthly_payments(
        t["cash_payments"], t["students"], a.as_of, a.admin, t.ids.get("cash_payments", 0))),
    "payment-commands": ("cash_payments", lambda s, t, a: W.apply_payment_commands(t["cash_payments"], s.read.parquet(a.commands))),
    "force-status": ("cash_payments", lambda s, t, a: W.force_payment_status(
        t["cash_payments"], s.read.parquet(a.commands), a.status, a.as_of, a.admin)),
    "register": ("students", lambda s, t, a: W.register_students(
        t["students"], s.read.parquet(a.requests), t["departments"], t["dormitories"], a.as_of, t.ids.get("students", 0))),
    "approve": ("students", lambda s, t, a: W.approve_students(t["students"], s.read.parquet(a.commands))),
    "logins": ("admins", lambda s, t, a: W.stamp_last_login(t["admins"], s.read.parquet(a.commands))),
    "create-payments": ("cash_payments", lambda s, t, a: W.create_payments(
        t["cash_payments"], s.read.parquet(a.requests), t["students"], a.as_of, t.ids.get("cash_payments", 0))),
    "ticks": ("meal_attendance", lambda s, t, a: W.record_ticks(
        t["meal_attendance"], s.read.parquet(a.ticks), t["students"], t["menus"], a.as_of, t.ids.get("meal_attendance", 0))),
}

#: Reports of one day, month or year.
DATED = ("payment_status", "department_summary_for_year", "unpaid_students", "daily_attendance")


def _date(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="stipendlens.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    p = sub.add_parser("load")
    p.add_argument("--sf-dir", required=True)
    p.add_argument("--root", required=True)
    inputs = {"monthly-payments": (), "payment-commands": ("commands",), "force-status": ("commands",), "register": ("requests",),
              "approve": ("commands",), "logins": ("commands",), "create-payments": ("requests",), "ticks": ("ticks",)}
    for job, files in inputs.items():
        p = sub.add_parser(job)
        p.add_argument("--root", required=True)
        for f in files:
            p.add_argument(f"--{f}", required=True)
        if job in ("monthly-payments", "force-status", "register", "create-payments", "ticks"):
            p.add_argument("--as-of", required=True, type=_date)
        if job in ("monthly-payments", "force-status"):
            p.add_argument("--admin", required=True, type=int)
        if job == "force-status":
            p.add_argument("--status", required=True, choices=["CONFIRMED", "SENT"])
    p = sub.add_parser("delete")
    p.add_argument("--root", required=True)
    p.add_argument("--table", required=True, choices=sorted(PRIMARY_KEYS))
    p.add_argument("--ids", required=True)
    p = sub.add_parser("vacuum")
    p.add_argument("--root", required=True)
    p.add_argument("--keep-versions", type=int, default=2)
    p.add_argument("--older-than", type=int, default=86_400)
    p = sub.add_parser("report")
    p.add_argument("--root", required=True)
    p.add_argument("--name", required=True, choices=sorted(REPORTS))
    p.add_argument("--as-of", type=_date, default=None)
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=["parquet", "json"], default="parquet")
    args = ap.parse_args(argv)
    if args.job == "report" and args.name in DATED and args.as_of is None:
        ap.error(f"report {args.name} needs --as-of")
    spark = spark or SparkSession.builder.appName(f"stipendlens-{args.job}").getOrCreate()

    if args.job == "load":
        d = Domain(spark, args.sf_dir)
        tables = {n: getattr(d, n) for n in ("departments", "dormitories", "students", "admins", "menus",
                                              "meal_attendance", "cash_payments", "audit_logs")}
        write_domain(tables, args.root)
        out = {"job": "load", "root": args.root}
    elif args.job == "vacuum":
        out = {"job": args.job, "removed": vacuum(spark, args.root, args.keep_versions, args.older_than)}
    elif args.job == "delete":
        ids = spark.read.parquet(args.ids)
        out = {"job": args.job, **commit_delete(spark, args.root, args.table, ids)}
    elif args.job in WRITES:
        t = read_domain(spark, args.root)
        name, run = WRITES[args.job]
        out = {"job": args.job, **commit_result(spark, args.root, name, run(spark, t, args), base=t)}
    else:
        t = read_domain(spark, args.root)
        df = REPORTS[args.name](t, args.as_of.date() if args.as_of else None)
        if args.format == "json":
            write_json(df, args.out)
        else:
            df.write.mode("overwrite").parquet(args.out)
        out = {"job": "report", "name": args.name, "out": args.out}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
