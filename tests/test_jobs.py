"""The spark-submit jobs end to end on sf0.001: load, bulk payments (run
twice: idempotent), a report to JSON."""

import json
import os
import tempfile

from stipendlens import jobs
from stipendlens.sources.tables import read_domain


def test_jobs_end_to_end(spark):
    root = tempfile.mkdtemp(prefix="lake-")
    jobs.main(["load", "--sf-dir", "/root/testdata/sf0.001", "--root", root], spark)
    before = read_domain(spark, root)["cash_payments"].count()
    first = jobs.main(["monthly-payments", "--root", root, "--as-of", "1998-06-15", "--admin", "1"], spark)
    again = jobs.main(["monthly-payments", "--root", root, "--as-of", "1998-06-15", "--admin", "1"], spark)
    t = read_domain(spark, root)
    # FIXTURES: 75 eligible students have no June 1998 record at sf0.001
    assert t["cash_payments"].count() == before + 75
    assert first["audit_appended"] == 1 and again["audit_appended"] == 1
    assert t["cash_payments"].filter("payment_month = 6 and payment_year = 1998 and status = 'PENDING'").count() >= 75
    out = os.path.join(root, "_r6")
    jobs.main(["report", "--root", root, "--name", "department_summary", "--out", out, "--format", "json"], spark)
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json") for x in open(os.path.join(out, f))]
    assert len(lines) == 25 and {"department_name", "total_amount"} <= set(lines[0])
