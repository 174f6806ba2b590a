"""Data-quality rules (C1-C11) and split_valid properties."""

import datetime as dt

from pyspark.sql import functions as F

from stipendlens.operators import quality as Q
from tests.conftest import rows

REQ_SCHEMA = ("seq long, first_name string, last_name string, email string, password string, gender string, "
              "year_of_study int, year_enrolled int, student_type string, department_id long, dormitory_id long")


def _requests(spark):
    return spark.createDataFrame([
        (1, "Liya", "Haile", "liya@example.org", "Passw0rdX", "Female", 1, 2026, "CAFE", 1, 1),       # ok
        (2, "Dup", "Email", "hedda@example.org", "Passw0rdX", "Female", 1, 2026, "CAFE", 1, 1),       # stored email
        (3, "Weak", "Pw", "weak@example.org", "password", "Male", 1, 2026, "CAFE", 1, 1),            # pattern
        (4, "No", "Mail", "", "Passw0rdX", "Male", 1, 2026, "CAFE", 1, 1),                          # required
        (5, "Bad", "Year", "year@example.org", "Passw0rdX", "Male", 9, 2026, "CAFE", 1, 1),          # check
        (6, "Bad", "Dept", "dept@example.org", "Passw0rdX", "Male", 1, 2026, "CAFE", 77, 1),         # fk
        (7, "Twin", "One", "twin@example.org", "Passw0rdX", "Male", 1, 2026, "NON_CAFE", None, None),  # first wins
        (8, "Twin", "Two", "twin@example.org", "Passw0rdX", "Male", 1, 2026, "NON_CAFE", None, None),  # dup in batch
        (9, "Bad", "Type", "type@example.org", "Passw0rdX", "Robot", 1, 2026, "STAFF", 1, 1),         # enum x2
        (10, None, "Nofirst", "nof@example.org", "Passw0rdX", "Male", None, 2026, "CAFE", 1, 1),      # not null
    ], REQ_SCHEMA)


def test_split_valid_reasons(spark, seed):
    req = _requests(spark)
    rules = Q.student_rules(req, seed["students"], seed["departments"], seed["dormitories"], order_col="seq",
                            ingest=True)
    valid, rejected = Q.split_valid(req, rules, "seq")
    assert sorted(r[0] for r in rows(valid, "seq")) == [1, 7]
    got = {r[0]: (r[1], r[2]) for r in rows(rejected, "seq", "first_reason", "message")}
    assert got == {
        2: ("UNIQUE", "Email already registered."),
        3: ("PATTERN", Q.STRONG_PASSWORD_MESSAGE),
        4: ("REQUIRED", Q.REQUIRED_MESSAGE),
        5: ("CHECK", Q.CHECK_MESSAGE),
        6: ("FK", Q.FK_MESSAGE),
        8: ("UNIQUE", "Email already registered."),
        9: ("DOMAIN", 'invalid input value for enum gender_enum: "Robot"'),
        10: ("NOT_NULL", 'null value in column "first_name" violates not-null constraint'),
    }
    all9 = rows(rejected.filter("seq = 9"), "rule_ids")[0][0]
    assert all9 == ["domain:gender", "domain:student_type"]
    # every input row lands in exactly one side
    assert valid.count() + rejected.count() == req.count()
    assert valid.join(rejected, "seq").count() == 0


def test_payment_rules_messages(spark, seed):
    p = spark.createDataFrame([
        (1, 2, 3000.0, 4, 2026), (2, 2, 3000.0, 5, 2026), (3, 2, 3000.0, 5, 2026), (4, 99, 3000.0, 6, 2026),
        (5, 4, -1.0, 13, 2026)], "seq long, student_id long, amount double, payment_month int, payment_year int")
    p = p.withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    rules = Q.payment_rules(p, seed["cash_payments"], seed["students"], order_col="seq")
    v = {(r[0], r[1]) for r in rows(Q.violations(p, rules, "seq"), "seq", "rule_id")}
    assert v == {(1, "unique:one_payment_per_month"), (3, "unique:one_payment_per_month"),
                 (4, "fk:student_id"), (5, "check:amount_positive"), (5, "check:payment_month")}
    msg = rows(Q.violations(p, rules, "seq").filter("seq = 1"), "message")[0][0]
    assert msg == "Payment already exists for this student/month."


def test_null_keys_never_collide(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "seq long, email string")
    v = rows(Q.violations(df, [Q.unique("email", order_col="seq")], "seq"), "seq", "message")
    assert v == [(4, "Duplicate data is not allowed.")]


def test_check_null_passes(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 5)], "k long, total_rooms int")
    assert rows(Q.violations(df, Q.dormitory_rules(df), "k"), "k") == [(2,)]


def test_defaults_only_for_missing_columns(spark):
    df = spark.createDataFrame([(1, None)], "student_id long, is_approved boolean")
    out = Q.apply_defaults(df, Q.table_defaults("students", dt.datetime(2026, 4, 15)))
    r = out.collect()[0]
    assert r["is_approved"] is None and r["created_at"] == dt.datetime(2026, 4, 15)


def test_assign_ids_after_stored_max(spark, seed):
    new = spark.createDataFrame([(3,), (1,), (2,)], "seq long")
    got = sorted(rows(Q.assign_ids(new, "student_id", seed["students"], "seq"), "seq", "student_id"))
    assert got == [(1, 6), (2, 7), (3, 8)]


def test_failed_row_cannot_win_a_key(spark, seed):
    # row 1 fails the FK, so row 2 is the one stored; row 3 then collides
    t = spark.createDataFrame([(1, 1, 99, "LUNCH"), (2, 1, 4, "LUNCH"), (3, 1, 5, "LUNCH")],
                              "seq long, student_id long, menu_id long, meal_type string")
    t = t.withColumn("meal_date", F.lit(dt.date(2026, 5, 1)))
    rules = Q.attendance_rules(t, seed["meal_attendance"], seed["students"], seed["menus"], order_col="seq")
    valid, rejected = Q.split_valid(t, rules, "seq")
    assert rows(valid, "seq") == [(2,)]
    assert sorted(rows(rejected, "seq", "first_reason")) == [(1, "FK"), (3, "UNIQUE")]


def test_form_number_coercion_and_castable(spark):
    df = spark.createDataFrame([(1, "3"), (2, ""), (3, "abc"), (4, None), (5, " 2 ")], "seq long, year_of_study string")
    assert rows(Q.coerce_form_numbers(df, ["year_of_study"]), "seq", "year_of_study") == [
        (1, 3), (2, 0), (3, None), (4, None), (5, 2)]
    v = rows(Q.violations(df, [Q.castable("year_of_study", "int")], "seq"), "seq", "message")
    assert sorted(v) == [(2, 'invalid input syntax for type int: ""'), (3, 'invalid input syntax for type int: "abc"')]


def _pk_rules(df):
    return [Q.unique("id", name="t_pkey"), *Q.not_null("id")]


def test_primary_key_duplicates_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "d"), (3, "d"), (None, "e"), (None, "f")], "id long, x string")
    got = sorted((r["id"] or 0, r["rule_id"]) for r in Q.violations(df, _pk_rules(df), "id").collect())
    assert got == [(0, "not_null:id")] * 2 + [(1, "unique:t_pkey")] + [(3, "unique:t_pkey")] * 2
    valid, rejected = Q.split_valid(df, _pk_rules(df), "id")
    assert sorted(r["id"] for r in valid.collect()) == [1, 2, 3]
    assert valid.count() + rejected.count() == 8


def test_null_order_values_come_first_and_still_collide(spark):
    df = spark.createDataFrame([(1, "k", None), (2, "k", None), (3, "k", 5), (4, None, None)], "id long, k string, o long")
    got = [r["id"] for r in Q.violations(df, [Q.unique("k", name="k_key", order_col="o")], "id").collect()]
    assert sorted(got) == [2, 3]


def test_form_numbers_never_fail_the_batch(spark):
    texts = ["3", " 4 ", "", None, "abc", "NaN", "1e30", "1d", "2.9", "-1e2", "0x10", "Infinity"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, n string")
    got = {r["i"]: r["n"] for r in Q.coerce_form_numbers(df, ["n"]).collect()}
    assert [got[i] for i in range(len(texts))] == [3, 4, 0, None, None, None, None, None, 2, -100, None, None]
    bad = {r["i"] for r in Q.violations(df, [Q.form_number("n", "n")], "i").collect()}
    assert bad == {4, 5, 6, 7, 10, 11}


def test_every_rule_fires_on_the_faulty_tables(spark):
    import __spark_entry__ as E

    fired = {}
    for name in ("c06_faulty_students", "c07_faulty_payments", "c08_faulty_ticks", "c09_faulty_menus", "c10_faulty_audit_rows"):
        got = E.queries()[name](spark, "/root/testdata/sf0.01")
        fired[name] = {r["rule_id"] for r in got.select("rule_id").distinct().collect()}
    assert fired["c06_faulty_students"] >= {
        "domain:gender", "domain:student_type", "length:first_name", "not_null:student_id", "not_null:email", "not_null:student_type",
        "check:year_of_study", "fk:department_id", "fk:dormitory_id", "unique:students_email_key", "unique:students_pkey"}
    assert fired["c07_faulty_payments"] >= {
        "domain:status", "not_null:payment_year", "check:amount_positive", "check:payment_month", "fk:student_id", "fk:confirmed_by",
        "unique:cash_payments_pkey"}
    assert fired["c08_faulty_ticks"] >= {"domain:meal_type", "not_null:meal_date", "fk:student_id", "fk:menu_id", "unique:meal_attendance_pkey"}
    assert fired["c09_faulty_menus"] >= {"length:item_name", "not_null:item_name", "domain:meal_type", "check:price_non_negative", "unique:menus_pkey"}
    assert fired["c10_faulty_audit_rows"] >= {"check:actor_type_in", "check:action_in", "length:target_table", "unique:audit_logs_pkey"}
