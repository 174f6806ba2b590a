"""Integrity rules as data-quality operators.

A rule set is evaluated over a batch of rows identified by ``key`` (an
input sequence number or the primary key) and produces one violation row
per failing (row, rule): ``key..., rule_id, reason, message``.

* Row-local rules (required, pattern, domain, length, NOT NULL, CHECK) are
  one projection: an array of optional violation structs, exploded. No
  shuffle.
* UNIQUE is an aggregate of the first sequence number per key (combined
  map-side, so a key held by a third of the batch is one row per task)
  joined back, plus a semi join against the distinct keys already stored.
  NULL in a key column never collides (SQL semantics). Within a batch the
  lowest sequence number wins, like row-by-row inserts.
* FOREIGN KEY is an anti join against the referenced primary keys; NULL
  references pass. No aggregate stands between its shuffle and the join, so
  AQE can split a hot referencing key.

``split_valid`` partitions a batch into valid rows and rejected rows with
the first failing reason in PostgreSQL's order (input type / enum, NOT
NULL, CHECK, UNIQUE, FK), the message the API would have answered, and
the ids of all failing rules.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipendlens.functions.scalars import ntz_literal
from stipendlens.plans.joins import present_keys
from stipendlens.plans.lineage import cut_lineage
from stipendlens.plans.ranking import dense_ids
from stipendlens.schemas import (ACTOR_TYPES, ADMIN_ROLES, AUDIT_ACTIONS, GENDERS, MAX_LENGTHS, MEAL_TYPES,
                                 PAYMENT_STATUSES, PRIMARY_KEYS, STUDENT_TYPES, TABLES)

# --- fixed values: failure order and API messages ---------------------------
REASON_ORDER = ("REQUIRED", "PATTERN", "DOMAIN", "LENGTH", "NOT_NULL", "CHECK", "UNIQUE", "FK")
UNIQUE_MESSAGES = {
    "students_email_key": "Email already registered.",
    "one_payment_per_month": "Payment already exists for this student/month.",
}
UNIQUE_MESSAGE_OTHERWISE = "Duplicate data is not allowed."
FK_MESSAGE = "Referenced record does not exist."
CHECK_MESSAGE = "Submitted values do not meet required rules."
REQUIRED_MESSAGE = "Email and password are required"
STRONG_PASSWORD_MESSAGE = "Password must be 8+ chars with uppercase, lowercase, and number."
STRONG_PASSWORD = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d).{8,}$"

VIOLATION_FIELDS = ["rule_id", "reason", "message"]


@dataclass(frozen=True, eq=False)
class Rule:
    rule_id: str
    reason: str
    fails: Column | None = None          # row-local rules: TRUE when the row violates
    message: Column | str | None = None
    cols: tuple[str, ...] = ()
    ref: DataFrame | None = field(default=None, compare=False)
    ref_cols: tuple[str, ...] = ()
    existing: DataFrame | None = field(default=None, compare=False)
    order_col: str | tuple[str, ...] | None = None

    def message_col(self) -> Column:
        m = self.message
        if m is None:
            return F.lit(None).cast("string")
        return F.lit(m) if isinstance(m, str) else m


# ------------------------------------------------------------------ builders
def not_null(*cols: str) -> list[Rule]:
    return [Rule(f"not_null:{c}", "NOT_NULL", F.col(c).isNull(),
                 f'null value in column "{c}" violates not-null constraint', (c,)) for c in cols]


def check(rule_id: str, cond: Column, cols: Sequence[str] = ()) -> Rule:
    """CHECK (cond): only FALSE violates; NULL passes as in SQL. ``cols``
    names the columns ``cond`` reads (the rule is skipped without them)."""
    return Rule(f"check:{rule_id}", "CHECK", cond == False, CHECK_MESSAGE, tuple(cols))  # noqa: E712


def in_domain(col: str, values: Iterable[str], type_name: str | None = None) -> Rule:
    values = list(values)
    msg = F.concat(F.lit(f"invalid input value for enum {type_name or col}: \""), F.col(col).cast("string"),
                   F.lit("\""))
    return Rule(f"domain:{col}", "DOMAIN", F.col(col).isNotNull() & ~F.col(col).isin(*values), msg, (col,))


def check_in(col: str, values: Iterable[str]) -> Rule:
    """A CHECK (col IN (...)) constraint (not an enum type)."""
    return check(f"{col}_in", F.col(col).isin(*list(values)), (col,))


def max_length(col: str, n: int) -> Rule:
    return Rule(f"length:{col}", "LENGTH", F.length(F.col(col)) > n,
                f"value too long for type character varying({n})", (col,))


def required(*cols: str, message: str = REQUIRED_MESSAGE) -> list[Rule]:
    """Ingest check: missing or empty values (JavaScript falsiness of text)."""
    return [Rule(f"required:{c}", "REQUIRED",
                 F.col(c).isNull() | (F.col(c).cast("string") == ""), message, (c,)) for c in cols]


def matches(col: str, regex: str, message: str) -> Rule:
    """Ingest check: present values must match ``regex`` (Java regex; look-aheads work)."""
    return Rule(f"pattern:{col}", "PATTERN", F.col(col).isNotNull() & ~F.col(col).rlike(regex), message, (col,))


def castable(col: str, sql_type: str) -> Rule:
    """Input-syntax rule for text columns bound to a typed column: a present
    value that does not parse (``try_cast`` gives NULL) is a violation."""
    c = F.col(col)
    bad = c.isNotNull() & F.expr(f"try_cast(`{col}` AS {sql_type})").isNull()
    msg = F.concat(F.lit(f"invalid input syntax for type {sql_type}: \""), c.cast("string"), F.lit("\""))
    return Rule(f"type:{col}", "DOMAIN", bad, msg, (col,))


FORM_NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?\s*$"


def _form_bigint(name: str) -> Column:
    """bigint of form text, NULL where it is no number or out of range."""
    number = F.when(F.col(name).cast("string").rlike(FORM_NUMBER), F.trim(F.col(name).cast("string"))).try_cast("double")
    return F.when(F.abs(number) < 9.2e18, number).cast("long")


def form_number(text: str, name: str) -> Rule:
    """Present form text that is not a number in range (blank counts as 0)."""
    c = F.col(text)
    bad = c.isNotNull() & (F.trim(c) != "") & _form_bigint(text).isNull()
    return Rule(f"type:{name}", "DOMAIN", bad, F.concat(F.lit('invalid input syntax for type integer: "'), c, F.lit('"')), (text,))


def coerce_form_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text form fields to numbers the way the registration page did it
    (``Number(text)``): blank text becomes 0, text that is not a number
    (or is out of bigint range) becomes NULL, numbers keep their value.
    Results are bigint; fractional input is cut toward zero."""
    out = df
    for name in cols:
        t = F.trim(F.col(name).cast("string"))
        out = out.withColumn(name, F.when(F.col(name).isNull(), F.lit(None))
                             .when(t == "", F.lit(0))
                             .otherwise(_form_bigint(name)).cast("long"))
    return out


def unique(*cols: str, name: str | None = None, existing: DataFrame | None = None,
           order_col: str | Sequence[str] | None = None) -> Rule:
    """UNIQUE over ``cols``; within the batch the row first in ``order_col``
    order (one column or several, compared left to right) keeps the key."""
    name = name or "_".join(cols) + "_key"
    if order_col is not None and not isinstance(order_col, str):
        order_col = tuple(order_col)
    return Rule(f"unique:{name}", "UNIQUE", None, UNIQUE_MESSAGES.get(name, UNIQUE_MESSAGE_OTHERWISE),
                tuple(cols), existing=existing, order_col=order_col)


def foreign_key(col: str, ref: DataFrame, ref_col: str) -> Rule:
    return Rule(f"fk:{col}", "FK", None, FK_MESSAGE, (col,), ref=ref, ref_cols=(ref_col,))


# ----------------------------------------------------------------- evaluation
def _violation_struct(r: Rule) -> Column:
    return F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.reason).alias("reason"),
                    r.message_col().alias("message"))


def _row_local(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame | None:
    local = [r for r in rules if r.fails is not None]
    if not local:
        return None
    fails = [F.coalesce(r.fails, F.lit(False)) for r in local]
    any_fail = fails[0]
    for f in fails[1:]:
        any_fail = any_fail | f
    # valid rows (the bulk) are dropped before any per-row array is built
    arr = F.array(*[F.when(f, _violation_struct(r)) for f, r in zip(fails, local)])
    v = df.filter(any_fail).select(*key, F.filter(arr, lambda x: x.isNotNull()).alias("__v"))
    return v.select(*key, F.explode("__v").alias("__v")).select(*key, *[F.col(f"__v.{c}").alias(c)
                                                                        for c in VIOLATION_FIELDS])


def _tag(df: DataFrame, r: Rule, key: Sequence[str]) -> DataFrame:
    return df.select(*key, F.lit(r.rule_id).alias("rule_id"), F.lit(r.reason).alias("reason"),
                     r.message_col().alias("message"))


def _present(df: DataFrame, r: Rule) -> DataFrame:
    """Rows whose key columns are all present (NULL never collides)."""
    out = df
    for c in r.cols:
        out = out.filter(F.col(c).isNotNull())
    return out


def _order_expr(r: Rule, key: Sequence[str]) -> Column:
    order = r.order_col or key[0]
    return F.col(order) if isinstance(order, str) else F.struct(*[F.col(c) for c in order])


def _unique_stored(df: DataFrame, r: Rule, key: Sequence[str]) -> DataFrame | None:
    if r.existing is None:
        return None
    present = _present(df, r)
    return _tag(present.join(present_keys(r.existing, r.cols), list(r.cols), "left_semi"), r, key)


def _unique_in_batch(df: DataFrame, failing: DataFrame | None, r: Rule, key: Sequence[str]) -> DataFrame:
    """Rows inserted one by one: the first row of a key that passes every
    other rule is stored, every later row with that key collides. Rows that
    fail some other rule are never stored, so they cannot win a key.

    Rows are counted per (key columns, order, row key), combined map-side,
    so rows that nothing tells apart (a primary key given twice) are one
    counted row: the winner's group loses all but one, every later group all
    of its rows. NULL orders come first. Only keys that occur more than once
    are joined back."""
    cols = list(r.cols)
    present = _present(df, r).withColumn("__ord", _order_expr(r, key))
    if failing is not None:
        bad = failing.select(*[F.col(k).alias(f"__bad_{k}") for k in key], F.lit(True).alias("__bad"))
        same = [F.col(k).eqNullSafe(F.col(f"__bad_{k}")) for k in key]
        present = present.join(bad, same, "left").drop(*[f"__bad_{k}" for k in key])
        clean = F.col("__bad").isNull()
    else:
        clean = F.lit(True)
    rest = [k for k in key if k not in cols]
    place = F.struct(F.col("__ord").alias("o"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(rest)])
    present = present.withColumn("__place", place).withColumn("__clean", clean)
    groups = present.groupBy(*cols, *rest, "__place", "__clean").agg(F.count(F.lit(1)).alias("__n"))
    dup = (groups.groupBy(*cols)
           .agg(F.sum("__n").alias("__rows"), F.min(F.when(F.col("__clean"), F.col("__place"))).alias("__first"))
           .filter((F.col("__rows") > 1) & F.col("__first").isNotNull())
           .drop("__rows"))
    # cut here: with the aggregate between shuffle and join, AQE could not split a hot key's rows
    dup = cut_lineage(dup)
    later = groups.join(dup, cols, "inner").filter(F.col("__place") >= F.col("__first"))
    losers = F.col("__n") - F.when(F.col("__place") == F.col("__first"), 1).otherwise(0)
    later = later.withColumn("__times", losers).filter(F.col("__times") > 0)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))
    return _tag(later.withColumn("__copy", each), r, key)


def _foreign_key(df: DataFrame, r: Rule, key: Sequence[str]) -> DataFrame:
    c, rc = r.cols[0], r.ref_cols[0]
    refs = present_keys(r.ref, [rc]).withColumnRenamed(rc, c)
    missing = df.filter(F.col(c).isNotNull()).join(refs, c, "left_anti")
    return _tag(missing, r, key)


def violations(df: DataFrame, rules: Sequence[Rule], key: Sequence[str] | str,
               materialize: bool = True) -> DataFrame:
    """All (row, rule) failures of ``df`` as ``key..., rule_id, reason, message``.
    ``key`` must identify a row of the batch (duplicate keys merge rows).

    Two phases: every rule except in-batch uniqueness first; then the
    in-batch UNIQUE test, whose key winners are the first rows (in
    ``order_col`` order) that passed phase one. Each phase-one rule is a
    narrow branch (key + the rule's columns). With ``materialize`` the
    phase-one violations - usually far fewer rows than the batch - are
    checkpointed once when in-batch rules need them, instead of re-running
    every branch."""
    key = [key] if isinstance(key, str) else list(key)
    rules = [r for r in rules if all(c in df.columns for c in r.cols)]
    parts = []
    local = _row_local(df, rules, key)
    if local is not None:
        parts.append(local)
    for r in rules:
        if r.reason == "UNIQUE":
            stored = _unique_stored(df, r, key)
            if stored is not None:
                parts.append(stored)
        elif r.reason == "FK":
            parts.append(_foreign_key(df, r, key))
    phase1 = None
    if parts:
        phase1 = parts[0]
        for p in parts[1:]:
            phase1 = phase1.unionByName(p)
    uniques = [r for r in rules if r.reason == "UNIQUE"]
    if not uniques:
        if phase1 is not None:
            return phase1
        schema = T.StructType([df.schema[k] for k in key] + [T.StructField(c, T.StringType()) for c in
                                                               VIOLATION_FIELDS])
        return df.sparkSession.createDataFrame([], schema)
    failing = None
    if phase1 is not None:
        if materialize:
            phase1 = cut_lineage(phase1)
        failing = phase1.select(*key).distinct()
    out = phase1
    for r in uniques:
        part = _unique_in_batch(df, failing, r, key)
        out = part if out is None else out.unionByName(part)
    return out


def _reason_rank(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in REASON_ORDER]), col)


def split_valid(df: DataFrame, rules: Sequence[Rule], key: Sequence[str] | str,
                materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: every input row lands in exactly one of them,
    also rows whose ``key`` is NULL or repeated: the batch is numbered and
    checkpointed, and verdicts are kept by that number; ``key`` only orders
    rows where a rule names no order.
    ``rejected`` adds ``first_reason``, ``first_rule``, ``message`` and
    ``rule_ids`` (all failing rules, at most one per rule).

    With ``materialize`` the per-row verdicts are checkpointed (reliably,
    under ``spark.checkpoint.dir``) so that several consumers - the valid
    rows, the rejected rows, id numbering, audit rows - do not re-run the
    joins and aggregates of the rules."""
    key = [key] if isinstance(key, str) else list(key)
    rules = [replace(r, order_col=r.order_col or key[0]) if r.reason == "UNIQUE" else r for r in rules]
    df, key = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id())), ["__row"]
    v = violations(df, rules, key, materialize)
    per_row = v.groupBy(*key).agg(
        F.min(F.struct(_reason_rank(F.col("reason")).alias("rk"), F.col("rule_id"), F.col("reason"),
                       F.col("message"))).alias("__first"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    per_row = per_row.select(*key, F.col("__first.reason").alias("first_reason"),
                             F.col("__first.rule_id").alias("first_rule"),
                             F.col("__first.message").alias("message"), "rule_ids")
    if materialize:
        per_row = cut_lineage(per_row)
    valid = df.join(per_row.select(*key), key, "left_anti")
    rejected = df.join(per_row, key, "inner")
    return valid.drop("__row"), rejected.drop("__row")


# ------------------------------------------------------------- C7 / C8 helpers
def apply_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Column defaults: applied only when the input has no such column; an
    explicit NULL stays NULL (as with an INSERT naming the column)."""
    out = df
    for name, value in defaults.items():
        if name not in df.columns:
            out = out.withColumn(name, value)
    return out


def assign_ids(df: DataFrame, id_col: str, existing: DataFrame | None, order_col: str, last_id: int | None = None) -> DataFrame:
    """Surrogate ids after ``last_id``, the stored high-water mark (by default
    the maximum of ``existing``; SERIAL: gaps are allowed but none are made):
    dense and deterministic in ``order_col`` order."""
    if last_id is not None:
        start = last_id
    else:
        start = existing.select(F.max(id_col)).scalar() if existing is not None else F.lit(0)
    return dense_ids(df, order_col, start, id_col)


def table_defaults(table: str, as_of: dt.datetime) -> dict[str, Column]:
    ts = ntz_literal(as_of)
    return {
        "students": {"is_approved": F.lit(False), "created_at": ts},
        "admins": {"role": F.lit("CAFE_MANAGER"), "is_active": F.lit(True)},
        "menus": {"is_available": F.lit(True)},
        "meal_attendance": {"meal_date": F.lit(as_of.date()), "recorded_at": ts},
        "cash_payments": {"amount": F.lit("3000.00").cast("decimal(10,2)"), "status": F.lit("PENDING")},
        "audit_logs": {"logged_at": ts},
    }.get(table, {})


# ------------------------------------------------------------- table rule sets
def _lengths(table: str, present: Sequence[str]) -> list[Rule]:
    return [max_length(c, n) for c, n in MAX_LENGTHS.get(table, {}).items() if c in present]


def _not_nulls(table: str, present: Sequence[str]) -> list[Rule]:
    return not_null(*[f.name for f in TABLES[table].fields if not f.nullable and f.name in present])


def _pkey(table: str, present: Sequence[str], existing: DataFrame | None, order_col: str | None = None) -> list[Rule]:
    """PRIMARY KEY uniqueness, where the rows carry the key."""
    pk = PRIMARY_KEYS[table]
    return [unique(pk, name=f"{table}_pkey", existing=existing, order_col=order_col)] if pk in present else []


def student_rules(df: DataFrame, existing: DataFrame | None, departments: DataFrame, dormitories: DataFrame,
                  order_col: str | None = None, ingest: bool = False) -> list[Rule]:
    cols = df.columns
    rules: list[Rule] = []
    if ingest:
        rules += required("email", "password")
        rules.append(matches("password", STRONG_PASSWORD, STRONG_PASSWORD_MESSAGE))
    rules += [in_domain("gender", GENDERS, "gender_enum"), in_domain("student_type", STUDENT_TYPES,
                                                                     "student_type_enum")]
    rules += _lengths("students", cols) + _not_nulls("students", cols)
    rules.append(check("year_of_study", F.col("year_of_study").between(1, 5), ["year_of_study"]))
    rules.append(unique("email", name="students_email_key", existing=existing, order_col=order_col))
    rules += _pkey("students", cols, existing, order_col)
    rules += [foreign_key("department_id", departments, "department_id"),
              foreign_key("dormitory_id", dormitories, "dormitory_id")]
    return rules


def payment_rules(df: DataFrame, existing: DataFrame | None, students: DataFrame, admins: DataFrame | None = None,
                  order_col: str | None = None) -> list[Rule]:
    cols = df.columns
    rules = [in_domain("status", PAYMENT_STATUSES, "payment_status_enum")] + _not_nulls("cash_payments", cols)
    rules += _pkey("cash_payments", cols, existing, order_col)
    rules += [check("amount_positive", F.col("amount") > 0, ["amount"]),
              check("payment_month", F.col("payment_month").between(1, 12), ["payment_month"]),
              unique("student_id", "payment_month", "payment_year", name="one_payment_per_month",
                     existing=existing, order_col=order_col),
              foreign_key("student_id", students, "student_id")]
    if admins is not None and "confirmed_by" in cols:
        rules.append(foreign_key("confirmed_by", admins, "admin_id"))
    return rules


def attendance_rules(df: DataFrame, existing: DataFrame | None, students: DataFrame, menus: DataFrame,
                     order_col: str | None = None) -> list[Rule]:
    cols = df.columns
    return ([in_domain("meal_type", MEAL_TYPES, "meal_type_enum")] + _not_nulls("meal_attendance", cols)
            + _pkey("meal_attendance", cols, existing, order_col)
            + [unique("student_id", "meal_date", "meal_type", name="one_tick_per_meal", existing=existing,
                      order_col=order_col),
               foreign_key("student_id", students, "student_id"),
               foreign_key("menu_id", menus, "menu_id")])


def department_rules(df: DataFrame, existing: DataFrame | None = None) -> list[Rule]:
    cols = df.columns
    return (_lengths("departments", cols) + _not_nulls("departments", cols) + _pkey("departments", cols, existing)
            + [unique("department_name", name="departments_department_name_key", existing=existing)])


def dormitory_rules(df: DataFrame, existing: DataFrame | None = None) -> list[Rule]:
    cols = df.columns
    return ([in_domain("gender_type", GENDERS, "gender_enum")] + _lengths("dormitories", cols)
            + _not_nulls("dormitories", cols) + _pkey("dormitories", cols, existing)
            + [check("total_rooms_positive", F.col("total_rooms") > 0, ["total_rooms"])])


def admin_rules(df: DataFrame, existing: DataFrame | None = None) -> list[Rule]:
    cols = df.columns
    return ([in_domain("role", ADMIN_ROLES, "admin_role_enum")] + _lengths("admins", cols)
            + _not_nulls("admins", cols) + _pkey("admins", cols, existing) + [unique("email", name="admins_email_key", existing=existing)])


def menu_rules(df: DataFrame, existing: DataFrame | None = None) -> list[Rule]:
    cols = df.columns
    return ([in_domain("meal_type", MEAL_TYPES, "meal_type_enum")] + _lengths("menus", cols)
            + _not_nulls("menus", cols) + _pkey("menus", cols, existing) + [check("price_non_negative", F.col("price") >= 0, ["price"])])


def audit_rules(df: DataFrame, existing: DataFrame | None = None) -> list[Rule]:
    cols = df.columns
    return ([check_in("actor_type", ACTOR_TYPES), check_in("action", AUDIT_ACTIONS)]
            + _lengths("audit_logs", cols) + _not_nulls("audit_logs", cols) + _pkey("audit_logs", cols, existing))
