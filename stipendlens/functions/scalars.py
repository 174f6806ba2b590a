"""Scalar expressions behind the reports and presentation views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: month abbreviations and status labels of the portal -----
MONTH_ABBREVIATIONS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
                       "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
STATUS_LABELS = {"SENT": "Sent ✓", "CONFIRMED": "Confirmed"}
STATUS_LABEL_OTHERWISE = "Pending"
MISSING = "—"  # em dash shown for empty values
APPROVED_LABEL = "✅ Yes"
NOT_APPROVED_LABEL = "⏳ Pending"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def full_name(first: Column | str = "first_name", last: Column | str = "last_name") -> Column:
    """``first || ' ' || last``: NULL if either part is NULL (not concat_ws)."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def period_of(as_of: dt.date | dt.datetime) -> tuple[int, int]:
    """(month, year) of the clock as Python ints, so the filters are literals
    that Catalyst folds and that prune (payment_year, payment_month) partitions."""
    return as_of.month, as_of.year


def ntz_literal(value: dt.datetime | dt.date) -> Column:
    """A TIMESTAMP_NTZ literal with the same wall-clock value in every
    session and process time zone (a datetime literal would be shifted
    through the local and session zones)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def month_label(col: Column | str = "payment_month") -> Column:
    """1..12 -> Jan..Dec; anything else -> NULL (element_at would fail in ANSI mode)."""
    c = _c(col)
    arr = F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS])
    return F.when(c.between(1, 12), F.element_at(arr, c.cast("int")))


def status_label(col: Column | str = "status") -> Column:
    c = _c(col)
    out = None
    for k, v in STATUS_LABELS.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(STATUS_LABEL_OTHERWISE)


def first_non_empty(*cols: Column | str, default: str = MISSING) -> Column:
    """JavaScript ``a || b || '—'``: NULL and the empty string count as missing."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(default))


def dorm_label(name: Column | str = "dorm_name", block: Column | str = "block") -> Column:
    """``name (Block X)`` when the dormitory name is present, else the dash.
    A NULL block prints as ``null`` like JavaScript string interpolation."""
    n = _c(name)
    return (F.when(F.nullif(n, F.lit("")).isNotNull(),
                   F.concat(n, F.lit(" (Block "), F.coalesce(_c(block).cast("string"), F.lit("null")), F.lit(")")))
            .otherwise(MISSING))


def approval_label(col: Column | str = "is_approved") -> Column:
    return F.when(_c(col), APPROVED_LABEL).otherwise(NOT_APPROVED_LABEL)


def format_timestamp(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")


def format_date(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd")
