"""Enum ordering.

PostgreSQL sorts enum values by declaration order; alphabetical order is
wrong for meal types (BREAKFAST < DINNER < LUNCH) and payment statuses.
``enum_ordinal`` maps a label to its 1-based declaration position, NULL
for NULL and for labels outside the domain (so they sort with the NULLs,
like the ``CASE`` ordering of the daily dashboard).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stipendlens.schemas import MEAL_TYPES, PAYMENT_STATUSES, STUDENT_TYPES


def enum_ordinal(col: Column | str, domain: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(v) for v in domain]), c)
    return F.when(pos > 0, pos.cast("int"))


def meal_ordinal(col: Column | str = "meal_type") -> Column:
    return enum_ordinal(col, MEAL_TYPES)


def status_ordinal(col: Column | str = "status") -> Column:
    return enum_ordinal(col, PAYMENT_STATUSES)


def type_ordinal(col: Column | str = "student_type") -> Column:
    return enum_ordinal(col, STUDENT_TYPES)
