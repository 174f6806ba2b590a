"""Column-level helpers (built-in Spark expressions only, no UDFs)."""

from stipendlens.functions.enums import enum_ordinal, meal_ordinal, status_ordinal, type_ordinal
from stipendlens.functions.scalars import (
    approval_label,
    dorm_label,
    first_non_empty,
    format_date,
    format_timestamp,
    full_name,
    month_label,
    period_of,
    status_label,
)

__all__ = [
    "enum_ordinal", "meal_ordinal", "status_ordinal", "type_ordinal",
    "approval_label", "dorm_label", "first_non_empty", "format_date",
    "format_timestamp", "full_name", "month_label", "period_of", "status_label",
]
