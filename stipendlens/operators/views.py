"""Presentation views (F11-F17): the labels the portals computed in the
browser, as columns over the report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendlens.functions.scalars import (approval_label, dorm_label, first_non_empty, format_date,
                                           format_timestamp, month_label, status_label)

MEAL_FALLBACK = "Meal"  # fixed value: label for a tick whose menu is gone


def payment_tracker(student_payments: DataFrame) -> DataFrame:
    """Student portal payment list: ``Jan 2026``-style period, amount and
    status label (unknown or NULL status reads ``Pending``)."""
    return student_payments.select(
        "payment_id", "student_id",
        F.concat(month_label("payment_month"), F.lit(" "), F.col("payment_year").cast("string")).alias("period"),
        "amount",
        status_label("status").alias("status_label"),
    )


def audit_feed(recent_audit: DataFrame) -> DataFrame:
    """Admin audit list: ``action → table``, time as ``yyyy-MM-dd HH:mm:ss``
    and the first non-empty of new value, old value, dash."""
    return recent_audit.select(
        "log_id",
        F.concat(F.col("action"), F.lit(" → "), F.col("target_table")).alias("headline"),
        format_timestamp("logged_at").alias("logged_at_text"),
        first_non_empty("new_value", "old_value").alias("detail"),
    )


def profile_card(student_profiles: DataFrame) -> DataFrame:
    """Student portal profile card over ``student_profiles``."""
    return student_profiles.select(
        "student_id",
        F.concat(F.lit("#"), F.col("student_id").cast("string")).alias("student_ref"),
        F.concat(F.coalesce(F.col("first_name"), F.lit("null")), F.lit(" "),
                 F.coalesce(F.col("last_name"), F.lit("null"))).alias("full_name"),
        "email",
        first_non_empty("department_name").alias("department"),
        "year_of_study", "year_enrolled", "student_type",
        first_non_empty("gender").alias("gender"),
        dorm_label("dorm_name", "block").alias("dormitory"),
        approval_label("is_approved").alias("approved"),
    )


def meal_feed(student_recent_meals: DataFrame) -> DataFrame:
    """Student portal meal list: meal type, item (``Meal`` when missing) and
    the day as ``yyyy-MM-dd``."""
    return student_recent_meals.select(
        "student_id", "meal_rank", "meal_type",
        first_non_empty("item_name", default=MEAL_FALLBACK).alias("item"),
        format_date("meal_date").alias("meal_day"),
    )


__all__ = ["payment_tracker", "audit_feed", "profile_card", "meal_feed"]
