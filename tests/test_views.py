"""Presentation views on the seed."""

from stipendlens.operators import reports as R
from stipendlens.operators import views as V
from tests.conftest import rows


def test_payment_tracker(seed):
    out = V.payment_tracker(R.student_payments(seed["students"], seed["cash_payments"]))
    assert rows(out, "student_id", "period", "status_label") == [
        (2, "Apr 2026", "Sent ✓"), (2, "Mar 2026", "Sent ✓"), (2, "Feb 2026", "Confirmed"),
        (4, "Apr 2026", "Pending"), (4, "Mar 2026", "Sent ✓")]


def test_audit_feed(seed):
    out = V.audit_feed(R.recent_audit(seed["audit_logs"], 50))
    assert rows(out, "headline", "logged_at_text", "detail")[0] == (
        "UPDATE → Cash_Payments", "2026-04-15 09:00:00", "Confirmed payment and marked as SENT")


def test_profile_card(spark, seed):
    prof = R.student_profiles(seed["students"], seed["departments"], seed["dormitories"])
    out = {r[0]: r[1:] for r in rows(V.profile_card(prof), "student_id", "student_ref", "full_name", "department",
                                     "dormitory", "approved")}
    assert out[2] == ("#2", "Hedda Mellow", "Electrical & Computer Engineering", "Dorm Block C (Block C)", "✅ Yes")
    assert out[5][-1] == "⏳ Pending"
    no_dorm = V.profile_card(prof.withColumn("dorm_name", prof["dorm_name"].substr(1, 0)).filter("student_id = 1"))
    assert rows(no_dorm, "dormitory") == [("—",)]


def test_meal_feed(spark, seed):
    menus = seed["menus"].filter("menu_id <> 4")  # Shiro Wot gone: the tick shows "Meal"
    meals = R.student_recent_meals(seed["students"], seed["meal_attendance"], menus, 30)
    assert rows(V.meal_feed(meals), "student_id", "meal_type", "item", "meal_day") == [
        (1, "BREAKFAST", "Kinche", "2026-04-15"), (1, "LUNCH", "Meal", "2026-04-15"),
        (3, "BREAKFAST", "Firfir", "2026-04-15")]
