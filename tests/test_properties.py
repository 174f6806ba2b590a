"""Hypothesis properties (few examples each: every example runs Spark jobs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stipendlens.operators import quality as Q
from stipendlens.operators import workflows as W
from stipendlens.plans.ranking import rank_within

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

rank_rows = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(0, 6))),
                     min_size=1, max_size=40)


@SETTINGS
@given(data=rank_rows, descending=st.booleans(), buckets=st.integers(1, 5))
def test_rank_within_equals_window_rank(spark, data, descending, buckets):
    df = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(data)], "id long, p int, v int")
    order = F.col("v").desc_nulls_first() if descending else F.col("v").asc_nulls_last()
    want = df.withColumn("r", F.rank().over(Window.partitionBy("p").orderBy(order)).cast("long"))
    got = rank_within(df, "v", by=["p"], descending=descending, out="r", buckets=buckets)
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, want.select("id", "r").collect()))


tick_rows = st.lists(st.tuples(st.integers(1, 4), st.integers(0, 10), st.sampled_from(["BREAKFAST", "LUNCH", "X"]),
                               st.integers(0, 2)), min_size=1, max_size=30)


@SETTINGS
@given(data=tick_rows)
def test_split_valid_partitions_the_batch(spark, seed, data):
    day = dt.date(2026, 5, 1)
    t = spark.createDataFrame([(i, s, m, meal, day + dt.timedelta(days=dd)) for i, (s, m, meal, dd) in enumerate(data)],
                              "seq long, student_id long, menu_id long, meal_type string, meal_date date")
    rules = Q.attendance_rules(t, seed["meal_attendance"], seed["students"], seed["menus"], order_col="seq")
    valid, rejected = Q.split_valid(t, rules, "seq")
    v = {r[0] for r in valid.select("seq").collect()}
    rj = {r[0] for r in rejected.select("seq").collect()}
    assert v.isdisjoint(rj) and v | rj == set(range(len(data)))
    # valid rows are unique per key and reference existing students and menus
    keys = [tuple(r) for r in valid.select("student_id", "meal_date", "meal_type").collect()]
    assert len(keys) == len(set(keys))
    assert all(1 <= r[0] <= 5 and 1 <= r[1] <= 9 for r in valid.select("student_id", "menu_id").collect())


cmd_rows = st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["confirm", "send"]), st.integers(0, 20)),
                    min_size=1, max_size=25)


@SETTINGS
@given(statuses=st.lists(st.sampled_from(["PENDING", "CONFIRMED", "SENT", None]), min_size=5, max_size=5),
       cmds=cmd_rows)
def test_fold_equals_sequential(spark, statuses, cmds):
    pays = spark.createDataFrame(
        [(i + 1, i + 1, 1, 2026, s) for i, s in enumerate(statuses)],
        "payment_id long, student_id long, payment_month int, payment_year int, status string",
    ).withColumn("amount", F.lit("3000.00").cast("decimal(10,2)")).withColumn(
        "confirmed_by", F.lit(None).cast("long")).withColumn("confirmed_at", F.lit(None).cast("timestamp_ntz")).withColumn(
        "sent_at", F.lit(None).cast("timestamp_ntz"))
    base = dt.datetime(2026, 4, 1)
    rows_ = [(k + 1, pid, kind, 1, base + dt.timedelta(minutes=m)) for k, (pid, kind, m) in enumerate(cmds)]
    c = spark.createDataFrame(rows_, "cmd_id long, payment_id long, kind string, admin_id long, ts timestamp_ntz")
    res = W.apply_payment_commands(pays, c)
    state = {i + 1: s for i, s in enumerate(statuses)}
    accepted = set()
    for cmd_id, pid, kind, _, ts in sorted(rows_, key=lambda r: (r[4], r[0])):
        cur = state.get(pid, "MISSING")
        if kind == "confirm" and cur == "PENDING":
            state[pid] = "CONFIRMED"
            accepted.add(cmd_id)
        elif kind == "send" and cur in ("PENDING", "CONFIRMED"):
            state[pid] = "SENT"
            accepted.add(cmd_id)
    got = {r[0]: r[1] for r in res.table.select("payment_id", "status").collect()}
    assert got == {k: v for k, v in state.items() if k in got}
    assert {r[0] for r in res.audit.select("audit_seq").collect()} == accepted
    assert res.audit.count() + res.rejected.count() == len(rows_)
