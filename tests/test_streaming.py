"""T1 + T2 over micro-batches equal the batch rules M8 + R8 (no late data)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from stipendlens.operators import reports as R
from stipendlens.streaming import run_tick_streams
from stipendlens.streaming import ticks as S
from tests.conftest import rows


def _ticks(spark):
    base = dt.date(2026, 4, 10)
    data = []
    k = 0
    for day in range(4):
        for student in range(1, 8):
            for meal in ("BREAKFAST", "LUNCH", "DINNER"):
                if (student + day) % 3 == 0 and meal == "DINNER":
                    continue
                for dup in range(1 + (student % 2)):  # odd students tick twice
                    k += 1
                    data.append((k, student, 1 + k % 9, base + dt.timedelta(days=day), meal,
                                 dt.datetime(2026, 4, 10 + day, 7 + dup)))
    return spark.createDataFrame(data, "attendance_id long, student_id long, menu_id long, meal_date date, "
                                       "meal_type string, recorded_at timestamp_ntz")


def test_stream_equals_batch(spark):
    ticks = _ticks(spark)
    work = tempfile.mkdtemp(prefix="stream-test-")
    src = os.path.join(work, "in")
    # files arrive day by day, in order: one file per day, several micro-batches
    for day in sorted(r[0] for r in ticks.select("meal_date").distinct().collect()):
        ticks.filter(F.col("meal_date") == day).coalesce(1).write.mode("append").parquet(src)
    ticks_path, dash_path, marks = run_tick_streams(spark, src, os.path.join(work, "out"), max_files_per_trigger=1)
    streamed = S.current_ticks(spark, ticks_path, marks)
    assert streamed.count() == streamed.select("student_id", "meal_date", "meal_type").distinct().count()
    dash = S.read_dashboard(spark, dash_path)
    for day in sorted(r[0] for r in ticks.select("meal_date").distinct().collect()):
        want = rows(R.daily_attendance(ticks, day), "meal_type", "students_attended", "total_ticks")
        want = [(m, s, s) for m, s, _ in want]  # batch total counts raw ticks; after T1 one per student
        got = sorted(rows(dash.filter(F.col("meal_date") == day), "meal_type", "students_attended", "total_ticks"))
        assert got == sorted(want)


def test_late_tick_is_dropped_by_stream_but_kept_by_batch(spark, seed):
    from stipendlens.operators import workflows as W

    schema = ("attendance_id long, student_id long, menu_id long, meal_date date, meal_type string, "
              "recorded_at timestamp_ntz")
    work = tempfile.mkdtemp(prefix="stream-late-")
    src = os.path.join(work, "in")
    base = dt.date(2026, 4, 1)
    for i in range(5):  # days 1..5 arrive in order, one micro-batch each
        day = base + dt.timedelta(days=i)
        spark.createDataFrame([(i + 1, 1, 1, day, "LUNCH", dt.datetime.combine(day, dt.time(12)))], schema) \
            .coalesce(1).write.mode("append").parquet(src)
    # then a tick for day 1 (student 3) arrives: 4 days behind the latest day, beyond the 2-day watermark
    late_day = base
    spark.createDataFrame([(99, 3, 2, late_day, "LUNCH", dt.datetime(2026, 4, 6, 9))], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    ticks_path, _, marks = run_tick_streams(spark, src, os.path.join(work, "out"), max_files_per_trigger=1)
    streamed = S.current_ticks(spark, ticks_path, marks)
    assert streamed.filter("student_id = 3").count() == 0 and streamed.count() == 5
    late = S.late_ticks(spark.read.schema(S.TICK_SCHEMA).parquet(src), streamed)
    assert [r["attendance_id"] for r in late.collect()] == [99]
    # the batch rule has no time limit: the same tick is accepted
    late = spark.createDataFrame([(99, 3, 2, "LUNCH", late_day, dt.datetime(2026, 4, 6, 9))],
                                 "seq long, student_id long, menu_id long, meal_type string, meal_date date, "
                                 "recorded_at timestamp_ntz")
    r = W.record_ticks(seed["meal_attendance"], late, seed["students"], seed["menus"], dt.datetime(2026, 4, 6))
    assert r.changed.count() == 1


def _write(spark, src, data):
    spark.createDataFrame(data, S.TICK_SCHEMA).coalesce(1).write.mode("append").parquet(src)


def test_the_earliest_tick_wins_across_batches_restarts_and_the_watermark(spark):
    """A later file brings the earlier tick; the stream is stopped and started again; state goes with the watermark."""
    work = tempfile.mkdtemp(prefix="stream-first-")
    src, out = os.path.join(work, "in"), os.path.join(work, "out")
    day = lambda n: dt.date(2026, 4, n)
    at = lambda n, h: dt.datetime(2026, 4, n, h)
    _write(spark, src, [(1, 1, 5, day(1), "LUNCH", at(1, 13)), (2, 2, 5, day(1), "LUNCH", at(1, 13)), (3, 1, 5, day(2), "LUNCH", None)])
    _write(spark, src, [(4, 1, 6, day(1), "LUNCH", at(1, 12)), (5, 2, 6, day(1), "LUNCH", at(1, 13)), (6, 1, 6, day(2), "LUNCH", at(2, 9))])
    ticks, dash, marks = run_tick_streams(spark, src, out, max_files_per_trigger=1)
    first = {1: 4, 2: 2}  # earlier by time; at the same time the smaller id
    got = S.current_ticks(spark, ticks, marks).filter(F.col("meal_date") == day(1))
    assert {r["student_id"]: r["attendance_id"] for r in got.collect()} == first
    assert S.open_ticks(spark, marks).count() == 3, "no day is closed yet"
    # the query was stopped; it goes on from its checkpoint with later days, which close the first ones
    _write(spark, src, [(7, 1, 6, day(1), "LUNCH", at(1, 11))])
    for n in range(3, 9):
        _write(spark, src, [(10 + n, 1, 6, day(n), "LUNCH", at(n, 12))])
    run_tick_streams(spark, src, out, max_files_per_trigger=1)
    everything = S.current_ticks(spark, ticks, marks).collect()
    assert {(r["student_id"], r["meal_date"]): r["attendance_id"] for r in everything} == {
        (1, day(1)): 7, (2, day(1)): 2, (1, day(2)): 3, **{(1, day(n)): 10 + n for n in range(3, 9)}}
    assert S.open_ticks(spark, marks).count() <= 3, "state of closed days is gone"
    closed = spark.read.schema(S.TICK_SCHEMA).parquet(ticks)
    assert closed.filter(F.col("meal_date") == day(1)).count() == 2 and closed.count() == len(everything) - S.open_ticks(spark, marks).count()
    want = {(day(1), 2), (day(2), 1), *((day(n), 1) for n in range(3, 9))}
    assert {(r["meal_date"], r["students_attended"]) for r in S.read_dashboard(spark, dash).collect()} == want


def test_a_batch_changes_its_own_groups_of_the_dashboard_and_can_be_replayed(spark):
    work = tempfile.mkdtemp(prefix="stream-dash-")
    src, out = os.path.join(work, "in"), os.path.join(work, "out")
    rows_of = lambda n, meal, students: [(100 * n + s, s, 1, dt.date(2026, 4, n), meal, dt.datetime(2026, 4, n, 8)) for s in students]
    _write(spark, src, rows_of(1, "LUNCH", [1, 2]) + rows_of(1, "DINNER", [1]))
    _, dash, _ = run_tick_streams(spark, src, out)
    files = {r[0] for r in S.read_dashboard(spark, dash).select(F.input_file_name()).collect()}
    _write(spark, src, rows_of(1, "LUNCH", [2, 3]) + rows_of(2, "LUNCH", [9]))
    run_tick_streams(spark, src, out)
    board = S.read_dashboard(spark, dash)
    assert sorted(rows(board, "meal_date", "meal_type", "students_attended")) == [
        (dt.date(2026, 4, 1), "DINNER", 1), (dt.date(2026, 4, 1), "LUNCH", 3), (dt.date(2026, 4, 2), "LUNCH", 1)]
    kept = {r[0] for r in board.select(F.input_file_name()).collect()} & files
    assert len(kept) == 1 and "DINNER" in next(iter(kept)), "the unchanged group was not written again"


def test_the_dashboards_state_stays_bounded(spark):
    work = tempfile.mkdtemp(prefix="stream-bound-")
    src, out = os.path.join(work, "in"), os.path.join(work, "out")
    for n in range(1, 13):
        _write(spark, src, [(100 * n + s, s, 1, dt.date(2026, 4, n), "LUNCH", dt.datetime(2026, 4, n, 8)) for s in range(20)])
    q = S.start_dashboard(S.tick_stream(spark, src, 1), f"{out}/d", f"{out}/c")
    q.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert len(held) >= 12 and max(held) <= 5 * 21 and S.read_dashboard(spark, f"{out}/d").count() == 12
