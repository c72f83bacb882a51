"""Recurrences: the calendar examples of the reference, worked by hand."""

import datetime as dt

from recordchecks.operators.recurrence import coverage, occurrences, schedule_findings

SCHEMA = ("schedule_id bigint, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz, "
          "weekday int, day_of_month int, day_of_quarter int, hh int, mm int, duration_min int, "
          "quarter_months array<int>")
T = dt.datetime


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = occurrences(df).orderBy("schedule_id", "occ_no").collect()
    res = {}
    for r in out:
        res.setdefault(r.schedule_id, []).append((r.start_ts, r.end_ts))
    return res


def test_reference_examples(spark):
    q = [1, 4, 7, 10]
    rows = [
        (1, "daily", T(2023, 1, 1), T(2023, 1, 5), None, None, None, 9, 0, None, q),
        (2, "weekly", T(2023, 1, 1), T(2023, 2, 1), 0, None, None, 14, 0, 120, q),
        (3, "biweekly", T(2023, 1, 1), T(2023, 4, 1), 2, None, None, 10, 30, 30, q),
        (4, "monthly", T(2023, 1, 1), T(2023, 6, 1), None, 15, None, 15, 0, None, q),
        (5, "quarterly", T(2023, 1, 1), T(2024, 1, 1), None, None, 50, 9, 0, 180, q),
    ]
    r = _run(spark, rows)
    assert [s for s, _ in r[1]] == [T(2023, 1, d, 9) for d in (1, 2, 3, 4)]
    assert r[1][0][1] == T(2023, 1, 1, 10)
    assert [s for s, _ in r[2]] == [T(2023, 1, 2, 14), T(2023, 1, 9, 14), T(2023, 1, 16, 14),
                                    T(2023, 1, 23, 14), T(2023, 1, 30, 14)]
    assert r[2][0][1] == T(2023, 1, 2, 16)
    assert len(r[3]) == 7 and r[3][0][0] == T(2023, 1, 4, 10, 30) and r[3][0][1] == T(2023, 1, 4, 11)
    assert [s for s, _ in r[4]] == [T(2023, m, 15, 15) for m in (1, 2, 3, 4, 5)]
    assert [s for s, _ in r[5]] == [T(2023, 2, 19, 9), T(2023, 5, 20, 9), T(2023, 8, 19, 9),
                                    T(2023, 11, 19, 9)]


def test_monthly_clamp_and_skip(spark):
    q = [1, 4, 7, 10]
    rows = [
        (1, "monthly", T(2024, 1, 1), T(2024, 6, 1), None, 31, None, 8, 0, None, q),
        (2, "monthly", T(2023, 2, 1), T(2023, 5, 1), None, 31, None, 8, 0, None, q),
        (3, "monthly", T(2023, 1, 20, 7, 45), T(2023, 3, 31), None, 20, None, None, None, None, q),
    ]
    r = _run(spark, rows)
    assert [s.date() for s, _ in r[1]] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31),
                                           dt.date(2024, 4, 30), dt.date(2024, 5, 31)]
    assert [s.date() for s, _ in r[2]] == [dt.date(2023, 3, 31), dt.date(2023, 4, 30)]
    # no time set: the start's time is kept
    assert [s for s, _ in r[3]] == [T(2023, 1, 20, 7, 45), T(2023, 2, 20, 7, 45), T(2023, 3, 20, 7, 45)]


def test_daily_without_time_and_before_start(spark):
    q = [1, 4, 7, 10]
    rows = [
        (1, "daily", T(2023, 1, 1, 10, 30), T(2023, 1, 3, 12), None, None, None, None, None, None, q),
        (2, "daily", T(2023, 1, 1, 10, 30), T(2023, 1, 3, 12), None, None, None, 9, 0, None, q),
        (3, "weekly", T(2023, 1, 2, 15), T(2023, 1, 20), 0, None, None, 14, 0, None, q),
    ]
    r = _run(spark, rows)
    assert [s for s, _ in r[1]] == [T(2023, 1, 1, 10, 30), T(2023, 1, 2), T(2023, 1, 3)]
    assert [s for s, _ in r[2]] == [T(2023, 1, 2, 9), T(2023, 1, 3, 9)]
    # Monday 14:00 is before the Monday 15:00 start: one week later
    assert [s for s, _ in r[3]] == [T(2023, 1, 9, 14), T(2023, 1, 16, 14)]


def test_quarterly_clamp_custom_months(spark):
    rows = [(1, "quarterly", T(2023, 1, 1), T(2023, 12, 31), None, None, 92, None, None, None, [2, 5, 8, 11])]
    r = _run(spark, rows)
    # Nov 2022 quarter runs to Jan 31; Feb quarter (89 days) clamps to Apr 30
    assert [s.date() for s, _ in r[1]] == [dt.date(2023, 1, 31), dt.date(2023, 4, 30), dt.date(2023, 7, 31),
                                           dt.date(2023, 10, 31)]


def test_findings_and_coverage(spark):
    q = [1, 4, 7, 10]
    sched = spark.createDataFrame(
        [(7, "monthly", T(2023, 1, 1), T(2023, 3, 1), None, 40, None, None, None, None, q),
         (8, "daily", T(2023, 1, 1), T(2023, 1, 2, 12), None, None, None, 9, 0, None, q)], SCHEMA)
    assert [r.schedule_id for r in schedule_findings(sched).collect()] == [7]
    ev = spark.createDataFrame([(8, T(2023, 1, 1, 9, 30)), (8, T(2023, 1, 1, 10)), (8, T(2023, 1, 2, 9, 59))],
                               "user_id bigint, ts timestamp_ntz")
    cov = {r.occ_no: r.n_events for r in coverage(occurrences(sched), ev).collect()}
    assert cov == {1: 1, 2: 1}


def test_coverage_of_a_hot_key_equals_counting(spark):
    """A key with a third of all events; bounds and events at one time; keys without events."""
    import random
    rng = random.Random(5)
    at = lambda: T(2024, 1, 1) + dt.timedelta(minutes=30 * rng.randrange(1500))
    events = [(1 if i % 3 == 0 else rng.randrange(2, 40), at()) for i in range(3000)] + [(None, at()), (3, None)]
    occ = []
    for i in range(400):
        start = at()
        occ.append((rng.randrange(1, 60), "daily", i, start, start + dt.timedelta(minutes=rng.choice([0, 30, 60, 5000]))))
    got = coverage(spark.createDataFrame(occ, "schedule_id bigint, kind string, occ_no int, start_ts timestamp_ntz, end_ts timestamp_ntz"),
                   spark.createDataFrame(events, "user_id bigint, ts timestamp_ntz")).collect()
    assert {(r.schedule_id, r.occ_no, r.n_events) for r in got} == {
        (k, n, sum(e == k and t is not None and s <= t < end for e, t in events)) for k, _, n, s, end in occ}
    assert len(got) == len(occ)


def test_coverage_joins_no_events_to_occurrences(spark):
    """The only join is that of the blocks' totals; events meet occurrences in a window."""
    occ = spark.createDataFrame([(1, 1, T(2024, 1, 1), T(2024, 1, 2))], "schedule_id bigint, occ_no int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    ev = spark.createDataFrame([(1, T(2024, 1, 1, 5))], "user_id bigint, ts timestamp_ntz")
    plan = coverage(occ, ev)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" in plan and coverage(occ, ev).first().n_events == 1
