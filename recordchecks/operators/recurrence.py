"""Recurring schedules expanded to occurrences.

Input ``schedules(schedule_id, kind, start_ts, end_ts, weekday, day_of_month,
day_of_quarter, hh, mm, duration_min, quarter_months)``; NULL ``hh`` means no
fixed time of day, NULL ``duration_min`` means one hour.  Each schedule row
builds its own array of occurrence starts from ``sequence`` arithmetic and
explodes it once: no shuffle, work proportional to the occurrences.  The end
bound is inclusive on the occurrence start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordchecks.functions.gen import posexplode_kept

KINDS = ("daily", "weekly", "biweekly", "monthly", "quarterly")


def _tod() -> Column:
    return F.make_dt_interval(F.lit(0), F.col("hh"), F.col("mm"), F.lit(0))


def _has_tod() -> Column:
    return F.col("hh").isNotNull()


def _at(date: Column, offset: Column) -> Column:
    return date.cast("timestamp_ntz") + offset


def _start_time() -> Column:
    """Time of day of the start, as an interval (kept when no time is set)."""
    s = F.col("start_ts")
    return s - F.to_date(s).cast("timestamp_ntz")


def _upto(n: Column) -> Column:
    """``[0, 1, ..., n]``, empty when ``n < 0`` (``sequence(0, -1)`` would
    count down)."""
    return F.when(n >= 0, F.sequence(F.lit(0), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def _bounded(arr: Column) -> Column:
    return F.filter(arr, lambda t: t <= F.col("end_ts"))


def daily() -> Column:
    """First at the set time (next day if that is before the start) or at
    the start itself; then every day at the set time, or at midnight."""
    s = F.col("start_ts")
    first_t = _at(F.to_date(s), _tod())
    first = F.when(_has_tod(), F.when(first_t < s, first_t + F.make_dt_interval(F.lit(1))).otherwise(first_t)
                   ).otherwise(s)
    base = F.to_date(first)
    later = F.coalesce(_tod(), F.make_dt_interval(F.lit(0)))
    ks = _upto(F.datediff(F.to_date("end_ts"), base))
    return _bounded(F.transform(ks, lambda k: F.when(k == 0, first).otherwise(
        _at(F.date_add(base, k), later))))


def every_n_weeks(weeks: int) -> Column:
    """First on the weekday on or after the start (keeping the start's
    time, or at the set time); when that is before the start, one step later."""
    s = F.col("start_ts")
    step = 7 * weeks
    ahead = F.pmod(F.col("weekday") - F.weekday(s), F.lit(7))
    d0 = s + F.make_dt_interval(ahead)
    d0t = _at(F.to_date(d0), _tod())
    first = F.when(_has_tod(), F.when(d0t < s, d0t + F.make_dt_interval(F.lit(step))).otherwise(d0t)
                   ).otherwise(d0)
    n = F.floor(F.datediff(F.to_date("end_ts"), F.to_date(first)) / step)
    ks = _upto(n)
    return _bounded(F.transform(ks, lambda k: first + F.make_dt_interval(k * step)))


def monthly() -> Column:
    """First occurrence in the first month that has the day and is not
    before the start; later months clamp the day to the month end and return
    to the day after (D30: the start's time kept when no time is set)."""
    s = F.col("start_ts")
    d = F.col("day_of_month")
    m0 = F.trunc(F.to_date(s), "month")
    n = F.months_between(F.trunc(F.to_date("end_ts"), "month"), m0).cast("int")
    t = F.when(_has_tod(), _tod()).otherwise(_start_time())

    def month(i):
        return F.add_months(m0, i)
    cands = F.transform(_upto(n), lambda i: F.struct(
        i.alias("i"),
        (d <= F.dayofmonth(F.last_day(month(i)))).alias("exists"),
        _at(F.date_add(month(i), F.least(d, F.dayofmonth(F.last_day(month(i)))) - 1), t).alias("ts")))
    first_i = F.get(F.transform(F.filter(cands, lambda c: c["exists"] & (c["ts"] >= s)),
                                lambda c: c["i"]), 0)
    valid = (d >= 1) & (d <= 31)
    return F.when(valid & first_i.isNotNull(), _bounded(F.transform(
        F.filter(cands, lambda c: c["i"] >= first_i), lambda c: c["ts"]))).otherwise(
        F.array().cast("array<timestamp_ntz>"))


def quarterly() -> Column:
    """R5 (D17): the n-th day of every quarter (quarters start in the given
    months), clamped to the quarter's last day; at the set time or midnight."""
    s = F.col("start_ts")
    n = F.col("day_of_quarter")
    qm = F.array_sort(F.col("quarter_months"))
    m0 = F.add_months(F.trunc(F.to_date(s), "month"), -12)
    span = F.months_between(F.trunc(F.to_date("end_ts"), "month"), m0).cast("int")
    t = F.coalesce(_tod(), F.make_dt_interval(F.lit(0)))
    months = F.filter(F.transform(_upto(span),
                                  lambda i: F.add_months(m0, i)),
                      lambda md: F.array_contains(qm, F.month(md)))

    def next_gap(md):
        pos = F.array_position(qm, F.month(md))  # 1-based
        nxt = F.get(qm, F.pmod(pos, F.size(qm)).cast("int"))
        g = F.pmod(nxt - F.month(md), F.lit(12))
        return F.when(g == 0, F.lit(12)).otherwise(g)
    cands = F.transform(months, lambda md: _at(
        F.least(F.date_add(md, n - 1), F.date_sub(F.add_months(md, next_gap(md)), 1)), t))
    return F.filter(cands, lambda c: (c >= s) & (c <= F.col("end_ts")))


def occurrence_starts() -> Column:
    k = F.col("kind")
    return (F.when(k == "daily", daily())
            .when(k == "weekly", every_n_weeks(1))
            .when(k == "biweekly", every_n_weeks(2))
            .when(k == "monthly", monthly())
            .when(k == "quarterly", quarterly()))


def occurrences(schedules: DataFrame) -> DataFrame:
    """``(schedule_id, kind, occ_no, start_ts, end_ts)``."""
    s = schedules.select("schedule_id", "kind", "duration_min", occurrence_starts().alias("starts"))
    o = posexplode_kept(s, ["schedule_id", "kind", "duration_min"], "starts", "pos", "start_ts")
    return o.select("schedule_id", "kind", (F.col("pos") + 1).alias("occ_no"), "start_ts",
                    (F.col("start_ts") + F.make_dt_interval(
                        F.lit(0), F.lit(0), F.coalesce(F.col("duration_min"), F.lit(60)), F.lit(0)))
                    .alias("end_ts"))


def schedule_findings(schedules: DataFrame) -> DataFrame:
    """Monthly day outside 1-31 is reported instead of searched."""
    return schedules.where((F.col("kind") == "monthly")
                           & ~F.col("day_of_month").between(1, 31)).select(
        "schedule_id", F.lit("day_of_month must be between 1 and 31").alias("finding"))


def coverage(occ: DataFrame, events: DataFrame, key: str = "user_id", ts: str = "ts", block: str = "day") -> DataFrame:
    """Events inside each occurrence ``[start, end)``, zero for none.

    A sweep, not a join of events to occurrences: the count of an occurrence is
    the number of its key's events before its end less those before its start.
    Events and bounds are laid out by (key, block of time) and counted up within
    the block; the totals of the blocks, one row each, are counted up by key and
    carried in.  So the work is linear however many events an occurrence holds,
    and a key with a third of all events is split by its blocks.  Occurrences are
    told apart by ``schedule_id`` and ``occ_no``; events without key or time count
    nowhere."""
    kind = occ.schema["start_ts"].dataType
    # at one time, bounds stand before events: the end is outside, the start inside.  _n: 1 for an event
    bound = F.inline(F.array(F.struct(F.col("start_ts").alias("_t"), F.lit(True).alias("_first")), F.struct(F.col("end_ts").alias("_t"), F.lit(False).alias("_first"))))
    bounds = occ.select(F.col("schedule_id").alias("_k"), "occ_no", bound).withColumn("_n", F.lit(0))
    seen = events.select(F.col(key).alias("_k"), F.lit(None).cast(occ.schema["occ_no"].dataType).alias("occ_no"), F.col(ts).cast(kind).alias("_t"),
                         F.lit(None).cast("boolean").alias("_first"), F.lit(1).alias("_n")).where("_k is not null and _t is not null")
    points = bounds.unionByName(seen).withColumn("_block", F.date_trunc(block, "_t"))
    before = F.sum("_n").over(Window.partitionBy("_k", "_block").orderBy("_t", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = points.withColumn("_before", before).where("_n = 0")
    totals = points.groupBy("_k", "_block").agg(F.sum("_n").alias("_total"))
    carried = totals.select("_k", "_block", (F.sum("_total").over(Window.partitionBy("_k").orderBy("_block")) - F.col("_total")).alias("_carried"))
    count = F.col("_before") + F.col("_carried")
    # sorted, whatever the planner expects: it takes the occurrences for as few as their schedules and would broadcast them
    return within.join(carried.hint("merge"), ["_k", "_block"]).groupBy(F.col("_k").alias("schedule_id"), "occ_no").agg(
        F.max(F.when(F.col("_first"), F.col("_t"))).alias("start_ts"), F.max(F.when(~F.col("_first"), F.col("_t"))).alias("end_ts"),
        F.greatest(F.sum(F.when(F.col("_first"), -count).otherwise(count)), F.lit(0)).cast("long").alias("n_events"))
