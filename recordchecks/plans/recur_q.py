"""Registered recurrence queries over one schedule per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.operators import recurrence as RC
from recordchecks.plans.registry import query
from recordchecks.sources.bindings import schedules
from recordchecks.sources.tables import table

SCHED_SQL = """
sch AS (
  SELECT c_custkey AS schedule_id,
    (['daily', 'weekly', 'biweekly', 'monthly', 'quarterly'])[1 + c_custkey % 5] AS kind,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 28 AS INTEGER))
      + to_hours(CAST(c_custkey % 24 AS BIGINT)) + to_minutes(CAST((c_custkey * 13) % 60 AS BIGINT)) AS start_ts,
    CAST(c_custkey % 7 AS INTEGER) AS weekday,
    CAST(1 + (c_custkey * 7) % 31 AS INTEGER) AS day_of_month,
    CAST(1 + (c_custkey * 11) % 92 AS INTEGER) AS day_of_quarter,
    CASE WHEN c_custkey % 9 <> 0 THEN CAST((c_custkey * 5) % 24 AS INTEGER) END AS hh,
    CASE WHEN c_custkey % 9 <> 0 THEN CAST((c_custkey * 17) % 60 AS INTEGER) END AS mm,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST(15 * (1 + c_custkey % 8) AS INTEGER) END AS duration_min,
    CASE WHEN c_custkey % 2 = 0 THEN [1, 4, 7, 10] ELSE [2, 5, 8, 11] END AS qm,
    CAST(20 + c_custkey % 400 AS INTEGER) AS span_days
  FROM customer),
s2 AS (
  SELECT *, start_ts + to_days(span_days) AS end_ts,
    CASE WHEN hh IS NOT NULL THEN to_minutes(CAST(hh * 60 + mm AS BIGINT)) END AS tod,
    CAST(CAST(start_ts AS DATE) AS TIMESTAMP) AS start_day
  FROM sch),
d1 AS (
  SELECT *, CASE WHEN tod IS NULL THEN start_ts
                 WHEN start_day + tod < start_ts THEN start_day + tod + INTERVAL 1 DAY
                 ELSE start_day + tod END AS first
  FROM s2 WHERE kind = 'daily'),
daily AS (
  SELECT schedule_id, kind, duration_min, end_ts,
    CASE WHEN k = 0 THEN first ELSE CAST(CAST(first AS DATE) AS TIMESTAMP) + to_days(CAST(k AS INTEGER))
                                     + coalesce(tod, INTERVAL 0 MINUTE) END AS st
  FROM (SELECT *, unnest(range(0, date_diff('day', CAST(first AS DATE), CAST(end_ts AS DATE)) + 1)) AS k FROM d1)),
w1 AS (
  SELECT *, CASE kind WHEN 'weekly' THEN 7 ELSE 14 END AS step,
    start_ts + to_days(CAST((((weekday - (isodow(start_ts) - 1)) % 7) + 7) % 7 AS INTEGER)) AS d0
  FROM s2 WHERE kind IN ('weekly', 'biweekly')),
w2 AS (
  SELECT *, CASE WHEN tod IS NULL THEN d0
                 WHEN CAST(CAST(d0 AS DATE) AS TIMESTAMP) + tod < start_ts
                   THEN CAST(CAST(d0 AS DATE) AS TIMESTAMP) + tod + to_days(step)
                 ELSE CAST(CAST(d0 AS DATE) AS TIMESTAMP) + tod END AS first
  FROM w1),
weekly AS (
  SELECT schedule_id, kind, duration_min, end_ts, first + to_days(CAST(k * step AS INTEGER)) AS st
  FROM (SELECT *, unnest(range(0, CAST(floor(date_diff('day', CAST(first AS DATE), CAST(end_ts AS DATE)) / step) AS BIGINT) + 1)) AS k
        FROM w2)),
m1 AS (
  SELECT *, CAST(date_trunc('month', start_ts) AS DATE) AS m0,
    coalesce(tod, start_ts - date_trunc('day', start_ts)) AS t
  FROM s2 WHERE kind = 'monthly'),
m2 AS (
  SELECT *, CAST(m0 + to_months(CAST(i AS INTEGER)) AS DATE) AS ms
  FROM (SELECT *, unnest(range(0, date_diff('month', m0, CAST(date_trunc('month', end_ts) AS DATE)) + 1)) AS i FROM m1)),
m3 AS (
  SELECT *, day_of_month <= day(last_day(ms)) AS ex,
    CAST(ms + to_days(CAST(least(day_of_month, day(last_day(ms))) - 1 AS INTEGER)) AS TIMESTAMP) + t AS st
  FROM m2),
m4 AS (SELECT schedule_id, min(i) AS i0 FROM m3 WHERE ex AND st >= start_ts GROUP BY schedule_id),
monthly AS (
  SELECT m3.schedule_id, kind, duration_min, end_ts, st FROM m3 JOIN m4 ON m3.schedule_id = m4.schedule_id
  WHERE i >= i0 AND day_of_month BETWEEN 1 AND 31),
q1 AS (
  SELECT *, CAST(CAST(date_trunc('month', start_ts) AS DATE) - INTERVAL 12 MONTH AS DATE) AS m0
  FROM s2 WHERE kind = 'quarterly'),
q2 AS (
  SELECT *, CAST(m0 + to_months(CAST(i AS INTEGER)) AS DATE) AS md
  FROM (SELECT *, unnest(range(0, date_diff('month', m0, CAST(date_trunc('month', end_ts) AS DATE)) + 1)) AS i FROM q1)),
q3 AS (
  SELECT *, list_sort(qm) AS sqm FROM q2 WHERE list_contains(qm, month(md))),
q4 AS (
  SELECT *, ((((sqm[(list_position(sqm, month(md)) % len(sqm)) + 1] - month(md)) % 12) + 12) % 12) AS g0 FROM q3),
quarterly AS (
  SELECT schedule_id, kind, duration_min, end_ts,
    CAST(least(md + to_days(CAST(day_of_quarter - 1 AS INTEGER)),
               CAST(md + to_months(CAST(CASE WHEN g0 = 0 THEN 12 ELSE g0 END AS INTEGER)) AS DATE) - INTERVAL 1 DAY)
         AS TIMESTAMP) + coalesce(tod, INTERVAL 0 MINUTE) AS st, start_ts
  FROM q4),
occ_all AS (
  SELECT schedule_id, kind, duration_min, st FROM daily WHERE st <= end_ts
  UNION ALL SELECT schedule_id, kind, duration_min, st FROM weekly WHERE st <= end_ts
  UNION ALL SELECT schedule_id, kind, duration_min, st FROM monthly WHERE st <= end_ts
  UNION ALL SELECT schedule_id, kind, duration_min, st FROM quarterly WHERE st >= start_ts AND st <= end_ts),
occ AS (
  SELECT schedule_id, kind, row_number() OVER (PARTITION BY schedule_id ORDER BY st) AS occ_no,
         st AS start_ts, st + to_minutes(CAST(coalesce(duration_min, 60) AS BIGINT)) AS end_ts
  FROM occ_all)"""


def _kind_query(kind):
    @query(f"recur_{kind}", f"WITH {SCHED_SQL} SELECT * FROM occ WHERE kind = '{kind}'")
    def q(spark, d):
        s = schedules(spark, d)
        return RC.occurrences(s.where(F.col("kind") == kind))
    return q


for _k in RC.KINDS:
    _kind_query(_k)


@query("recur_coverage", f"""WITH {SCHED_SQL}
SELECT o.schedule_id, o.occ_no, o.start_ts, o.end_ts, count(e.ts) AS n_events
FROM occ o LEFT JOIN events e ON e.user_id = o.schedule_id AND e.ts >= o.start_ts AND e.ts < o.end_ts
GROUP BY o.schedule_id, o.occ_no, o.start_ts, o.end_ts""")
def q_coverage(spark, d):
    occ = RC.occurrences(schedules(spark, d))
    return RC.coverage(occ, table(spark, d, "events"))
