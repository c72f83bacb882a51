"""Registered job-status queries over job runs derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.operators import job_status as JS
from recordchecks.plans.hl7_sql import sq
from recordchecks.plans.registry import query
from recordchecks.rules import job_texts as JT
from recordchecks.sources.bindings import job_runs

_ALLOWED = "[" + ", ".join(f"'{s}'" for s in JT.STATUSES) + "]"
_IN = "(" + ", ".join(sq(s) for s in JT.STATUSES) + ")"
_VALUES = ", ".join(f"({str(r).lower()}, {sq(a)}, {sq(c)}, {sq(k)}, {sq(t)})"
                    for r, a, c, k, t in JT.statement_rows())

JOBS_SQL = f"""
jobs AS (
  SELECT o_orderkey + 1 AS job_seq,
    CASE WHEN o_orderkey % 89 <> 0 THEN 'JOB_' || printf('%06d', o_orderkey) END AS job_id,
    CASE WHEN o_orderkey % 97 = 5 THEN 'DONE' WHEN o_orderkey % 101 = 7 THEN NULL
         WHEN o_orderstatus = 'O' THEN 'SUCCESS' WHEN o_orderstatus = 'F' THEN 'FAILURE'
         ELSE 'PARTIAL_SUCCESS' END AS amia_status,
    CASE WHEN o_orderkey % 103 = 9 THEN 'done'
         WHEN substr(o_orderpriority, 1, 1) IN ('1', '5') THEN 'FAILURE'
         WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS claria_status,
    CASE o_orderkey % 8 WHEN 1 THEN 'SUCCESS' WHEN 3 THEN 'FAILURE' WHEN 5 THEN '' WHEN 7 THEN 'PARTIAL_SUCCESS'
         ELSE CASE WHEN o_orderkey % 107 = 2 THEN 'RETRY' END END AS reprocess_amia,
    CASE o_orderkey % 6 WHEN 2 THEN 'SUCCESS' WHEN 4 THEN 'PARTIAL_SUCCESS' END AS reprocess_claria
  FROM orders),
st(is_reprocess, s_amia, s_claria, statement_key, statement) AS (VALUES {_VALUES}),
j2 AS (
  SELECT *, (reprocess_amia IS NOT NULL OR reprocess_claria IS NOT NULL) AS has_reprocess,
    CASE WHEN coalesce(amia_status IN {_IN}, false) = false
           THEN 'Invalid status for AMIA: ' || coalesce(amia_status, 'None') || '. Must be one of {_ALLOWED.replace("'", "''")}'
         WHEN coalesce(claria_status IN {_IN}, false) = false
           THEN 'Invalid status for CLARIA: ' || coalesce(claria_status, 'None') || '. Must be one of {_ALLOWED.replace("'", "''")}'
         WHEN coalesce(reprocess_amia, '') <> '' AND reprocess_amia NOT IN {_IN}
           THEN 'Invalid status for AMIA Reprocess: ' || reprocess_amia || '. Must be one of {_ALLOWED.replace("'", "''")}'
         WHEN coalesce(reprocess_claria, '') <> '' AND reprocess_claria NOT IN {_IN}
           THEN 'Invalid status for CLARIA Reprocess: ' || reprocess_claria || '. Must be one of {_ALLOWED.replace("'", "''")}'
    END AS error
  FROM jobs),
j3 AS (
  SELECT *,
    CASE WHEN has_reprocess THEN coalesce(nullif(reprocess_amia, ''), amia_status) ELSE amia_status END AS ea,
    CASE WHEN has_reprocess THEN coalesce(nullif(reprocess_claria, ''), claria_status) ELSE claria_status END AS ec
  FROM j2),
stm AS (
  SELECT j3.job_seq, j3.job_id, j3.amia_status, j3.claria_status, j3.reprocess_amia, j3.reprocess_claria,
         j3.has_reprocess, j3.error, st.statement_key, st.statement
  FROM j3 LEFT JOIN st ON j3.error IS NULL AND st.is_reprocess = j3.has_reprocess
                       AND st.s_amia = j3.ea AND st.s_claria = j3.ec)"""


@query("job_statement", f"WITH {JOBS_SQL} SELECT * FROM stm")
def q_statement(spark, d):
    return JS.statements(job_runs(spark, d))


@query("job_status_invalid", f"WITH {JOBS_SQL} SELECT job_seq, job_id, error FROM stm WHERE error IS NOT NULL")
def q_invalid(spark, d):
    return JS.statements(job_runs(spark, d)).where(F.col("error").isNotNull()).select(
        "job_seq", "job_id", "error")


@query("job_report", f"""WITH {JOBS_SQL},
r AS (SELECT *, coalesce(job_id, 'Job_' || job_seq) AS jid FROM stm)
SELECT 0 AS job_seq, 0 AS line_no, {sq(JT.REPORT_TITLE)} AS line
UNION ALL SELECT 0, 1, repeat('=', 80)
UNION ALL SELECT job_seq, 0, chr(10) || jid || ': ERROR - ' || error FROM r WHERE error IS NOT NULL
UNION ALL SELECT job_seq, 0, chr(10) || jid || ':' FROM r WHERE error IS NULL
UNION ALL SELECT job_seq, 1, '  AMIA Status: ' || coalesce(amia_status, 'None') FROM r WHERE error IS NULL
UNION ALL SELECT job_seq, 2, '  CLARIA Status: ' || coalesce(claria_status, 'None') FROM r WHERE error IS NULL
UNION ALL SELECT job_seq, 3, '  Reprocess AMIA: ' || coalesce(reprocess_amia, 'None') FROM r WHERE error IS NULL AND has_reprocess
UNION ALL SELECT job_seq, 4, '  Reprocess CLARIA: ' || coalesce(reprocess_claria, 'None') FROM r WHERE error IS NULL AND has_reprocess
UNION ALL SELECT job_seq, CASE WHEN has_reprocess THEN 5 ELSE 3 END, '  Status: ' || statement FROM r WHERE error IS NULL""")
def q_report(spark, d):
    return JS.report(job_runs(spark, d))
