"""Device job statuses to report statements.

Input ``job_runs(job_seq, job_id, amia_status, claria_status, reprocess_amia,
reprocess_claria)``.  The 18-row statement table (two tables of status x
status) is the only broadcast: its size is fixed by the status enum, not by
the data.  Everything else is a per-row expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.functions.gen import posexplode_kept
from recordchecks.rules import job_texts as JT


def statement_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JT.statement_rows(),
                                 "is_reprocess boolean, s_amia string, s_claria string, "
                                 "statement_key string, statement string")


def _valid(c):
    return c.isin(*JT.STATUSES)


def _shown(c):
    """Python-style rendering of an optional value (None when absent)."""
    return F.coalesce(c, F.lit("None"))


def status_error(df: DataFrame):
    """First failing of the four checks, as text; NULL when all pass.
    An empty reprocess value is not checked (falsy), D25."""
    allowed = "[" + ", ".join(f"'{s}'" for s in JT.STATUSES) + "]"

    def msg(dev, col):
        return F.concat(F.lit(f"Invalid status for {dev}: "), _shown(F.col(col)),
                        F.lit(f". Must be one of {allowed}"))
    ra, rc = F.col("reprocess_amia"), F.col("reprocess_claria")
    bad_a = ~F.coalesce(_valid(F.col("amia_status")), F.lit(False))
    bad_c = ~F.coalesce(_valid(F.col("claria_status")), F.lit(False))
    bad_ra = (F.coalesce(ra, F.lit("")) != "") & ~F.coalesce(_valid(ra), F.lit(False))
    bad_rc = (F.coalesce(rc, F.lit("")) != "") & ~F.coalesce(_valid(rc), F.lit(False))
    return (F.when(bad_a, msg("AMIA", "amia_status"))
            .when(bad_c, msg("CLARIA", "claria_status"))
            .when(bad_ra, msg("AMIA Reprocess", "reprocess_amia"))
            .when(bad_rc, msg("CLARIA Reprocess", "reprocess_claria")))


def statements(jobs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Statement per job (NULL with ``error`` set when invalid).
    Reprocess values that are absent or empty fall back to the initial status
    (E8); ``has_reprocess`` is true when either reprocess value is not NULL."""
    spark = spark or jobs.sparkSession
    table = F.broadcast(statement_table(spark))
    has_rep = F.col("reprocess_amia").isNotNull() | F.col("reprocess_claria").isNotNull()
    eff_a = F.when(has_rep, F.coalesce(F.nullif("reprocess_amia", F.lit("")), "amia_status")).otherwise(
        F.col("amia_status"))
    eff_c = F.when(has_rep, F.coalesce(F.nullif("reprocess_claria", F.lit("")), "claria_status")).otherwise(
        F.col("claria_status"))
    j = jobs.select("*", has_rep.alias("has_reprocess"), status_error(jobs).alias("error"),
                    eff_a.alias("_a"), eff_c.alias("_c"))
    cond = ((j["has_reprocess"] == table["is_reprocess"]) & (j["_a"] == table["s_amia"])
            & (j["_c"] == table["s_claria"]) & j["error"].isNull())
    out = j.join(table, cond, "left")
    return out.select(*jobs.columns, "has_reprocess", "error", "statement_key", "statement")


def default_job_id(jobs: DataFrame, seq_col: str = "job_seq") -> DataFrame:
    """A missing job id becomes ``Job_{seq}``; ``seq`` is the explicit
    1-based position column, so no global window is needed."""
    return jobs.withColumn("job_id", F.coalesce(F.col("job_id"),
                                                F.concat(F.lit("Job_"), F.col(seq_col).cast("string"))))


def report(jobs: DataFrame) -> DataFrame:
    """T4: report lines ``(job_seq, line_no, line)``; the title lines carry
    ``job_seq`` 0.  Lines of a job are built on its own row."""
    st = statements(default_job_id(jobs))
    ok_lines = F.concat(
        F.array(F.concat(F.lit("\n"), F.col("job_id"), F.lit(":")),
                F.concat(F.lit("  AMIA Status: "), _shown(F.col("amia_status"))),
                F.concat(F.lit("  CLARIA Status: "), _shown(F.col("claria_status")))),
        F.when(F.col("has_reprocess"), F.array(
            F.concat(F.lit("  Reprocess AMIA: "), _shown(F.col("reprocess_amia"))),
            F.concat(F.lit("  Reprocess CLARIA: "), _shown(F.col("reprocess_claria"))))
        ).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("  Status: "), F.col("statement"))))
    lines = F.when(F.col("error").isNotNull(), F.array(
        F.concat(F.lit("\n"), F.col("job_id"), F.lit(": ERROR - "), F.col("error")))).otherwise(ok_lines)
    body = posexplode_kept(st, ["job_seq"], lines, "line_no", "line")
    title = jobs.sparkSession.createDataFrame(
        [(0, 0, JT.REPORT_TITLE), (0, 1, "=" * 80)], "job_seq long, line_no int, line string")
    return title.unionByName(body.select(F.col("job_seq").cast("long"), "line_no", "line"))
