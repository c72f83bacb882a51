"""Structured Streaming wiring for the stateless checks.

HL7 validation and JSON rule checks are per-row expressions (no state, no
shuffle), so the batch operators run unchanged on a streaming DataFrame:
``readStream`` of message / document files -> findings -> ``writeStream``
to Parquet.  The caller names the checkpoint folder, on shared storage: with
the same folder a restarted query resumes where it stopped (exactly-once file
sink).
Totals of a running stream (verdict counts, error frequencies) are stateful
counts that survive a restart the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.operators import hl7_validate as HV
from recordchecks.operators import json_rules as J


def message_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """One HL7 message per file (``wholetext``), keyed by the file path."""
    return (spark.readStream.format("text").option("wholetext", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path)
            .select(F.input_file_name().alias("msg_id"), F.col("value").alias("raw")))


def document_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """JSON Lines: one device record per line, keyed by file and line text hash
    (equal lines of a file, which have equal findings, share a key)."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger).load(path)
            .select(F.concat(F.input_file_name(), F.lit("#"), F.xxhash64("value").cast("string")).alias("doc_id"),
                    F.col("value").alias("json")))


def start_hl7_findings(spark: SparkSession, source: str, sink: str, checkpoint: str,
                       profiles=("strict", "lenient"), available_now: bool = False):
    """Findings of every arriving message, appended to Parquet at ``sink``."""
    out = HV.findings(message_stream(spark, source), profiles)
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .option("path", sink))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def start_json_checks(spark: SparkSession, source: str, sink: str, rules: DataFrame,
                      checkpoint: str, available_now: bool = False):
    """Per-field results of every arriving document, appended to Parquet.
    The rule table is compiled once when the query starts."""
    compiled = J.compile_rules(rules)
    out = J.field_checks(J.validate(document_stream(spark, source), compiled))
    out = out.withColumn("errors", F.array_join("errors", "; "))
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .option("path", sink))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


TOTALS = "batch BIGINT, profile STRING, severity STRING, code STRING, location STRING, n BIGINT"


def start_finding_totals(spark: SparkSession, source: str, sink: str, checkpoint: str,
                         profiles=("strict", "lenient"), available_now: bool = False):
    """L17, A6, A7 of a running stream: how often each finding (profile, severity,
    code, location) and each message (code ``message``) came so far.

    The counts are the stream's state, split by key, with partial counts before
    the shuffle.  Each micro-batch writes the counts it changed as a table of
    its own under ``sink``, named by the batch: a batch that runs again after a
    failure overwrites its table, so nothing counts twice.  ``finding_totals``
    reads the latest of each.  Locations carry no occurrence number, so the
    state holds a row a rule and field, however many messages arrive."""
    found = HV.validated(message_stream(spark, source), profiles)
    one = F.array(*[F.struct(F.lit(p).alias("profile"), F.concat(
        F.array(F.struct(F.lit("all").alias("severity"), F.lit("message").alias("code"), F.lit("").alias("location"))),
        F.transform(f"f_{p}", lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code"), F.regexp_replace(
            f["location"], r"\[\d+\]", "").alias("location")))).alias("fs")) for p in profiles])
    rows = found.select(F.inline(one)).select("profile", F.inline("fs"))
    counts = rows.groupBy("profile", "severity", "code", "location").agg(F.count(F.lit(1)).alias("n"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.select(F.lit(batch).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(f"{sink}/part={batch}")

    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def finding_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The latest count of each key that ``start_finding_totals`` wrote."""
    keys = ["profile", "severity", "code", "location"]
    return spark.read.schema(TOTALS).parquet(f"{sink}/part=*").groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
