"""Registered JSON rule-check queries over the device records
derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.functions.gen import inline_kept
from recordchecks.functions.jsonpath import lookup, steps, targets
from recordchecks.operators import json_rules as J
from recordchecks.operators import rule_index as I
from recordchecks.plans.json_sql import DOCS_SQL, with_checks
from recordchecks.plans.registry import query
from recordchecks.rules import json_rules as JR
from recordchecks.session import shared_path
from recordchecks.sources.bindings import device_records
from recordchecks.sources.sinks import write_json, write_json_with_totals
from recordchecks.sources.tables import table

DEVICE = "AMIA"


def _validated(spark, d):
    rules = J.compile_rules(J.filter_rules(J.rules_frame(spark), DEVICE, 1, "TREATMENT"))
    return J.validate(device_records(spark, d), rules)


@query("json_docs", f"WITH {DOCS_SQL} SELECT doc_id, json_valid(json) AS is_parseable FROM docs")
def q_docs(spark, d):
    return device_records(spark, d).select(
        "doc_id", F.try_parse_json("json").isNotNull().alias("is_parseable"))


@query("json_path", f"""WITH {DOCS_SQL}
SELECT doc_id,
  json_extract_string(json, '$."Patient Info"."DOB"') AS dob,
  json_extract_string(json, '$."Actual Therapy"[0]."Cycle Type"') AS first_cycle_type,
  CAST(json_extract_string(json, '$."Vitals"."Pre-Treatment"."Weight"') AS DOUBLE) AS pre_weight,
  json_extract_string(json, '$."Actual Therapy"[3]."CycleAttributes"."Fill Volume"') AS fourth_fill_volume
FROM vd""")
def q_path(spark, d):
    v = device_records(spark, d).select("doc_id", F.try_parse_json("json").alias("v")).where(
        F.col("v").isNotNull())
    g = lambda p, t: F.try_variant_get(lookup(F.col("v"), steps(p)), "$", t)
    return v.select("doc_id", g("Patient Info.DOB", "string").alias("dob"),
                    g("Actual Therapy[0].Cycle Type", "string").alias("first_cycle_type"),
                    g("Vitals.Pre-Treatment.Weight", "double").alias("pre_weight"),
                    g("Actual Therapy[3].CycleAttributes.Fill Volume", "string").alias("fourth_fill_volume"))


@query("json_path_wildcard", f"""WITH {DOCS_SQL}
SELECT doc_id, 'Actual Therapy[' || i || '].Cycle Type' AS field_path,
       json_extract_string(json, '$."Actual Therapy"[' || i || ']."Cycle Type"') AS value
FROM (SELECT doc_id, json, unnest(range(CAST(json_array_length(json, '$."Actual Therapy"') AS BIGINT))) AS i FROM vd
      WHERE json_type(json, '$."Actual Therapy"') = 'ARRAY')
UNION ALL SELECT doc_id, 'Actual Therapy[*].Cycle Type', NULL FROM vd
WHERE coalesce(json_type(json, '$."Actual Therapy"'), 'NULL') <> 'ARRAY'""")
def q_path_wildcard(spark, d):
    v = device_records(spark, d).select("doc_id", F.try_parse_json("json").alias("v")).where(
        F.col("v").isNotNull())
    t = inline_kept(v, ["doc_id"], targets(F.col("v"), "Actual Therapy[*].Cycle Type"), "field_path")
    return t.select("doc_id", "field_path", F.try_variant_get("value", "$", "string").alias("value"))


_FC = ["doc_id", "rule_no", "field_path", "extract_column", "data_type", "is_required", "is_valid",
       "errors", "is_required_missing", "actual_value"]


@query("json_field_checks", with_checks("""
SELECT doc_id, rule_no, field_path, extract_column, data_type, is_required, is_valid,
       array_to_string(errors, '; ') AS errors, is_required_missing, actual_value FROM fce"""))
def q_field_checks(spark, d):
    fc = J.field_checks(_validated(spark, d))
    return fc.select(*[F.array_join("errors", "; ").alias("errors") if c == "errors" else c for c in _FC])


@query("sink_json", with_checks("""
SELECT doc_id, rule_no, field_path, extract_column, data_type, is_required, is_valid,
       array_to_string(errors, '; ') AS errors, is_required_missing, actual_value FROM fce"""))
def q_sink_json(spark, d):
    """The detailed validation results written as JSON lines and read back."""
    path = shared_path(spark, "validation_json")
    checks = J.field_checks(_validated(spark, d))
    write_json(checks, path)
    back = spark.read.schema(checks.schema).json(path)
    return back.select(*[F.array_join("errors", "; ").alias("errors") if c == "errors" else c for c in _FC])


@query("json_required", with_checks("""
SELECT doc_id, rule_no, field_path FROM fce WHERE is_required_missing"""))
def q_required(spark, d):
    return J.field_checks(_validated(spark, d)).where("is_required_missing").select(
        "doc_id", "rule_no", "field_path")


def _err_query(key, like_sql, pred):
    @query(key, with_checks(f"SELECT doc_id, rule_no, field_path, message FROM errs WHERE {like_sql}"))
    def q(spark, d):
        f = J.findings(_validated(spark, d))
        return f.where((F.col("severity") == "error") & F.col("rule_no").isNotNull()
                       & (F.col("rule_no") > 0) & pred(F.col("message"))).select(
            "doc_id", "rule_no", "field_path", "message")
    return q


_err_query("json_type_check", "message LIKE 'Expected %'", lambda m: m.startswith("Expected "))
_err_query("json_length_check", "message LIKE 'Length %'", lambda m: m.startswith("Length "))
_err_query("json_format_check",
           "(message LIKE 'Invalid timestamp format%' OR message = 'Timestamp value must be string')",
           lambda m: m.startswith("Invalid timestamp format") | (m == "Timestamp value must be string"))
_err_query("json_range_check", "strpos(message, 'out of reasonable range') > 0",
           lambda m: m.contains("out of reasonable range"))


@query("json_missing_warnings", with_checks("""
SELECT doc_id, warning FROM wr WHERE warning LIKE 'Optional medical field%'"""))
def q_missing_warn(spark, d):
    return J.quality_issues(_validated(spark, d)).where(
        F.col("warning").startswith("Optional medical field"))


@query("json_extreme_warnings", with_checks("""
SELECT doc_id, warning FROM wr WHERE warning LIKE 'Extreme value in%'"""))
def q_extreme_warn(spark, d):
    return J.quality_issues(_validated(spark, d)).where(F.col("warning").startswith("Extreme value in"))


@query("json_quality_issues", with_checks("SELECT doc_id, warning FROM wr"))
def q_quality(spark, d):
    return J.quality_issues(_validated(spark, d))


@query("json_doc_summary", with_checks("SELECT * FROM summ"))
def q_summary(spark, d):
    return J.summary(_validated(spark, d))


@query("json_batch_totals", with_checks("""
SELECT count(*) AS total_files, count(*) FILTER (WHERE is_valid) AS valid_files,
       count(*) FILTER (WHERE NOT is_valid) AS invalid_files FROM summ"""))
def q_totals(spark, d):
    return J.batch_totals(_validated(spark, d))


@query("json_write_totals", with_checks("""
SELECT count(*) AS total_files, count(*) FILTER (WHERE is_valid) AS valid_files,
       count(*) FILTER (WHERE NOT is_valid) AS invalid_files, CAST(sum(warning_count) AS BIGINT) AS warnings FROM summ"""))
def q_write_totals(spark, d):
    """S8 with A6: the summaries of all documents written as JSON, counted by the same pass."""
    return write_json_with_totals(J.summary(_validated(spark, d)), shared_path(spark, "json_summaries"), {
        "total_files": F.count(F.lit(1)), "valid_files": F.count_if("is_valid"),
        "invalid_files": F.count_if(~F.col("is_valid")), "warnings": F.sum("warning_count")})


@query("json_common_errors", with_checks("SELECT error, count(*) AS n FROM allerr GROUP BY error"))
def q_common(spark, d):
    return J.common_errors(_validated(spark, d))


@query("json_top_errors", with_checks("""
SELECT error, count(*) AS n FROM allerr GROUP BY error ORDER BY n DESC, error LIMIT 5"""))
def q_top(spark, d):
    return J.top_errors(_validated(spark, d), 5)


@query("json_bad_docs", f"""WITH {DOCS_SQL}
SELECT doc_id, 'Validation error: document is not valid JSON' AS error FROM docs WHERE NOT json_valid(json)""")
def q_bad(spark, d):
    return J.bad_docs(_validated(spark, d))


@query("json_report_head", with_checks("""
, ordered_err AS (
  SELECT doc_id, error, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3) - 1 AS o,
         count(*) OVER (PARTITION BY doc_id) AS n_err
  FROM (SELECT doc_id, message AS error, rule_no AS k1, idx AS k2, err_no AS k3 FROM errs
        UNION ALL SELECT doc_id, 'Validation error: document is not valid JSON', 0, 0, 0
        FROM docs WHERE NOT json_valid(json))),
det AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_no, idx) - 1 AS o FROM fce),
mis AS (
  SELECT doc_id, field_path, row_number() OVER (PARTITION BY doc_id ORDER BY rule_no, idx) - 1 AS o
  FROM fce WHERE is_required_missing),
wro AS (SELECT doc_id, warning, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS o FROM wr)
SELECT doc_id, 'summary' AS section, 0 AS ord, 'Total Fields Checked: ' || total_fields_checked AS line FROM summ
UNION ALL SELECT doc_id, 'summary', 1, 'Passed Validation: ' || passed_validation FROM summ
UNION ALL SELECT doc_id, 'summary', 2, 'Failed Validation: ' || failed_validation FROM summ
UNION ALL SELECT doc_id, 'summary', 3, 'Overall Status: ' || CASE WHEN is_valid THEN 'PASS' ELSE 'FAIL' END FROM summ
UNION ALL SELECT doc_id, 'errors', o, '• ' || error FROM ordered_err WHERE o < 10
UNION ALL SELECT DISTINCT doc_id, 'errors', 10, '... and ' || (n_err - 10) || ' more errors' FROM ordered_err WHERE n_err > 10
UNION ALL SELECT doc_id, 'warnings', o, '⚠ ' || warning FROM wro WHERE o < 5
UNION ALL SELECT doc_id, 'missing', o, '✗ ' || field_path FROM mis WHERE o < 5
UNION ALL SELECT doc_id, 'details', o, CASE WHEN is_valid THEN '✓ ' || field_path
       ELSE '✗ ' || field_path || ' - Errors: ' || array_to_string(errors, ', ') END FROM det WHERE o < 5
"""))
def q_report(spark, d):
    return J.report_lines(_validated(spark, d))


_SCOPE = ["CUSTOMER_ID", "DEVICE"]


def _clinic_tables(spark, d):
    """Documents with their clinic (the order's customer) and device, and the rule
    table of all clinics and devices: a clinic leaves out some template rules."""
    tmpl = F.array(*[F.struct(F.lit(i).alias("rule_no"), *[F.lit(v).cast("int" if c == "LENGTH" else "string").alias(c)
                     for c, v in zip(JR.REQUIRED_COLUMNS[2:], r[2:], strict=True)]) for i, r in enumerate(JR.DEFAULT_RULES, 1)])
    rules = table(spark, d, "customer").select(F.col("c_custkey").alias("CUSTOMER_ID"), F.explode(tmpl).alias("t")).select("CUSTOMER_ID", "t.*")
    rules = rules.where((F.col("SOURCE") == "TREATMENT") & ((F.col("CUSTOMER_ID") + F.col("rule_no")) % 7 != 0))
    both = F.when(F.col("DEVICE") == "BOTH", F.array(F.lit("AMIA"), F.lit("CLARIA"))).otherwise(F.array("DEVICE"))
    rules = rules.withColumn("DEVICE", F.explode(both))
    clinic = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("CUSTOMER_ID"),
                                              F.when(F.col("o_orderkey") % 2 == 0, "AMIA").otherwise("CLARIA").alias("DEVICE"))
    return device_records(spark, d).join(clinic.hint("merge"), "doc_id"), rules


def _clinic_sql(final_sql: str) -> str:
    """The checks of all template rules, those kept that hold for the document's clinic and device."""
    device = " OR ".join(f"(rule_no = {i} AND {'true' if r[2] == 'BOTH' else f'{_DEVICE_SQL} = ' + repr(r[2])})"
                         for i, r in enumerate(JR.DEFAULT_RULES, 1) if r[3] == "TREATMENT")
    return with_checks(f"""
, cfce AS (
  SELECT f.* FROM fce f JOIN orders o ON o.o_orderkey = f.doc_id JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE (c.c_custkey + rule_no) % 7 <> 0 AND ({device}))
{final_sql}""", rules=JR.DEFAULT_RULES)


_DEVICE_SQL = "(CASE WHEN doc_id % 2 = 0 THEN 'AMIA' ELSE 'CLARIA' END)"


@query("json_rule_index", _clinic_sql("""
SELECT doc_id, rule_no, field_path, extract_column, data_type, is_required, is_valid,
       array_to_string(errors, '; ') AS errors, is_required_missing, actual_value FROM cfce"""))
def q_rule_index(spark, d):
    """V11 with P10 as a join: every document against the rules of its clinic and device."""
    fc = I.field_checks(*_clinic_tables(spark, d), _SCOPE)
    return fc.select(*[F.array_join("errors", "; ").alias("errors") if c == "errors" else c for c in _FC])


@query("json_rule_index_findings", _clinic_sql("""
SELECT doc_id, rule_no, field_path, 'error' AS severity, unnest(errors) AS message,
       unnest(range(CAST(len(errors) AS BIGINT))) AS err_no FROM cfce
UNION ALL SELECT doc_id, NULL, NULL, 'warning', warning, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 FROM wr
UNION ALL SELECT doc_id, 0, NULL, 'error', 'Validation error: document is not valid JSON', 0 FROM docs WHERE NOT json_valid(json)"""))
def q_rule_index_findings(spark, d):
    """U3 by the same join: what fails, and the warnings."""
    return I.findings(*_clinic_tables(spark, d), _SCOPE)


@query("json_rule_index_summary", _clinic_sql("""
SELECT d.doc_id, json_valid(d.json) AND coalesce(f.failed, 0) = 0 AS is_valid, coalesce(f.total, 0) AS total_fields_checked,
  coalesce(f.passed, 0) AS passed_validation, coalesce(f.failed, 0) AS failed_validation,
  coalesce(f.missing, '') AS missing_required_fields, coalesce(w.n, 0) AS warning_count
FROM docs d
LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE is_valid) AS passed, count(*) FILTER (WHERE NOT is_valid) AS failed,
                  string_agg(CASE WHEN is_required_missing THEN field_path END, '|' ORDER BY rule_no, idx) AS missing
           FROM cfce GROUP BY doc_id) f ON d.doc_id = f.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM wr GROUP BY doc_id) w ON d.doc_id = w.doc_id"""))
def q_rule_index_summary(spark, d):
    """V12 by the same join, one row a document."""
    return I.summary(*_clinic_tables(spark, d), _SCOPE)
