"""Configuration operators over a multi-clinic configuration that grows with
the data: every customer is a clinic with its own copy of the rule and
mapping templates (S4 rules CSV, P10 rule filter, G1 mapping compile).
The copies are made by exploding a literal template array on each customer
row - narrow, no join."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.operators import hl7_build as B
from recordchecks.operators import json_rules as J
from recordchecks.plans.hl7_sql import sq
from recordchecks.plans.registry import query
from recordchecks.rules import hl7_mapping as M
from recordchecks.rules import json_rules as JR
from recordchecks.session import shared_path
from recordchecks.sources.tables import table

_RULE_COLS = JR.REQUIRED_COLUMNS[2:]  # DEVICE .. LENGTH, per template
_MAP_COLS = ["SEGMENT", "SEGMENT_ID", "CHILD_OBR", "JSON_ATTRIBUTE", "HL7_KEY", "IDENTIFIER", "DISPLAY_NAME",
             "DATA_TYPE", "UNIT", "SEQUENCE"]


def _lit(v, ty):
    return F.lit(v).cast(ty)


def clinic_rules(spark, d):
    tmpl = F.array(*[F.struct(*[_lit(v, "int" if c == "LENGTH" else "string").alias(c)
                                for c, v in zip(_RULE_COLS, r[2:])]) for r in JR.DEFAULT_RULES])
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.explode(tmpl).alias("t"))
    return c.select(F.col("c_custkey").alias("CUSTOMER_ID"), F.col("c_name").alias("CUSTOMER_NAME"),
                    *[F.col(f"t.{x}").alias(x) for x in _RULE_COLS])


def clinic_mapping(spark, d):
    tmpl = F.array(*[F.struct(*[_lit(v, "string").alias(c) for c, v in zip(_MAP_COLS, r)])
                     for r in M.DEFAULT_MAPPING])
    c = table(spark, d, "customer").select("c_custkey", F.explode(tmpl).alias("t"))
    return c.select(F.col("c_custkey").alias("customer_id"), *[F.col(f"t.{x}").alias(x) for x in _MAP_COLS])


def _values(rows, cols):
    def v(x):
        return "NULL" if x is None else (str(x) if isinstance(x, int) else sq(x))
    return "(VALUES " + ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows) + f") t({', '.join(cols)})"


_RULES_SQL = f"""
SELECT c_custkey AS CUSTOMER_ID, c_name AS CUSTOMER_NAME, t.*
FROM customer CROSS JOIN {_values([r[2:] for r in JR.DEFAULT_RULES], _RULE_COLS)}"""


@query("json_rules", _RULES_SQL)
def q_rules(spark, d):
    """The clinic rule table written as headed CSV to the shared folder,
    read back with the required-column check."""
    path = shared_path(spark, "clinic_rules_csv")
    clinic_rules(spark, d).write.option("header", True).csv(path)
    return J.load_rules(spark, path)


@query("json_rule_filter", "SELECT * FROM (" + _RULES_SQL + """) r
WHERE CUSTOMER_ID = 1 AND SOURCE = 'TREATMENT' AND (DEVICE = 'AMIA' OR DEVICE = 'BOTH')""")
def q_rule_filter(spark, d):
    """P10: rules of one clinic, source and device (or BOTH)."""
    return J.filter_rules(clinic_rules(spark, d), "AMIA", 1, "TREATMENT")


@query("hl7_mapping", f"""
WITH m AS (SELECT c_custkey AS customer_id, t.* FROM customer CROSS JOIN {_values(M.DEFAULT_MAPPING, _MAP_COLS)}),
n AS (
  SELECT customer_id, SEGMENT AS segment,
    CASE WHEN SEGMENT = 'OBX' AND coalesce(trim(CHILD_OBR), '') <> ''
           THEN upper(replace(replace(CHILD_OBR, ' ', '_'), '-', '_'))
         WHEN SEGMENT = 'OBR' THEN upper(replace(replace(JSON_ATTRIBUTE, ' ', '_'), '-', '_')) END AS section,
    upper(replace(replace(JSON_ATTRIBUTE, ' ', '_'), '-', '_')) AS attr,
    IDENTIFIER AS identifier, DISPLAY_NAME AS display_name, coalesce(DATA_TYPE, '') AS data_type,
    coalesce(UNIT, '') AS unit, coalesce(TRY_CAST(nullif(trim(SEQUENCE), '') AS INTEGER), 999) AS sequence
  FROM m)
SELECT *, row_number() OVER (PARTITION BY customer_id, segment, section ORDER BY sequence, attr) AS rank_in_group
FROM n""")
def q_mapping(spark, d):
    """S5 + G1: each clinic's mapping written as CSV to the shared folder,
    read back with its schema, and compiled: normalised attribute, section,
    sequence (empty = 999), rank inside its segment / section."""
    path = shared_path(spark, "clinic_mapping_csv")
    clinic_mapping(spark, d).write.option("header", True).option("emptyValue", "").csv(path)
    m = B.load_mapping(spark, path, extra_cols="customer_id BIGINT")
    return B.compile_mapping(m, group_cols=("customer_id",))
