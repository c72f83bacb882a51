"""Registered schema-contract queries: three contracts over the
driver tables - orders and lineitem against changed extracts, customer
against itself."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from recordchecks.operators import schema_contract as SC
from recordchecks.plans.registry import query
from recordchecks.plans.schema_sql import ORACLES_SCHEMA
from recordchecks.sources.tables import table

ORDERS_EXPECTED = StructType([
    StructField("o_orderkey", LongType(), False), StructField("o_custkey", LongType(), False),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
    StructField("o_orderdate", TimestampNTZType()), StructField("o_orderpriority", StringType())])
LINEITEM_EXPECTED = StructType([
    StructField("l_orderkey", LongType(), False), StructField("l_partkey", LongType()),
    StructField("l_suppkey", LongType()), StructField("l_linenumber", IntegerType()),
    StructField("l_quantity", DoubleType()), StructField("l_extendedprice", DoubleType()),
    StructField("l_discount", DoubleType()), StructField("l_tax", DoubleType()),
    StructField("l_returnflag", StringType()), StructField("l_linestatus", StringType()),
    StructField("l_shipdate", TimestampNTZType())])


def contracts(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    orders_actual = o.select(
        k.try_cast("int").alias("o_orderkey"),
        F.when(k % 71 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.when(k % 50 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        "o_orderdate", F.lit("x").alias("o_comment"))
    li = table(spark, d, "lineitem")
    lk = F.col("l_orderkey")
    li_actual = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
        F.when(lk % 60 == 0, F.lit("unknown")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("l_shipdate"))
    cust = table(spark, d, "customer")
    return [SC.Contract("orders", ORDERS_EXPECTED, orders_actual, allow_type_coercion=True),
            SC.Contract("lineitem", LINEITEM_EXPECTED, li_actual),
            SC.Contract("customer", cust.schema, cust)]


_FC = ["source", "severity", "column_name", "message"]


@query("schema_fields", ORACLES_SCHEMA["schema_fields"])
def q_fields(spark, d):
    return SC.schema_fields(spark, contracts(spark, d))


@query("schema_diff", ORACLES_SCHEMA["schema_diff"])
def q_diff(spark, d):
    f = SC.schema_fields(spark, contracts(spark, d))
    e = f.where("side = 'expected'").select("source", "name", F.col("type_name").alias("expected_type"))
    a = f.where("side = 'actual'").select("source", "name", F.col("type_name").alias("actual_type"))
    j = e.join(a, ["source", "name"], "full_outer")
    return j.select("source", "name", "expected_type", "actual_type",
                    F.when(F.col("expected_type").isNull(), "extra")
                    .when(F.col("actual_type").isNull(), "missing").otherwise("matched").alias("status"))


def _section_query(key, section, severity=None):
    @query(key, ORACLES_SCHEMA[key])
    def q(spark, d):
        f = SC.findings(spark, contracts(spark, d)).where(F.col("section") == section)
        if severity:
            f = f.where(F.col("severity") == severity)
        return f.select(*_FC)
    return q


_section_query("schema_count", 1)
_section_query("schema_missing", 2)
_section_query("schema_extra", 3)
_section_query("schema_types", 4, "error")
_section_query("schema_coercion", 4, "warning")
_section_query("schema_nullable", 5)


@query("schema_verdict", ORACLES_SCHEMA["schema_verdict"])
def q_verdict(spark, d):
    return SC.verdict(spark, contracts(spark, d))


@query("schema_report", ORACLES_SCHEMA["schema_report"])
def q_report(spark, d):
    return SC.report(spark, contracts(spark, d))


@query("schema_conformance", """
WITH oa AS (
  SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
         CASE WHEN o_orderkey % 71 <> 0 THEN o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice
  FROM orders),
la AS (
  SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS l_quantity,
         CASE WHEN l_orderkey % 60 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS l_shipdate
  FROM lineitem)
SELECT 'orders' AS source, 'o_orderkey' AS column_name, 'bigint' AS expected_type, 'int' AS actual_type,
       count(*) AS n_rows, 0 AS n_uncastable, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_null_violations FROM oa
UNION ALL SELECT 'orders', 'o_custkey', 'bigint', 'bigint', count(*), 0, count(*) FILTER (WHERE o_custkey IS NULL) FROM oa
UNION ALL SELECT 'orders', 'o_totalprice', 'double', 'string', count(*),
       count(*) FILTER (WHERE o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DOUBLE) IS NULL), 0 FROM oa
UNION ALL SELECT 'lineitem', 'l_orderkey', 'bigint', 'bigint', count(*), 0,
       count(*) FILTER (WHERE l_orderkey IS NULL) FROM la
UNION ALL SELECT 'lineitem', 'l_quantity', 'double', 'int', count(*),
       count(*) FILTER (WHERE l_quantity IS NOT NULL AND TRY_CAST(l_quantity AS DOUBLE) IS NULL), 0 FROM la
UNION ALL SELECT 'lineitem', 'l_shipdate', 'timestamp_ntz', 'string', count(*),
       count(*) FILTER (WHERE l_shipdate IS NOT NULL AND TRY_CAST(l_shipdate AS TIMESTAMP) IS NULL), 0 FROM la""")
def q_conformance(spark, d):
    out = None
    for c in contracts(spark, d):
        part = SC.conformance(c)
        out = part if out is None else out.unionByName(part)
    return out
