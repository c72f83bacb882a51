"""Schema contracts between an expected and an extracted table.

C1-C9 compare schemas.  A schema is metadata - the driver reads it from the
plan without running a job - so the field tables are built from
``df.schema`` and compared with DataFrame joins (they are tiny and broadcast
automatically).  Many sources are checked together by unioning their field
tables; everything downstream is keyed by ``source``.

C10 is the part that touches data: for every mismatched column, the rows whose
value does not cast to the expected type, and the NULLs where the contract
says NOT NULL - all columns of a source in one aggregate pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordchecks.rules.schema_rules import coercion_pairs

FIELDS_SCHEMA = ("source string, side string, ordinal int, name string, type_name string, "
                 "type_family string, nullable boolean")


@dataclass
class Contract:
    source: str
    expected: StructType
    actual: DataFrame
    allow_type_coercion: bool = False
    ignore_extra_columns: bool = False


def _family(dt) -> str:
    return dt.typeName()


def schema_fields(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """``(source, side, ordinal, name, type_name, type_family, nullable)``."""
    rows = []
    for c in contracts:
        for side, schema in (("expected", c.expected), ("actual", c.actual.schema)):
            for i, f in enumerate(schema.fields):
                rows.append((c.source, side, i, f.name, f.dataType.simpleString(), _family(f.dataType),
                             f.nullable))
    return spark.createDataFrame(rows, FIELDS_SCHEMA)


def _flags(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    return spark.createDataFrame(
        [(c.source, c.allow_type_coercion, c.ignore_extra_columns) for c in contracts],
        "source string, allow_type_coercion boolean, ignore_extra_columns boolean")


def _pylist(col):
    """Sorted names rendered as a Python list: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(col), lambda x: F.concat(
        F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def findings(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """``(source, section, severity, column_name, message)``.

    ``section`` orders the report: count, missing, extra, type, nullable.
    Duplicate names on one side are reported as an error (D27)."""
    f = schema_fields(spark, contracts)
    fl = _flags(spark, contracts)
    e = f.where(F.col("side") == "expected").alias("e")
    a = f.where(F.col("side") == "actual").alias("a")
    per = (f.groupBy("source").agg(
        F.count_if(F.col("side") == "expected").alias("n_exp"),
        F.count_if(F.col("side") == "actual").alias("n_act")).join(fl, "source"))
    count_f = per.where((F.col("n_exp") != F.col("n_act")) & ~F.col("ignore_extra_columns")).select(
        "source", F.lit(1).alias("section"), F.lit("error").alias("severity"),
        F.lit(None).cast("string").alias("column_name"),
        F.format_string("Column count mismatch: Expected %d, Found %d columns", "n_exp", "n_act").alias("message"))
    names = f.groupBy("source", "side").agg(F.collect_set("name").alias("names"))
    pivot = (names.groupBy("source").agg(
        F.max(F.when(F.col("side") == "expected", F.col("names"))).alias("en"),
        F.max(F.when(F.col("side") == "actual", F.col("names"))).alias("an")).join(fl, "source"))
    missing = F.array_except(F.coalesce("en", F.array()), F.coalesce("an", F.array()))
    extra = F.array_except(F.coalesce("an", F.array()), F.coalesce("en", F.array()))
    miss_f = pivot.where(F.size(missing) > 0).select(
        "source", F.lit(2).alias("section"), F.lit("error").alias("severity"),
        F.lit(None).cast("string").alias("column_name"),
        F.concat(F.lit("Missing columns: "), _pylist(missing)).alias("message"))
    extra_f = pivot.where((F.size(extra) > 0) & ~F.col("ignore_extra_columns")).select(
        "source", F.lit(3).alias("section"), F.lit("warning").alias("severity"),
        F.lit(None).cast("string").alias("column_name"),
        F.concat(F.lit("Extra columns: "), _pylist(extra)).alias("message"))
    both = (e.join(a, (F.col("e.source") == F.col("a.source")) & (F.col("e.name") == F.col("a.name")))
            .join(fl, F.col("e.source") == fl["source"]))
    pairs = spark.createDataFrame(coercion_pairs(), "t1 string, t2 string")
    typed = both.where(F.col("e.type_name") != F.col("a.type_name")).join(
        F.broadcast(pairs), (F.col("e.type_family") == pairs["t1"]) & (F.col("a.type_family") == pairs["t2"]),
        "left")
    coercible = F.col("allow_type_coercion") & F.col("t1").isNotNull()
    type_f = typed.select(
        F.col("e.source").alias("source"), F.lit(4).alias("section"),
        F.when(coercible, "warning").otherwise("error").alias("severity"),
        F.col("e.name").alias("column_name"),
        F.when(coercible, F.format_string('Type mismatch (coercible) for "%s": %s -> %s', F.col("e.name"),
                                          F.col("e.type_name"), F.col("a.type_name")))
        .otherwise(F.format_string('Type mismatch for "%s": Expected %s, Found %s', F.col("e.name"),
                                   F.col("e.type_name"), F.col("a.type_name"))).alias("message"))
    pyb = lambda c: F.when(c, "True").otherwise("False")
    null_f = both.where(F.col("e.nullable") != F.col("a.nullable")).select(
        F.col("e.source").alias("source"), F.lit(5).alias("section"), F.lit("warning").alias("severity"),
        F.col("e.name").alias("column_name"),
        F.concat(F.lit('Nullable mismatch for "'), F.col("e.name"), F.lit('": Expected '),
                 pyb(F.col("e.nullable")), F.lit(", Found "), pyb(F.col("a.nullable"))).alias("message"))
    dup_f = (f.groupBy("source", "side", "name").count().where(F.col("count") > 1).select(
        "source", F.lit(0).alias("section"), F.lit("error").alias("severity"), F.col("name").alias("column_name"),
        F.concat(F.lit("Duplicate column name on the "), F.col("side"), F.lit(" side: "), F.col("name"))
        .alias("message")))
    return (dup_f.unionByName(count_f).unionByName(miss_f).unionByName(extra_f)
            .unionByName(type_f).unionByName(null_f))


def verdict(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """Per source: valid iff no error; counts of each side's columns."""
    fnd = findings(spark, contracts)
    f = schema_fields(spark, contracts)
    cnt = f.groupBy("source").agg(F.count_if(F.col("side") == "expected").alias("expected_columns"),
                                  F.count_if(F.col("side") == "actual").alias("extracted_columns"))
    agg = fnd.groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("error_count"),
                                    F.count_if(F.col("severity") == "warning").alias("warning_count"))
    out = cnt.join(agg, "source", "left").fillna(0, ["error_count", "warning_count"])
    return out.select("source", (F.col("error_count") == 0).alias("is_valid"), "expected_columns",
                      "extracted_columns", "error_count", "warning_count")


def report(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """Difference report as ordered rows ``(source, section, ord, line)``."""
    fnd = findings(spark, contracts)
    v = verdict(spark, contracts)
    ok = v.where("is_valid").select("source", F.lit(0).alias("section"), F.lit(0).alias("ord"),
                                    F.format_string("Schema validation passed for '%s'", "source").alias("line"))
    lines = fnd.join(v.where(~F.col("is_valid")).select("source"), "source").select(
        "source", "section", F.lit(1).alias("ord"),
        F.concat(F.when(F.col("severity") == "error", "ERROR: ").otherwise("WARNING: "), F.col("message"))
        .alias("line"))
    return ok.unionByName(lines)


def conformance(contract: Contract) -> DataFrame:
    """For each column present on both sides whose type differs, rows
    whose value does not cast to the expected type; for each column the
    contract declares NOT NULL, the NULL rows.  One aggregate over the data."""
    exp = {f.name: f for f in contract.expected.fields}
    act = {f.name: f for f in contract.actual.schema.fields}
    checks = []
    for name in [n for n in exp if n in act]:
        ef, af = exp[name], act[name]
        typed = ef.dataType.simpleString() != af.dataType.simpleString()
        if not typed and ef.nullable:
            continue
        bad_cast = (F.count_if(F.col(name).isNotNull() & F.col(name).try_cast(ef.dataType).isNull())
                    if typed else F.lit(0).cast("bigint"))
        bad_null = F.count_if(F.col(name).isNull()) if not ef.nullable else F.lit(0).cast("bigint")
        checks.append((name, ef.dataType.simpleString(), af.dataType.simpleString(), bad_cast, bad_null))
    if not checks:
        return contract.actual.sparkSession.createDataFrame(
            [], "source string, column_name string, expected_type string, actual_type string, "
                "n_rows bigint, n_uncastable bigint, n_null_violations bigint")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, (_, _, _, bc, bn) in enumerate(checks):
        aggs += [bc.alias(f"c{i}"), bn.alias(f"n{i}")]
    one = contract.actual.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(et).alias("expected_type"),
                              F.lit(at).alias("actual_type"), F.col(f"c{i}").alias("n_uncastable"),
                              F.col(f"n{i}").alias("n_null_violations"))
                     for i, (n, et, at, _, _) in enumerate(checks)])
    return one.select(F.lit(contract.source).alias("source"), "n_rows", F.inline(rows)).select(
        "source", "column_name", "expected_type", "actual_type", "n_rows", "n_uncastable", "n_null_violations")
