"""JSON documents checked against a table of rules (SURVEY 2.10, V1-V15,
A6-A8, A13, W3, W6).

Plan.  Rules are few and known when the query is built, so the rule table is
read once (its size checked) and each rule is compiled into one struct
expression; all rules of a document are evaluated in one projection over the
parsed Variant and exploded once.  The document is parsed once
(``try_parse_json`` in its own projection).  Per-document results (summary,
warnings, report lines) are computed on that row too, so the only shuffles are
the batch-level aggregates (totals, error frequencies), which are
partial-aggregated map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.functions.gen import explode_kept, inline_kept, posexplode_kept
from recordchecks.functions.jsonpath import lookup, steps, targets, targets_path
from recordchecks.rules import json_rules as JR

# Rules compiled into one projection at most this many at a time; a larger
# table is compiled in several projections over the same parsed column.
MAX_RULES_PER_PROJECTION = 300
# A rule table larger than this is not a configuration table.
MAX_RULES = 20_000
_DETAILS = ("array<struct<rule_no:int,field_path:string,extract_column:string,data_type:string,is_required:boolean,"
            "errors:array<string>,is_required_missing:boolean,actual_value:string>>")


@dataclass(frozen=True)
class Rule:
    rule_no: int
    path: str
    extract_column: str | None
    data_type: str
    nullability: str | None
    ts_format: str | None
    length: int | None
    path_error: str | None = None  # the path cannot be read; every document gets this as an error


# ------------------------------------------------------------------ sources
def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules CSV with a header; reject when any required column is absent,
    naming all that are absent."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in JR.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df.select(
        F.col("CUSTOMER_ID").try_cast("bigint").alias("CUSTOMER_ID"),
        *[F.col(c) for c in JR.REQUIRED_COLUMNS[1:9]],
        F.col("LENGTH").try_cast("double").try_cast("int").alias("LENGTH"))


def rules_frame(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or JR.DEFAULT_RULES, JR.RULES_SCHEMA)


def filter_rules(rules: DataFrame, device: str = "BOTH", customer_id: int = 1,
                 source: str = "TREATMENT") -> DataFrame:
    """P10: customer and source match; device matches or the rule is BOTH."""
    return rules.where((F.col("CUSTOMER_ID") == customer_id) & (F.col("SOURCE") == source)
                       & ((F.col("DEVICE") == device) | (F.col("DEVICE") == "BOTH")))


def _rule(no: int, r) -> Rule:
    try:
        steps(r["JSON_ATTRIBUTE_NAME"])
        error = None
    except ValueError as e:
        error = f"Validation error: {e}"
    return Rule(no, r["JSON_ATTRIBUTE_NAME"], r["EXTRACT_QRY_COLUMN"], r["DATATYPE"] or "",
                r["JSON_ATTRIBUTE_NULLABILITY"], r["TS_FORMAT"], r["LENGTH"], error)


def compile_rules(rules: DataFrame) -> list[Rule]:
    """Read the (filtered) rule table once, numbered in its order.  Every rule
    becomes expressions of the plan, so this is for configuration tables; its
    size is checked on the read itself, which stops after one row too many."""
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; operators.rule_index joins rule tables of any size")
    return [_rule(i + 1, r) for i, r in enumerate(rows)]


# ------------------------------------------------------------------ value helpers
def _kind(t: Column) -> Column:
    """JSON kind by the schema of a Variant: str int float bool list dict null, NULL if absent."""
    return (F.when(t.isNull(), F.lit(None))
            .when(t == "STRING", "str")
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
            .when(t == "BOOLEAN", "bool")
            .when(t.startswith("ARRAY"), "list")
            .when(t.startswith("OBJECT"), "dict")
            .when(t == "VOID", "NoneType")
            .otherwise("str"))


def _str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _num(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _str_float(s: Column) -> Column:
    """Float value of a numeric string, NULL otherwise."""
    return F.when(s.rlike(JR.FLOAT_PATTERN), F.trim(s).try_cast("double"))


def _str_int(s: Column) -> Column:
    return F.when(s.rlike(JR.INT_PATTERN), F.trim(s).try_cast("double"))


def _told(when: Column, text: Column | str) -> Column:
    """The text in an array, or an empty array.  Arrays of texts are put together with
    ``concat``: ``array_compact`` is a higher-order function, whose arguments are
    interpreted, so a check inside of it would never be compiled."""
    return F.when(when, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(F.array().cast("array<string>"))


def _forms(v: Column, kind: Column) -> list[Column]:
    """String and number form of a value."""
    return [F.when(kind == "str", _str(v)).alias("s"), F.when(kind.isin("int", "float"), _num(v)).alias("num")]


def _enrich(t: Column) -> Column:
    """One target plus its JSON kind, string and number forms."""
    kind = _kind(F.schema_of_variant(t["value"]))
    return F.struct(t["field_path"].alias("field_path"), t["value"].alias("value"), kind.alias("kind"), *_forms(t["value"], kind))


def _enriched(found: Column) -> Column:
    """Targets plus JSON kind, string and number forms; a transform for each step, so
    every one is computed once and the checks only read struct fields."""
    typed = F.transform(found, lambda t: F.struct(t["field_path"], t["value"], F.schema_of_variant(t["value"]).alias("schema")))
    kinds = F.transform(typed, lambda t: F.struct(t["field_path"], t["value"], _kind(t["schema"]).alias("kind")))
    return F.transform(kinds, lambda t: F.struct(t["field_path"], t["value"], t["kind"], *_forms(t["value"], t["kind"])))


def _type_error(e: Column, dtype: str) -> Column:
    """V5 (D18): message in an array, empty when the type is acceptable."""
    dt = dtype.upper()
    kind, s, n = e["kind"], e["s"], e["num"]
    if dt == "STRING":
        ok = kind == "str"
        what = "string"
    elif dt in ("NUMBER", "DECIMAL"):
        ok = kind.isin("int", "float") | ((kind == "str") & _str_float(s).isNotNull())
        what = "number"
    elif dt == "INTEGER":
        ok = ((kind == "int") | ((kind == "float") & (n == F.floor(n)))
              | ((kind == "str") & _str_int(s).isNotNull()))
        what = "integer"
    else:
        return F.array().cast("array<string>")
    return _told(~F.coalesce(ok, F.lit(False)) & kind.isNotNull(), F.concat(F.lit(f"Expected {what}, got "), kind))


def _ts_ok(s: Column, fmt: str) -> Column:
    pats = [JR.TS_FORMATS[fmt]] if fmt in JR.TS_FORMATS else JR.FALLBACK_FORMATS
    ok = None
    for p in pats:
        t = (s.rlike(JR.TIME_SHAPES[p]) if p in JR.TIME_SHAPES
             else s.rlike(JR.FORMAT_SHAPES[p]) & F.try_to_timestamp(s, F.lit(p)).isNotNull())
        ok = t if ok is None else (ok | t)
    return ok


def _range_errors(path: str, e: Column) -> list[Column]:
    """V8: an array with a message or none per range rule whose keyword is in the path.
    For a plain path the keyword test is decided when the rule is compiled;
    wildcard targets keep the same keywords (the index adds none)."""
    return [_range_error(e, *r[1:]) for r in JR.RANGE_RULES if r[0] in path]


def _range_error(e: Column, lo, lo_open: bool, hi, int_only: bool, string_only: bool, msg: str) -> Column:
    kind, s = e["kind"], e["s"]
    if string_only:
        x = F.when(kind == "str", _str_int(s) if int_only else _str_float(s))
    else:
        x = F.when(kind.isin("int", "float"), e["num"]).when(kind == "str", _str_float(s))
    low_bad = (x <= lo) if lo_open else (x < lo)
    return _told(low_bad | (x > hi), msg)


def _actual(e: Column) -> Column:
    kind = e["kind"]
    return (F.when(kind == "str", e["s"])
            .when(kind == "int", _str(e["value"]))  # never through a double: 2^53 + 1 stays itself
            .when(kind == "float", e["num"].cast("string"))
            .when(kind == "bool", _str(e["value"]))
            .when(kind.isNotNull() & (kind != "NoneType"), F.to_json(e["value"])))


def _check_target(rule: Rule, e: Column) -> Column:
    """One enriched (rule, target) -> result struct."""
    kind = e["kind"]
    required = (rule.nullability or "") == "N"
    missing = e["value"].isNull() | (kind == "NoneType") | ((kind == "str") & (e["s"] == ""))
    errs = [_type_error(e, rule.data_type)]
    if rule.length is not None:
        errs.append(_told((kind == "str") & (F.length(e["s"]) > F.lit(int(rule.length))),
                          F.concat(F.lit("Length "), F.length(e["s"]).cast("string"),
                                    F.lit(f" exceeds maximum {int(rule.length)}"))))
    if rule.ts_format is not None:
        errs.append(F.when(kind != "str", F.array(F.lit(JR.MSG_TS_NOT_STRING))).otherwise(
            _told(~_ts_ok(e["s"], rule.ts_format), f"Invalid timestamp format. Expected: {rule.ts_format}")))
    errs += _range_errors(rule.path, e)
    checked = F.concat(*errs)
    errors = (F.when(missing & F.lit(required), F.array(F.lit(JR.MSG_REQUIRED)))
              .when(missing, F.array().cast("array<string>"))
              .otherwise(checked))
    return F.struct(
        F.lit(rule.rule_no).alias("rule_no"), e["field_path"].alias("field_path"),
        F.lit(rule.extract_column).cast("string").alias("extract_column"),
        F.lit(rule.data_type).alias("data_type"), F.lit(required).alias("is_required"),
        errors.alias("errors"),
        (missing & F.lit(required)).alias("is_required_missing"),
        _actual(e).alias("actual_value"))


def _bad_path(rule: Rule) -> Column:
    """Result of a rule whose path cannot be read: one error, the job goes on."""
    return F.struct(
        F.lit(rule.rule_no).alias("rule_no"), F.lit(rule.path).alias("field_path"),
        F.lit(rule.extract_column).cast("string").alias("extract_column"), F.lit(rule.data_type).alias("data_type"),
        F.lit((rule.nullability or "") == "N").alias("is_required"), F.array(F.lit(rule.path_error)).alias("errors"),
        F.lit(False).alias("is_required_missing"), F.lit(None).cast("string").alias("actual_value"))


def _rule_results(v: Column, rule: Rule) -> Column:
    return F.transform(_enriched(targets(v, rule.path)), lambda e: _check_target(rule, e))


_WATCHED = sorted(set(JR.OPTIONAL_MEDICAL_FIELDS) | {p for p, _, _ in JR.EXTREME_CHECKS})


def _with_values(parsed: DataFrame, paths: list[str]) -> DataFrame:
    """``doc_id, v`` and for path ``i`` its value ``x{i}``, kind ``k{i}`` and forms ``s{i}``, ``n{i}``.

    Plain columns, each made in a projection of its own and read more than once by the
    next, so no step is copied into its readers (a struct that is only read by field would be)."""
    at = range(len(paths))
    xs = [f"x{i}" for i in at]
    p = parsed.select("doc_id", "v", *[lookup(F.col("v"), steps(path)).alias(x) for path, x in zip(paths, xs, strict=True)])
    p = p.select("doc_id", "v", *xs, *[F.schema_of_variant(x).alias(f"y{i}") for i, x in enumerate(xs)])
    p = p.select("doc_id", "v", *xs, *[_kind(F.col(f"y{i}")).alias(f"k{i}") for i in at])
    forms = [f.alias(f"{n}{i}") for i in at for f, n in zip(_forms(F.col(f"x{i}"), F.col(f"k{i}")), "sn", strict=True)]
    return p.select("doc_id", "v", *xs, *[f"k{i}" for i in at], *forms)


def _target(path: str, i: int) -> dict[str, Column]:
    return {"field_path": F.lit(targets_path(path)), "value": F.col(f"x{i}"), "kind": F.col(f"k{i}"), "s": F.col(f"s{i}"), "num": F.col(f"n{i}")}


def _warnings(at: dict[str, dict[str, Column]]) -> Column:
    """V9 + V10: data-quality warnings of one document, in order."""
    out = []
    for p in JR.OPTIONAL_MEDICAL_FIELDS:
        e = at[p]
        miss = e["value"].isNull() | (e["kind"] == "NoneType") | ((e["kind"] == "str") & (e["s"] == ""))
        out.append(_told(F.coalesce(miss, F.lit(False)), f"Optional medical field {p} is missing"))
    for p, lo, hi in JR.EXTREME_CHECKS:
        e = at[p]
        num = F.when(e["kind"].isin("int", "float"), e["num"]).when(e["kind"] == "str", _str_float(e["s"]))
        shown = (F.when(e["kind"] == "str", e["s"])
                 .when(e["kind"] == "int", _str(e["value"]))
                 .otherwise(e["num"].cast("string")))
        out.append(_told((num < lo) | (num > hi),
                         F.concat(F.lit(f"Extreme value in {p}: "), shown,
                                  F.lit(f" (expected {lo}-{hi})"))))
    return F.concat(*out)


# ------------------------------------------------------------------ the job
def _is_plain(rule: Rule) -> bool:
    return rule.path_error is None and "[*]" not in steps(rule.path)


def validate(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id",
             json_col: str = "json") -> DataFrame:
    """Per document: ``(doc_id, parsed, details array<struct>, warnings)``.

    ``details`` holds one struct per (rule, target) in rule order;
    unparseable documents get no details and one error (V15).  A plain path
    is looked up and typed in staged columns and checked without a lambda
    (codegen); only ``[*]`` rules use ``transform``.  Rules are
    compiled ``MAX_RULES_PER_PROJECTION`` at a time."""
    p = docs.select(F.col(id_col).alias("doc_id"), F.try_parse_json(F.col(json_col)).alias("v"))
    v = F.col("v")
    paths = list(dict.fromkeys([r.path for r in rules if _is_plain(r)] + _WATCHED))
    at = {path: _target(path, i) for i, path in enumerate(paths)}
    staged = _with_values(p, paths)
    chunks = [rules[i:i + MAX_RULES_PER_PROJECTION]
              for i in range(0, len(rules), MAX_RULES_PER_PROJECTION)] or [[]]
    cols = []
    for n, chunk in enumerate(chunks):
        parts = [F.array(_bad_path(r)) if r.path_error else
                 F.array(_check_target(r, at[r.path])) if _is_plain(r) else _rule_results(v, r)
                 for r in chunk]
        arr = F.concat(*parts) if parts else F.array().cast(_DETAILS)
        cols.append(arr.alias(f"d{n}"))
    checked = staged.select("doc_id", "v", *cols, _warnings(at).alias("warnings"))
    details = F.concat(*[F.col(f"d{n}") for n in range(len(chunks))]) if len(chunks) > 1 else F.col("d0")
    return checked.select("doc_id", F.col("v").isNotNull().alias("parsed"),
                          F.when(F.col("v").isNotNull(), details).alias("details"),
                          F.when(F.col("v").isNotNull(), F.col("warnings"))
                          .otherwise(F.array().cast("array<string>")).alias("warnings"))


def doc_errors(validated: DataFrame) -> Column:
    """All error texts of a document in rule order; parse failure = one."""
    return F.when(F.col("parsed"), F.flatten(F.col("details")["errors"])).otherwise(
        F.array(F.lit("Validation error: document is not valid JSON")))


def field_checks(validated: DataFrame) -> DataFrame:
    """One row per (document, rule, target)."""
    fc = inline_kept(validated, ["doc_id"], "details", "rule_no")
    return fc.select("doc_id", "rule_no", "field_path", "extract_column", "data_type", "is_required",
                     (F.size("errors") == 0).alias("is_valid"), "errors", "is_required_missing",
                     "actual_value")


def field_checks_in_parts(docs: DataFrame, rules: DataFrame, part: int = MAX_RULES, **kw) -> DataFrame:
    """V11 for a rule table of any size: its rules are compiled ``part`` at a
    time, one pass over the documents each; the rows are those of one pass."""
    out, held = None, []

    def with_held():
        checks = field_checks(validate(docs, held, **kw))
        return checks if out is None else out.unionByName(checks)
    for i, r in enumerate(rules.toLocalIterator(), 1):
        held = [*held, _rule(i, r)]
        if len(held) == part:
            out, held = with_held(), []
    return with_held() if held or out is None else out


def findings(validated: DataFrame) -> DataFrame:
    """Errors (one row each, with field path and rule) and warnings, built
    as one array on the document's row and exploded once."""
    def row(rule_no, path, no, severity, message):
        return F.struct(rule_no.cast("int").alias("rule_no"), path.cast("string").alias("field_path"), no.cast("int").alias("err_no"),
                        F.lit(severity).alias("severity"), message.alias("message"))
    none = F.lit(None)
    errs = F.flatten(F.transform("details", lambda d: F.transform(
        d["errors"], lambda e, i: row(d["rule_no"], d["field_path"], i, "error", e))))
    warns = F.transform("warnings", lambda w, i: row(none, none, i, "warning", w))
    bad = F.array(row(F.lit(0), none, F.lit(0), "error", F.lit("Validation error: document is not valid JSON")))
    return inline_kept(validated, ["doc_id"], F.when(F.col("parsed"), F.concat(errs, warns)).otherwise(bad), "severity")


def _details() -> Column:
    """Details, empty for a document that is not JSON.  Read twice: a column read once would be
    copied into the higher-order functions around it, which interpret their arguments."""
    return F.when(F.col("details").isNotNull(), F.col("details")).otherwise(F.array())


def summary(validated: DataFrame) -> DataFrame:
    """Per document, computed on its own row (no shuffle)."""
    d = _details()
    failed = F.size(F.filter(d, lambda x: F.size(x["errors"]) > 0))
    missing = F.transform(F.filter(d, lambda x: x["is_required_missing"]), lambda x: x["field_path"])
    return validated.select(
        "doc_id",
        (F.col("parsed") & (failed == 0)).alias("is_valid"),
        F.size(d).cast("bigint").alias("total_fields_checked"),
        F.size(F.filter(d, lambda x: F.size(x["errors"]) == 0)).cast("bigint").alias("passed_validation"),
        failed.cast("bigint").alias("failed_validation"),
        F.array_join(missing, "|").alias("missing_required_fields"),
        F.size("warnings").cast("bigint").alias("warning_count"))


def batch_totals(validated: DataFrame) -> DataFrame:
    """One global aggregate."""
    s = summary(validated)
    return s.agg(F.count(F.lit(1)).alias("total_files"),
                 F.count_if(F.col("is_valid")).alias("valid_files"),
                 F.count_if(~F.col("is_valid")).alias("invalid_files"))


def common_errors(validated: DataFrame, by_field: bool = False) -> DataFrame:
    """Error frequency by text (D23: optionally by field too).  Partial
    aggregation map side: a text that is a third of all errors still sends
    one row per map task."""
    e = explode_kept(validated, ["doc_id"], doc_errors(validated), "error")
    if by_field:
        e = explode_kept(field_checks(validated), ["field_path"], "errors", "error")
        return e.groupBy("field_path", "error").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def quality_issues(validated: DataFrame) -> DataFrame:
    """Warning rows tagged with their document."""
    return explode_kept(validated, ["doc_id"], "warnings", "warning")


def top_errors(validated: DataFrame, n: int = 5) -> DataFrame:
    """Most common errors; ties by text."""
    from recordchecks.operators.basics import top_n
    return top_n(common_errors(validated), "n", "error", n)


def report_lines(validated: DataFrame, n_errors: int = 10, n_warnings: int = 5,
                 n_missing: int = 5, n_details: int = 5) -> DataFrame:
    """Report sections as ordered rows ``(doc_id, section, ord, line)``.
    Lists are truncated per document on its own row."""
    d = _details()
    errs = doc_errors(validated)
    failed = F.size(F.filter(d, lambda x: F.size(x["errors"]) > 0))
    valid = F.col("parsed") & (failed == 0)
    summary_lines = F.array(
        F.concat(F.lit("Total Fields Checked: "), F.size(d).cast("string")),
        F.concat(F.lit("Passed Validation: "), F.size(F.filter(d, lambda x: F.size(x["errors"]) == 0)).cast("string")),
        F.concat(F.lit("Failed Validation: "), failed.cast("string")),
        F.concat(F.lit("Overall Status: "), F.when(valid, "PASS").otherwise("FAIL")))
    more = F.when(F.size(errs) > n_errors, F.array(F.concat(
        F.lit("... and "), (F.size(errs) - n_errors).cast("string"), F.lit(" more errors"))))
    err_lines = F.concat(F.transform(F.slice(errs, 1, n_errors), lambda e: F.concat(F.lit("• "), e)),
                         F.coalesce(more, F.array().cast("array<string>")))
    warn_lines = F.transform(F.slice("warnings", 1, n_warnings), lambda w: F.concat(F.lit("⚠ "), w))
    miss = F.transform(F.filter(d, lambda x: x["is_required_missing"]), lambda x: x["field_path"])
    miss_lines = F.transform(F.slice(miss, 1, n_missing), lambda m: F.concat(F.lit("✗ "), m))
    det_lines = F.transform(F.slice(d, 1, n_details), lambda x: F.when(
        F.size(x["errors"]) == 0, F.concat(F.lit("✓ "), x["field_path"])).otherwise(
        F.concat(F.lit("✗ "), x["field_path"], F.lit(" - Errors: "), F.array_join(x["errors"], ", "))))
    sections = F.array(*[F.struct(F.lit(name).alias("section"), arr.alias("lines"))
                         for name, arr in (("summary", summary_lines), ("errors", err_lines),
                                           ("warnings", warn_lines), ("missing", miss_lines),
                                           ("details", det_lines))])
    return posexplode_kept(inline_kept(validated, ["doc_id"], sections, "section"),
                           ["doc_id", "section"], "lines", "ord", "line")


def bad_docs(validated: DataFrame) -> DataFrame:
    """Documents that are not valid JSON, one error row each."""
    return validated.where(~F.col("parsed")).select(
        "doc_id", F.lit("Validation error: document is not valid JSON").alias("error"))
