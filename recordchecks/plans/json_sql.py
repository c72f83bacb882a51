"""DuckDB oracle for the JSON rule checks: the same device records built
with ``json_object`` from the tables, every rule path resolved with
``json_extract`` (wildcards by index over ``json_array_length``), and each
check written as SQL over the resolved value."""

from __future__ import annotations

from recordchecks.functions.jsonpath import steps
from recordchecks.plans.hl7_sql import sq
from recordchecks.rules import json_rules as JR

DOCS_SQL = r"""
cyc AS (
  SELECT l_orderkey, sum(l_quantity) AS total_qty,
    list(json_object(
        'Therapy Cycle Time', printf('%02d:%02d:%02d', l_linenumber * 4, l_partkey % 60, l_suppkey % 60),
        'Cycle Type', l_returnflag || '-' || l_linestatus || (CASE WHEN l_linenumber = 1 THEN 'FILL' ELSE '' END),
        'CycleAttributes', json_object('Fill Volume', CAST(trunc(l_quantity) AS BIGINT), 'Fill Time', l_linenumber * 60))
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS cycles
  FROM lineitem GROUP BY l_orderkey),
docs0 AS (
  SELECT o.o_orderkey AS doc_id, CAST(json_object(
    'Patient Info', json_object(
       'ERP Patient ID', CASE WHEN o.o_orderkey % 53 = 0 THEN '' ELSE '07501-' || printf('%08d', o.o_custkey) END,
       'Clinic Patient ID', CAST(o.o_custkey AS VARCHAR),
       'Treatment ID', CASE WHEN o.o_orderkey % 59 = 1 THEN to_json('T' || o.o_orderkey) ELSE to_json(o.o_orderkey) END,
       'Device Type', CASE WHEN o.o_orderkey % 2 = 0 THEN 'AMIA' ELSE 'CLARIA' END,
       'First Name', 'FNAME-' || o.o_custkey,
       'Last Name', 'LNAME-' || o.o_custkey,
       'DOB', CASE WHEN o.o_custkey % 37 = 0 THEN '30-FEB-1985'
                   ELSE printf('%02d-%s-%04d', 1 + o.o_custkey % 28,
                               (['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'])[1 + o.o_custkey % 12],
                               1940 + o.o_custkey % 60) END),
    'Batch', json_object('ID', 'B' || o.o_orderkey, 'Date', strftime(o.o_orderdate, '%d-%b-%Y'),
                         'Time', CASE WHEN o.o_orderkey % 241 = 2 THEN to_json(915)
                                      WHEN o.o_orderkey % 3 = 0 THEN to_json('09:15:30') ELSE to_json('09:15') END, 'Type', 'Normal'),
    'Vitals', json_object(
       'Pre-Treatment', json_object(
          'Weight', CASE WHEN o.o_orderkey % 43 <> 0 THEN
             CASE WHEN o.o_orderkey % 241 = 4 THEN 1500 ELSE CAST(trunc(o.o_totalprice / 1000) AS BIGINT) END END,
          'Blood Pressure Systolic', CASE WHEN o.o_orderkey % 241 = 3 THEN '350' ELSE CAST(60 + o.o_orderkey % 160 AS VARCHAR) END,
          'Pulse', CAST(o.o_orderkey % 260 AS VARCHAR),
          'Temperature', CASE WHEN o.o_orderkey % 241 = 1 THEN 'warm' ELSE CAST(85 + o.o_orderkey % 30 AS VARCHAR) END,
          'Glucose', CASE WHEN o.o_orderkey % 61 = 0 THEN 'high' ELSE CAST(o.o_orderkey % 1100 AS VARCHAR) END),
       'Post-Treatment', json_object(
          'Weight', CASE WHEN o.o_orderkey % 2 = 0 THEN to_json(CAST(trunc(o.o_totalprice / 1000) AS BIGINT) + 1)
                         ELSE to_json(CAST(CAST(trunc(o.o_totalprice / 1000) AS BIGINT) + 1 AS VARCHAR)) END,
          'Blood Pressure Systolic', CAST(70 + o.o_orderkey % 150 AS VARCHAR))),
    'Actual Therapy', c.cycles,
    'Total Therapy', json_object('Total Therapy Volume', c.total_qty)) AS VARCHAR) AS j
  FROM orders o LEFT JOIN cyc c ON o.o_orderkey = c.l_orderkey),
docs AS (
  SELECT doc_id, CASE WHEN doc_id % 47 = 0 THEN substr(j, 1, length(j) - 1) ELSE j END AS json FROM docs0),
vd AS (SELECT doc_id, json FROM docs WHERE json_valid(json))"""


def dpath(st) -> str:
    out = "$"
    for s in st:
        out += f"[{s}]" if isinstance(s, int) else '."' + s + '"'
    return out


def _fmt(st) -> str:
    s = ""
    for p in st:
        if isinstance(p, int):
            s += f"[{p}]"
        else:
            s += ("." if s else "") + p
    return s


def _targets_sql(rule_no: int, path: str) -> str:
    st = steps(path)
    if "[*]" not in st:
        return (f"SELECT doc_id, {rule_no} AS rule_no, 0 AS idx, {sq(path)} AS field_path, "
                f"json_extract(json, {sq(dpath(st))}) AS jv FROM vd")
    k = st.index("[*]")
    head, rest = st[:k], st[k + 1:]
    hp = dpath(head)
    rest_p = dpath(rest)[1:]
    rest_f = _fmt(rest)
    return (f"SELECT doc_id, {rule_no} AS rule_no, i AS idx, "
            f"{sq(_fmt(head) + '[')} || i || {sq(']' + ('.' + rest_f if rest_f else ''))} AS field_path, "
            f"json_extract(json, {sq(hp + '[')} || i || {sq(']' + rest_p)}) AS jv "
            f"FROM (SELECT doc_id, json, unnest(range(CAST(json_array_length(json, {sq(hp)}) AS BIGINT))) AS i FROM vd "
            f"WHERE json_type(json, {sq(hp)}) = 'ARRAY') "
            f"UNION ALL SELECT doc_id, {rule_no}, 0, {sq(path)}, NULL FROM vd "
            f"WHERE coalesce(json_type(json, {sq(hp)}), 'NULL') <> 'ARRAY'")


KIND = """CASE WHEN jv IS NULL THEN NULL
  WHEN json_type(jv) = 'VARCHAR' THEN 'str'
  WHEN json_type(jv) IN ('BIGINT', 'UBIGINT') THEN 'int'
  WHEN json_type(jv) = 'DOUBLE' THEN 'float'
  WHEN json_type(jv) = 'BOOLEAN' THEN 'bool'
  WHEN json_type(jv) = 'ARRAY' THEN 'list'
  WHEN json_type(jv) = 'OBJECT' THEN 'dict'
  WHEN json_type(jv) = 'NULL' THEN 'NoneType' END"""


def _sfloat(s="s"):
    return f"(CASE WHEN regexp_matches({s}, {sq(JR.FLOAT_PATTERN)}) THEN TRY_CAST(trim({s}) AS DOUBLE) END)"


def _sint(s="s"):
    return f"(CASE WHEN regexp_matches({s}, {sq(JR.INT_PATTERN)}) THEN TRY_CAST(trim({s}) AS DOUBLE) END)"


def _type_err(dtype: str) -> str:
    dt = dtype.upper()
    if dt == "STRING":
        ok, what = "kind = 'str'", "string"
    elif dt in ("NUMBER", "DECIMAL"):
        ok, what = f"kind IN ('int', 'float') OR (kind = 'str' AND {_sfloat()} IS NOT NULL)", "number"
    elif dt == "INTEGER":
        ok = (f"kind = 'int' OR (kind = 'float' AND num = floor(num)) OR "
              f"(kind = 'str' AND {_sint()} IS NOT NULL)")
        what = "integer"
    else:
        return "NULL"
    return f"CASE WHEN NOT coalesce({ok}, false) THEN 'Expected {what}, got ' || kind END"


_SQL_FMT = {"DD-MON-YYYY": "%d-%b-%Y", "HH:MM": "%H:%M", "HH:MM:SS": "%H:%M:%S"}
_SQL_FALLBACK = ["%d-%b-%Y", "%H:%M", "%H:%M:%S", "%Y-%m-%d"]


def _errors_sql(rule) -> str:
    _, _, _, _, path, _, dtype, null, tsf, length = rule
    errs = [_type_err(dtype)]
    if length is not None:
        errs.append(f"CASE WHEN kind = 'str' AND length(s) > {int(length)} THEN "
                    f"'Length ' || length(s) || ' exceeds maximum {int(length)}' END")
    if tsf is not None:
        fmts = [_SQL_FMT[tsf]] if tsf in _SQL_FMT else _SQL_FALLBACK
        ok = " OR ".join(f"try_strptime(s, {sq(f)}) IS NOT NULL" for f in fmts)
        errs.append(f"CASE WHEN kind <> 'str' THEN {sq(JR.MSG_TS_NOT_STRING)} "
                    f"WHEN NOT ({ok}) THEN {sq('Invalid timestamp format. Expected: ' + tsf)} END")
    for kw, lo, lo_open, hi, int_only, string_only, msg in JR.RANGE_RULES:
        if string_only:
            x = f"(CASE WHEN kind = 'str' THEN {_sint() if int_only else _sfloat()} END)"
        else:
            x = f"(CASE WHEN kind IN ('int', 'float') THEN num WHEN kind = 'str' THEN {_sfloat()} END)"
        low = f"{x} <= {lo}" if lo_open else f"{x} < {lo}"
        errs.append(f"CASE WHEN strpos(field_path, {sq(kw)}) > 0 AND {x} IS NOT NULL AND "
                    f"({low} OR {x} > {hi}) THEN {sq(msg)} END")
    return "list_filter([" + ", ".join(errs) + "], lambda x: x IS NOT NULL)"


def _rule_block(rule_no: int, rule) -> str:
    _, _, _, _, path, extract, dtype, null, tsf, length = rule
    req = "true" if null == "N" else "false"
    return (f"SELECT doc_id, rule_no, idx, field_path, {sq(extract)} AS extract_column, "
            f"{sq(dtype)} AS data_type, {req} AS is_required, "
            f"CASE WHEN missing AND {req} THEN [{sq(JR.MSG_REQUIRED)}] WHEN missing THEN []::VARCHAR[] "
            f"ELSE {_errors_sql(rule)} END AS errors, missing AND {req} AS is_required_missing, actual_value "
            f"FROM tv WHERE rule_no = {rule_no}")


def filtered_rules(device="AMIA", customer_id=1, source="TREATMENT"):
    return [r for r in JR.DEFAULT_RULES
            if r[0] == customer_id and r[3] == source and r[2] in (device, "BOTH")]


def _warnings_sql() -> str:
    parts = []
    n = 0
    for p in JR.OPTIONAL_MEDICAL_FIELDS:
        parts.append(f"SELECT doc_id, {n} AS ord, {sq(f'Optional medical field {p} is missing')} AS warning "
                     f"FROM vd WHERE coalesce(json_type(json, {sq(dpath(steps(p)))}), 'NULL') = 'NULL' "
                     f"OR (json_type(json, {sq(dpath(steps(p)))}) = 'VARCHAR' AND "
                     f"json_extract_string(json, {sq(dpath(steps(p)))}) = '')")
        n += 1
    for p, lo, hi in JR.EXTREME_CHECKS:
        dp = sq(dpath(steps(p)))
        parts.append(f"""SELECT doc_id, {n} AS ord, {sq(f'Extreme value in {p}: ')} || shown || {sq(f' (expected {lo}-{hi})')}
          FROM (SELECT doc_id,
                  CASE WHEN json_type(json, {dp}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(json, {dp}) AS DOUBLE)
                       WHEN json_type(json, {dp}) = 'VARCHAR' THEN {_sfloat(f"json_extract_string(json, {dp})")} END AS x,
                  CASE WHEN json_type(json, {dp}) = 'VARCHAR' THEN json_extract_string(json, {dp})
                       WHEN json_type(json, {dp}) IN ('BIGINT', 'UBIGINT') THEN CAST(CAST(json_extract_string(json, {dp}) AS BIGINT) AS VARCHAR)
                       ELSE CAST(CAST(json_extract_string(json, {dp}) AS DOUBLE) AS VARCHAR) END AS shown
                FROM vd) WHERE x IS NOT NULL AND (x < {lo} OR x > {hi})""")
        n += 1
    return "\n  UNION ALL ".join(parts)


def with_checks(final_sql: str, device="AMIA", rules=None) -> str:
    """``final_sql`` over the checks of the numbered ``rules`` (default: those of the device)."""
    rules = filtered_rules(device) if rules is None else rules
    tg = "\n  UNION ALL ".join(_targets_sql(i + 1, r[4]) for i, r in enumerate(rules))
    blocks = "\n  UNION ALL ".join(_rule_block(i + 1, r) for i, r in enumerate(rules))
    return f"""WITH {DOCS_SQL},
tg AS (
  {tg}),
tk AS (SELECT *, {KIND} AS kind FROM tg),
tv AS (
  SELECT *, (CASE WHEN kind = 'str' THEN json_extract_string(jv, '$') END) AS s,
         (CASE WHEN kind IN ('int', 'float') THEN CAST(json_extract_string(jv, '$') AS DOUBLE) END) AS num,
         (jv IS NULL OR kind = 'NoneType' OR (kind = 'str' AND json_extract_string(jv, '$') = '')) AS missing,
         (CASE WHEN kind = 'str' THEN json_extract_string(jv, '$')
               WHEN kind = 'int' THEN CAST(CAST(json_extract_string(jv, '$') AS BIGINT) AS VARCHAR)
               WHEN kind = 'float' THEN CAST(CAST(json_extract_string(jv, '$') AS DOUBLE) AS VARCHAR)
               WHEN kind = 'bool' THEN json_extract_string(jv, '$')
               WHEN kind IS NOT NULL AND kind <> 'NoneType' THEN CAST(jv AS VARCHAR) END) AS actual_value
  FROM tk),
fc AS (
  {blocks}),
fce AS (SELECT * , len(errors) = 0 AS is_valid FROM fc),
wr AS (
  {_warnings_sql()}),
errs AS (
  SELECT doc_id, rule_no, idx, field_path, unnest(errors) AS message, unnest(range(CAST(len(errors) AS BIGINT))) AS err_no
  FROM fce),
allerr AS (
  SELECT doc_id, message AS error FROM errs
  UNION ALL SELECT doc_id, 'Validation error: document is not valid JSON' FROM docs WHERE NOT json_valid(json)),
summ AS (
  SELECT d.doc_id, json_valid(d.json) AND coalesce(f.failed, 0) = 0 AS is_valid,
    coalesce(f.total, 0) AS total_fields_checked, coalesce(f.passed, 0) AS passed_validation,
    coalesce(f.failed, 0) AS failed_validation, coalesce(f.missing, '') AS missing_required_fields,
    coalesce(w.n, 0) AS warning_count
  FROM docs d
  LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE is_valid) AS passed,
                    count(*) FILTER (WHERE NOT is_valid) AS failed,
                    string_agg(CASE WHEN is_required_missing THEN field_path END, '|' ORDER BY rule_no, idx) AS missing
             FROM fce GROUP BY doc_id) f ON d.doc_id = f.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM wr GROUP BY doc_id) w ON d.doc_id = w.doc_id)
{final_sql}"""

