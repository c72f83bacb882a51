"""DuckDB oracle for the HL7 group: the same message texts built from the
tables in SQL, parsed relationally (unnest + window numbering), and every
rule written as its own SELECT, unioned.  Independent of the Spark plan,
which parses each message inside its row with higher-order functions."""

from __future__ import annotations

from recordchecks.rules import hl7_rules as R
from recordchecks.sources.bindings import FAULT_MODULUS, FAULTS


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MESSAGES_SQL = r"""
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity,
             l_returnflag, l_linestatus) AS i
  FROM lineitem),
obx AS (
  SELECT l_orderkey,
    list('OBX|' || i || '|' || (CASE WHEN l_orderkey % 13 = 5 AND i = 1 THEN '' ELSE 'NM' END) || '|' ||
         (CASE WHEN l_linenumber = 5 THEN 'P' || l_partkey
               ELSE 'P' || l_partkey || '^Part ' || l_partkey || '^LN' END) || '||' ||
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '|' ||
         (CASE WHEN l_linestatus = 'F' THEN '10*3/uL' ELSE 'mg/dL' END) || '|' ||
         (CASE l_linenumber WHEN 3 THEN '<50' WHEN 4 THEN '>= 3' ELSE '1-50' END) ||
         '||||' || l_returnflag ORDER BY i) AS obx
  FROM li GROUP BY l_orderkey),
msg0 AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS msg_id, o.o_orderkey AS k,
    list_concat(
      CASE WHEN o.o_orderkey % 23 = 4 THEN ['EVN|A01'] ELSE [] END,
      list_filter([
        'MSH|^~\&|LAB|FAC|HIS|HOSP|' ||
          (CASE WHEN o.o_orderkey % 11 = 7 THEN '20241399' ELSE strftime(o.o_orderdate, '%Y%m%d%H%M%S') END) ||
          '||' || (CASE WHEN o.o_orderkey % 29 = 1 THEN 'ADT^A01' WHEN o.o_orderkey % 9 = 8 THEN 'ORU^R01^ORU_R01'
                        ELSE 'ORU^R01' END) ||
          '|MSG' || o.o_orderkey || '|P|' ||
          (CASE o.o_orderkey % 7 WHEN 5 THEN '2.8' WHEN 6 THEN '2.9' ELSE '2.5.1' END),
        CASE WHEN o.o_orderkey % 17 <> 3 THEN
          'PID|1||' || o.o_custkey || '^^^HOSP^MR' || (CASE WHEN o.o_custkey % 10 = 9 THEN '~^^^HOSP^MR' ELSE '' END) ||
          '||' || replace(c.c_name, '#', '^') || '||' ||
          (CASE WHEN o.o_custkey % 37 = 0 THEN '19850230'
                ELSE printf('%04d%02d%02d', 1940 + o.o_custkey % 60, 1 + o.o_custkey % 12, 1 + o.o_custkey % 28) END) ||
          '|' || (['M','F','O','U','A','X'])[1 + o.o_custkey % 6] END,
        'PV1|1|' || (['I','O','E','P','Z'])[CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)],
        'ORC|NW|' || (CASE WHEN o.o_orderkey % 19 = 2 THEN 'PX' ELSE 'PL' END) || o.o_orderkey || '|FL' || o.o_orderkey,
        'OBR|1|PL' || o.o_orderkey || '|FL' || o.o_orderkey || '|' ||
          (CASE WHEN o.o_orderkey % 31 = 3 THEN '' ELSE 'SVC^' || o.o_orderpriority || '^LN' END) ||
          '|||' || strftime(o.o_orderdate, '%Y%m%d%H%M%S') || repeat('|', 18) || o.o_orderstatus
      ], lambda x: x IS NOT NULL),
      coalesce(b.obx, [])) AS sl
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN obx b ON o.o_orderkey = b.l_orderkey),
faults(r, seg, pos, val) AS (VALUES """ + ", ".join(
    f"({r}, '{seg}', {pos}, {'NULL' if val is None else sq(val)})" for r, (seg, pos, val) in enumerate(FAULTS)) + r"""),
mline AS (
  SELECT msg_id, unnest(sl) AS line, generate_subscripts(sl, 1) AS no, seg, pos, val
  FROM msg0 JOIN faults ON k % """ + str(FAULT_MODULUS) + r""" = r),
medit AS (
  SELECT msg_id, no, CASE WHEN seg <> split_part(line, '|', 1) OR (seg = 'OBX' AND line NOT LIKE 'OBX|1|%') THEN line
    ELSE array_to_string(list_transform(
      string_split(line || repeat('|', greatest(0, pos + 1 - len(string_split(line, '|')))), '|'),
      lambda x, i: CASE WHEN i = pos + 1 THEN val ELSE x END), '|') END AS line
  FROM mline WHERE NOT (pos = 0 AND seg = split_part(line, '|', 1))),
mfix AS (SELECT msg_id, list(line ORDER BY no) AS sl FROM medit GROUP BY msg_id),
msgl AS (SELECT m.msg_id, m.k, coalesce(f.sl, m.sl) AS sl FROM msg0 m LEFT JOIN mfix f ON m.msg_id = f.msg_id),
msgs AS (
  SELECT msg_id, CASE k % 5 WHEN 0 THEN array_to_string(sl, chr(13) || chr(10))
                            WHEN 1 THEN array_to_string(sl, chr(13))
                            ELSE array_to_string(sl, chr(10)) END AS raw
  FROM msgl)"""

PARSE_SQL = r"""
lines AS (
  SELECT msg_id, unnest(regexp_split_to_array(raw, '\r\n|\r|\n')) AS line,
         generate_subscripts(regexp_split_to_array(raw, '\r\n|\r|\n'), 1) AS lpos
  FROM msgs),
segs AS (
  SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY lpos) AS seg_pos,
         string_split(line, '|') AS f
  FROM lines WHERE trim(line) <> ''),
segs2 AS (
  SELECT msg_id, seg_pos, f, f[1] AS name,
         row_number() OVER (PARTITION BY msg_id, f[1] ORDER BY seg_pos) AS occ
  FROM segs),
m AS (
  SELECT msg_id,
    coalesce(arg_min(name, seg_pos) FILTER (WHERE name NOT IN ('FHS', 'BHS', 'BTS', 'FTS')) = 'MSH', false) AS parsed,
    any_value(f) FILTER (WHERE name = 'MSH' AND occ = 1) AS msh,
    any_value(f) FILTER (WHERE name = 'PID' AND occ = 1) AS pid,
    any_value(f) FILTER (WHERE name = 'PV1' AND occ = 1) AS pv1,
    any_value(f) FILTER (WHERE name = 'ORC' AND occ = 1) AS orc,
    any_value(f) FILTER (WHERE name = 'OBR' AND occ = 1) AS obr,
    count(*) FILTER (WHERE name = 'MSH') > 0 AS has_msh,
    count(*) FILTER (WHERE name = 'PID') > 0 AS has_pid,
    count(*) FILTER (WHERE name = 'PV1') > 0 AS has_pv1,
    count(*) FILTER (WHERE name = 'ORC') > 0 AS has_orc,
    count(*) FILTER (WHERE name = 'OBR') > 0 AS has_obr,
    count(*) FILTER (WHERE name = 'OBX') AS n_obx
  FROM segs2 GROUP BY msg_id),
ok AS (SELECT * FROM m WHERE parsed),
ox AS (SELECT s.msg_id, s.occ, s.f AS obx FROM segs2 s JOIN ok USING (msg_id) WHERE s.name = 'OBX')"""


def fld(seg_var: str, seg: str, n: int) -> str:
    if seg == "MSH":
        return f"(CASE WHEN {seg_var} IS NOT NULL THEN '|' END)" if n == 1 else f"{seg_var}[{n}]"
    return f"{seg_var}[{n + 1}]"


def blank(v: str) -> str:
    return f"(coalesce(trim({v}), '') = '')"


def present(v: str) -> str:
    return f"(NOT {blank(v)})"


def inlist(values) -> str:
    return "(" + ", ".join(sq(v) for v in values) + ")"


def _row(profile, sev, code, loc_sql, msg_sql, src, where):
    return (f"SELECT msg_id, {sq(profile)} AS profile, {sq(sev)} AS severity, {sq(code)} AS code, "
            f"{loc_sql} AS location, {msg_sql} AS message FROM {src} WHERE {where}")


def _ts(profile, v, loc, guard, strict):
    fmt_ok = f"regexp_matches({v}, {sq(R.TIMESTAMP_PATTERN)})"
    date_bad = f"(length({v}) >= 8 AND try_strptime(substr({v}, 1, 8), '%Y%m%d') IS NULL)"
    out = [_row(profile, "warning", "ts_format", sq(loc),
                f"{sq(loc + ' timestamp format may be invalid: ')} || {v}", "ok",
                f"{guard} AND {present(v)} AND NOT {fmt_ok}")]
    cond = f"{guard} AND {present(v)} AND {date_bad}"
    if not strict:
        cond += f" AND {fmt_ok}"
    out.append(_row(profile, "warning", "ts_date", sq(loc),
                    f"{sq(loc + ' contains invalid date: ')} || {v}", "ok", cond))
    return out


def _code(profile, v, loc, values, text, guard):
    return _row(profile, "warning", "code_set", sq(loc),
                f"{sq(f'{loc} {text} ' + chr(39))} || {v} || "
                f"{sq(chr(39) + ' not in standard values ' + R.pylist(values))}",
                "ok", f"{guard} AND {present(v)} AND {v} NOT IN {inlist(values)}")


def _obx_loc(n):
    return f"('OBX[' || occ || '].{n}')"


def strict_rows() -> list[str]:
    P = "strict"
    rows = []
    for s in R.STRICT_REQUIRED_SEGMENTS:
        rows.append(_row(P, "error", "segment_missing", sq(s), sq(f"Required segment {s} is missing"),
                         "ok", f"NOT has_{s.lower()}" if s != "OBX" else "n_obx = 0"))
    rows.append(_row(P, "error", "no_obx", "'OBX'",
                     sq("At least one OBX segment is required for ORU_R01"), "ok", "n_obx = 0"))
    for n, desc in R.MSH_REQUIRED:
        rows.append(_row(P, "error", "required", sq(f"MSH.{n}"), sq(f"MSH.{n} ({desc}) is required"),
                         "ok", blank(fld("msh", "MSH", n))))
    t = fld("msh", "MSH", 9)
    rows.append(_row(P, "warning", "msg_type", "'MSH.9'",
                     f"'Expected message type ORU^R01, found ' || {t}", "ok",
                     f"{present(t)} AND {t} <> 'ORU^R01'"))
    v = fld("msh", "MSH", 12)
    rows.append(_row(P, "warning", "version", "'MSH.12'", f"'Unsupported HL7 version: ' || {v}", "ok",
                     f"{present(v)} AND {v} NOT IN {inlist(R.STRICT_VERSIONS)}"))
    rows += _ts(P, fld("msh", "MSH", 7), "MSH.7", "true", True)
    for n, desc in R.PID_REQUIRED:
        rows.append(_row(P, "error", "required", sq(f"PID.{n}"), sq(f"PID.{n} ({desc}) is required"),
                         "ok", f"has_pid AND {blank(fld('pid', 'PID', n))}"))
    p3 = fld("pid", "PID", 3)
    rows.append(f"""SELECT msg_id, 'strict', 'error', 'pid3_id', 'PID.3',
        'PID.3 patient identifier value is required'
        FROM (SELECT msg_id, unnest(string_split({p3}, '~')) AS rep FROM ok
              WHERE has_pid AND {present(p3)}) WHERE {blank("string_split(rep, '^')[1]")}""")
    rows += _ts(P, fld("pid", "PID", 7), "PID.7", "has_pid", True)
    rows.append(_code(P, fld("pid", "PID", 8), "PID.8", R.SEX_CODES, "sex code", "has_pid"))
    for n, desc in R.PV1_REQUIRED:
        rows.append(_row(P, "error", "required", sq(f"PV1.{n}"), sq(f"PV1.{n} ({desc}) is required"),
                         "ok", f"has_pv1 AND {blank(fld('pv1', 'PV1', n))}"))
    rows.append(_code(P, fld("pv1", "PV1", 2), "PV1.2", R.PATIENT_CLASSES, "patient class", "has_pv1"))
    rows.append(_code(P, fld("orc", "ORC", 1), "ORC.1", R.ORDER_CONTROLS, "order control", "has_orc"))
    for n, desc in R.OBR_REQUIRED:
        rows.append(_row(P, "error", "required", sq(f"OBR.{n}"), sq(f"OBR.{n} ({desc}) is required"),
                         "ok", f"has_obr AND {blank(fld('obr', 'OBR', n))}"))
    rows.append(_code(P, fld("obr", "OBR", 25), "OBR.25", R.RESULT_STATUSES, "result status", "has_obr"))
    rows += _ts(P, fld("obr", "OBR", 7), "OBR.7", "has_obr", True)
    rows.append(_code(P, fld("obr", "OBR", 5), "OBR.5", R.PRIORITIES, "priority", "has_obr"))
    for n, desc in R.OBX_REQUIRED:
        rows.append(_row(P, "error", "required", _obx_loc(n), f"{_obx_loc(n)} || {sq(f' ({desc}) is required')}",
                         "ox", blank(fld("obx", "OBX", n))))
    for n, values, text in ((2, R.STRICT_VALUE_TYPES, "value type"), (11, R.OBX_STATUSES, "result status")):
        v = fld("obx", "OBX", n)
        rows.append(_row(P, "warning", "code_set", _obx_loc(n),
                         f"{_obx_loc(n)} || {sq(f' {text} ' + chr(39))} || {v} || "
                         f"{sq(chr(39) + ' not in standard values ' + R.pylist(values))}",
                         "ox", f"{present(v)} AND {v} NOT IN {inlist(values)}"))
    v = fld("obx", "OBX", 6)
    rows.append(_row(P, "warning", "units", _obx_loc(6), f"{_obx_loc(6)} || ' units format may be invalid: ' || {v}",
                     "ox", f"{present(v)} AND NOT regexp_matches({v}, {sq(R.STRICT_UNITS_PATTERN)})"))
    v = fld("obx", "OBX", 7)
    rows.append(_row(P, "warning", "ref_range", _obx_loc(7),
                     f"{_obx_loc(7)} || ' reference range format may be invalid: ' || {v}", "ox",
                     f"{present(v)} AND NOT regexp_matches({v}, {sq(R.RANGE_PATTERNS[0])}) "
                     f"AND NOT regexp_matches({v}, {sq(R.RANGE_PATTERNS[1])})"))
    for n, what in ((2, "placer"), (3, "filler")):
        a, b = fld("orc", "ORC", n), fld("obr", "OBR", n)
        rows.append(_row(P, "warning", "order_mismatch", sq(f"ORC.{n}"),
                         sq(f"ORC.{n} and OBR.{n} {what} order numbers should match"), "ok",
                         f"has_orc AND has_obr AND {present(a)} AND {present(b)} AND {a} <> {b}"))
    v = fld("obx", "OBX", 3)
    rows.append(_row(P, "warning", "obx3_component", _obx_loc(3),
                     f"'OBX observation identifier should use component separator: ' || {v}", "ox",
                     f"{present(v)} AND strpos({v}, '^') = 0"))
    return rows


def lenient_rows() -> list[str]:
    P = "lenient"
    rows = []
    rows.append(_row(P, "error", "segment_missing", "'MSH'", sq("Required segment MSH is missing"),
                     "ok", "NOT has_msh"))
    for s in R.LENIENT_EXPECTED_SEGMENTS:
        rows.append(_row(P, "warning", "segment_expected", sq(s), sq(f"Expected segment {s} is missing"),
                         "ok", f"NOT has_{s.lower()}" if s != "OBX" else "n_obx = 0"))
    rows.append(_row(P, "error", "no_obx", "'OBX'",
                     sq("At least one OBX segment is required for ORU_R01"), "ok", "n_obx = 0"))
    for n in R.LENIENT_MSH_RECOMMENDED:
        rows.append(_row(P, "warning", "recommended", sq(f"MSH.{n}"),
                         sq(f"MSH.{n} is missing but recommended"), "ok", blank(fld("msh", "MSH", n))))
    t = fld("msh", "MSH", 9)
    rows.append(_row(P, "warning", "msg_type", "'MSH.9'", f"'MSH.9 should be ''ORU^R01'', found: ' || {t}",
                     "ok", f"{present(t)} AND strpos({t}, 'ORU^R01') = 0"))
    v = fld("msh", "MSH", 12)
    rows.append(_row(P, "warning", "version", "'MSH.12'", f"'Unsupported HL7 version: ' || {v}", "ok",
                     f"{present(v)} AND {v} NOT IN {inlist(R.LENIENT_VERSIONS)}"))
    rows += _ts(P, fld("msh", "MSH", 7), "MSH.7", "true", False)
    for n in R.LENIENT_PID_RECOMMENDED:
        rows.append(_row(P, "warning", "recommended", sq(f"PID.{n}"),
                         sq(f"PID.{n} is missing but recommended for patient identification"), "ok",
                         f"has_pid AND {blank(fld('pid', 'PID', n))}"))
    rows += _ts(P, fld("pid", "PID", 7), "PID.7", "has_pid", False)
    rows.append(_code(P, fld("pid", "PID", 8), "PID.8", R.SEX_CODES, "sex code", "has_pid"))
    rows.append(_code(P, fld("pv1", "PV1", 2), "PV1.2", R.PATIENT_CLASSES, "patient class", "has_pv1"))
    rows.append(_code(P, fld("orc", "ORC", 1), "ORC.1", R.ORDER_CONTROLS, "order control", "has_orc"))
    for n in R.LENIENT_OBR_CRITICAL:
        rows.append(_row(P, "error", "critical", sq(f"OBR.{n}"), sq(f"OBR.{n} is required for ORU_R01 messages"),
                         "ok", f"has_obr AND {blank(fld('obr', 'OBR', n))}"))
    rows.append(_code(P, fld("obr", "OBR", 25), "OBR.25", R.RESULT_STATUSES, "result status", "has_obr"))
    rows += _ts(P, fld("obr", "OBR", 7), "OBR.7", "has_obr", False)
    for n in R.LENIENT_OBX_CRITICAL:
        rows.append(_row(P, "error", "critical", _obx_loc(n), f"{_obx_loc(n)} || ' is required for observation data'",
                         "ox", blank(fld("obx", "OBX", n))))
    for n, values, text in ((2, R.LENIENT_VALUE_TYPES, "value type"), (11, R.OBX_STATUSES, "result status")):
        v = fld("obx", "OBX", n)
        rows.append(_row(P, "warning", "code_set", _obx_loc(n),
                         f"{_obx_loc(n)} || {sq(f' {text} ' + chr(39))} || {v} || "
                         f"{sq(chr(39) + ' not in standard values ' + R.pylist(values))}",
                         "ox", f"{present(v)} AND {v} NOT IN {inlist(values)}"))
    v = fld("obx", "OBX", 6)
    rows.append(_row(P, "warning", "units", _obx_loc(6), f"{_obx_loc(6)} || ' units format may be invalid: ' || {v}",
                     "ox", f"{present(v)} AND NOT regexp_matches({v}, {sq(R.LENIENT_UNITS_PATTERN)})"))
    a, b = fld("orc", "ORC", 2), fld("obr", "OBR", 2)
    rows.append(_row(P, "warning", "order_mismatch", "'ORC.2'",
                     sq("ORC.2 and OBR.2 placer order numbers should match"), "ok",
                     f"has_orc AND has_obr AND {present(a)} AND {present(b)} AND {a} <> {b}"))
    return rows


def parse_rows() -> list[str]:
    return [f"SELECT msg_id, {sq(p)}, 'error', 'parse', 'MSH', {sq(e)} FROM m WHERE NOT parsed"
            for p, e in (("strict", R.STRICT_PARSE_ERROR), ("lenient", R.LENIENT_PARSE_ERROR))]


def with_findings(final_sql: str) -> str:
    union = "\n  UNION ALL ".join(strict_rows() + lenient_rows() + parse_rows())
    return f"WITH {MESSAGES_SQL},{PARSE_SQL},\nfnd AS (\n  {union})\n{final_sql}"


def with_parsed(final_sql: str) -> str:
    return f"WITH {MESSAGES_SQL},{PARSE_SQL}\n{final_sql}"
