"""DuckDB oracle for the schema contracts: the actual side described by
DuckDB from the same changed projections (``DESCRIBE SELECT ...``), the
expected side as the contract states it, and the comparison in SQL."""

from recordchecks.rules.schema_rules import coercion_pairs

_ACTUAL_ORDERS = """SELECT TRY_CAST(o_orderkey AS INTEGER) AS o_orderkey,
  CASE WHEN o_orderkey % 71 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
  o_orderdate, 'x' AS o_comment FROM orders"""
_ACTUAL_LINEITEM = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity,
  l_extendedprice, l_discount, l_returnflag, l_linestatus,
  CASE WHEN l_orderkey % 60 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS l_shipdate FROM lineitem"""
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in coercion_pairs())

SCHEMA_CTES = f"""
tmap(duck, type_name, type_family) AS (VALUES ('BIGINT', 'bigint', 'long'), ('INTEGER', 'int', 'integer'),
  ('DOUBLE', 'double', 'double'), ('VARCHAR', 'string', 'string'), ('TIMESTAMP', 'timestamp_ntz', 'timestamp_ntz')),
flags(source, allow_type_coercion, ignore_extra_columns) AS (VALUES ('orders', true, false),
  ('lineitem', false, false), ('customer', false, false)),
expected_raw(source, ordinal, name, duck, nullable) AS (VALUES
  ('orders', 0, 'o_orderkey', 'BIGINT', false), ('orders', 1, 'o_custkey', 'BIGINT', false),
  ('orders', 2, 'o_orderstatus', 'VARCHAR', true), ('orders', 3, 'o_totalprice', 'DOUBLE', true),
  ('orders', 4, 'o_orderdate', 'TIMESTAMP', true), ('orders', 5, 'o_orderpriority', 'VARCHAR', true),
  ('lineitem', 0, 'l_orderkey', 'BIGINT', false), ('lineitem', 1, 'l_partkey', 'BIGINT', true),
  ('lineitem', 2, 'l_suppkey', 'BIGINT', true), ('lineitem', 3, 'l_linenumber', 'INTEGER', true),
  ('lineitem', 4, 'l_quantity', 'DOUBLE', true), ('lineitem', 5, 'l_extendedprice', 'DOUBLE', true),
  ('lineitem', 6, 'l_discount', 'DOUBLE', true), ('lineitem', 7, 'l_tax', 'DOUBLE', true),
  ('lineitem', 8, 'l_returnflag', 'VARCHAR', true), ('lineitem', 9, 'l_linestatus', 'VARCHAR', true),
  ('lineitem', 10, 'l_shipdate', 'TIMESTAMP', true)),
actual_raw AS (
  SELECT 'orders' AS source, row_number() OVER () - 1 AS ordinal, column_name AS name, column_type AS duck,
         column_name <> 'o_comment' AS nullable
  FROM (DESCRIBE {_ACTUAL_ORDERS})
  UNION ALL SELECT 'lineitem', row_number() OVER () - 1, column_name, column_type, true
  FROM (DESCRIBE {_ACTUAL_LINEITEM})
  UNION ALL SELECT 'customer', row_number() OVER () - 1, column_name, column_type, true
  FROM (DESCRIBE SELECT * FROM customer)),
sf AS (
  SELECT e.source, 'expected' AS side, e.ordinal, e.name, t.type_name, t.type_family, e.nullable
  FROM expected_raw e JOIN tmap t ON e.duck = t.duck
  UNION ALL SELECT a.source, 'expected', a.ordinal, a.name, t.type_name, t.type_family, a.nullable
  FROM actual_raw a JOIN tmap t ON a.duck = t.duck WHERE a.source = 'customer'
  UNION ALL SELECT a.source, 'actual', a.ordinal, a.name, t.type_name, t.type_family, a.nullable
  FROM actual_raw a JOIN tmap t ON a.duck = t.duck),
pairs(t1, t2) AS (VALUES {_PAIRS}),
cnt AS (SELECT source, count(*) FILTER (WHERE side = 'expected') AS n_exp,
               count(*) FILTER (WHERE side = 'actual') AS n_act FROM sf GROUP BY source),
ex AS (SELECT * FROM sf WHERE side = 'expected'),
ac AS (SELECT * FROM sf WHERE side = 'actual'),
fnd AS (
  SELECT c.source, 1 AS section, 'error' AS severity, NULL AS column_name,
         'Column count mismatch: Expected ' || n_exp || ', Found ' || n_act || ' columns' AS message
  FROM cnt c JOIN flags f ON c.source = f.source WHERE n_exp <> n_act AND NOT f.ignore_extra_columns
  UNION ALL SELECT source, 2, 'error', NULL,
         'Missing columns: [' || string_agg(chr(39) || name || chr(39), ', ' ORDER BY name) || ']'
  FROM ex WHERE NOT EXISTS (SELECT 1 FROM ac WHERE ac.source = ex.source AND ac.name = ex.name) GROUP BY source
  UNION ALL SELECT ac.source, 3, 'warning', NULL,
         'Extra columns: [' || string_agg(chr(39) || name || chr(39), ', ' ORDER BY name) || ']'
  FROM ac JOIN flags f ON ac.source = f.source
  WHERE NOT f.ignore_extra_columns AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.source = ac.source AND ex.name = ac.name)
  GROUP BY ac.source
  UNION ALL SELECT e.source, 4,
    CASE WHEN f.allow_type_coercion AND p.t1 IS NOT NULL THEN 'warning' ELSE 'error' END, e.name,
    CASE WHEN f.allow_type_coercion AND p.t1 IS NOT NULL
         THEN 'Type mismatch (coercible) for "' || e.name || '": ' || e.type_name || ' -> ' || a.type_name
         ELSE 'Type mismatch for "' || e.name || '": Expected ' || e.type_name || ', Found ' || a.type_name END
  FROM ex e JOIN ac a ON e.source = a.source AND e.name = a.name JOIN flags f ON e.source = f.source
  LEFT JOIN pairs p ON p.t1 = e.type_family AND p.t2 = a.type_family
  WHERE e.type_name <> a.type_name
  UNION ALL SELECT e.source, 5, 'warning', e.name,
    'Nullable mismatch for "' || e.name || '": Expected ' || (CASE WHEN e.nullable THEN 'True' ELSE 'False' END)
    || ', Found ' || (CASE WHEN a.nullable THEN 'True' ELSE 'False' END)
  FROM ex e JOIN ac a ON e.source = a.source AND e.name = a.name WHERE e.nullable <> a.nullable),
vd AS (
  SELECT c.source, coalesce(x.e, 0) = 0 AS is_valid, c.n_exp AS expected_columns, c.n_act AS extracted_columns,
         coalesce(x.e, 0) AS error_count, coalesce(x.w, 0) AS warning_count
  FROM cnt c LEFT JOIN (SELECT source, count(*) FILTER (WHERE severity = 'error') AS e,
                               count(*) FILTER (WHERE severity = 'warning') AS w FROM fnd GROUP BY source) x
  ON c.source = x.source)"""


def _sq(final: str) -> str:
    return f"WITH {SCHEMA_CTES}\n{final}"


_F = "SELECT source, severity, column_name, message FROM fnd WHERE "
ORACLES_SCHEMA = {
    "schema_fields": _sq("SELECT * FROM sf"),
    "schema_diff": _sq("""SELECT coalesce(e.source, a.source) AS source, coalesce(e.name, a.name) AS name,
        e.type_name AS expected_type, a.type_name AS actual_type,
        CASE WHEN e.name IS NULL THEN 'extra' WHEN a.name IS NULL THEN 'missing' ELSE 'matched' END AS status
        FROM ex e FULL OUTER JOIN ac a ON e.source = a.source AND e.name = a.name"""),
    "schema_count": _sq(_F + "section = 1"),
    "schema_missing": _sq(_F + "section = 2"),
    "schema_extra": _sq(_F + "section = 3"),
    "schema_types": _sq(_F + "section = 4 AND severity = 'error'"),
    "schema_coercion": _sq(_F + "section = 4 AND severity = 'warning'"),
    "schema_nullable": _sq(_F + "section = 5"),
    "schema_verdict": _sq("SELECT * FROM vd"),
    "schema_report": _sq("""SELECT source, 0 AS section, 0 AS ord,
        'Schema validation passed for ' || chr(39) || source || chr(39) AS line FROM vd WHERE is_valid
        UNION ALL SELECT f.source, f.section, 1,
        CASE WHEN f.severity = 'error' THEN 'ERROR: ' ELSE 'WARNING: ' END || f.message
        FROM fnd f JOIN vd ON f.source = vd.source WHERE NOT vd.is_valid"""),
}
