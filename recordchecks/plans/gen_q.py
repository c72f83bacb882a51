"""Registered HL7 generation queries over the device records and
the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.operators import hl7_build as B
from recordchecks.operators import hl7_groups as HG
from recordchecks.plans.json_sql import DOCS_SQL
from recordchecks.plans.registry import query
from recordchecks.session import shared_path
from recordchecks.sources.bindings import device_records
from recordchecks.sources.sinks import read_message_files, write_message_files
from recordchecks.sources.tables import table

RUN_TS = "20250101120000"
OBS_TS = "20250101123423"


def _docs(spark, d):
    return device_records(spark, d)


def _sections(spark, d):
    return B.section_rows(_docs(spark, d), B.mapping_frame(spark), OBS_TS)


def _messages(spark, d):
    return B.messages(_docs(spark, d), B.mapping_frame(spark), RUN_TS, OBS_TS)


@query("json_flatten", "WITH " + DOCS_SQL + """
SELECT v.doc_id, upper(replace(replace(replace(substr(t.fullkey, 3), '"', ''), ' ', '_'), '-', '_')) AS path,
  CASE WHEN t.type = 'VARCHAR' THEN json_extract_string(t.value, '$')
       WHEN t.type = 'DOUBLE' AND CAST(t.value AS DOUBLE) = floor(CAST(t.value AS DOUBLE))
         THEN CAST(CAST(CAST(t.value AS DOUBLE) AS BIGINT) AS VARCHAR)
       ELSE CAST(t.value AS VARCHAR) END AS value,
  CASE WHEN t.type = 'VARCHAR' THEN 'STRING' WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'BIGINT'
       WHEN t.type = 'DOUBLE' THEN 'DECIMAL(' || length(CAST(CAST(CAST(t.value AS DOUBLE) AS BIGINT) AS VARCHAR)) || ',0)'
       ELSE t.type END AS kind
FROM vd v, json_tree(v.json) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def q_flatten(spark, d):
    return B.flatten(_docs(spark, d)).select("doc_id", "path", "value", "kind")


def _headers(spark, d):
    return B.header_segments(_docs(spark, d), RUN_TS, OBS_TS).where("parsed")


GEN_CTES = r"""
li AS (
  SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_returnflag, l_linestatus) - 1 AS item
  FROM lineitem WHERE l_orderkey % 47 <> 0),
nl AS (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS tq FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o.o_orderkey AS doc_id, o.o_custkey AS c, o.o_totalprice, coalesce(nl.n, 0) AS n, nl.tq,
         CASE WHEN o.o_orderkey % 59 = 1 THEN 'T' || o.o_orderkey ELSE CAST(o.o_orderkey AS VARCHAR) END AS tid,
         CASE WHEN o.o_orderkey % 2 = 0 THEN 'AMIA' ELSE 'CLARIA' END AS dev
  FROM orders o LEFT JOIN nl ON o.o_orderkey = nl.l_orderkey WHERE o.o_orderkey % 47 <> 0),
mp(identifier, attr, display, dtype, unit) AS (VALUES
  ('PRE_WEIGHT', 'PRE_TREATMENT.WEIGHT', 'Pre-Treatment Weight', 'NM', 'kg'),
  ('PRE_BP_SYS', 'PRE_TREATMENT.BLOOD_PRESSURE_SYSTOLIC', 'Pre-Treatment Systolic BP', 'NM', 'mmHg'),
  ('PRE_PULSE', 'PRE_TREATMENT.PULSE', 'Pre-Treatment Pulse', 'NM', 'bpm'),
  ('POST_WEIGHT', 'POST_TREATMENT.WEIGHT', 'Post-Treatment Weight', 'NM', 'kg'),
  ('CYCLE_TIME', 'THERAPY_CYCLE_TIME', 'Therapy Cycle Time', 'TM', ''),
  ('CYCLE_TYPE', 'CYCLE_TYPE', 'Cycle Type', 'ST', ''),
  ('FILL_VOLUME', 'FILL_VOLUME', 'Fill Volume', 'NM', 'mL'),
  ('FILL_TIME', 'FILL_TIME', 'Fill Time', 'NM', 's'),
  ('TOTAL_VOLUME', 'TOTAL_THERAPY_VOLUME', 'Total Therapy Volume', 'NM', 'mL')),
vit AS (
  SELECT doc_id, 'PRE_WEIGHT' AS identifier, 1 AS seq,
         CASE WHEN doc_id % 241 = 4 THEN '1500' ELSE CAST(CAST(trunc(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS value
         FROM o WHERE doc_id % 43 <> 0
  UNION ALL SELECT doc_id, 'PRE_BP_SYS', 2, CASE WHEN doc_id % 241 = 3 THEN '350' ELSE CAST(60 + doc_id % 160 AS VARCHAR) END FROM o
  UNION ALL SELECT doc_id, 'PRE_PULSE', 3, CAST(doc_id % 260 AS VARCHAR) FROM o
  UNION ALL SELECT doc_id, 'POST_WEIGHT', 999, CAST(CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1 AS VARCHAR) FROM o),
cyc AS (
  SELECT doc_id, item, 'CYCLE_TIME' AS identifier, 1 AS seq,
         printf('%02d:%02d:%02d', l_linenumber * 4, l_partkey % 60, l_suppkey % 60) AS value FROM li
  UNION ALL SELECT doc_id, item, 'CYCLE_TYPE', 2,
         l_returnflag || '-' || l_linestatus || (CASE WHEN l_linenumber = 1 THEN 'FILL' ELSE '' END) FROM li
  UNION ALL SELECT doc_id, item, 'FILL_VOLUME', 3, CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) FROM li
  UNION ALL SELECT doc_id, item, 'FILL_TIME', 4, CAST(l_linenumber * 60 AS VARCHAR) FROM li),
obx AS (
  SELECT doc_id, 'VITALS' AS section, NULL::INTEGER AS item, 2 AS obr_set_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS obx_set_id, identifier, value FROM vit
  UNION ALL SELECT doc_id, 'ACTUAL_THERAPY', item, 3 + item,
         row_number() OVER (PARTITION BY doc_id, item ORDER BY seq), identifier, value FROM cyc
  UNION ALL SELECT doc_id, 'TOTAL_THERAPY', NULL, 3 + greatest(n, 1), 1, 'TOTAL_VOLUME', CAST(tq AS VARCHAR)
  FROM o WHERE tq IS NOT NULL),
obr AS (
  SELECT doc_id, 2 AS obr_set_id, 'VITALS' AS identifier, 'Vital Signs' AS display FROM o
  UNION ALL SELECT doc_id, 3 + i, 'ACTUAL_THERAPY', 'Actual Therapy Cycle'
  FROM (SELECT doc_id, unnest(range(CAST(greatest(n, 1) AS BIGINT))) AS i FROM o)
  UNION ALL SELECT doc_id, 3 + greatest(n, 1), 'TOTAL_THERAPY', 'Total Therapy' FROM o),
hdr AS (
  SELECT doc_id,
    'BHS|^~\&|SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY|20250101120000||BatchType-Normal||B' || doc_id AS bhs,
    'MSH|^~\&|SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY|20250101120000||ORU^R01|MSG' || doc_id || '|P|2.5' AS msh,
    'PID|1||' || (CASE WHEN doc_id % 53 = 0 THEN '' ELSE '07501-' || printf('%08d', c) || '^^^Baxter_Patient_ID~' END)
      || c || '^^^Clinic_Patient_ID||LNAME-' || c || '^FNAME-' || c || '^' AS pid,
    'PV1|1|O|^^^XYZClinic' AS pv1,
    'ORC|RE|' || tid || '|FILLER_ID|||||||20250101120000' AS orc,
    'OBR|1|||VITAL_SIGNS^Vitals Panel^CLINIC_APP|||20250101123423' AS fixed_obr,
    'NTE|1||Treatment ID: ' || tid || '|' AS nte1,
    'NTE|2||Clinic Timezone: PST' AS nte2,
    'OBX|1|ST|DEVICE_TYPE^Device Type|1|' || dev || '||||||F' AS device_obx,
    'BTS|1|final segment|100' AS bts
  FROM o)"""
_OBX_SQL = "WITH " + GEN_CTES + """
SELECT doc_id, obr_set_id, obx_set_id, identifier, value FROM obx"""


@query("hl7_headers", f"WITH {GEN_CTES} SELECT doc_id, bhs, msh FROM hdr")
def q_headers(spark, d):
    return _headers(spark, d).select("doc_id", "bhs", "msh")


@query("hl7_pid", f"WITH {GEN_CTES} SELECT doc_id, pid FROM hdr")
def q_pid(spark, d):
    return _headers(spark, d).select("doc_id", "pid")


@query("hl7_pv1_orc", f"WITH {GEN_CTES} SELECT doc_id, pv1, orc FROM hdr")
def q_pv1_orc(spark, d):
    return _headers(spark, d).select("doc_id", "pv1", "orc")


@query("hl7_fixed_rows", f"WITH {GEN_CTES} SELECT doc_id, fixed_obr, nte1, nte2, device_obx, bts FROM hdr")
def q_fixed(spark, d):
    return _headers(spark, d).select("doc_id", "fixed_obr", "nte1", "nte2", "device_obx", "bts")


@query("hl7_obr_rows", f"""WITH {GEN_CTES}
SELECT doc_id, obr_set_id, identifier,
       'OBR|' || obr_set_id || '|||' || identifier || '^' || display || '|||20250101123423' AS segment FROM obr""")
def q_obr(spark, d):
    return _sections(spark, d).where(F.col("seg_name") == "OBR").select(
        "doc_id", "obr_set_id", "identifier", "segment")


@query("hl7_cycles", f"""WITH {GEN_CTES}
SELECT doc_id, item + 1 AS cycle_no, obr_set_id, count(*) AS n_obx FROM obx WHERE section = 'ACTUAL_THERAPY'
GROUP BY doc_id, item, obr_set_id""")
def q_cycles(spark, d):
    s = _sections(spark, d).where((F.col("seg_name") == "OBX") & (F.col("item") >= 0))
    return s.groupBy("doc_id", "item", "obr_set_id").agg(F.count(F.lit(1)).alias("n_obx")).select(
        "doc_id", (F.col("item") + 1).alias("cycle_no"), "obr_set_id", "n_obx")


@query("hl7_set_ids", f"""WITH {GEN_CTES}
SELECT doc_id, 'OBR' AS seg_name, obr_set_id, 0 AS obx_set_id FROM obr
UNION ALL SELECT doc_id, 'OBX', obr_set_id, obx_set_id FROM obx""")
def q_set_ids(spark, d):
    return _sections(spark, d).select("doc_id", "seg_name", "obr_set_id", "obx_set_id")


@query("json_attr_values", f"""WITH {GEN_CTES}
SELECT x.doc_id, x.section, m.attr, x.item, x.value FROM obx x JOIN mp m ON x.identifier = m.identifier""")
def q_attr_values(spark, d):
    return B.attr_values(_docs(spark, d), B.mapping_frame(spark)).select(
        "doc_id", "section", "attr", "item", "value")


_MESSAGES_SQL = f"""WITH {GEN_CTES},
segs AS (
  SELECT doc_id, 0 AS o1, 0 AS o2, 0 AS o3, bhs AS seg FROM hdr
  UNION ALL SELECT doc_id, 1, 0, 0, msh FROM hdr UNION ALL SELECT doc_id, 2, 0, 0, pid FROM hdr
  UNION ALL SELECT doc_id, 3, 0, 0, pv1 FROM hdr UNION ALL SELECT doc_id, 4, 0, 0, orc FROM hdr
  UNION ALL SELECT doc_id, 5, 0, 0, fixed_obr FROM hdr UNION ALL SELECT doc_id, 6, 0, 0, nte1 FROM hdr
  UNION ALL SELECT doc_id, 7, 0, 0, nte2 FROM hdr UNION ALL SELECT doc_id, 8, 0, 0, device_obx FROM hdr
  UNION ALL SELECT doc_id, 9, obr_set_id, 0,
         'OBR|' || obr_set_id || '|||' || identifier || '^' || display || '|||20250101123423' FROM obr
  UNION ALL SELECT x.doc_id, 9, x.obr_set_id, x.obx_set_id,
         'OBX|' || x.obx_set_id || '|' || m.dtype || '|' || x.identifier || '^' || m.display || '|' || x.obr_set_id
         || '|' || x.value || '|' || m.unit || '|||||F' FROM obx x JOIN mp m ON x.identifier = m.identifier
  UNION ALL SELECT doc_id, 10, 0, 0, bts FROM hdr)
SELECT doc_id, count(*) AS n_segments, string_agg(seg, chr(13) ORDER BY o1, o2, o3) AS hl7_message
FROM segs GROUP BY doc_id"""


@query("hl7_messages", _MESSAGES_SQL)
def q_messages(spark, d):
    return _messages(spark, d).where("status = 'success'").select("doc_id", "n_segments", "hl7_message")


@query("hl7_obx_rows", _OBX_SQL)
def q_obx(spark, d):
    return _sections(spark, d).where(F.col("seg_name") == "OBX").select(
        "doc_id", "obr_set_id", F.col("obx_set_id").cast("bigint").alias("obx_set_id"), "identifier", "value")


@query("hl7_gen_status", """
SELECT o_orderkey AS sequence, CASE WHEN o_orderkey % 47 = 0 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN o_orderkey % 47 = 0 THEN 'Error generating HL7 message: record is not valid JSON' END AS error
FROM orders""")
def q_status(spark, d):
    return _messages(spark, d).select(F.col("doc_id").alias("sequence"), "status", "error")


@query("hl7_gen_totals", """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE o_orderkey % 47 <> 0) AS successful,
       count(*) FILTER (WHERE o_orderkey % 47 = 0) AS failed FROM orders""")
def q_totals(spark, d):
    return B.gen_totals(_messages(spark, d))


@query("hl7_file_manifest", f"""
SELECT doc_id AS sequence, printf('hl7_output_%03d.hl7', doc_id) AS file_name, length(hl7_message) AS n_chars, hl7_message
FROM ({_MESSAGES_SQL})""")
def q_manifest(spark, d):
    """All messages written under their names and read back."""
    path = shared_path(spark, "hl7_output")
    write_message_files(B.file_manifest(_messages(spark, d)), path)
    return read_message_files(spark, path).select("sequence", "file_name", F.length("hl7_message").alias("n_chars"), "hl7_message")


def relational_segments(spark, d):
    """Patients, orders and observations from customer, orders, lineitem."""
    c = table(spark, d, "customer")
    patients = c.select(F.col("c_custkey").cast("string").alias("patient_id"),
                        F.replace(F.col("c_name"), F.lit("#"), F.lit("^")).alias("name"),
                        F.format_string("%04d%02d%02d", (1940 + F.col("c_custkey") % 60).cast("int"),
                                        (1 + F.col("c_custkey") % 12).cast("int"),
                                        (1 + F.col("c_custkey") % 28).cast("int")).alias("dob"),
                        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"))
    o = table(spark, d, "orders")
    orders = o.select(F.col("o_orderkey").cast("string").alias("order_id"),
                      F.col("o_custkey").cast("string").alias("patient_id"),
                      F.concat(F.lit("SVC^"), F.col("o_orderpriority"), F.lit("^LN")).alias("service"),
                      F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("observed_ts"),
                      F.col("o_orderstatus").alias("status"))
    li = table(spark, d, "lineitem")
    pk = F.col("l_partkey").cast("string")
    obs = li.select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("seq"),
                    F.lit("NM").alias("value_type"),
                    F.concat(F.lit("P"), pk, F.lit("^Part "), pk, F.lit("^LN")).alias("code"),
                    F.col("l_quantity").cast("bigint").cast("string").alias("value"),
                    F.lit("mg/dL").alias("unit"), F.lit("1-50").alias("range"),
                    F.col("l_returnflag").alias("status"))
    return B.oru_segments(patients, orders, obs, RUN_TS), orders


ORU_CTES = r"""
ob AS (
  SELECT l_orderkey, l_linenumber,
    'OBX|' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        'P' || l_partkey || '\S\Part ' || l_partkey || '\S\LN', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), l_returnflag)
      || '|NM|P' || l_partkey || '\S\Part ' || l_partkey || '\S\LN||' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
      || '|mg/dL|1-50||||' || l_returnflag AS seg,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        'P' || l_partkey || '\S\Part ' || l_partkey || '\S\LN', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), l_returnflag) AS i
  FROM lineitem),
obl AS (SELECT l_orderkey, list(seg ORDER BY i) AS obx FROM ob GROUP BY l_orderkey),
om AS (
  SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderkey AS VARCHAR) AS msg_id,
    strftime(o.o_orderdate, '%Y%m%d%H%M%S') AS ts,
    ['PID|1||' || o.o_custkey || '||' || replace(c.c_name, '#', '\S\') || '||'
       || printf('%04d%02d%02d', 1940 + o.o_custkey % 60, 1 + o.o_custkey % 12, 1 + o.o_custkey % 28)
       || '|' || (CASE WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END),
     'PV1|1|O',
     'OBR|1|' || o.o_orderkey || '||SVC\S\' || o.o_orderpriority || '\S\LN|||'
       || strftime(o.o_orderdate, '%Y%m%d%H%M%S') || repeat('|', 18) || o.o_orderstatus] || coalesce(b.obx, []) AS body
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN obl b ON o.o_orderkey = b.l_orderkey)"""


@query("oru_from_tables", "WITH " + ORU_CTES + """
SELECT msg_id, array_to_string(['MSH|^~\\&|SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY|20250101120000||ORU^R01^ORU_R01|'
       || msg_id || '|P|2.5'] || body, chr(13)) AS raw, 1 + len(body) AS n_segments FROM om""")
def q_oru(spark, d):
    segs, _ = relational_segments(spark, d)
    return segs.select("msg_id", F.array_join("segs", "\r").alias("raw"), F.size("segs").alias("n_segments"))


@query("oru_multi_patient", "WITH " + ORU_CTES + """,
k AS (SELECT *, substr(ts, 1, 8) || '-' || CAST(floor(o_orderkey / 1000) AS BIGINT) AS batch_key FROM om),
g AS (
  SELECT batch_key, count(DISTINCT o_custkey) AS n_patients, 1 + sum(len(body)) AS n_segments,
         flatten(list(body ORDER BY CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR))) AS segs
  FROM k GROUP BY batch_key)
SELECT batch_key AS msg_id, n_patients, n_segments,
       array_to_string(['MSH|^~\\&|SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY|20250101120000||ORU^R01^ORU_R01|B'
       || batch_key || '|P|2.5'] || segs, chr(13)) AS raw FROM g""")
def q_oru_multi(spark, d):
    segs, _ = relational_segments(spark, d)
    key = F.concat(F.substring("observed_ts", 1, 8), F.lit("-"),
                   F.floor(F.col("order_id").cast("bigint") / 1000).cast("string"))
    return B.oru_multi_patient(segs, key, RUN_TS)


def _broken(segs, key):
    """Faults of structure by key: an order without OBR, a wrong set id, PID after OBR,
    two patients with one set id, and (no fault) two patients numbered rightly."""
    r, s = F.pmod(key.cast("bigint"), F.lit(31)), F.col("segs")
    named = lambda n: F.filter(s, lambda a: F.startswith(a, F.lit(n)))
    second = lambda pid: F.concat(s, F.transform(F.slice(s, F.lit(2), F.size(s) - 1), lambda a: F.when(
        F.startswith(a, F.lit("PID|1|")), F.concat(F.lit(pid), F.substr(a, F.lit(7)))).otherwise(a)))
    return segs.withColumn("segs", F.when(r == 1, F.filter(s, lambda a: ~F.startswith(a, F.lit("OBR"))))
                           .when(r == 2, F.transform(s, lambda a: F.when(F.startswith(a, F.lit("OBX|1|")), F.concat(
                               F.lit("OBX|9|"), F.substr(a, F.lit(7)))).otherwise(a)))
                           .when(r == 3, F.concat(named("MSH"), named("PV1"), named("OBR"), named("PID"), named("OBX")))
                           .when(r == 4, second("PID|1|")).when(r == 5, second("PID|2|")).otherwise(s))


MSH_SQL = r"""'MSH|^~\&|SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY|20250101120000||ORU^R01^ORU_R01|' || msg_id || '|P|2.5'"""
BROKEN_SQL = "WITH " + ORU_CTES + f""",
whole AS (SELECT msg_id, o_orderkey % 31 AS r, body, body[1] AS pid, body[2] AS pv1, body[3] AS obr, body[4:] AS obx FROM om),
broken AS (
  SELECT msg_id, r, [{MSH_SQL}] || CASE r
    WHEN 1 THEN [pid, pv1] || obx
    WHEN 2 THEN [pid, pv1, obr] || list_transform(obx, lambda x: CASE WHEN x LIKE 'OBX|1|%' THEN 'OBX|9|' || substr(x, 7) ELSE x END)
    WHEN 3 THEN [pv1, obr, pid] || obx
    WHEN 4 THEN body || body
    WHEN 5 THEN body || ['PID|2|' || substr(pid, 7), pv1, obr] || obx
    ELSE body END AS segs FROM whole),
flat AS (
  SELECT msg_id, i, seg, split_part(seg, '|', 1) AS name, split_part(seg, '|', 2) AS sid
  FROM (SELECT msg_id, unnest(segs) AS seg, unnest(range(1, CAST(len(segs) AS BIGINT) + 1)) AS i FROM broken)),
grp AS (
  SELECT *, count(*) FILTER (WHERE name = 'PID') OVER w AS np,
    count(*) FILTER (WHERE name IN ('PID', 'OBR')) OVER w AS nb,
    coalesce(lag(name) OVER (PARTITION BY msg_id ORDER BY i), 'message start') AS prev
  FROM flat WINDOW w AS (PARTITION BY msg_id ORDER BY i)),
num AS (
  SELECT *, count(*) FILTER (WHERE name = 'OBR') OVER (PARTITION BY msg_id, np ORDER BY i) AS nr,
    count(*) FILTER (WHERE name = 'OBX') OVER (PARTITION BY msg_id, nb ORDER BY i) AS nx FROM grp)"""


@query("oru_structure", BROKEN_SQL + """,
allowed(a, b) AS (VALUES ('message start', 'MSH'), ('MSH', 'PID'), ('PID', 'PV1'), ('PID', 'ORC'), ('PID', 'OBR'),
  ('PV1', 'ORC'), ('PV1', 'OBR'), ('ORC', 'OBR'), ('OBR', 'OBX'), ('OBX', 'OBX'), ('OBX', 'ORC'), ('OBX', 'OBR'), ('OBX', 'PID')),
due AS (SELECT *, CASE name WHEN 'PID' THEN np WHEN 'OBR' THEN nr WHEN 'OBX' THEN nx END AS expected FROM num),
has AS (SELECT msg_id, bool_or(name = 'OBX') AS obx, bool_or(name = 'OBR') AS obr, max(i) AS n, arg_max(name, i) AS last
        FROM flat GROUP BY msg_id)
SELECT msg_id, 'error' AS severity, 'segment_missing' AS code, 'OBX' AS location,
       'Required segment OBX is missing' AS message FROM has WHERE NOT obx
UNION ALL SELECT msg_id, 'error', 'segment_missing', 'OBR', 'Required segment OBR is missing' FROM has WHERE NOT obr
UNION ALL SELECT msg_id, 'error', 'no_obx', 'OBX', 'At least one OBX segment is required for ORU_R01' FROM has WHERE NOT obx
UNION ALL SELECT msg_id, 'error', 'group', 'segment ' || i, name || ' is not expected after ' || prev
FROM due WHERE NOT EXISTS (SELECT 1 FROM allowed WHERE a = prev AND b = name)
UNION ALL SELECT msg_id, 'error', 'group', 'segment ' || i, name || ' set id ' || sid || ' out of sequence, expected ' || expected
FROM due WHERE expected IS NOT NULL AND sid <> CAST(expected AS VARCHAR)
UNION ALL SELECT msg_id, 'error', 'group', 'segment ' || n, 'message ends after ' || last FROM has WHERE last <> 'OBX'""")
def q_oru_structure(spark, d):
    segs, _ = relational_segments(spark, d)
    return HG.structure(B.oru_messages(_broken(segs, F.col("order_id"))))


_XML_SQL = BROKEN_SQL + """,
fx AS (
  SELECT msg_id, i, name, j + CASE WHEN name = 'MSH' THEN 1 ELSE 0 END AS j, f[j + 1] AS v
  FROM (SELECT *, unnest(range(1, CAST(len(f) AS BIGINT))) AS j FROM (SELECT *, string_split(seg, '|') AS f FROM num))),
sx AS (
  SELECT msg_id, i, string_agg('<' || name || '.' || j || '>' || replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
         || '</' || name || '.' || j || '>', '' ORDER BY j) FILTER (WHERE v <> '') AS fields
  FROM fx GROUP BY msg_id, i),
px AS (
  SELECT n.msg_id, n.i, CASE
      WHEN name = 'PID' AND np > 1 THEN '</ORU_R01.ORDER_OBSERVATION></ORU_R01.PATIENT_RESULT><ORU_R01.PATIENT_RESULT>'
      WHEN name = 'PID' THEN '<ORU_R01.PATIENT_RESULT>' WHEN name = 'OBR' THEN '<ORU_R01.ORDER_OBSERVATION>' ELSE '' END
    || '<' || name || '>' || CASE WHEN name = 'MSH' THEN '<MSH.1>|</MSH.1>' ELSE '' END || coalesce(fields, '') || '</' || name || '>' AS x
  FROM num n LEFT JOIN sx ON n.msg_id = sx.msg_id AND n.i = sx.i JOIN whole w ON n.msg_id = w.msg_id WHERE w.r NOT IN (1, 2, 3))
SELECT msg_id, '<ORU_R01>' || string_agg(x, '' ORDER BY i) || '</ORU_R01.ORDER_OBSERVATION></ORU_R01.PATIENT_RESULT></ORU_R01>' AS xml
FROM px GROUP BY msg_id"""


def _whole_messages(spark, d):
    """Messages of one or two patients, without those that ``_broken`` breaks."""
    segs, _ = relational_segments(spark, d)
    whole = segs.where(~F.pmod(F.col("order_id").cast("bigint"), F.lit(31)).isin(1, 2, 3))
    return B.oru_messages(_broken(whole, F.col("order_id")))


@query("oru_xml", _XML_SQL)
def q_oru_xml(spark, d):
    return HG.to_xml(_whole_messages(spark, d))


@query("oru_xml_read", BROKEN_SQL + """
SELECT msg_id, array_to_string(segs, chr(13)) AS raw FROM broken WHERE r NOT IN (1, 2, 3)""")
def q_oru_xml_read(spark, d):
    """The XML of all whole messages written, read back and turned into segments again."""
    path = shared_path(spark, "oru-xml")
    HG.to_xml(_whole_messages(spark, d)).write.parquet(path)
    return HG.from_xml(spark.read.parquet(path))


@query("oru_batch_segments", "WITH " + ORU_CTES + r""",
k AS (SELECT *, substr(ts, 1, 4) AS batch_key, row_number() OVER (PARTITION BY substr(ts, 1, 4)
        ORDER BY CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS pno FROM om),
g AS (
  SELECT batch_key, flatten(list(['PID|' || pno || substr(body[1], 6)] || body[2:] ORDER BY pno)) AS body FROM k GROUP BY batch_key),
m AS (
  SELECT batch_key AS msg_id, ['MSH|^~\&|SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY|20250101120000||ORU^R01^ORU_R01|B'
       || batch_key || '|P|2.5'] || body AS segs FROM g)
SELECT msg_id, unnest(range(1, CAST(len(segs) AS BIGINT) + 1)) AS seg_no, unnest(segs) AS segment FROM m""")
def q_batch_segments(spark, d):
    """A message a year: each holds about a seventh of all orders."""
    segs, _ = relational_segments(spark, d)
    return HG.batch_segments(segs, F.substring("observed_ts", 1, 4), RUN_TS)
