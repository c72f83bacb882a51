"""Registered HL7 parse / validation queries over the message
table derived from orders, customer and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.operators import hl7_groups as HG
from recordchecks.operators import hl7_parse as HP
from recordchecks.operators import hl7_validate as HV
from recordchecks.plans.hl7_sql import with_findings, with_parsed
from recordchecks.plans.registry import query
from recordchecks.sources.bindings import hl7_messages

FIELDS_SQL = """
flds AS (
  SELECT msg_id, seg_pos, name AS seg_name, occ AS seg_occ, 1 AS field_no, '|' AS value
  FROM segs2 WHERE name = 'MSH'
  UNION ALL
  SELECT msg_id, seg_pos, name, occ, CASE WHEN name = 'MSH' THEN idx ELSE idx - 1 END, f[idx]
  FROM (SELECT *, unnest(range(2, len(f) + 1)) AS idx FROM segs2))"""


def _with_fields(final):
    return with_parsed("").rstrip() + "," + FIELDS_SQL + "\n" + final


@query("hl7_segments", with_parsed("""
SELECT msg_id, seg_pos, name AS seg_name, occ AS seg_occ, len(f) - 1 AS n_fields,
       array_to_string(f, '|') AS seg_text FROM segs2"""))
def q_segments(spark, d):
    return HP.segments(hl7_messages(spark, d))


@query("hl7_fields", _with_fields("""
SELECT msg_id, seg_pos, seg_name, seg_occ, field_no, value,
       len(string_split(value, '~')) AS n_reps,
       string_split(string_split(value, '~')[1], '^')[1] AS first_component
FROM flds"""))
def q_fields(spark, d):
    return HP.fields(hl7_messages(spark, d))


@query("hl7_field_tree", _with_fields(r""", lv AS (
  SELECT msg_id, seg_pos, seg_name, field_no, value, (seg_name = 'MSH' AND field_no <= 2) OR msg_id IN (
           SELECT msg_id FROM flds WHERE seg_name = 'MSH' AND seg_occ = 1 AND field_no = 2 AND value = '') AS whole,
         msg_id LIKE '%5' OR msg_id LIKE '%0' AS other FROM flds WHERE value <> ''),
rp AS (SELECT * EXCLUDE (value), unnest(l) AS value, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS rep_no
       FROM (SELECT *, CASE WHEN whole THEN [value] ELSE string_split(value, '~') END AS l FROM lv)),
cp AS (SELECT * EXCLUDE (value, l), unnest(l2) AS value, unnest(range(1, CAST(len(l2) AS BIGINT) + 1)) AS comp_no
       FROM (SELECT *, CASE WHEN whole THEN [value] ELSE string_split(value, '^') END AS l2 FROM rp)),
sp AS (SELECT * EXCLUDE (value, l2), unnest(l3) AS value, unnest(range(1, CAST(len(l3) AS BIGINT) + 1)) AS sub_no
       FROM (SELECT *, CASE WHEN whole THEN [value] ELSE string_split(value, '&') END AS l3 FROM cp))
SELECT msg_id, seg_pos, seg_name, field_no, rep_no, comp_no, sub_no,
       CASE WHEN whole AND other THEN translate(value, '|^~\&', '!@$?;') ELSE value END AS value
FROM sp WHERE value <> ''"""))
def q_field_tree(spark, d):
    """A fifth of the messages declare other delimiters; the tree is the same."""
    other = F.col("msg_id").cast("string").rlike("[05]$")
    return HG.field_tree(hl7_messages(spark, d).withColumn("raw", F.when(
        other, F.translate("raw", "|^~\\&", "!@$?;")).otherwise(F.col("raw"))))


@query("hl7_available_fields", _with_fields("""
SELECT msg_id, seg_pos, seg_name, seg_occ, field_no, value FROM flds
WHERE coalesce(trim(value), '') <> ''"""))
def q_available(spark, d):
    return HP.available_fields(hl7_messages(spark, d))


@query("hl7_field_preview", _with_fields("""
SELECT msg_id, seg_pos, seg_name, field_no,
       CASE WHEN length(value) > 50 THEN left(value, 50) || '...' ELSE value END AS preview
FROM flds WHERE coalesce(trim(value), '') <> ''"""))
def q_preview(spark, d):
    return HP.field_preview(hl7_messages(spark, d))


@query("hl7_availability", _with_fields("""
SELECT s.msg_id, s.seg_pos, s.name AS seg_name, s.occ AS seg_occ,
       count(*) FILTER (WHERE coalesce(trim(x.value), '') <> '') AS n_available
FROM segs2 s LEFT JOIN flds x ON s.msg_id = x.msg_id AND s.seg_pos = x.seg_pos
GROUP BY s.msg_id, s.seg_pos, s.name, s.occ"""))
def q_availability(spark, d):
    return HP.availability(hl7_messages(spark, d))


@query("hl7_message_type", with_parsed("""
SELECT m.msg_id,
  CASE WHEN coalesce(trim(msh[9]), '') <> '' THEN msh[9] END AS message_type,
  CASE WHEN coalesce(trim(msh[9]), '') <> '' AND strpos(msh[9], 'ORU^R01') = 0
       THEN 'Expected message type ORU^R01, but found ' || msh[9] END AS type_warning
FROM m"""))
def q_message_type(spark, d):
    return HP.message_type(hl7_messages(spark, d))


@query("hl7_unparseable", with_parsed("""
SELECT msg_id, 'HL7 Validation Error: message does not start with an MSH segment' AS strict_error,
       'Message parsing failed: message does not start with an MSH segment' AS lenient_error
FROM m WHERE NOT parsed"""))
def q_unparseable(spark, d):
    return HP.unparseable(hl7_messages(spark, d))


_FCOLS = ["msg_id", "profile", "severity", "code", "location", "message"]


@query("hl7_findings", with_findings("SELECT * FROM fnd"))
def q_findings(spark, d):
    return HV.findings(hl7_messages(spark, d)).select(*_FCOLS)


@query("hl7_verdict", with_findings("""
SELECT m.msg_id, p.profile, coalesce(c.e, 0) = 0 AS is_valid, coalesce(c.e, 0) AS error_count,
       coalesce(c.w, 0) AS warning_count
FROM m CROSS JOIN (VALUES ('strict'), ('lenient')) p(profile)
LEFT JOIN (SELECT msg_id, profile, count(*) FILTER (WHERE severity = 'error') AS e,
                  count(*) FILTER (WHERE severity = 'warning') AS w
           FROM fnd GROUP BY msg_id, profile) c
  ON c.msg_id = m.msg_id AND c.profile = p.profile"""))
def q_verdict(spark, d):
    return HV.verdict(hl7_messages(spark, d))


def _group_query(key: str, group: str, profiles=("strict", "lenient")):
    from recordchecks.rules.hl7_rules import CODE_GROUPS
    codes = ", ".join(f"'{c}'" for c in CODE_GROUPS[group])
    profs = ", ".join(f"'{p}'" for p in profiles)
    sql = with_findings(f"SELECT * FROM fnd WHERE code IN ({codes}) AND profile IN ({profs})")

    @query(key, sql)
    def q(spark, d):
        return HV.findings_of(hl7_messages(spark, d), group, profiles).select(*_FCOLS)
    return q


_group_query("hl7_strict_structure", "structure", ("strict",))
_group_query("hl7_lenient_structure", "structure", ("lenient",))
_group_query("hl7_strict_required", "required", ("strict",))
_group_query("hl7_lenient_required", "required", ("lenient",))
_group_query("hl7_pid3", "pid3", ("strict",))
_group_query("hl7_msgtype_check", "msg_type")
_group_query("hl7_code_sets", "code_sets")
_group_query("hl7_timestamps", "timestamps")
_group_query("hl7_units", "units")
_group_query("hl7_ref_range", "ref_range", ("strict",))
_group_query("hl7_order_consistency", "order_consistency")
_group_query("hl7_obx3", "obx3", ("strict",))
