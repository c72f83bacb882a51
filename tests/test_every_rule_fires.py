"""Every rule of the tables fires on the derived messages."""

from conftest import SF_SMALL
from recordchecks.operators import hl7_validate as HV
from recordchecks.sources.bindings import hl7_messages

SF = SF_SMALL.replace("0.001", "0.01")


def test_every_hl7_rule_fires(spark):
    got = {(r.profile, r.code, r.location.split("[")[0] + "." + r.location.rsplit(".", 1)[-1] if "[" in r.location else r.location)
           for r in HV.findings(hl7_messages(spark, SF)).select("profile", "code", "location").distinct().collect()}
    strict = {("segment_missing", s) for s in ("PID", "PV1", "ORC", "OBR", "OBX")} | {("no_obx", "OBX"), ("parse", "MSH"), ("msg_type", "MSH.9"), ("version", "MSH.12")}
    strict |= {("required", f"MSH.{n}") for n in (2, 3, 4, 5, 6, 7, 9, 10, 11, 12)} | {("required", f"PID.{n}") for n in (3, 5, 7, 8)}
    strict |= {("required", f"OBR.{n}") for n in (2, 3, 4, 7, 25)} | {("required", f"OBX.{n}") for n in (1, 2, 3, 5, 11)} | {("required", "PV1.2")}
    strict |= {("code_set", x) for x in ("PID.8", "PV1.2", "ORC.1", "OBR.25", "OBR.5", "OBX.2", "OBX.11")} | {("pid3_id", "PID.3")}
    strict |= {("ts_format", x) for x in ("PID.7", "OBR.7")} | {("ts_date", x) for x in ("MSH.7", "PID.7", "OBR.7")}
    strict |= {("units", "OBX.6"), ("ref_range", "OBX.7"), ("obx3_component", "OBX.3"), ("order_mismatch", "ORC.2"), ("order_mismatch", "ORC.3")}
    lenient = {("parse", "MSH"), ("no_obx", "OBX"), ("msg_type", "MSH.9"), ("version", "MSH.12"), ("order_mismatch", "ORC.2")}
    lenient |= {("segment_expected", s) for s in ("PID", "PV1", "OBR", "OBX")} | {("recommended", f"MSH.{n}") for n in (7, 9, 10, 12)}
    lenient |= {("recommended", f"PID.{n}") for n in (3, 5, 7, 8)} | {("critical", f"OBR.{n}") for n in (4, 7, 25)}
    lenient |= {("critical", f"OBX.{n}") for n in (2, 3, 5, 11)} | {("code_set", x) for x in ("PID.8", "PV1.2", "ORC.1", "OBR.25", "OBX.2", "OBX.11")}
    missing = ({("strict", *x) for x in strict} | {("lenient", *x) for x in lenient}) - got
    assert not missing, sorted(missing)


def test_every_json_message_kind_occurs(spark):
    from pyspark.sql import functions as F

    from recordchecks.operators import json_rules as J
    from recordchecks.rules import json_rules as JR
    from recordchecks.sources.bindings import device_records
    rules = J.compile_rules(J.filter_rules(J.rules_frame(spark), "CLARIA", 1, "TREATMENT"))
    found = J.findings(J.validate(device_records(spark, SF), rules))
    kinds = {r[0] for r in found.select(F.regexp_replace("message", r"[0-9.]+|: .*| [(].*", "")).distinct().collect()}
    texts = {r[0] for r in found.where("message like '%out of reasonable range%'").select("message").distinct().collect()}
    assert texts == {r[-1] for r in JR.RANGE_RULES}
    for kind in (JR.MSG_REQUIRED, JR.MSG_TS_NOT_STRING, "Expected number, got str", "Expected integer, got str", "Length  exceeds maximum ",
                 "Invalid timestamp format. Expected", "Validation error", "Extreme value in Vitals"):
        assert any(k.startswith(kind.replace(".", "")) or k.startswith(kind) for k in kinds), (kind, kinds)
    assert any("is missing" in k for k in kinds)
