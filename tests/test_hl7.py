"""HL7 parsing and validation on the reference's sample messages.

Expected error / warning counts are the hand-worked results of FIXTURES.md
section 5 (the samples themselves are not valid by the rules, D26)."""

import pytest

from recordchecks.operators import hl7_parse as HP
from recordchecks.operators import hl7_validate as HV

FULL = "\n".join([
    r"MSH|^~\&|LAB_SYSTEM|LAB_FACILITY|HIS_SYSTEM|HOSPITAL|20240101143000||ORU^R01|MSG12345|P|2.5.1|||AL|NE",
    "PID|1|12345^^^HOSP^MR|12345^^^HOSP^MR||PATIENT^SAMPLE^J||19850101|M|||123 MAIN ST^^CITY^ST^12345||(555)123-4567|||S||123456789|",
    "PV1|1|O|OPD^101^^^HOSP||||123456^DOCTOR^JOHN^^^^^^MD|||SUR||||2|||||||||||||||||||||20240101100000|",
    "ORC|NW|PLACER123|FILLER456|||||||||||123456^DOCTOR^JOHN^^^^^^MD|",
    "OBR|1|PLACER123|FILLER456|LAB1234^COMPLETE BLOOD COUNT^LN|||20240101140000|||||||||||||||||||||F||||||||||C|20240101143000|",
    "OBX|1|NM|WBC^White Blood Cell Count^LN||7.5|10*3/uL|4.0-11.0|||F|||20240101141500|",
    "OBX|2|NM|RBC^Red Blood Cell Count^LN||4.5|10*6/uL|4.2-5.8|||F|||20240101141500|",
    "OBX|3|NM|HGB^Hemoglobin^LN||14.0|g/dL|13.0-17.0|||F|||20240101141500|",
    "OBX|4|NM|HCT^Hematocrit^LN||42.0|%|39.0-50.0|||F|||20240101141500|",
])
COMPLETE = "\n".join([
    r"MSH|^~\&|LAB_SYSTEM|LAB_FACILITY|HIS_SYSTEM|HOSPITAL|20240101143000||ORU^R01|MSG12345|P|2.5|||AL|NE",
    "PID|1|12345^^^HOSP^MR||PATIENT^SAMPLE^J||19850101|M|||123 MAIN ST^^CITY^ST^12345||(555)123-4567|",
    "PV1|1|O|OPD^101^^^HOSP||||123456^DOCTOR^JOHN^^^^^^MD|",
    "OBR|1|||LAB1234^COMPLETE BLOOD COUNT^LN|||20240101140000|||||||||||||||||||||F|",
    "OBX|1|NM|WBC^White Blood Cell Count^LN||7.5|10*3/uL|4.0-11.0|||F|||20240101141500|",
])
MINIMAL = "\n".join([
    r"MSH|^~\&|SEND|FAC|RECV|FAC|202401011200||ORU^R01|123|P|2.3|",
    "OBR|1|||TEST^TEST^LN|||202401011200|||||||||||||||||||||F|",
    "OBX|1|ST|TEST^Test^LN||Result||||F|||",
])
PROBLEM = "\n".join([
    r"MSH|^~\&|SEND|FAC|RECV|FAC|202401011200||ORU^R01|123|P|2.3|",
    "PID|1|||||||",
    "OBR|1||||||202401011200|||||||||||||||||||||",
    "OBX|1|||||||||||",
])
ADT = "\n".join([
    r"MSH|^~\&|SYS1|FAC1|SYS2|FAC2|202401011200||ADT^A01|123|P|2.3|",
    "EVN|A01|202401011200|",
    "PID|1|12345^^^FAC^MR||TEST^PATIENT^^^||19700101|M|||",
])

EXPECTED = {  # msg_id: (strict errors, strict warnings, lenient errors, lenient warnings)
    "full": (5, 2, 5, 2),
    "complete": (8, 2, 2, 5),
    "minimal": (7, 0, 2, 2),
    "problem": (14, 0, 6, 5),
    "adt": (8, 2, 1, 8),
}


@pytest.fixture(scope="module")
def msgs(spark):
    rows = [("full", FULL), ("complete", COMPLETE), ("minimal", MINIMAL), ("problem", PROBLEM), ("adt", ADT),
            ("crlf", FULL.replace("\n", "\r\n")), ("cr", FULL.replace("\n", "\r")),
            ("bad", "EVN|A01\n" + FULL), ("null", None)]
    return spark.createDataFrame(rows, "msg_id string, raw string")


def test_verdict_counts(msgs):
    got = {(r.msg_id, r.profile): (r.error_count, r.warning_count) for r in HV.verdict(msgs).collect()}
    for mid, (se, sw, le, lw) in EXPECTED.items():
        assert got[(mid, "strict")] == (se, sw), mid
        assert got[(mid, "lenient")] == (le, lw), mid
    # line endings do not matter
    assert got[("crlf", "strict")] == got[("full", "strict")] == got[("cr", "strict")]
    assert got[("bad", "strict")] == (1, 0) and got[("null", "lenient")] == (1, 0)


def test_full_message_details(msgs):
    f = HV.findings(msgs.where("msg_id = 'full'"), ("strict",)).collect()
    errs = sorted(r.location for r in f if r.severity == "error")
    assert errs == ["OBR.25", "OBX[1].11", "OBX[2].11", "OBX[3].11", "OBX[4].11"]
    warns = sorted(r.message for r in f if r.severity == "warning")
    assert warns == ["OBX[1].6 units format may be invalid: 10*3/uL",
                     "OBX[2].6 units format may be invalid: 10*6/uL"]


def test_adt_details(msgs):
    f = HV.findings(msgs.where("msg_id = 'adt'"), ("strict",)).collect()
    w = {r.message for r in f if r.severity == "warning"}
    assert "Expected message type ORU^R01, found ADT^A01" in w
    assert "PID.7 timestamp format may be invalid: M" in w
    t = HP.message_type(msgs.where("msg_id = 'adt'")).collect()[0]
    assert t.message_type == "ADT^A01" and t.type_warning == "Expected message type ORU^R01, but found ADT^A01"


def test_timestamps(spark):
    good = ["20240101", "202401011200", "20240101143000", "20240101143000.1234+0500"]
    bad_fmt = ["2024", "20241399", "2024010114"]
    bad_date = ["20240230", "20241939"]
    rows = []
    for i, ts in enumerate(good + bad_fmt + bad_date):
        raw = (rf"MSH|^~\&|A|B|C|D|{ts}||ORU^R01|1|P|2.5" + "\nPID|1||1^^^H||N^M||19800101|M\nPV1|1|O"
               "\nORC|NW|1|2\nOBR|1|1|2|X^Y|||20240101|||||||||||||||||||F\nOBX|1|NM|A^B||1|mg|1-2|||F")
        rows.append((ts, raw))
    df = spark.createDataFrame(rows, "msg_id string, raw string")
    f = HV.findings_of(df, "timestamps").collect()
    by = {}
    for r in f:
        by.setdefault((r.msg_id, r.profile), set()).add(r.code)
    for ts in good:
        assert (ts, "strict") not in by
    assert by[("20241399", "strict")] == {"ts_format", "ts_date"}
    assert by[("20241399", "lenient")] == {"ts_format"}  # lenient tests the date only after the pattern
    assert by[("20240230", "strict")] == {"ts_date"} and by[("20240230", "lenient")] == {"ts_date"}
    assert by[("2024010114", "strict")] == {"ts_format"}


def test_pid3_units_range_orc(spark):
    raw = (r"MSH|^~\&|A|B|C|D|20240101||ORU^R01|1|P|2.5" + "\nPID|1||1^^^H~^^^H||N^M||19800101|M\nPV1|1|O"
           "\nORC|NW|P1|F1\nOBR|1|P2|F1|X^Y|||20240101|||||||||||||||||||F"
           "\nOBX|1|NM|A^B||1|mg|<5|||F\nOBX|2|NM|AB||1|mg|>= 3|||F")
    df = spark.createDataFrame([("m", raw)], "msg_id string, raw string")
    f = {(r.profile, r.code, r.location) for r in HV.findings(df).collect()}
    assert ("strict", "pid3_id", "PID.3") in f
    assert ("strict", "ref_range", "OBX[2].7") in f and ("strict", "ref_range", "OBX[1].7") not in f
    assert ("strict", "order_mismatch", "ORC.2") in f and ("lenient", "order_mismatch", "ORC.2") in f
    assert ("strict", "obx3_component", "OBX[2].3") in f


def test_fields_and_availability(msgs):
    fl = HP.fields(msgs.where("msg_id = 'minimal'"))
    msh = {r.field_no: r.value for r in fl.where("seg_name = 'MSH'").collect()}
    assert msh[1] == "|" and msh[2] == "^~\\&" and msh[9] == "ORU^R01" and msh[12] == "2.3"
    av = {(r.seg_name): r.n_available for r in HP.availability(msgs.where("msg_id = 'minimal'")).collect()}
    assert av["OBX"] == 5  # 1, ST, TEST^Test^LN, Result, F
    pv = HP.field_preview(msgs.where("msg_id = 'full'")).where("seg_name = 'PV1'").collect()
    assert all(len(r.preview) <= 53 for r in pv)


def test_partition_invariance(msgs):
    a = sorted(tuple(r) for r in HV.verdict(msgs.repartition(1)).collect())
    b = sorted(tuple(r) for r in HV.verdict(msgs.repartition(7)).collect())
    assert a == b
