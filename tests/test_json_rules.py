"""JSON rule checks on the reference's sample document (FIXTURES.md 7)."""

import json

import pytest

from recordchecks.operators import json_rules as J

DOC = {
    "Patient Info": {"ERP Patient ID": "07501-77130212", "Clinic Patient ID": "123445531", "Treatment ID": 1102786,
                     "Device Type": "AMIA", "First Name": "FNAME-77130212", "Last Name": "LNAME-77130212",
                     "DOB": "26-APR-1986"},
    "Batch": {"ID": "bd31f758", "Date": "12-Aug-2024", "Time": "09:15", "Type": "Normal"},
    "Treatment Time": {"Date": "12-AUG-2024", "Time": "05:10"},
    "Vitals": {"Pre-Treatment": {"Weight": 130, "Blood Pressure Systolic": "100", "Blood Pressure Diastolic": "200",
                                 "Pulse": "100", "Glucose": "60", "Temperature": "212"},
               "Post-Treatment": {"Weight": 140, "Blood Pressure Systolic": "100", "Blood Pressure Diastolic": "210",
                                  "Pulse": "150", "Glucose": "70", "Temperature": "230"}},
    "Actual Therapy": [{"Therapy Cycle Time": "06:30:00", "Cycle Type": "LASTFILL",
                        "CycleAttributes": {"Fill Volume": 100, "Fill Time": 600}}],
}
R = [  # CUSTOMER_ID .. LENGTH
    (1, "C", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Weight", "w", "NUMBER", "N", None, None),
    (1, "C", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Weight", "w", "STRING", "N", None, None),
    (1, "C", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Temperature", "t", "NUMBER", "N", None, None),
    (1, "C", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Blood Pressure Diastolic", "d", "INTEGER", "N", None, None),
    (1, "C", "BOTH", "TREATMENT", "Patient Info.DOB", "dob", "STRING", "N", "DD-MON-YYYY", None),
    (1, "C", "BOTH", "TREATMENT", "Batch.Time", "bt", "STRING", "N", "HH:MM:SS", None),
    (1, "C", "BOTH", "TREATMENT", "Actual Therapy[0].Cycle Type", "ct", "STRING", "N", None, 5),
    (1, "C", "BOTH", "TREATMENT", "Actual Therapy[*].Cycle Type", "ct", "STRING", "N", None, None),
    (1, "C", "BOTH", "TREATMENT", "Actual Therapy[3].Cycle Type", "ct", "STRING", "N", None, None),
    (1, "C", "BOTH", "TREATMENT", "Patient Info.Middle Name", "mn", "STRING", "Y", None, None),
    (1, "C", "CLARIA", "TREATMENT", "Batch.ID", "bid", "INTEGER", "N", None, None),
    (2, "C", "BOTH", "TREATMENT", "Batch.ID", "bid", "INTEGER", "N", None, None),
]


@pytest.fixture(scope="module")
def validated(spark):
    rules = J.compile_rules(J.filter_rules(J.rules_frame(spark, R), "AMIA", 1, "TREATMENT"))
    docs = spark.createDataFrame([(1, json.dumps(DOC)), (2, json.dumps(DOC)), (3, json.dumps(DOC)),
                                  (4, "{not json")], "doc_id long, json string")
    return J.validate(docs, rules).cache()


def test_rule_filter(spark):
    rules = J.compile_rules(J.filter_rules(J.rules_frame(spark, R), "AMIA", 1, "TREATMENT"))
    assert len(rules) == 10  # CLARIA-only and customer 2 rules dropped


def test_field_results(validated):
    rows = J.field_checks(validated).where("doc_id = 1").orderBy("rule_no", "field_path").collect()
    res = [(r.rule_no, r.field_path, r.is_valid, list(r.errors)) for r in rows]
    assert res == [
        (1, "Vitals.Pre-Treatment.Weight", True, []),
        (2, "Vitals.Pre-Treatment.Weight", False, ["Expected string, got int"]),
        (3, "Vitals.Pre-Treatment.Temperature", False, ["Temperature value out of reasonable range (90-110°F)"]),
        (4, "Vitals.Pre-Treatment.Blood Pressure Diastolic", True, []),
        (5, "Patient Info.DOB", True, []),
        (6, "Batch.Time", False, ["Invalid timestamp format. Expected: HH:MM:SS"]),
        (7, "Actual Therapy[0].Cycle Type", False, ["Length 8 exceeds maximum 5"]),
        (8, "Actual Therapy[0].Cycle Type", True, []),
        (9, "Actual Therapy[3].Cycle Type", False, ["Required field is missing or empty"]),
        (10, "Patient Info.Middle Name", True, []),
    ]


def test_summary_warnings_batch(validated):
    s = {r.doc_id: r for r in J.summary(validated).collect()}
    assert s[1].total_fields_checked == 10 and s[1].passed_validation == 5 and s[1].failed_validation == 5
    assert s[1].missing_required_fields == "Actual Therapy[3].Cycle Type" and s[1].warning_count == 0
    assert not s[4].is_valid and s[4].total_fields_checked == 0
    t = J.batch_totals(validated).collect()[0]
    assert (t.total_files, t.valid_files, t.invalid_files) == (4, 0, 4)
    ce = {r.error: r.n for r in J.common_errors(validated).collect()}
    assert ce["Expected string, got int"] == 3 and ce["Validation error: document is not valid JSON"] == 1
    top = J.top_errors(validated, 2).collect()
    assert [r.n for r in top] == [3, 3] and top[0].error < top[1].error


def test_report_lines(validated):
    lines = [r.line for r in J.report_lines(validated).where("doc_id = 1 AND section = 'summary'")
             .orderBy("ord").collect()]
    assert lines == ["Total Fields Checked: 10", "Passed Validation: 5", "Failed Validation: 5",
                     "Overall Status: FAIL"]


def test_warnings(spark):
    doc = json.loads(json.dumps(DOC))
    doc["Vitals"]["Pre-Treatment"]["Weight"] = 20
    del doc["Vitals"]["Post-Treatment"]["Blood Pressure Systolic"]
    docs = spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, json string")
    w = [r.warning for r in J.quality_issues(J.validate(docs, [])).collect()]
    assert w == ["Optional medical field Vitals.Post-Treatment.Blood Pressure Systolic is missing",
                 "Extreme value in Vitals.Pre-Treatment.Weight: 20 (expected 30-300)"]


def test_load_rules_rejects_missing_columns(spark, tmp_path):
    p = tmp_path / "rules.csv"
    p.write_text("CUSTOMER_ID,DEVICE\n1,BOTH\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        J.load_rules(spark, str(p))
