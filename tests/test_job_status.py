"""Job status statements: the reference's 12 cases and 3-job batch."""

from recordchecks.operators import job_status as JS

SCHEMA = "job_seq long, job_id string, amia_status string, claria_status string, reprocess_amia string, reprocess_claria string"
CASES = [
    ("SUCCESS", "SUCCESS", None, None, "STATEMENT_SUCCESS"),
    ("FAILURE", "FAILURE", None, None, "STATEMENT_FAILED"),
    ("PARTIAL_SUCCESS", "PARTIAL_SUCCESS", None, None, "STATEMENT_PARTIAL_SUCCESS"),
    ("SUCCESS", "FAILURE", None, None, "STATEMENT_SUCCESS_AND_FAILURE"),
    ("FAILURE", "PARTIAL_SUCCESS", None, None, "STATEMENT_FAILURE_AND_PARTIAL_SUCCESS"),
    ("SUCCESS", "PARTIAL_SUCCESS", None, None, "STATEMENT_SUCCESS_AND_PARTIAL_SUCCESS"),
    ("FAILURE", "FAILURE", "SUCCESS", "SUCCESS", "STATEMENT_REPROCESS_SUCCESS"),
    ("FAILURE", "FAILURE", "FAILURE", "FAILURE", "STATEMENT_REPROCESS_FAILED"),
    ("FAILURE", "FAILURE", "PARTIAL_SUCCESS", "PARTIAL_SUCCESS", "STATEMENT_REPROCESS_PARTIAL_SUCCESS"),
    ("FAILURE", "FAILURE", "SUCCESS", "FAILURE", "STATEMENT_REPROCESS_SUCCESS_AND_FAILURE"),
    ("FAILURE", "FAILURE", "FAILURE", "PARTIAL_SUCCESS", "STATEMENT_REPROCESS_FAILURE_AND_PARTIAL_SUCCESS"),
    ("FAILURE", "FAILURE", "SUCCESS", "PARTIAL_SUCCESS", "STATEMENT_REPROCESS_SUCCESS_AND_PARTIAL_SUCCESS"),
]


def test_twelve_cases(spark):
    df = spark.createDataFrame([(i + 1, f"J{i}", a, c, ra, rc) for i, (a, c, ra, rc, _) in enumerate(CASES)], SCHEMA)
    got = {r.job_seq: r for r in JS.statements(df).collect()}
    for i, case in enumerate(CASES):
        assert got[i + 1].statement_key == case[4]
    assert got[4].statement.startswith("Job execution failed for CLARIA device and completed successfully for AMIA")
    assert got[10].statement.endswith("for CLARIA device job issues.")


def test_batch_and_errors(spark):
    df = spark.createDataFrame([
        (1, "JOB_001", "SUCCESS", "SUCCESS", None, None),
        (2, "JOB_002", "FAILURE", "PARTIAL_SUCCESS", "SUCCESS", None),
        (3, "JOB_003", "SUCCESS", "FAILURE", None, "PARTIAL_SUCCESS"),
        (4, None, "DONE", "SUCCESS", None, None),
        (5, "JOB_005", "SUCCESS", "SUCCESS", "", None),
        (6, "JOB_006", "SUCCESS", "SUCCESS", "SUCCESS", "NOPE"),
    ], SCHEMA)
    got = {r.job_seq: r for r in JS.statements(df).collect()}
    assert got[1].statement_key == "STATEMENT_SUCCESS" and not got[1].has_reprocess
    assert got[2].statement_key == "STATEMENT_REPROCESS_SUCCESS_AND_PARTIAL_SUCCESS"
    assert got[3].statement_key == "STATEMENT_REPROCESS_SUCCESS_AND_PARTIAL_SUCCESS"
    assert got[4].statement is None and got[4].error.startswith("Invalid status for AMIA: DONE.")
    assert got[5].has_reprocess and got[5].statement_key == "STATEMENT_REPROCESS_SUCCESS"
    assert got[6].error.startswith("Invalid status for CLARIA Reprocess: NOPE.")
    lines = [r.line for r in JS.report(df).orderBy("job_seq", "line_no").collect()]
    assert lines[0] == "BATCH JOB STATUS REPORT"
    assert any(x.startswith("\nJob_4: ERROR - Invalid status for AMIA: DONE.") for x in lines)
    assert "  Reprocess AMIA: SUCCESS" in lines and "  Reprocess CLARIA: None" in lines
