"""Plan shape: the per-row operators add no shuffle, and data joins are not
broadcast on a size estimate (session setting; explicit hints only)."""

import datetime as dt
import json

from recordchecks.operators import hl7_build as B
from recordchecks.operators import hl7_validate as HV
from recordchecks.operators import json_rules as J
from recordchecks.operators import recurrence as RC
from recordchecks.operators import job_status as JS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hl7_validation_has_no_exchange(spark):
    msgs = spark.createDataFrame([("1", "MSH|^~\\&|A|B|C|D|20240101||ORU^R01|1|P|2.5\nOBX|1|NM|A^B||1")],
                                 "msg_id string, raw string")
    for df in (HV.verdict(msgs), HV.findings(msgs)):
        assert "Exchange" not in _plan(df)


def test_json_checks_and_generation_have_no_exchange(spark):
    docs = spark.createDataFrame([(1, json.dumps({"Vitals": {"Pre-Treatment": {"Weight": 70}}}))],
                                 "doc_id long, json string")
    rules = J.compile_rules(J.filter_rules(J.rules_frame(spark), "AMIA", 1, "TREATMENT"))
    v = J.validate(docs, rules)
    for df in (J.summary(v), J.field_checks(v), J.report_lines(v)):
        assert "Exchange" not in _plan(df)
    m = B.messages(docs, B.mapping_frame(spark), "20250101000000", "20250101000000")
    assert "Exchange" not in _plan(m)


def test_recurrence_has_no_exchange(spark):
    s = spark.createDataFrame(
        [(1, "monthly", dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1), None, 31, None, 9, 0, None, [1, 4, 7, 10])],
        "schedule_id bigint, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz, weekday int, "
        "day_of_month int, day_of_quarter int, hh int, mm int, duration_min int, quarter_months array<int>")
    assert "Exchange" not in _plan(RC.occurrences(s))


def test_only_hinted_broadcast(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    p = _plan(E.queries()["hl7_verdict"](spark, SF_SMALL))
    assert "BroadcastHashJoin" not in p and "SortMergeJoin" in p
    jobs = spark.createDataFrame([(1, "J", "SUCCESS", "FAILURE", None, None)],
                                 "job_seq long, job_id string, amia_status string, claria_status string, "
                                 "reprocess_amia string, reprocess_claria string")
    assert "BroadcastHashJoin" in _plan(JS.statements(jobs))  # the 18-row statement table


def _broadcasts_by_size(spark, df_of) -> bool:
    """Whether the plan of ``df_of()`` broadcasts in a session that goes by size estimates."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "1g")
        return "Broadcast" in _plan(df_of())
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_generated_rows_are_not_broadcast_on_an_estimate(spark, monkeypatch):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from recordchecks.operators import rule_index as I
    monkeypatch.setattr(I, "BROADCAST_PROBES", 0)
    for name in ("recur_coverage", "json_rule_index", "json_rule_index_findings", "json_rule_index_summary"):
        plan_of = lambda name=name: E.queries()[name](spark, SF_SMALL)
        assert not _broadcasts_by_size(spark, lambda: plan_of()), name


def test_json_results_are_compressed(spark, tmp_path):
    import os
    from recordchecks.sources.sinks import write_json
    df = spark.range(3).selectExpr("id", "repeat('x', 1000) as text")
    write_json(df, str(tmp_path / "out"))
    parts = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert parts and all(f.endswith(".json.gz") for f in parts)
    assert spark.read.schema(df.schema).json(str(tmp_path / "out")).exceptAll(df).count() == 0
