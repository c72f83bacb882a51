"""Totals of a running stream over a restart, and totals of the pass that writes."""

from pyspark.sql import functions as F

from recordchecks.operators import hl7_validate as HV
from recordchecks.sources.sinks import write_json_with_totals
from recordchecks.streaming.checks import finding_totals, message_stream, start_finding_totals

GOOD = "MSH|^~\\&|A|B|C|D|20240101||ORU^R01|1|P|2.5\rPID|1||1^^^H||N^M||19800101|M\rOBR|1|a|b|c|||20240101\rOBX|1|NM|X^Y||5\rOBX|2|ZZ|X||5"


def test_totals_go_on_after_a_restart(spark, tmp_path):
    src, sink, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for step in range(3):  # each round is a new query on the same checkpoint
        for i in range(3):
            (src / f"m{step}{i}.hl7").write_text(GOOD if i else "EVN|A01")
        q = start_finding_totals(spark, str(src), sink, ck, available_now=True)
        q.awaitTermination(180)
        assert q.exception() is None
    got = {tuple(r)[:4]: r.n for r in finding_totals(spark, sink).collect()}
    whole = spark.read.text(str(src), wholetext=True).select(F.input_file_name().alias("msg_id"), F.col("value").alias("raw"))
    want = {}
    for r in HV.findings(whole).select("profile", "severity", "code", F.regexp_replace("location", r"\[\d+\]", "").alias("l")).collect():
        want[tuple(r)] = want.get(tuple(r), 0) + 1
    want |= {(p, "all", "message", ""): 9 for p in ("strict", "lenient")}
    assert got == want and got[("strict", "error", "parse", "MSH")] == 3 and got[("strict", "error", "required", "OBX.11")] == 12
    assert message_stream(spark, str(src)).isStreaming


def test_totals_of_the_pass_that_writes(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 3 == 0).alias("ok"))
    totals = {"n": F.count(F.lit(1)), "n_ok": F.count_if("ok"), "largest": F.max("id")}
    out = write_json_with_totals(df, str(tmp_path / "a"), totals)
    assert [tuple(r) for r in out.collect()] == [(1000, 334, 999)] and out.columns == list(totals)
    assert spark.read.json(str(tmp_path / "a")).count() == 1000
    none = write_json_with_totals(df.where("id < 0"), str(tmp_path / "b"), totals)
    assert [tuple(r) for r in none.collect()] == [(0, 0, None)]
