"""Rows and messages by loops over batches are those of the joined expressions, and nothing of them is interpreted."""

import json

import pytest

from recordchecks.functions import record_rows as R
from recordchecks.operators import hl7_build as B

MAPPING = [("OBR", "", "", "A", "", "SEC_A", "Section A", "", "", "2"), ("OBR", "", "", "list b", "", "SEC_B", "Section B", "", "", "1"),
           ("OBR", "", "", "A", "", "SEC_A2", None, "", "", "3"), ("OBX", "", "A", "x", "", "X", "X|y", "NM", "u", ""),
           ("OBX", "", "A", "x", "", "X", "X|y", "NM", "u", ""), ("OBX", "", "A", "x", "", "X1", "first", None, None, "x"),
           ("OBX", "", "A", "deep-er.k", "", "DK", "d", "ST", "", "1"), ("OBX", "", "A", "k[1]", "", None, "no id", "ST", "", "1"),
           ("OBX", "", "list b", "x", "", "LX", "lx", "NM", "", "2"), ("OBX", "", "list b", "y z", "", "LY", "ly", "NM", "", "2"),
           ("OBX", "", "list b", "list b", "", "LL", "ll", "NM", "", "1"), ("OBX", "", "Gone", "x", "", "G", "g", "NM", "", "1")]
DOCS = ['{"A": {"x": 1.50, "deep er": {"k": "a|b^c~d&e\\\\"}, "k": [1, "two"]}, "x": null}', '{"x": "root", "A": {"x": "hidden"}}',
        '{"list b": [{"x": 1, "X": 2, "y-z": {"x": [3, [4]]}}, 5, [6, {"x": 7}], null, {"Y Z": true}, {}]}', '[{"x": 1}, [2]]', "7", '"x"', "null", "[]",
        '{"A": {"x": 1e3}}', '{"A": {"x": -0}}', '{"A": {"x": -0.00}}', '{"A": {"x": 100.00}}', '{"A": {"x": 1234567890123456789012345678901234567890.5}}',
        '{"A": {"x": 12345678901234567890123456789012345678}}', '{"A": {"x": 0.1e-9}}', '{"A": {"x": "\\ud800"}}', '{"A": {"x": "\\u00e9\\ud83d\\ude00\\n"}}',
        '{"A": {"x": 1}} and more', ' \n{"A": {"x": 2}}', '{"A": {"x": 1, "x": 2}}', '{"A": {"x": NaN}}', '{"A": {"x": 01}}', '{"A": {"x": .5}}', '{"a[": {"x": [1]}, "": {"x": 3}}',
        '{"A.X": 9, "a": {"X": 8}}', '{"A": {"x": "=", "straße": 1}}', "", "{bad", '{"A": {"x": " "}}', "=1",
        json.dumps({"A": {"x": list(range(300))}, "list b": [{"x": i} for i in range(300)]}),
        '{"A": {"x": 1, "z": ' + "[" * 200 + "]" * 200 + "}}", '{"list b": ' + '[{"x": ' * 100 + "5" + "}]" * 100 + "}"]


def _sorted(df):
    return sorted(json.dumps(list(r), default=str) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(DOCS), (len(DOCS), None)], "doc_id long, json string")


def test_odd_records_as_by_a_join(spark, docs, monkeypatch):
    mapping = B.mapping_frame(spark, MAPPING)
    for rows_of in (lambda most: B.section_rows(docs, mapping, "2025", most), lambda most: B.messages(docs, mapping, "2025", "2025", max_compiled=most)):
        joined = rows_of(0)
        rows = _sorted(joined)
        for batch in (1, 4 << 20):
            monkeypatch.setattr(R, "BATCH_BYTES", batch)
            compiled = rows_of(B.MAX_COMPILED_ROWS)
            assert compiled.dtypes == joined.dtypes and _sorted(compiled) == rows


def test_a_mapping_without_sections(spark, docs):
    mapping = B.mapping_frame(spark, [r for r in MAPPING if r[0] == "OBX"])
    assert _sorted(B.messages(docs, mapping, "2025", "2025")) == _sorted(B.messages(docs, mapping, "2025", "2025", max_compiled=0))
    assert B.section_rows(docs, mapping, "2025").collect() == []


def test_nothing_is_interpreted(spark, docs):
    mapping = B.mapping_frame(spark)
    for df in (B.section_rows(docs, mapping, "2025"), B.messages(docs, mapping, "2025", "2025")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "Exchange" not in plan


def test_known_keys_are_bounded(monkeypatch):
    monkeypatch.setattr(R, "MAX_KNOWN", 3)
    known = R._Known(str.upper)
    assert [known[k] for k in "abcdeab"] == list("ABCDEAB") and len(known) <= 3


def test_two_digits_as_by_a_formatter(spark):
    from pyspark.sql import functions as F

    from recordchecks.sources.bindings import two_digits
    df = spark.createDataFrame([(n,) for n in [None, *range(-120, 121), 2**31 - 1, -2**31]], "n int")
    assert df.where(two_digits(F.col("n")) != F.format_string("%02d", "n")).collect() == []
    plan = df.select(two_digits(F.col("n")).alias("t"))
    assert plan.where("t is null").count() == 0
