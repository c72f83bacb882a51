"""Property: HL7 escaping round-trips any text (hypothesis-generated)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordchecks.functions.hl7 import escape_value, unescape_value

TEXT = st.text(alphabet=st.sampled_from(list("ab|^~&\\EFSRT ")), max_size=12)


@settings(max_examples=4, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=60))
def test_escape_roundtrip(spark, values):
    values = values + ["\\F\\", "\\E\\", "a|b^c~d&e\\f", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = df.select("i", "v", escape_value(F.col("v")).alias("e")).select(
        "i", "v", "e", unescape_value(F.col("e")).alias("u")).collect()
    for r in out:
        assert r.u == r.v
        assert not any(ch in r.e for ch in "|^~&")
