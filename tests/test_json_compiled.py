"""JSON checks stay compiled: no check of a plain path inside a higher-order function, which interprets its arguments."""

from pyspark.sql import functions as F

from recordchecks.operators import json_rules as J
from recordchecks.rules import json_rules as JR


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_checks_have_no_lambda(spark):
    rules = J.compile_rules(J.rules_frame(spark, [r for r in JR.DEFAULT_RULES if "[*]" not in r[4]]))
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit('{"a": 1}').alias("json")).repartition(2)
    assert "lambda" not in _plan(J.validate(docs, rules))
    assert "lambda" not in _plan(J.common_errors(J.validate(docs, rules)))


def test_times_by_shape_are_those_of_the_parser(spark):
    parts = [str(n) for n in range(0, 70)] + [f"{n:02d}" for n in range(0, 10)] + ["", "007", "-1", "x"]
    hm = [f"{a}:{b}" for a in parts for b in parts]
    hms = [f"{a}:{b}:{c}" for a in ("0", "7", "23", "24", "") for b in parts for c in ("0", "09", "59", "60", "")]
    for pattern, texts in (("H:m", hm), ("H:m:s", hms)):
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        old = F.col("s").rlike(JR.FORMAT_SHAPES[pattern]) & F.try_to_timestamp("s", F.lit(pattern)).isNotNull()
        assert df.where(old != F.col("s").rlike(JR.TIME_SHAPES[pattern])).collect() == []
