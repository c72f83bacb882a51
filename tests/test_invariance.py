"""SURVEY 5.4: same results with 1 and many partitions and with the input
rows in another order."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from recordchecks.operators import json_rules as J
from recordchecks.operators import recurrence as RC
from recordchecks.sources.bindings import device_records, schedules


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_json_summary_invariant(spark):
    docs = device_records(spark, SF_SMALL).cache()
    rules = J.compile_rules(J.filter_rules(J.rules_frame(spark), "AMIA", 1, "TREATMENT"))
    a = _rows(J.summary(J.validate(docs.repartition(1), rules)))
    b = _rows(J.summary(J.validate(docs.orderBy(F.rand(7)).repartition(13), rules)))
    assert a == b and len(a) > 0


def test_occurrences_invariant(spark):
    s = schedules(spark, SF_SMALL).cache()
    a = _rows(RC.occurrences(s.repartition(1)))
    b = _rows(RC.occurrences(s.orderBy(F.rand(3)).repartition(11)))
    assert a == b and len(a) > 0
