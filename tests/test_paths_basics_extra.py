"""Nested wildcard paths, and the remaining basic operators."""

import json

from pyspark.sql import functions as F

from recordchecks.functions.jsonpath import steps, targets
from recordchecks.operators import basics as B


def test_nested_wildcard_targets(spark):
    doc = {"A": [{"B": [{"C": 1}, {"C": 2}]}, {"B": []}, {"B": [{"C": "x"}]}, {"X": 1}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"A": 5}))], "id int, j string")
    t = df.select("id", F.inline(targets(F.try_parse_json("j"), "A[*].B[*].C"))).select(
        "id", "field_path", F.try_variant_get("value", "$", "string").alias("v")).collect()
    got = sorted((r.id, r.field_path, r.v) for r in t)
    assert (1, "A[0].B[0].C", "1") in got and (1, "A[0].B[1].C", "2") in got and (1, "A[2].B[0].C", "x") in got
    assert (1, "A[3].B[*].C", None) in got  # inner path not an array: one NULL target
    assert (2, "A[*].B[*].C", None) in got  # outer path not an array
    assert steps("A[-1].B") == ["A", -1, "B"]


def test_basic_operators(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (2, "d"), (3, None)], "k int, s string")
    sp = B.split_delimited(df, "s", " ", "parts").collect()
    assert [len(r.parts) if r.parts else None for r in sp] == [3, 1, 1, None]
    fm = B.flatmap_expr(df, F.split("s", " "), "tok", keep=["k"]).collect()
    assert len(fm) == 5
    assert B.dedup_rows(df).count() == 3 and B.dedup_rows(df, ["k"]).count() == 3
    rc = {r.table_name: r.n_rows for r in B.row_counts({"t": df, "u": df.where("k = 2")}).collect()}
    assert rc == {"t": 4, "u": 2}
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1), ("d", 5)], "msg string, n long")
    assert [r.msg for r in B.top_n(counts, "n", "msg", 3).collect()] == ["d", "a", "b"]
    ex = B.explode_rows(spark.createDataFrame([(1, [1, 2]), (2, None)], "k int, a array<int>"), "a", "x",
                        outer=True).collect()
    assert sorted((r.k, r.x) for r in ex) == [(1, 1), (1, 2), (2, None)]
