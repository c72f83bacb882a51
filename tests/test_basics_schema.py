"""Basic operators (FIXTURES.md 1-4) and schema contracts (FIXTURES.md 9)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from recordchecks.operators import basics as B
from recordchecks.operators import schema_contract as SC


def test_people_and_marks(spark):
    people = spark.createDataFrame([("A", 23), ("B", 39), ("C", 34), ("D", 32)], ["Name", "Age"])
    assert B.count_if(people, F.col("Age") > 30).collect()[0].n == 3
    obs, o = B.count_if_observed(people, F.col("Age") > 30)
    obs.write.format("noop").mode("overwrite").save()
    assert o.get["n"] == 3
    marks = spark.createDataFrame([(1, "Arabinda", 23, "32|49|39"), (6, "Manderic", 36, "89|45|90"),
                                   (7, "X", 1, "1|2|3|4"), (8, "Y", 1, "x|5"), (9, "Z", 1, None)],
                                  "ID int, Name string, Age int, Marks string")
    out = {r.ID: r for r in B.split_to_columns(marks, "Marks", r"\|").collect()}
    assert out[1].sub_0 == 32 and out[6].sub_2 == 90 and out[7].sub_3 == 4 and out[1].sub_3 is None
    assert out[8].sub_0 is None and out[8].sub_1 == 5 and out[9].sub_0 is None


def test_log_pairs_titles(spark):
    T = dt.datetime
    log = spark.createDataFrame([
        (1, 101, "login", T(2023, 9, 5, 8, 30)), (2, 102, "click", T(2023, 9, 6, 12, 45)),
        (3, 101, "click", T(2023, 9, 7, 14, 15)), (4, 103, "login", T(2023, 9, 8, 9, 0)),
        (5, 102, "logout", T(2023, 9, 9, 17, 30)), (6, 101, "click", T(2023, 9, 10, 11, 20)),
        (7, 103, "click", T(2023, 9, 11, 10, 15)), (8, 102, "click", T(2023, 9, 12, 13, 10)),
        (9, 104, "x", T(2023, 9, 13)), (10, 104, "x", T(2023, 9, 6))],
        "log_id long, user_id long, action string, timestamp timestamp_ntz")
    got = {r.user_id: r.n_actions for r in B.actions_in_window(log, "user_id", "timestamp", "2023-09-13").collect()}
    assert got == {101: 2, 102: 3, 103: 2}
    pairs = spark.createDataFrame([("car", 2), ("car", 3), ("car", 4), ("car1", 2), ("car1", 3), ("car1", 4)], ["k", "v"])
    assert {r.k: r.total for r in B.sum_by_key(pairs, "k", "v").collect()} == {"car": 9, "car1": 9}
    nums = spark.createDataFrame([(i,) for i in range(1, 11)], ["x"])
    assert B.sum_all(nums, "x").collect()[0].total == 55
    assert [r.y for r in B.map_expr(nums.where("x <= 6"), F.col("x") + 2, "y").orderBy("y").collect()] == list(range(3, 9))
    titles = spark.createDataFrame([("Heat (1995)", "Drama|Crime"), ("A (x) (2001)", ""), ("NoYear", None)],
                                   "title string, genres string")
    p = {r.title: r.paren for r in B.paren_extract(titles, "title").collect()}
    assert p == {"Heat (1995)": "1995", "A (x) (2001)": "x", "NoYear": None}
    g = B.explode_rows(B.split_delimited(titles, "genres", r"\|"), "genres", out="genre")
    assert g.count() == 3  # Drama, Crime, and the empty string; NULL drops
    d = B.dedup_counts(g.select("genre").unionByName(g.select("genre"))).collect()[0]
    assert (d.n_rows, d.n_distinct) == (6, 3)


def test_schema_contract(spark):
    expected = StructType([StructField("id", LongType(), False), StructField("name", StringType()),
                           StructField("qty", IntegerType()), StructField("d", DateType())])
    actual = spark.createDataFrame([(1, "a", "3", 1.0), (2, "b", "x", 2.0)],
                                   StructType([StructField("id", IntegerType()), StructField("name", StringType()),
                                               StructField("qty", StringType()), StructField("extra", DoubleType())]))
    for coerce, n_err in ((False, 3), (True, 2)):
        c = [SC.Contract("s", expected, actual, allow_type_coercion=coerce)]
        f = SC.findings(spark, c).collect()
        errs = [r for r in f if r.severity == "error"]
        assert len(errs) == n_err, (coerce, [r.message for r in f])
        msgs = {r.message for r in f}
        assert "Missing columns: ['d']" in msgs and "Extra columns: ['extra']" in msgs
        assert 'Nullable mismatch for "id": Expected False, Found True' in msgs
        assert not SC.verdict(spark, c).collect()[0].is_valid
    conf = {r.column_name: r for r in SC.conformance(SC.Contract("s", expected, actual)).collect()}
    assert conf["qty"].n_uncastable == 1 and conf["id"].n_null_violations == 0
