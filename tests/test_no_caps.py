"""Sizes that earlier caps cut: depth, message length, keys, tables of rules and mappings."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from recordchecks.functions.arrays import occurrences, running
from recordchecks.operators import hl7_build as B
from recordchecks.operators import hl7_parse as HP
from recordchecks.operators import json_rules as J
from recordchecks.operators import recurrence as RC
from recordchecks.sources import bindings


def _nested(depth):
    out = {"Weight": 70 + depth}
    for i in range(depth, 0, -1):
        out = {f"L{i}": out}
    return out


def test_flatten_any_depth(spark):
    docs = spark.createDataFrame([(1, json.dumps({"Vitals": _nested(10), "s": '{"[\\', "none": None, "e": {}})), (2, "{bad")], "doc_id long, json string")
    rows = {r.path: r.value for r in B.flatten(docs).collect()}
    path = "VITALS." + ".".join(f"L{i}" for i in range(1, 11)) + ".WEIGHT"
    assert rows == {path: "80", "S": '{"[\\'}


def _walk(v, path="", key=None):
    """Scalars of a parsed document by plain recursion."""
    if isinstance(v, dict):
        for k, x in v.items():
            k = k.upper().replace(" ", "_").replace("-", "_")
            yield from _walk(x, f"{path}.{k}" if path else k, k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _walk(x, f"{path}[{i}]", key)
    elif v is not None:
        yield path, key, v if isinstance(v, str) else json.dumps(v)


ODD = [{"a b": {"c-d": [[1, [2, {"x": [3, "y"]}]], {"k": {"l": {"m": {"n": [True, None, "", "q\"uo\\te {[:,"]}}}}]}},
       [[[[[[{"deep": 1}, {"deep": [2]}]]]]]], {"e": {"f": {"g": {"h": {}}}}, "i": [[[[[]]]]]}, {"p": {"q": {"r": {"s": {"é ü": 1.5, "z": -2}}}}},
       {"wide": {"a": {"b": {"c": {"d": list(range(500))}}}}}]


def test_flatten_equals_recursion(spark, monkeypatch):
    docs = [(i, json.dumps(o, ensure_ascii=i % 2 == 0)) for i, o in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, json string")
    whole = [sorted(tuple(r) for r in B.flatten(df).collect())]
    for fast in (0, 1, 12):  # all by tokens, nearly all, none
        monkeypatch.setattr(B, "FAST_LEVELS", fast)
        whole.append(sorted(tuple(r) for r in B.flatten(df).collect()))
    assert all(w == whole[0] for w in whole)
    got = sorted((r[0], r[1], r[4], r[5]) for r in whole[0])
    assert got == sorted((i, *x) for i, o in enumerate(ODD) for x in _walk(o))


def test_very_deep_records_beside_a_broken_one(spark):
    """Valid records of 10 and 300 levels give their messages, 300 open brackets one error row."""
    docs = [(1, json.dumps({"Vitals": _nested(10)})), (2, json.dumps({"Vitals": _nested(300)})), (3, "[" * 300), (4, "{" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, json string")
    rows = {(r.doc_id, r.path): r.value for r in B.flatten(df).collect()}
    assert rows == {(i, "VITALS." + ".".join(f"L{k}" for k in range(1, n + 1)) + ".WEIGHT"): str(70 + n) for i, n in ((1, 10), (2, 300))}
    got = {r.doc_id: r for r in B.messages(df, _mapping(spark), "20250101", "20250101").collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["success", "success", "error", "error"]
    assert "OBX|1|NM|W^Weight|2|80|kg|||||F" in got[1].hl7_message and got[3].hl7_message is None


def _mapping(spark):
    deep = ".".join(f"L{i}" for i in range(1, 11)) + ".Weight"
    return B.mapping_frame(spark, [("OBR", "2", None, "Vitals", None, "VITALS", "Vital Signs", None, None, "1"),
                                   ("OBX", "5", "Vitals", deep, "OBX.5", "W", "Weight", "NM", "kg", "1"),
                                   ("OBR", "2", None, "Cycles", None, "CYC", "Cycle", None, None, "2"),
                                   ("OBX", "5", "Cycles", "Fill", "OBX.5", "F", "Fill", "NM", "mL", "2"),
                                   ("OBX", "5", "Cycles", "Time", "OBX.5", "T", "Time", "NM", "s", "1")])


def test_message_of_a_deep_record_and_joined_mapping(spark):
    doc = {"Vitals": _nested(10), "Cycles": [{"Fill": i, "Time": 2 * i} for i in range(150)]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"Cycles": []})), (3, "{bad")], "doc_id long, json string")
    mapping = _mapping(spark)
    compiled = B.messages(docs, mapping, "20250101", "20250101")
    joined = B.messages(docs, mapping, "20250101", "20250101", max_compiled=0)
    a, b = ({r.doc_id: r for r in x.collect()} for x in (compiled, joined))
    assert a == b and a[3].status == "error"
    segs = a[1].hl7_message.split("\r")
    assert "OBX|1|NM|W^Weight|2|80|kg|||||F" in segs
    obr = [s for s in segs if s.startswith("OBR|") and "CYC" in s]
    assert [s.split("|")[1] for s in obr] == [str(3 + i) for i in range(150)]
    assert segs[segs.index(obr[149]) + 1:][:2] == ["OBX|1|NM|T^Time|152|298|s|||||F", "OBX|2|NM|F^Fill|152|149|mL|||||F"]
    assert [s.split("|")[4].split("^")[0] for s in a[2].hl7_message.split("\r") if s.startswith("OBR|")][1:] == ["VITALS", "CYC"]


def test_one_message_per_order_whatever_its_size(spark):
    patients = spark.createDataFrame([("p", "N^M", "19800101", "F")], "patient_id string, name string, dob string, sex string")
    orders = spark.createDataFrame([("o", "p", "S", "20240101", "F")], "order_id string, patient_id string, service string, observed_ts string, status string")
    obs = spark.range(1, 1502).select(F.lit("o").alias("order_id"), F.col("id").cast("int").alias("seq"), F.lit("NM").alias("value_type"),
                                      F.lit("c").alias("code"), F.col("id").cast("string").alias("value"), F.lit("u").alias("unit"),
                                      F.lit("1-2").alias("range"), F.lit("F").alias("status"))
    rows = B.oru_segments(patients, orders, obs, "20250101").collect()
    assert len(rows) == 1 and len(rows[0].segs) == 4 + 1501 and rows[0].segs[-1].startswith("OBX|1501|")


def test_long_keys_stay_whole(spark, tmp_path):
    big = 3_000_000_123
    spark.createDataFrame([(big, 123_456_789, "O", 1.0, dt.datetime(2024, 1, 1), "1-URGENT")],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
                          ).write.parquet(str(tmp_path / "orders.parquet"))
    assert bindings.job_runs(spark, str(tmp_path)).first().job_id == f"JOB_{big}"
    spark.createDataFrame([(big, "n")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    from recordchecks.plans.config_q import clinic_rules
    assert clinic_rules(spark, str(tmp_path)).first().CUSTOMER_ID == big


def _rules(spark, paths):
    return J.rules_frame(spark, [(1, "C", "BOTH", "TREATMENT", p, "t", "INTEGER", "N", None, None) for p in paths])


def test_integers_stay_exact_and_a_bad_path_is_an_error_row(spark):
    docs = spark.createDataFrame([(1, '{"a": 9007199254740993, "b": [{"c": 1}, {"c": "x"}]}')], "doc_id long, json string")
    rows = J.field_checks(J.validate(docs, J.compile_rules(_rules(spark, ["a", "b[x].c", "b[*].c"])))).collect()
    assert [(r.field_path, r.errors, r.actual_value) for r in sorted(rows, key=lambda r: (r.rule_no, r.field_path))] == [
        ("a", [], "9007199254740993"), ("b[x].c", ["Validation error: Invalid array index: x"], None),
        ("b[0].c", [], "1"), ("b[1].c", ["Expected integer, got str"], "x")]


def test_rules_in_parts_give_the_same_rows(spark):
    docs = spark.createDataFrame([(i, json.dumps({f"k{j}": i for j in range(7)})) for i in range(4)], "doc_id long, json string")
    rules = _rules(spark, [f"k{j}" for j in range(9)])
    whole = J.field_checks(J.validate(docs, J.compile_rules(rules)))
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(whole) == key(J.field_checks_in_parts(docs, rules, part=4)) == key(J.field_checks_in_parts(docs, rules, part=3))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_running_and_occurrences(spark, n):
    names = [f"N{(i * i) % 7}" for i in range(n)]
    df = spark.createDataFrame([(names, list(range(n)))], "names array<string>, x array<int>")
    r = df.select(occurrences(F.col("names")).alias("o"), running(F.col("x"), F.lit(0), lambda a, b: a + b).alias("s")).first()
    assert r.o == [names[:i + 1].count(names[i]) for i in range(n)] and r.s == [sum(range(i)) for i in range(n)]


def test_parsing_is_linear(spark):
    def seconds(n):
        raw = "MSH|^~\\&|A\r" + "\r".join(f"OBX|{i}|NM|c||1" for i in range(n))
        df = spark.createDataFrame([("m", raw)], "msg_id string, raw string")
        t0 = time.time()
        assert HP.segments(df).agg(F.max("seg_occ")).first()[0] == n
        return time.time() - t0
    seconds(1000)
    assert seconds(8000) <= 8.5 * max(seconds(1000), 0.3)


def test_a_hot_user_has_the_same_counts(spark):
    t = dt.datetime(2024, 1, 1)
    occ = spark.createDataFrame([(u, k, t + dt.timedelta(hours=6 * k), t + dt.timedelta(hours=6 * k + 5)) for u in (1, 2) for k in range(6)],
                                "schedule_id long, occ_no int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    events = [(1 if i % 3 else i, t + dt.timedelta(minutes=i % 1500)) for i in range(3000)]
    ev = spark.createDataFrame(events, "user_id long, ts timestamp_ntz")
    df = RC.coverage(occ, ev)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan
    for r in df.collect():
        assert r.n_events == sum(u == r.schedule_id and r.start_ts <= x < r.end_ts for u, x in events)
