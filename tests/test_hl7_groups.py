"""Field tree, message grammar, group tree with XML, and batches of several patients."""

import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordchecks.functions import segment_xml as SX
from recordchecks.operators import hl7_groups as HG

MSH = "MSH|^~\\&|A|B|C|D|20240101||ORU^R01^ORU_R01|1|P|2.5"


def raws(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "msg_id long, raw string")


def tree(spark, text):
    return sorted(tuple(r)[1:] for r in HG.field_tree(raws(spark, text)).collect())


def test_field_tree_cuts_and_decodes(spark):
    rows = tree(spark, MSH + "\rPID|1||7^^^H&X~8||D\\T\\E\\S\\F^J\\E\\F\\E\\|\\H\\|")
    pid = [r for r in rows if r[1] == "PID"]
    assert pid == [(2, "PID", 1, 1, 1, 1, "1"), (2, "PID", 3, 1, 1, 1, "7"), (2, "PID", 3, 1, 4, 1, "H"), (2, "PID", 3, 1, 4, 2, "X"),
                   (2, "PID", 3, 2, 1, 1, "8"), (2, "PID", 5, 1, 1, 1, "D&E^F"), (2, "PID", 5, 1, 2, 1, "J\\F\\"), (2, "PID", 6, 1, 1, 1, "\\H\\")]
    assert (1, "MSH", 1, 1, 1, 1, "|") in rows and (1, "MSH", 2, 1, 1, 1, "^~\\&") in rows and (1, "MSH", 9, 1, 2, 1, "R01") in rows


def test_field_tree_follows_declared_delimiters(spark):
    text = MSH + "\rPID|1||7^^^H&X~8||D\\T\\E"
    for marks in ("!@$?;", ".*+([", "\\#%-:", "QEZ/'"):
        other = text.translate(str.maketrans("|^~\\&", marks)).replace(f"{marks[3]}T{marks[3]}", f"{marks[3]}T{marks[3]}")
        if set(marks) & set(text):
            continue
        same = [r for r in tree(spark, text) if r[1] == "PID"]
        got = [r for r in tree(spark, other) if r[1] == "PID"]
        assert [r[:-1] for r in got] == [r[:-1] for r in same]
        assert got[-1][-1] == f"D{marks[4]}E"  # an escape stands for the declared mark
    # a mark that is not declared cuts nothing
    assert [r[-1] for r in tree(spark, "MSH|^|A\rPID|1^2~3&4") if r[1] == "PID"] == ["1", "2~3&4"]


def test_field_tree_odd_messages(spark):
    assert tree(spark, None) == [] and tree(spark, "") == []
    assert tree(spark, "PID|1^2") == [(1, "PID", 1, 1, 1, 1, "1"), (1, "PID", 1, 1, 2, 1, "2")]  # no MSH: usual marks
    assert tree(spark, "MSH") == []
    assert [r[-1] for r in tree(spark, "BHS|^~\\&|S^T\r" + MSH) if r[1] == "BHS"] == ["|", "^~\\&", "S", "T"]


def breaks(spark, *segments):
    rows = HG.structure(raws(spark, "\r".join([MSH, *segments]))).where("code = 'group'").collect()
    return [(r.location, r.message) for r in rows]


def test_each_rule_of_the_grammar_fires(spark):
    pid, obr, obx = "PID|1||7", "OBR|1|O", "OBX|1|NM|X"
    assert breaks(spark, pid, "PV1|1", "ORC|NW", obr, "NTE|1", obx, "NTE|1", "OBX|2", "OBR|2", "OBX|1", "PID|2", obr, obx, "ZAB|1") == []
    assert breaks(spark, pid, obx) == [("segment 3", "OBX is not expected after PID")]
    assert breaks(spark, pid, obr, "OBX|2") == [("segment 4", "OBX set id 2 out of sequence, expected 1")]
    assert breaks(spark, pid, obr, obx, "OBX|3", "OBX") == [("segment 5", "OBX set id 3 out of sequence, expected 2"),
                                                            ("segment 6", "OBX set id  out of sequence, expected 3")]
    assert breaks(spark, obr, pid, obx) == [("segment 2", "OBR is not expected after MSH"), ("segment 3", "PID is not expected after OBR"),
                                            ("segment 4", "OBX is not expected after PID")]
    assert breaks(spark, pid, obr, obx, pid, obr, obx) == [("segment 5", "PID set id 1 out of sequence, expected 2")]
    assert breaks(spark, pid, obr, obx, obr, obx) == [("segment 5", "OBR set id 1 out of sequence, expected 2")]
    assert breaks(spark, pid, obr) == [("segment 3", "message ends after OBR")]
    assert breaks(spark, pid, obr, "EVN|A01", obx) == [("segment 4", "EVN is not expected after OBR")]


def test_grammar_of_long_and_broken_messages(spark):
    many = [f"OBX|{i}|NM|X" for i in range(1, 3001)]
    many[1999] = "OBX|7|NM|X"
    assert breaks(spark, "PID|1||7", "OBR|1|O", *many) == [("segment 2003", "OBX set id 7 out of sequence, expected 2000")]
    rows = HG.structure(raws(spark, "EVN|A01", None, "")).collect()
    assert [(r.msg_id, r.code) for r in rows] == [(0, "parse"), (1, "parse"), (2, "parse")]


def test_structure_reads_its_input_once(spark):
    plan = HG.structure(raws(spark, MSH))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan


def test_group_tree_and_xml_round_trip(spark):
    text = "\r".join([MSH, "SFT|x", "PID|1||7^<&>", "PV1|1|O", "ORC|NW", "OBR|1|O", "NTE|1||n", "OBX|1|NM|X||5 > 4 & 3 < 4||||||F", "OBR|2|P",
                      "OBX|1|NM|Y", "PID|2||8", "OBR|1|Q", "OBX|1|ST|Z"])
    df = raws(spark, text, MSH, "\r".join([MSH, "OBR|1|O", "OBX|1", "PID|1||7", "OBX|1"]))
    rows = {r.msg_id: r for r in HG.group_tree(df).collect()}
    name = lambda segs: [s[0] for s in segs]
    assert name(rows[0].head) == ["MSH", "SFT"]
    assert [(name(p.segs), [name(o) for o in p.orders]) for p in rows[0].patients] == [
        (["PID", "PV1"], [["ORC", "OBR", "NTE", "OBX"], ["OBR", "OBX"]]), (["PID"], [["OBR", "OBX"]])]
    assert name(rows[1].head) == ["MSH"] and rows[1].patients == []
    # an order without a patient, and an observation without an order, stay where they are
    assert [(name(p.segs), [name(o) for o in p.orders]) for p in rows[2].patients] == [([], [["OBR", "OBX"]]), (["PID", "OBX"], [])]
    x = HG.to_xml(df)
    root = ET.fromstring(x.where("msg_id = 0").first().xml)
    assert [c.tag for c in root] == ["MSH", "SFT", "ORU_R01.PATIENT_RESULT", "ORU_R01.PATIENT_RESULT"]
    assert [c.tag for c in root[2]] == ["PID", "PV1", "ORU_R01.ORDER_OBSERVATION", "ORU_R01.ORDER_OBSERVATION"]
    assert root[2][0].find("PID.3").text == "7^<&>"
    back = {r.msg_id: r.raw for r in HG.from_xml(x).collect()}
    assert back == {r.msg_id: r.raw for r in df.collect()}


def test_from_xml_of_null_and_of_empty_fields(spark):
    df = raws(spark, None, "MSH|^~\\&\rPID\rPV1|1||")
    back = {r.msg_id: r.raw for r in HG.from_xml(HG.to_xml(df)).collect()}
    assert back[1] == "MSH|^~\\&\rPID\rPV1|1" and back[0] in (None, "")
    assert HG.from_xml(spark.createDataFrame([(1, None)], "msg_id long, xml string")).first().raw is None


def test_batch_of_any_size_is_numbered_over_parts(spark):
    rows = [(f"{i:04d}", f"p{i % 40:02d}", "big" if i % 3 == 0 else f"k{i % 11}" if i % 5 else None,
             ["MSH|x", f"PID|1||p{i % 40:02d}", "OBR|1"] + [f"OBX|{j}" for j in range(i % 4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "order_id string, patient_id string, key string, segs array<string>").repartition(7)
    out = HG.batch_segments(df, F.col("key"), "20250101120000").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.msg_id, r.seg_no)):
        got.setdefault(r.msg_id, []).append(r.segment)
        assert len(got[r.msg_id]) == r.seg_no
    want = {}
    for order, patient, key, segs in sorted(rows, key=lambda r: (r[1], r[0])):
        m = want.setdefault(key or "", [])
        n = 1 + sum(s.startswith("PID") for s in m)
        m += [f"PID|{n}|" + s[6:] if s.startswith("PID|1|") else s for s in segs[1:]]
    assert {k: v[1:] for k, v in got.items()} == want and all(v[0].startswith("MSH|") for v in got.values())
    plan = HG.batch_segments(df, F.col("key"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_field_tree_cuts_at_plain_characters(spark):
    # a pattern of more than two characters is compiled anew for each value
    plan = HG.field_tree(raws(spark, MSH))._jdf.queryExecution().optimizedPlan().toString()
    cuts = plan[:plan.index("filter(split")]
    assert "split(" in cuts and "\\Q" not in cuts.replace("regexp_extract_all", "\0").split("\0")[0]
    # blank lines and any kind of line end; marks of any kind, within the plane and beyond it
    text = "MSH|^~\\&|A^B\r\n\r\n  \nPID|1^2~3&4\n\rPID|5"
    want = [(2, "PID", 1, 1, 1, 1, "1"), (2, "PID", 1, 1, 2, 1, "2"), (2, "PID", 1, 2, 1, 1, "3"), (2, "PID", 1, 2, 1, 2, "4"),
            (3, "PID", 1, 1, 1, 1, "5")]
    assert [r for r in tree(spark, text) if r[1] == "PID"] == want
    for marks in ("\t é一́", "\U0001F600\U00020000$^.", "7890x", "ndswb", "]){}*"):
        if not set(marks) & set("12345"):
            other = text.translate(str.maketrans("|^~\\&", marks))
            assert [r for r in tree(spark, other) if r[1] == "PID"] == want, marks


def test_xml_of_long_segments_and_odd_names(spark):
    for n in (62, 63, 64, 65, 200):
        fields = ["" if i % 7 == 0 else f"v{i}&" for i in range(1, n + 1)]
        x = HG.to_xml(raws(spark, "|".join(["MSH", *fields]) + "\n\n" + "|".join(["PID", *fields]) + "\r\n<A>|1\rZ|")).first().xml
        assert x == "<ORU_R01><MSH><MSH.1>|</MSH.1>" + "".join(
            f"<MSH.{i}>{v}amp;</MSH.{i}>" for i, v in enumerate(fields, 2) if v) + "</MSH><ORU_R01.PATIENT_RESULT><PID>" + "".join(
            f"<PID.{i}>{v}amp;</PID.{i}>" for i, v in enumerate(fields, 1) if v) + (
            "</PID><<A>><<A>.1>1</<A>.1></<A>><Z></Z></ORU_R01.PATIENT_RESULT></ORU_R01>")


def test_orders_meet_their_patient_before_their_observations(spark):
    from recordchecks.plans import gen_q
    segs, _ = gen_q.relational_segments(spark, "/root/testdata/sf0.001")
    plan = segs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    # the outer join is that of the observations, so no shuffle but the group's own holds them
    assert len(joins) == 2 and "order_id" in joins[0] and "patient_id" in joins[1]


def test_structure_folds_once_and_builds_only_what_it_tells(spark):
    plan = HG.structure(raws(spark, MSH))._jdf.queryExecution().optimizedPlan().toString()
    assert "MSH.12 (Version ID) is required" in plan and "Set ID) is required" not in plan and "PID.3" not in plan


def test_breaks_of_a_message_over_many_chunks(spark):
    many = [f"OBX|{i + (i % 3 == 0)}|NM|X" if i % 50 else "NTE|1" for i in range(1, 400)]
    n, want = 0, []
    for i, s in enumerate(many):
        n += s.startswith("OBX")
        if s.startswith("OBX") and s.split("|")[1] != str(n):
            want.append((f"segment {i + 4}", f"OBX set id {s.split('|')[1]} out of sequence, expected {n}"))
    got = breaks(spark, "PID|1||7", "FHS|x", "OBR|1|O", *many, "PV1|1")
    assert got == want + [("segment 403", "PV1 is not expected after OBX"), ("segment 403", "message ends after PV1")] and len(want) > 300


def test_xml_is_made_and_read_by_batches(spark):
    # a field costs no interpreted expression: of functions over arrays only those over segments are left
    made = HG.to_xml(raws(spark, MSH))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "split(" not in plan.split("MapInArrow")[0]
    plan = HG.from_xml(made.select("msg_id", "xml"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "map_from_arrays" not in plan and plan.count("MapInArrow") == 2


def test_batches_of_any_size_give_the_same_xml_and_messages(monkeypatch):
    texts = ["MSH|^~\\&|A\rPID|1||7 & <8>\rZAB\rOBR|" + "|" * 90 + "x", None, "", "PID|1", "MSH\rOBX||é一\U0001F600|\\S\\||", "EVN|" + "y" * 500]
    lines = pa.array([t and t.split("\r") for t in texts], pa.list_(pa.string()))
    want = [None if t is None else "\r".join(s.rstrip("|") for s in t.split("\r")) for t in texts]
    for size in (1, 40, 700, 1 << 20):
        monkeypatch.setattr(SX, "BATCH_BYTES", size)
        for part in (lines, lines.slice(2, 3)):
            made = SX._elements(part)
            assert [len(m) for m in made.to_pylist()] == [len(m or []) for m in part.to_pylist()]
        xml = pa.array([None if t is None else f"<ORU_R01>{''.join(m)}</ORU_R01>" for t, m in zip(texts, SX._elements(lines).to_pylist())])
        assert SX._raws(xml).to_pylist() == want and SX._raws(xml.slice(3)).to_pylist() == want[3:]
    assert SX._raws(pa.array([], pa.string())).to_pylist() == [] and SX._elements(lines.slice(0, 0)).to_pylist() == []


def test_from_xml_of_xml_written_elsewhere():
    read = lambda *xml: SX._raws(pa.array(xml, pa.string())).to_pylist()
    assert read("<?xml version='1.0'?>\n<ORU_R01>\n <MSH>\n  <MSH.1>|</MSH.1>\n  <MSH.2>^~\\&amp;</MSH.2>\n </MSH>\n"
                " <ORU_R01.PATIENT_RESULT>\n <PID>\n  <PID.5>E</PID.5>\n  <PID.3>a > b</PID.3>\n <PID.0>no</PID.0></PID>\n"
                " <NTE></NTE></ORU_R01.PATIENT_RESULT>\n</ORU_R01>\n") == ["MSH|^~\\&\rPID|||a > b||E\rNTE"]
    assert read("<PID><PID.2></PID.2></PID>", "<MSH><MSH.1>|</MSH.1></MSH>", "<MSH><MSH.3>x</MSH.3></MSH>", "no <b>xml</b> <", "") == [
        "PID||", "MSH", "MSH||x", "", ""]
    # what stands outside a segment is none's, also not the earlier message's
    assert read("<PID><PID.1>1</PID.1></PID>", "<PID.2>2</PID.2><OBX></OBX><OBX.3>3</OBX.3><NTE><NTE.1>1</NTE.1></NTE>") == [
        "PID|1", "OBX\rNTE|1"]
    assert read("<OBX><OBX.5>&amp;lt; &lt;</OBX.5></OBX>") == ["OBX|||||&lt; <"]
    with pytest.raises(ValueError):
        read("<PID><PID.3>a</PID.3><PID.3>b</PID.3></PID>")
