"""Inner structure of HL7 v2 messages: the tree of a field (H2), several
patients in one message of any size (G14), the message grammar (G15) and the
group tree with its XML both ways (G16).

Tree and grammar are expressions over the message's own row and the XML is made
and read by Arrow batches of such rows, so they shuffle nothing.  Only ``batch_segments`` shuffles: a batch may hold any share
of all orders, so it is sorted as rows and never gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordchecks.functions import hl7 as H
from recordchecks.functions import segment_xml as SX
from recordchecks.functions.arrays import CHUNK, bind
from recordchecks.functions.gen import explode_kept, inline_kept, posexplode_kept
from recordchecks.operators import hl7_validate as HV
from recordchecks.rules import hl7_grammar as G
from recordchecks.rules import hl7_mapping as M
from recordchecks.rules.hl7_rules import ENVELOPE_SEGMENTS, MSH_REQUIRED
from recordchecks.session import shared_path

HEADERS = ["MSH", "BHS", "FHS"]


# ------------------------------------------------------------------ H2
def _cut(v: Column, delimiter: Column, pattern: Column) -> Column:
    """``v`` cut at a one-character delimiter, given with its ``_pattern``;
    whole where it is not in it or none is declared."""
    return F.when((delimiter != "") & F.contains(v, delimiter), F.split(v, pattern, -1)).otherwise(F.array(v))


def _pattern(delimiter: Column) -> Column:
    """The delimiter as a pattern of two characters at most, which ``split``
    takes as plain text; any longer one it compiles anew for each value."""
    return F.when(delimiter.rlike("^[A-Za-z0-9]"), delimiter).otherwise(F.concat(F.lit("\\"), delimiter))


def _decoded(v: Column) -> Column:
    """Escape sequences of the delimiters ``d`` put back, in one pass from the
    left; other sequences (highlighting, hexadecimal) stay as they are."""
    esc = F.col("d.escape")
    quoted = F.concat(F.lit("\\Q"), esc, F.lit("\\E"))
    token = F.concat(F.lit("(?s)("), quoted, F.lit("[FSRTE]"), quoted, F.lit("|.)"))
    marks = {"F": F.col("d.field"), "S": F.col("d.component"), "R": F.col("d.repetition"), "T": F.col("d.sub"), "E": esc}

    def back(t: Column) -> Column:
        out = t
        for letter, mark in marks.items():
            out = F.when((mark != "") & (t == F.concat(esc, F.lit(letter), esc)), mark).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(v, token, F.lit(1)), back), "")


def field_tree(messages: DataFrame, id_col: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """H2: ``(msg_id, seg_pos, seg_name, field_no, rep_no, comp_no, sub_no,
    value)``, a row for each non-empty leaf, numbered from 1.

    The delimiters are those that the message's own MSH.1 and MSH.2 declare;
    one that is not declared cuts nothing, and a message without MSH is read
    with ``|^~\\&``.  Leaves are cut before they are decoded.  In header
    segments (MSH, and BHS and FHS of an envelope) field 1 is the separator and
    field 2 the other delimiters, both whole.  A null message has no rows."""
    p = messages.select(F.col(id_col).alias("msg_id"), H.segment_lines(F.col(raw_col)).alias("lines"))
    p = p.select("msg_id", "lines", F.coalesce(F.get(F.filter("lines", lambda s: F.startswith(s, F.lit("MSH"))), F.lit(0)),
                                               F.lit("MSH|^~\\&")).alias("msh"))
    p = p.select("msg_id", "lines", "msh", F.substring("msh", 4, 1).alias("fs"))
    p = p.select("msg_id", "lines", "msh", "fs", _pattern(F.col("fs")).alias("fp"))
    p = p.select("msg_id", "lines", "fs", "fp", F.coalesce(
        F.get(_cut(F.col("msh"), F.col("fs"), F.col("fp")), F.lit(1)), F.lit("")).alias("enc"))
    p = p.select("msg_id", "lines", "fp", F.struct(F.col("fs").alias("field"), *[
        F.substring("enc", i, 1).alias(n) for i, n in enumerate(("component", "repetition", "escape", "sub"), 1)]).alias("d"))
    p = p.select("msg_id", "lines", "fp", "d", F.struct(*[
        _pattern(F.col(f"d.{n}")).alias(n) for n in ("component", "repetition", "sub")]).alias("q"))
    s = posexplode_kept(p, ["msg_id", "d", "q", "fp"], "lines", "i", "line")
    s = s.select("msg_id", "d", "q", (F.col("i") + 1).alias("seg_pos"),
                 _cut(F.col("line"), F.col("d.field"), F.col("fp")).alias("parts"))
    s = s.select("msg_id", "d", "q", "seg_pos", F.get("parts", F.lit(0)).alias("seg_name"), "parts")
    header = F.col("seg_name").isin(*HEADERS)
    values = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    f = posexplode_kept(s, ["msg_id", "d", "q", "seg_pos", "seg_name"],
                        F.when(header, F.concat(F.array("d.field"), values)).otherwise(values), "i", "value")
    f = f.where(F.col("value") != "").select("msg_id", "d", "q", "seg_pos", "seg_name", (F.col("i") + 1).alias("field_no"),
                                             (header & (F.col("i") < 2)).alias("whole"), "value")
    keep, whole = ["msg_id", "d", "q", "seg_pos", "seg_name", "field_no", "whole"], F.col("whole")
    for n, mark in (("rep_no", "repetition"), ("comp_no", "component"), ("sub_no", "sub")):
        cut = F.when(whole, F.array("value")).otherwise(_cut(F.col("value"), F.col(f"d.{mark}"), F.col(f"q.{mark}")))
        # an empty part has empty parts only, so it is left out at once
        f = posexplode_kept(f, keep, cut, "i", "leaf").where(F.col("leaf") != "").select(
            *keep, (F.col("i") + 1).alias(n), F.col("leaf").alias("value"))
        keep = keep + [n]
    # the delimiters go on with the few leaves that hold an escape
    escaped = ~whole & (F.col("d.escape") != "") & F.contains(F.col("value"), F.col("d.escape"))
    out = [k for k in keep if k not in ("d", "q", "whole")]
    f = f.select(*out, "value", F.when(escaped, F.col("d")).alias("d"))
    return f.select(*out, F.when(F.col("d").isNull(), F.col("value")).otherwise(_decoded(F.col("value"))).alias("value"))


# ------------------------------------------------------------------ G15
def _grammar_breaks(lines: Column) -> Column:
    """Breaks of the order of segments and of set ids, an array in message
    order of ``(severity, code, location, message)``.  After a break the
    message goes on from the segment found, so each break is told once.

    One fold over the lines: its state is the last segment that moves the
    message on and the numbers so far.  Breaks are gathered by chunk, so that a
    long message with many of them copies no long list at each."""
    names = list(G.FOLLOWS)[1:]
    allowed = [f"{now}>{name}" for now, follow in G.FOLLOWS.items() for name in follow]
    none = F.array().cast("array<struct<severity:string,code:string,location:string,message:string>>")

    def found(text: Column, pos: Column) -> Column:
        return F.struct(F.lit("error").alias("severity"), F.lit("group").alias("code"),
                        F.concat(F.lit("segment "), pos.cast("string")).alias("location"), text.alias("message"))

    def state(last: Column, pos: Column, numbers: list[Column], out: Column) -> Column:
        return F.struct(last.alias("last"), pos.alias("pos"), *[n.alias(f"n_{s}") for s, n in zip(G.NUMBERED, numbers)], out.alias("out"))

    def step(a: Column, s: Column) -> Column:
        name, pos = s["name"], a["pos"] + 1
        numbers = [F.when(name == n, a[f"n_{n}"] + 1).when(name.isin(*anew) if anew else F.lit(False), 0).otherwise(a[f"n_{n}"])
                   for n, anew in G.NUMBERED.items()]
        due = F.coalesce(*[F.when(name == n, (a[f"n_{n}"] + 1).cast("string")) for n in G.NUMBERED])
        in_place = F.concat(a["last"], F.lit(">"), name).isin(*allowed) | F.startswith(name, F.lit(G.SITE_PREFIX))
        right = in_place & F.coalesce(s["set_id"] == due, F.lit(True))
        breaks = F.array_compact(F.array(
            F.when(~in_place, found(F.concat(name, F.lit(" is not expected after "), a["last"]), pos)),
            F.when(s["set_id"] != due, found(F.concat(
                name, F.lit(" set id "), s["set_id"], F.lit(" out of sequence, expected "), due), pos))))
        return state(F.when(name.isin(*names), name).otherwise(a["last"]), pos, numbers,
                     F.when(right, a["out"]).otherwise(F.concat(a["out"], breaks)))

    def chunk(heads: Column, a: Column, k: Column) -> Column:
        begin = state(a["last"], a["pos"], [a[f"n_{s}"] for s in G.NUMBERED], none)
        return bind(F.aggregate(F.slice(heads, k * CHUNK + 1, CHUNK), begin, step), lambda z: state(
            z["last"], z["pos"], [z[f"n_{s}"] for s in G.NUMBERED],
            F.when(F.size(z["out"]) == 0, a["out"]).otherwise(F.concat(a["out"], F.array(z["out"])))))

    def breaks(heads: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(heads) - 1, F.lit(0)) / CHUNK).cast("int"))
        begin = state(F.lit(G.MESSAGE_START), F.lit(0), [F.lit(0) for _ in G.NUMBERED], F.filter(F.array(none), lambda _: F.lit(False)))
        return bind(F.aggregate(chunks, begin, lambda a, k: chunk(heads, a, k)), lambda z: F.concat(F.flatten(z["out"]), F.array_compact(
            F.array(F.when(~z["last"].isin(G.MESSAGE_START, *G.MAY_END), found(F.concat(F.lit("message ends after "), z["last"]), z["pos"]))))))

    def head(line: Column) -> Column:
        return bind(H.line_name(line), lambda name: F.struct(name.alias("name"), F.substring_index(
            F.substr(line, F.length(name) + 2), "|", 1).alias("set_id")))

    return bind(F.filter(F.transform(lines, head), lambda s: ~s["name"].isin(*ENVELOPE_SEGMENTS)), breaks)


def structure(raw_messages: DataFrame) -> DataFrame:
    """Structural findings before export, ``(msg_id, severity, code,
    location, message)``: the strict profile's structure errors, and the message
    grammar (``rules/hl7_grammar.py``): a segment out of place, a set id out of
    sequence, a message that ends before its order is complete.  Both come
    from one reading of the message's row.  A message that does not start with
    MSH has the parse error only."""
    # ORC and PV1 are optional in a patient group, so their absence is no error
    places = {"segment_missing": ["MSH", "PID", "OBR", "OBX"], "required": [f"MSH.{n}" for n, _ in MSH_REQUIRED]}
    p = raw_messages.select("msg_id", H.segment_lines(F.coalesce("raw", F.lit(""))).alias("lines"))
    p = p.select("msg_id", "lines", F.transform("lines", H.line_name).alias("names"))
    # only MSH is split; of the others the line, its name and its set id are enough
    first = lambda s: H.line_fields(F.get(F.filter("lines", lambda line: H.line_name(line) == s), F.lit(0)))
    ctx = {"names": F.col("names"), "obx": F.filter("names", lambda n: n == "OBX"),
           "parsed": F.coalesce(F.get(F.filter("names", lambda n: ~n.isin(*ENVELOPE_SEGMENTS)), F.lit(0)) == "MSH", F.lit(False)),
           **{s: first(s) for s in ("MSH", "PID", "PV1", "ORC", "OBR")}}
    staged = p.select("msg_id", "lines", *[v.alias(f"c_{k}") for k, v in ctx.items()])
    c = {k: F.col(f"c_{k}") for k in ctx}
    kept = HV.strict_findings(c, HV._Checks(("segment_missing", "no_obx", "required"), places))
    flat = F.transform(kept, lambda x: F.struct(*[x[n].alias(n) for n in ("severity", "code", "location", "message")]))
    broken = F.array(F.struct(F.lit("error").alias("severity"), F.lit("parse").alias("code"), F.lit("MSH").alias("location"),
                              F.lit(HV.R.STRICT_PARSE_ERROR).alias("message")))
    found = F.when(c["parsed"], F.concat(flat, _grammar_breaks(F.col("lines")))).otherwise(broken)
    return inline_kept(staged, ["msg_id"], found, "severity")


# ------------------------------------------------------------------ G16
def _parts(items: Column, starts: Column) -> Column:
    """``items`` from each of the 1-based ``starts`` to the next."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items) + 1))
    # without starts there is one end, whose part is null
    return F.array_compact(F.zip_with(starts, ends, lambda a, b: F.slice(items, a, b - a)))


def _places(flags: Column) -> Column:
    """1-based places of the true elements."""
    return F.array_compact(F.transform(flags, lambda f, i: F.when(f, i + 1)))


def _before(items: Column, starts: Column) -> Column:
    """``items`` before the first group."""
    return F.slice(items, F.lit(1), F.coalesce(F.get(starts, F.lit(0)) - 1, F.size(items)))


def _with_fields(messages: DataFrame) -> DataFrame:
    return messages.withColumn("segs", F.transform("lines", H.line_fields))


def group_tree(raw_messages: DataFrame, with_segs: Callable[[DataFrame], DataFrame] = _with_fields) -> DataFrame:
    """``(msg_id, head, patients)``: the segments before the first group,
    and of each PATIENT_RESULT its own segments and its ORDER_OBSERVATION
    groups (``patients: array<struct<segs, orders: array<array<segment>>>>``).
    A segment is what ``with_segs``, which adds ``segs`` to ``lines``, makes of
    its line: its parts if not told otherwise; groups are told by the names alone.

    PID opens a patient group, and so does an order without one before it; ORC,
    or OBR without an ORC right before it, opens an order group.  No segment
    is lost: one out of place stays in the group that is open."""
    def patient(part: Column, opens: Column) -> Column:
        return bind(_places(opens), lambda at: F.struct(_before(part, at).alias("segs"), _parts(part, at).alias("orders")))

    p = raw_messages.select("msg_id", H.segment_lines(F.coalesce("raw", F.lit(""))).alias("lines"))
    p = with_segs(p).select("msg_id", "segs", F.transform("lines", H.line_name).alias("names"))
    p = p.select("msg_id", "segs", _places(F.transform("names", lambda n: n == "PID")).alias("pids"),
                 F.transform("names", lambda n, i: (n == "ORC") | ((n == "OBR") & ~F.coalesce(
                     F.get(F.col("names"), i - 1) == "ORC", F.lit(False)))).alias("opens"))
    p = p.select("msg_id", "segs", "opens", "pids", F.array_position("opens", F.lit(True)).cast("int").alias("first"))
    alone = (F.col("first") > 0) & F.coalesce(F.col("first") < F.get("pids", F.lit(0)), F.lit(True))
    p = p.select("msg_id", "segs", "opens", F.when(alone, F.concat(F.array("first"), "pids")).otherwise(F.col("pids")).alias("at"))
    return p.select("msg_id", _before(F.col("segs"), F.col("at")).alias("head"), F.zip_with(
        _parts(F.col("segs"), F.col("at")), _parts(F.col("opens"), F.col("at")), patient).alias("patients"))


def _element(name, body: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit("<"), name, F.lit(">"), body, F.lit("</"), name, F.lit(">"))


def to_xml(raw_messages: DataFrame) -> DataFrame:
    """``(msg_id, xml)``, the group tree as XML: groups as elements around
    their segments, text escaped."""
    order = lambda o: _element(G.ORDER_GROUP, F.array_join(o, ""))
    patient = lambda p: _element(G.PATIENT_GROUP, F.concat(
        F.array_join(p["segs"], ""), F.array_join(F.transform(p["orders"], order), "")))
    return group_tree(raw_messages, SX.with_elements).select("msg_id", _element("ORU_R01", F.concat(
        F.array_join("head", ""), F.array_join(F.transform("patients", patient), ""))).alias("xml"))


def from_xml(xml_messages: DataFrame) -> DataFrame:
    """Inverse of ``to_xml``: ``(msg_id, raw)``.  Segments come back in their
    order and fields at their numbers; empty fields after a segment's last
    value, which the XML does not hold, are not written.  Null XML gives null."""
    return SX.with_raw(xml_messages.select("msg_id", "xml")).select("msg_id", "raw")


# ------------------------------------------------------------------ G14
def batch_segments(segs: DataFrame, group: Column, run_ts: str) -> DataFrame:
    """G14 for batches of any size: ``(msg_id, seg_no, segment)``, the segments
    of one message for each ``group`` key, in order: MSH, then the orders'
    segments by patient and order.

    Orders are sorted by ranges of (key, patient, order), so that a key with a
    third of all orders is spread over a third of the parts; numbers are those
    within the part plus the sum over the key's earlier parts.  The parts are
    written first, so a lost executor cannot number them another way.  Set ids
    of patients are numbered the same way (PID.1 runs 1..n in the message).  Orders
    without a key share one message, whose key is empty."""
    spark = segs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "batch-segments")
    body = segs.select(F.coalesce(group.cast("string"), F.lit("")).alias("batch_key"), "patient_id", "order_id",
                       F.slice("segs", F.lit(2), F.size("segs") - 1).alias("body"))
    body.repartitionByRange(n_parts, "batch_key", "patient_id", "order_id").withColumn(
        "part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("n", F.size("body").cast("long"))
    # a key has at most one row a part here
    earlier = Window.partitionBy("batch_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = rows.groupBy("batch_key", "part").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).select(
        "batch_key", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("n_earlier"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c_earlier"))
    within = Window.partitionBy("batch_key", "part").orderBy("patient_id", "order_id")
    placed = rows.withColumn("at", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "patient_no", F.row_number().over(within)).join(of_part, ["batch_key", "part"])
    placed = placed.select("batch_key", (F.coalesce("at", F.lit(0)) + F.col("n_earlier")).alias("at"),
                           (F.col("patient_no") + F.col("c_earlier")).cast("string").alias("patient_no"), "body")
    numbered = F.transform("body", lambda s: F.when(
        F.startswith(s, F.lit("PID|1|")), F.concat(F.lit("PID|"), F.col("patient_no"), F.substr(s, F.lit(6)))).otherwise(s))
    out = posexplode_kept(placed, ["batch_key", "at"], numbered, "i", "segment").select(
        F.col("batch_key").alias("msg_id"), (F.col("at") + F.col("i") + 2).alias("seg_no"), "segment")
    msh = F.concat(F.lit(f"MSH|^~\\&|{M.APP_FIELDS}|{run_ts}||ORU^R01^ORU_R01|B"), F.col("batch_key"),
                   F.lit(f"|P|{M.HL7_VERSION}"))
    heads = of_part.where("c_earlier = 0").select(F.col("batch_key").alias("msg_id"), F.lit(1).cast("long").alias("seg_no"),
                                                  msh.alias("segment"))
    return out.unionByName(heads)
