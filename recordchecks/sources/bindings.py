"""Operator inputs derived from the driver tables.

Every input grows with the tables it comes from: messages are one per order,
JSON device records one per order, job runs one per order, schedules one per
customer.  Faults are injected by key arithmetic so every rule fires on a
known share of rows; the SQL oracles derive the same inputs the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.functions.arrays import bind
from recordchecks.sources.tables import table

# Line columns each input uses, in sort order.  Lines equal on these columns
# render identically, so sorting by them alone is deterministic and the
# lineitem scan reads only them.
_MSG_LINE = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"]
_DOC_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


# Faults of single fields, one in each message whose key has this remainder: (segment, field position, value).
# MSH.n stands at position n - 1.  Position 0 drops the segment; of OBX the first line is meant.
FAULT_MODULUS = 251
FAULTS = [
    *[("MSH", n - 1, "") for n in (2, 3, 4, 5, 6, 7, 9, 10, 11, 12)],
    ("PV1", 0, None), ("ORC", 0, None), ("OBR", 0, None),
    *[("PID", n, "") for n in (3, 5, 7, 8)], ("PID", 7, "1985-02"), ("PV1", 2, ""),
    *[("OBR", n, "") for n in (2, 3, 7, 25)], ("OBR", 7, "20241399"), ("OBR", 7, "soon"), ("OBR", 5, "Q"),
    *[("OBX", n, "") for n in (1, 3, 5, 11)], ("OBX", 2, "QQ"), ("OBX", 11, "Q"), ("OBX", 6, "mg dL"),
    ("ORC", 1, "ZZ"), ("ORC", 3, "FX"),
]


def _with_faults(segs: Column, key: Column) -> Column:
    """The segments with the fault of the key's remainder, if it has one."""
    table = F.create_map(*[x for r, (seg, pos, value) in enumerate(FAULTS) for x in (
        F.lit(r), F.struct(F.lit(seg).alias("seg"), F.lit(pos).alias("pos"), F.lit(value).cast("string").alias("value")))])
    fault = F.try_element_at(table, (key % FAULT_MODULUS).cast("int"))

    def edit(line: Column, f: Column) -> Column:
        parts = F.split(line, r"\|", -1)
        padded = F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), f["pos"] + 1 - F.size(parts))))
        changed = F.array_join(F.transform(padded, lambda v, i: F.when(i == f["pos"], f["value"]).otherwise(v)), "|")
        meant = F.when(f["seg"] == "OBX", F.startswith(line, F.lit("OBX|1|"))).otherwise(F.get(parts, 0) == f["seg"])
        return F.when(~meant, line).when(f["pos"] > 0, changed)

    return bind(fault, lambda f: F.when(f.isNull(), segs).otherwise(F.array_compact(F.transform(segs, lambda line: edit(line, f)))))


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _obx_text(line: Column, set_id: Column, orderkey: Column) -> Column:
    pk = _s(line["l_partkey"])
    obx2 = F.when((orderkey % 13 == 5) & (set_id == 1), F.lit("")).otherwise(F.lit("NM"))
    obx3 = F.when(line["l_linenumber"] == 5, F.concat(F.lit("P"), pk)).otherwise(
        F.concat(F.lit("P"), pk, F.lit("^Part "), pk, F.lit("^LN")))
    unit = F.when(line["l_linestatus"] == "F", F.lit("10*3/uL")).otherwise(F.lit("mg/dL"))
    rng = (F.when(line["l_linenumber"] == 3, F.lit("<50"))
           .when(line["l_linenumber"] == 4, F.lit(">= 3")).otherwise(F.lit("1-50")))
    return F.concat(F.lit("OBX|"), _s(set_id), F.lit("|"), obx2, F.lit("|"), obx3, F.lit("||"),
                    _s(line["l_quantity"].cast("bigint")), F.lit("|"), unit, F.lit("|"), rng,
                    F.lit("||||"), line["l_returnflag"])


def hl7_messages(spark: SparkSession, d: str) -> DataFrame:
    """``messages(msg_id, raw)``: one ORU^R01 message per order, whatever its size.

    Plan: lineitem is aggregated per order (a message is one row, so its lines
    belong together) and joined to the orders, which meet their customer before
    they are as wide as their lines (merge joins; nothing here is broadcast because
    every side grows with the data).  The aggregate and the join on the order key
    share one exchange."""
    li = table(spark, d, "lineitem").select("l_orderkey", *_MSG_LINE)
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_MSG_LINE))).alias("lines"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_orderdate", "o_orderpriority")
    cust = table(spark, d, "customer").select("c_custkey", "c_name")
    j = (orders.join(cust.hint("merge"), orders.o_custkey == cust.c_custkey, "left")
         .join(lines.hint("merge"), orders.o_orderkey == lines.l_orderkey, "left"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ks = _s(k)
    ts = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    ver = F.when(k % 7 == 5, F.lit("2.8")).when(k % 7 == 6, F.lit("2.9")).otherwise(F.lit("2.5.1"))
    mtype = (F.when(k % 29 == 1, F.lit("ADT^A01")).when(k % 9 == 8, F.lit("ORU^R01^ORU_R01"))
             .otherwise(F.lit("ORU^R01")))
    msh7 = F.when(k % 11 == 7, F.lit("20241399")).otherwise(ts)
    msh = F.concat(F.lit("MSH|^~\\&|LAB|FAC|HIS|HOSP|"), msh7, F.lit("||"), mtype,
                   F.lit("|MSG"), ks, F.lit("|P|"), ver)
    dob = F.when(c % 37 == 0, F.lit("19850230")).otherwise(
        F.format_string("%04d%02d%02d", (1940 + c % 60).cast("int"), (1 + c % 12).cast("int"),
                        (1 + c % 28).cast("int")))
    sex = F.get(F.array(*[F.lit(x) for x in ("M", "F", "O", "U", "A", "X")]), (c % 6).cast("int"))
    pid3 = F.concat(_s(c), F.lit("^^^HOSP^MR"),
                    F.when(c % 10 == 9, F.lit("~^^^HOSP^MR")).otherwise(F.lit("")))
    pid = F.when(k % 17 != 3, F.concat(
        F.lit("PID|1||"), pid3, F.lit("||"), F.replace(F.col("c_name"), F.lit("#"), F.lit("^")),
        F.lit("||"), dob, F.lit("|"), sex))
    cls = F.get(F.array(*[F.lit(x) for x in ("I", "O", "E", "P", "Z")]),
                (F.substring("o_orderpriority", 1, 1).cast("int") - 1))
    pv1 = F.concat(F.lit("PV1|1|"), cls)
    orc2 = F.when(k % 19 == 2, F.concat(F.lit("PX"), ks)).otherwise(F.concat(F.lit("PL"), ks))
    orc = F.concat(F.lit("ORC|NW|"), orc2, F.lit("|FL"), ks)
    obr4 = F.when(k % 31 == 3, F.lit("")).otherwise(
        F.concat(F.lit("SVC^"), F.col("o_orderpriority"), F.lit("^LN")))
    obr = F.concat(F.lit("OBR|1|PL"), ks, F.lit("|FL"), ks, F.lit("|"), obr4, F.lit("|||"), ts,
                   F.lit("|" * 18), F.col("o_orderstatus"))
    obx = F.transform(F.coalesce(F.col("lines"), F.array().cast(
        "array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double,l_returnflag:string,"
        "l_linestatus:string>>")),
        lambda ln, i: _obx_text(ln, i + 1, k))
    head = F.when(k % 23 == 4, F.array(F.lit("EVN|A01"))).otherwise(F.array().cast("array<string>"))
    segs = F.concat(head, F.array_compact(F.array(msh, pid, pv1, orc, obr)), obx)
    staged = j.select(ks.alias("msg_id"), k.alias("k"), _with_faults(segs, k).alias("segs"))
    # segment terminator varies by order: \r\n, \r or \n
    raw = (F.when(F.col("k") % 5 == 0, F.array_join("segs", "\r\n"))
           .when(F.col("k") % 5 == 1, F.array_join("segs", "\r"))
           .otherwise(F.array_join("segs", "\n")))
    return staged.select("msg_id", raw.alias("raw"))


def two_digits(n: Column) -> Column:
    """``%02d`` of a whole number, without a Java formatter for each value."""
    return F.coalesce(F.when(n.between(0, 9), F.concat(F.lit("0"), _s(n))).otherwise(_s(n)), F.lit("null"))


_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def device_records(spark: SparkSession, d: str) -> DataFrame:
    """``docs(doc_id, json)``: one device treatment record per order, shaped
    like the clinic export (nested objects, keys with spaces and ``-``, an
    array of therapy cycles from the order's line items).  Faults: empty or
    wrongly typed ids, a bad birth date, a seconds-bearing batch time, absent
    weights, string weights, non-numeric glucose, hour-24 cycle times, and
    truncated (unparseable) documents."""
    li = table(spark, d, "lineitem").select("l_orderkey", *_DOC_LINE)
    cycles = (li.groupBy("l_orderkey")
              .agg(F.array_sort(F.collect_list(F.struct(*_DOC_LINE))).alias("lines"),
                   F.sum("l_quantity").alias("total_qty")))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                              "o_orderdate")
    j = orders.join(cycles.hint("merge"), orders.o_orderkey == cycles.l_orderkey, "left")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = (F.col("o_totalprice") / 1000).cast("bigint")
    dob = F.when(c % 37 == 0, F.lit("30-FEB-1985")).otherwise(F.format_string(
        "%02d-%s-%04d", (1 + c % 28).cast("int"),
        F.get(F.array(*[F.lit(m) for m in _MONTHS]), (c % 12).cast("int")), (1940 + c % 60).cast("int")))
    patient = F.struct(
        F.when(k % 53 == 0, F.lit("")).otherwise(
            F.concat(F.lit("07501-"), F.format_string("%08d", c))).alias("ERP Patient ID"),
        _s(c).alias("Clinic Patient ID"),
        F.when(k % 59 == 1, F.concat(F.lit("T"), _s(k)).cast("variant"))
        .otherwise(k.cast("variant")).alias("Treatment ID"),
        F.when(k % 2 == 0, F.lit("AMIA")).otherwise(F.lit("CLARIA")).alias("Device Type"),
        F.concat(F.lit("FNAME-"), _s(c)).alias("First Name"),
        F.concat(F.lit("LNAME-"), _s(c)).alias("Last Name"),
        dob.alias("DOB"))
    batch = F.struct(
        F.concat(F.lit("B"), _s(k)).alias("ID"),
        F.date_format("o_orderdate", "dd-MMM-yyyy").alias("Date"),
        F.when(k % 241 == 2, F.lit(915).cast("variant")).otherwise(
            F.when(k % 3 == 0, F.lit("09:15:30")).otherwise(F.lit("09:15")).cast("variant")).alias("Time"),
        F.lit("Normal").alias("Type"))
    pre = F.struct(
        F.when(k % 43 != 0, F.when(k % 241 == 4, F.lit(1500)).otherwise(w)).alias("Weight"),
        _s(F.when(k % 241 == 3, F.lit(350)).otherwise(60 + k % 160)).alias("Blood Pressure Systolic"),
        _s(k % 260).alias("Pulse"),
        F.when(k % 241 == 1, F.lit("warm")).otherwise(_s(85 + k % 30)).alias("Temperature"),
        F.when(k % 61 == 0, F.lit("high")).otherwise(_s(k % 1100)).alias("Glucose"))
    post_w = F.when(k % 2 == 0, (w + 1).cast("variant")).otherwise(_s(w + 1).cast("variant"))
    post = F.struct(post_w.alias("Weight"), _s(70 + k % 150).alias("Blood Pressure Systolic"))
    cyc = F.transform("lines", lambda ln: F.struct(
        F.concat(two_digits((ln["l_linenumber"] * 4).cast("int")), F.lit(":"), two_digits((ln["l_partkey"] % 60).cast("int")),
                 F.lit(":"), two_digits((ln["l_suppkey"] % 60).cast("int"))).alias("Therapy Cycle Time"),
        F.concat(ln["l_returnflag"], F.lit("-"), ln["l_linestatus"],
                 F.when(ln["l_linenumber"] == 1, F.lit("FILL")).otherwise(F.lit(""))).alias("Cycle Type"),
        F.struct(ln["l_quantity"].cast("bigint").alias("Fill Volume"),
                 (ln["l_linenumber"] * 60).alias("Fill Time")).alias("CycleAttributes")))
    doc = F.struct(patient.alias("Patient Info"), batch.alias("Batch"),
                   F.struct(pre.alias("Pre-Treatment"), post.alias("Post-Treatment")).alias("Vitals"),
                   cyc.alias("Actual Therapy"),
                   F.struct(F.col("total_qty").alias("Total Therapy Volume")).alias("Total Therapy"))
    staged = j.select(k.alias("doc_id"), F.to_json(doc).alias("to_json_doc"))
    return staged.select("doc_id", F.when(F.col("doc_id") % 47 == 0, F.expr(
        "substring(to_json_doc, 1, length(to_json_doc) - 1)")).otherwise(F.col("to_json_doc")).alias("json"))


def job_runs(spark: SparkSession, d: str) -> DataFrame:
    """``job_runs(job_seq, job_id, amia_status, claria_status, reprocess_amia,
    reprocess_claria)``: one job per order.  AMIA from the order status
    (O success, F failure, P partial), CLARIA from the priority; a few invalid
    (``DONE``) or NULL values, empty and absent reprocess values, absent ids."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    amia = (F.when(k % 97 == 5, F.lit("DONE"))
            .when(k % 101 == 7, F.lit(None))
            .otherwise(F.when(F.col("o_orderstatus") == "O", "SUCCESS")
                       .when(F.col("o_orderstatus") == "F", "FAILURE").otherwise("PARTIAL_SUCCESS")))
    p = F.substring("o_orderpriority", 1, 1)
    claria = (F.when(k % 103 == 9, F.lit("done"))
              .otherwise(F.when(p.isin("1", "5"), "FAILURE").when(p == "2", "PARTIAL_SUCCESS")
                         .otherwise("SUCCESS")))
    rep_a = (F.when(k % 8 == 1, "SUCCESS").when(k % 8 == 3, "FAILURE").when(k % 8 == 5, "")
             .when(k % 8 == 7, "PARTIAL_SUCCESS").when(k % 107 == 2, "RETRY"))
    rep_c = F.when(k % 6 == 2, "SUCCESS").when(k % 6 == 4, "PARTIAL_SUCCESS")
    return o.select((k + 1).alias("job_seq"),
                    F.when(k % 89 != 0, F.concat(F.lit("JOB_"), F.format_string("%06d", k))).alias("job_id"),
                    amia.alias("amia_status"), claria.alias("claria_status"),
                    rep_a.alias("reprocess_amia"), rep_c.alias("reprocess_claria"))


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """``schedules``: one per customer; kind and parameters from the key."""
    c = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("daily", "weekly", "biweekly", "monthly", "quarterly")])
    start = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval((c % 28).cast("int"), (c % 24).cast("int"), ((c * 13) % 60).cast("int"),
                                  F.lit(0)))
    return table(spark, d, "customer").select(
        c.alias("schedule_id"), F.get(kinds, (c % 5).cast("int")).alias("kind"),
        start.alias("start_ts"),
        (start + F.make_dt_interval((20 + c % 400).cast("int"))).alias("end_ts"),
        (c % 7).cast("int").alias("weekday"),
        (1 + (c * 7) % 31).cast("int").alias("day_of_month"),
        (1 + (c * 11) % 92).cast("int").alias("day_of_quarter"),
        F.when(c % 9 != 0, ((c * 5) % 24).cast("int")).alias("hh"),
        F.when(c % 9 != 0, ((c * 17) % 60).cast("int")).alias("mm"),
        F.when(c % 4 != 0, (15 * (1 + c % 8)).cast("int")).alias("duration_min"),
        F.when(c % 2 == 0, F.array(*[F.lit(x) for x in (1, 4, 7, 10)])).otherwise(
            F.array(*[F.lit(x) for x in (2, 5, 8, 11)])).alias("quarter_months"))
