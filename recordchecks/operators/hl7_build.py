"""HL7 ORU^R01 generation.

Device records (JSON) are opened inside their own row, whatever they nest (G2),
matched against the compiled mapping (G1, G3, J2),
numbered (W2) and assembled (G11) on the same row: no shuffle.  Their rows are made
by ``functions.record_rows``; a mapping too large to travel with the plan is joined instead.  Every step is linear, or a
sort, in the size of a record.

Also relational ORU building (G13-G16): patient, order and observation tables
to messages, keyed by order (one message per order, whatever its size), or
several patients per message keyed by a day and key block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordchecks.functions import hl7 as H
from recordchecks.functions import record_rows as R
from recordchecks.functions.arrays import bind, run_starts, running
from recordchecks.functions.gen import explode_kept, inline_kept
from recordchecks.functions.jsonwalk import scalars_below
from recordchecks.rules import hl7_mapping as M

# A mapping of more rows is joined instead of being compiled into the plan.
MAX_COMPILED_ROWS = 2_000
# Levels of a record opened by expressions of their own; deeper ones by a walk over tokens.
FAST_LEVELS = 4


def norm_key(c: Column) -> Column:
    """Upper-case, space and ``-`` to ``_`` (both sides, D28)."""
    return F.upper(F.translate(c, " -", "__"))


# ------------------------------------------------------------------ G1
def load_mapping(spark: SparkSession, path: str, extra_cols: str = "") -> DataFrame:
    """The mapping CSV (header row), read with its schema - all strings,
    so an empty SEQUENCE stays distinguishable and becomes 999 in G1."""
    schema = (extra_cols + ", " if extra_cols else "") + M.MAPPING_SCHEMA
    return spark.read.schema(schema).option("header", True).csv(path)


def mapping_frame(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or M.DEFAULT_MAPPING, M.MAPPING_SCHEMA)


def compile_mapping(mapping: DataFrame, group_cols: tuple = ()) -> DataFrame:
    """G1 (W4): normalised attribute, section (CHILD_OBR of OBX rows, the
    attribute itself for OBR rows), SEQUENCE as int (empty = 999), and the
    rank of each row inside its segment / section by sequence."""
    seq = F.coalesce(F.nullif(F.trim("SEQUENCE"), F.lit("")).try_cast("int"), F.lit(999))
    attr = norm_key(F.col("JSON_ATTRIBUTE"))
    child = F.nullif(F.trim("CHILD_OBR"), F.lit(""))
    section = F.when((F.col("SEGMENT") == "OBX") & child.isNotNull(), norm_key(child)).when(
        F.col("SEGMENT") == "OBR", attr)
    m = mapping.select(*group_cols, F.col("SEGMENT").alias("segment"), section.alias("section"), attr.alias("attr"),
                       F.col("IDENTIFIER").alias("identifier"), F.col("DISPLAY_NAME").alias("display_name"),
                       F.coalesce(F.col("DATA_TYPE"), F.lit("")).alias("data_type"),
                       F.coalesce(F.col("UNIT"), F.lit("")).alias("unit"), seq.alias("sequence"))
    w = Window.partitionBy(*group_cols, "segment", "section").orderBy("sequence", "attr")
    return m.withColumn("rank_in_group", F.row_number().over(w))


# ------------------------------------------------------------------ G2, G3
def _node(path, top, idx, leaf, v) -> Column:
    return F.struct(path.alias("path"), top.alias("top"), idx.cast("int").alias("idx"),
                    leaf.alias("leaf"), v.alias("v"))


def _entries_of(v: Column) -> Column:
    """Entries of an object; NULL for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _items_of(v: Column) -> Column:
    """Elements of an array; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _expand(arr: Column) -> Column:
    """One level: objects open into their entries, arrays into their
    elements, scalars stay.  Keys are normalised on the way (G2), once each.
    What a node is shows by opening it: a schema would be read from all below
    it.  The array expression is referenced once, so the unrolled levels stay
    a linear chain."""
    def step(e):
        named = F.transform(_entries_of(e["v"]), lambda kv: F.struct(norm_key(kv["key"]).alias("name"), kv["value"].alias("v")))
        kids_obj = F.transform(named, lambda x: _node(
            F.when(e["path"] == "", x["name"]).otherwise(F.concat(e["path"], F.lit("."), x["name"])),
            F.coalesce(e["top"], x["name"]), e["idx"], x["name"], x["v"]))
        kids_arr = F.transform(
            _items_of(e["v"]),
            lambda x, i: _node(F.concat(e["path"], F.lit("["), i.cast("string"), F.lit("]")), e["top"],
                               F.when(e["idx"].isNull() & ~e["path"].contains("["), i).otherwise(e["idx"]),
                               e["leaf"], x))
        return F.coalesce(kids_obj, kids_arr, F.array(e))
    return F.flatten(F.transform(arr, step))


def flatten(docs: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """``(doc_id, path, top, idx, leaf, value, kind)`` for every scalar,
    keys normalised at every level, array elements as ``[i]``; JSON nulls give
    no row.  ``top`` is the first key, ``idx`` the index inside a first-level
    array, ``leaf`` the last key.  The document is opened inside its own row,
    whatever it nests, and exploded once."""
    v = docs.select(F.col(id_col).alias("doc_id"), F.try_parse_json(F.col(json_col)).alias("v"))
    staged = v.select("doc_id", F.when(F.col("v").isNotNull(), _nodes(F.col("v"))).alias("nodes"))
    out = inline_kept(staged, ["doc_id"], "nodes", "path")
    kind = F.schema_of_variant("v")
    return out.select("doc_id", "path", "top", "idx", "leaf",
                      F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).otherwise(
                          F.to_json("v")).alias("value"),
                      kind.alias("kind")).where(F.col("kind") != "VOID")


def attr_values(docs: DataFrame, mapping: DataFrame, max_compiled: int = MAX_COMPILED_ROWS) -> DataFrame:
    """Mapped attribute values per document ``(doc_id, section, attr,
    item, value)``.  Scalar sections look the attribute up from the root,
    then under the section (first found wins); list sections (arrays of
    objects) match each item's keys, nested ones included, by their last key
    (G10)."""
    # no filter on the parsed column: it would be pushed below the parse and
    # parse every document twice; unparseable ones drop at the generator
    v = docs.select("doc_id", F.try_parse_json("json").alias("v"))
    m = _matched(v, mapping, max_compiled).select("doc_id", "_best")
    return inline_kept(m, ["doc_id"], "_best", "section").select(
        "doc_id", "section", "attr", F.when(F.col("item") >= 0, F.col("item")).alias("item"), "identifier",
        "display_name", "data_type", "unit", "sequence", "value")


# ------------------------------------------------------------------ G4-G7
def _v(v: Column, *keys: str) -> Column:
    path = "$" + "".join('["' + k + '"]' for k in keys)
    return F.try_variant_get(v, path, "string")


def header_segments(docs: DataFrame, run_ts: str, obs_ts: str, tz: str = "PST") -> DataFrame:
    """G4-G7 per document on its own row: BHS, MSH, PID, PV1, ORC, fixed OBR,
    two NTE, device OBX, and BTS; values escaped (D9)."""
    v = F.try_parse_json("json")
    p = docs.select("doc_id", "json", v.alias("v"))
    e = lambda c: F.coalesce(H.escape_value(c), F.lit(""))
    pi = lambda k: _v(F.col("v"), "Patient Info", k)
    bhs = F.concat(F.lit(f"BHS|^~\\&|{M.APP_FIELDS}|{run_ts}||BatchType-"),
                   e(F.coalesce(_v(F.col("v"), "Batch", "Type"), F.lit(M.DEFAULT_BATCH_TYPE))), F.lit("||"),
                   e(_v(F.col("v"), "Batch", "ID")))
    msh = F.concat(F.lit(f"MSH|^~\\&|{M.APP_FIELDS}|{run_ts}||ORU^R01|MSG"), F.col("doc_id").cast("string"),
                   F.lit(f"|P|{M.HL7_VERSION}"))
    # put together with ``concat_ws``: a higher-order function's arguments are interpreted
    ids = F.concat_ws(
        "~", F.when(F.coalesce(pi("ERP Patient ID"), pi("Baxter Patient ID")) != "",
                    F.concat(e(F.coalesce(pi("ERP Patient ID"), pi("Baxter Patient ID"))), F.lit(M.BAXTER_ID_SUFFIX))),
        F.when(pi("Clinic Patient ID") != "", F.concat(e(pi("Clinic Patient ID")), F.lit(M.CLINIC_ID_SUFFIX))))
    name = F.when(pi("First Name").isNotNull() | pi("Last Name").isNotNull(), F.concat(
        e(pi("Last Name")), F.lit("^"), e(pi("First Name")), F.lit("^"), e(pi("Middle Name")))).otherwise(F.lit(""))
    pid = F.concat(F.lit("PID|1||"), ids, F.lit("||"), name)
    pv1 = F.concat(F.lit("PV1|1|O|^^^"), e(F.coalesce(pi("Clinic Name"), F.lit(M.DEFAULT_CLINIC))))
    tid = e(pi("Treatment ID"))
    orc = F.concat(F.lit("ORC|RE|"), tid, F.lit(f"|FILLER_ID|||||||{run_ts}"))
    fixed_obr = F.lit(f"OBR|1|||{M.VITALS_OBR}|||{obs_ts}")
    nte1 = F.concat(F.lit("NTE|1||Treatment ID: "), tid, F.lit("|"))
    nte2 = F.lit(f"NTE|2||Clinic Timezone: {tz}")
    dev = pi("Device Type")
    dev_obx = F.when(F.coalesce(dev, F.lit("")) != "", F.concat(
        F.lit(f"OBX|1|ST|{M.DEVICE_OBX}|1|"), e(dev), F.lit("||||||F")))
    return p.select("doc_id", "v", R.record_text(F.col("json"), F.col("v")).alias("text"), F.col("v").isNotNull().alias("parsed"), bhs.alias("bhs"), msh.alias("msh"),
                    pid.alias("pid"), pv1.alias("pv1"), orc.alias("orc"), fixed_obr.alias("fixed_obr"),
                    nte1.alias("nte1"), nte2.alias("nte2"), dev_obx.alias("device_obx"),
                    F.lit(M.BTS_SEGMENT).alias("bts"))


# ------------------------------------------------------------------ G8-G11
_ENTRY = ["section", "attr", "identifier", "display_name", "data_type", "unit", "sequence", "prio"]
_ENTRY_TYPE = "array<struct<" + ",".join(f"{n}:{'int' if n in ('sequence', 'prio') else 'string'}" for n in _ENTRY) + ">>"


def _entries(mapping: DataFrame) -> DataFrame:
    """``(key, entry)`` look-up rows of the mapping: ``ATTR`` (found from the
    root, priority 1), ``SECTION.ATTR`` (found under the section, priority 2),
    ``SECTION|LEAF`` (a key inside an item of a list section, G10)."""
    rows = compile_mapping(mapping).where((F.col("segment") == "OBX") & F.col("section").isNotNull())

    def entry(key: Column, prio: int) -> Column:
        return F.struct(key.alias("key"), F.struct(*_ENTRY[:-1], F.lit(prio).alias("prio")).alias("entry"))
    sec, attr = F.col("section"), F.col("attr")
    return rows.select(F.inline(F.array(entry(attr, 1), entry(F.concat(sec, F.lit("."), attr), 2),
                                        entry(F.concat(sec, F.lit("|"), attr), 1))))


def _sections(mapping: DataFrame) -> DataFrame:
    """One row: the OBR sections in order, as an array."""
    rows = compile_mapping(mapping).where(F.col("segment") == "OBR")
    one = F.struct(F.col("sequence").alias("sec_seq"), F.col("attr").alias("section"), "identifier", "display_name")
    return rows.agg(F.array_sort(F.collect_list(one)).alias("_secs"))


def _nodes(v: Column) -> Column:
    """Scalars of a document: ``FAST_LEVELS`` levels by expressions, what nests deeper
    by one fold over its tokens, which other documents never reach."""
    arr = F.array(_node(F.lit(""), F.lit(None).cast("string"), F.lit(None), F.lit(None).cast("string"), v))
    for _ in range(FAST_LEVELS):
        arr = _expand(arr)
    return F.flatten(F.transform(arr, lambda e: F.when(
        _entries_of(e["v"]).isNull() & _items_of(e["v"]).isNull(), F.array(e)).otherwise(scalars_below(e["v"], e["path"], e["top"], e["idx"], e["leaf"], norm_key))))


def _lookup(mapping: DataFrame) -> dict[str, list]:
    """Entries of a small mapping by look-up key."""
    by_key: dict[str, list] = {}
    for r in _entries(mapping).collect():  # 3 * max_compiled rows at most
        by_key.setdefault(r["key"], []).append(r["entry"])
    return by_key


def _compiled(mapping: DataFrame, obs_ts: str) -> R.Rows:
    """A small mapping as it travels with the plan."""
    lookup = {k: [e.asDict() for e in es] for k, es in sorted(_lookup(mapping).items())}
    return R.Rows(lookup, [s.asDict() for s in _sections(mapping).first()["_secs"]], obs_ts)


def _candidate(n: Column, m: Column) -> Column:
    value = bind(F.schema_of_variant(n["v"]), lambda k: F.when(k == "STRING", F.try_variant_get(n["v"], "$", "string")).when(
        (k != "VOID") & ~k.startswith("OBJECT") & ~k.startswith("ARRAY"), F.to_json(n["v"])))
    return F.struct(m["section"].alias("section"), m["attr"].alias("attr"), m["prio"].alias("prio"),
                    F.coalesce(n["idx"], F.lit(-1)).alias("item"), m["sequence"].alias("sequence"),
                    m["identifier"].alias("identifier"), m["display_name"].alias("display_name"),
                    m["data_type"].alias("data_type"), m["unit"].alias("unit"), value.alias("value"))


def _key_of(n: Column) -> Column:
    return F.when(n["idx"].isNull(), n["path"]).otherwise(F.concat(n["top"], F.lit("|"), n["leaf"]))


def _matched(df: DataFrame, mapping: DataFrame, max_compiled: int) -> DataFrame:
    """Adds ``_best``: the mapped values of each document, inside its row.

    A mapping of up to ``max_compiled`` rows becomes a literal map, so the
    look-up needs no join.  A larger one is joined to the exploded nodes on the
    look-up key (its small side broadcast only if Spark finds it small), and
    the matches return to their document by its id."""
    keep = df.columns
    opened = df.select(*keep, F.when(F.col("v").isNotNull(), _nodes(F.col("v"))).alias("_nodes"))
    if mapping.count() <= max_compiled:
        by_key = _lookup(mapping)
        empty = F.array().cast(_ENTRY_TYPE)

        def literal(e):
            return F.struct(*[F.lit(e[n]).cast("int" if n in ("sequence", "prio") else "string").alias(n) for n in _ENTRY])
        lookup = F.create_map(*[x for k, es in sorted(by_key.items()) for x in (F.lit(k), F.array(*map(literal, es)))])
        cand = F.flatten(F.transform("_nodes", lambda n: F.transform(
            F.coalesce(F.try_element_at(lookup, _key_of(n)), empty) if by_key else empty, lambda m: _candidate(n, m))))
        with_cand = opened.select(*keep, F.filter(cand, lambda x: x["value"].isNotNull()).alias("_cand"))
    else:
        n = inline_kept(opened.select("doc_id", "_nodes"), ["doc_id"], F.transform("_nodes", lambda x: F.struct(x.alias("n"), _key_of(x).alias("key"))), "key")
        hits = n.join(_entries(mapping), "key").select("doc_id", _candidate(F.col("n"), F.col("entry")).alias("c")).where("c.value is not null")
        with_cand = df.join(hits.groupBy("doc_id").agg(F.collect_list("c").alias("_cand")), "doc_id", "left").select(
            *keep, F.when(F.col("v").isNotNull(), F.coalesce("_cand", F.array())).alias("_cand"))
    # first found wins: a root look-up hides the under-section one (G8).  Items
    # of lists have one priority, so only the others, as many as the mapping
    # has rows at most, are compared.
    # ``bind``: a column read inside a lambda would be computed there, once an element.
    best = bind(F.filter("_cand", lambda x: (x["item"] < 0) & (x["prio"] == 1)), lambda root: F.filter(
        "_cand", lambda x: (x["item"] >= 0) | (x["prio"] == 1) | ~F.exists(
            root, lambda y: (y["section"] == x["section"]) & (y["attr"] == x["attr"]))))
    return with_cand.select(*keep, best.alias("_best"))


def _with_rows(df: DataFrame, mapping: DataFrame, obs_ts: str) -> DataFrame:
    """Adds ``rows``: per document the OBR and OBX rows in message order, numbered
    (W2), by a mapping that is joined: one OBR per section, one per item of a list
    section (D14), its OBX below it.  A section's values are sorted once; running
    counts number them.  ``record_rows`` does the same by a mapping that is not."""
    keep = df.columns
    m = _matched(df, mapping, 0)
    one = _sections(mapping)  # one row of configuration, the same for every document
    m = m.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")

    def section(best, s):
        mine = F.array_sort(F.transform(F.filter(best, lambda x: x["section"] == s["section"]), lambda x: F.struct(
            x["item"], x["sequence"], x["attr"], x["identifier"], x["display_name"], x["data_type"], x["unit"], x["value"])))
        return F.struct(s.alias("s"), mine.alias("mine"))

    def numbered(x):
        return F.struct(x["s"], x["mine"], run_starts(F.transform(x["mine"], lambda y: y["item"])).alias("starts"))

    def heads(x):
        return F.struct(x["s"], x["mine"], x["starts"], F.transform(x["starts"], lambda y, i: (y == i).cast("int")).alias("is_first"))
    st = m.select(*keep, bind(F.col("_best"), lambda best: F.transform("_secs", lambda s: section(best, s))).alias("_a"))
    st = st.select(*keep, F.transform("_a", numbered).alias("_a"))
    st = st.select(*keep, F.transform("_a", heads).alias("_a"))
    st = st.select(*keep, F.transform("_a", lambda x: F.struct(
        x["s"], x["mine"], x["starts"], x["is_first"],
        running(x["is_first"], F.lit(0), lambda a, b: a + b).alias("before"))).alias("_a"))
    # OBR set ids start at 2 and run on over the sections
    counts = F.transform("_a", lambda x: F.greatest(F.lit(1), F.aggregate(x["is_first"], F.lit(0), lambda a, b: a + b)))
    st = st.select(*keep, "_a", running(counts, F.lit(2), lambda a, b: a + b).alias("_ids"))

    def obr_row(s, item, obr_id):
        seg = F.concat(F.lit("OBR|"), obr_id.cast("string"), F.lit("|||"), s["identifier"], F.lit("^"),
                       s["display_name"], F.lit(f"|||{obs_ts}"))
        return F.struct(s["sec_seq"].alias("sec_seq"), item.alias("item"), obr_id.alias("obr_set_id"),
                        F.lit(0).alias("obx_set_id"), F.lit("OBR").alias("seg_name"),
                        s["identifier"].alias("identifier"), F.lit(None).cast("string").alias("value"),
                        seg.alias("segment"))

    def obx_row(s, y, obr_id, j):
        seg = F.concat(F.lit("OBX|"), j.cast("string"), F.lit("|"), y["data_type"], F.lit("|"),
                       y["identifier"], F.lit("^"), y["display_name"], F.lit("|"), obr_id.cast("string"),
                       F.lit("|"), H.escape_value(y["value"]), F.lit("|"), y["unit"], F.lit("|||||F"))
        return F.struct(s["sec_seq"].alias("sec_seq"), y["item"].alias("item"), obr_id.alias("obr_set_id"),
                        j.alias("obx_set_id"), F.lit("OBX").alias("seg_name"), y["identifier"].alias("identifier"),
                        y["value"].alias("value"), seg.alias("segment"))

    def rows_of(z):
        x, first_id = z["_a"], z["_ids"]

        def one(t, i):
            obr_id = first_id + t["before"] + t["is_first"] - 1
            obx = obx_row(x["s"], t["mine"], obr_id, i - t["starts"] + 1)
            return F.when(t["is_first"] == 1, F.array(obr_row(x["s"], t["mine"]["item"], obr_id), obx)).otherwise(F.array(obx))
        both = F.flatten(F.transform(F.arrays_zip(x["mine"].alias("mine"), x["starts"].alias("starts"),
                                                  x["is_first"].alias("is_first"), x["before"].alias("before")), one))
        return F.when(F.size(x["mine"]) > 0, both).otherwise(F.array(obr_row(x["s"], F.lit(-1), first_id)))
    return st.select(*keep, F.flatten(F.transform(F.arrays_zip("_a", "_ids"), rows_of)).alias("rows"))


def section_rows(docs: DataFrame, mapping: DataFrame, obs_ts: str, max_compiled: int = MAX_COMPILED_ROWS) -> DataFrame:
    """G8-G10 + W2: OBR and OBX rows of the mapped sections, numbered:
    ``(doc_id, sec_seq, item, obr_set_id, obx_set_id, seg_name, identifier,
    value, segment)``.  Sections follow the OBR rows' sequence; a list
    section gets one OBR per item (D14); OBR set ids start at 2 and run over
    sections and items; OBX set ids restart at 1 under each OBR, ordered by
    the mapping sequence."""
    # no filter on the parsed column: it would be pushed below the parse and
    # parse every document twice; unparseable ones drop at the generator
    v = docs.select("doc_id", "json", F.try_parse_json("json").alias("v"))
    if mapping.count() <= max_compiled:
        texts = v.select("doc_id", R.record_text(F.col("json"), F.col("v")).alias("text"))
        return R.section_rows(texts, _compiled(mapping, obs_ts))
    plan = _with_rows(v, mapping, obs_ts)
    return inline_kept(plan.select("doc_id", F.when(F.col("v").isNotNull(), F.col("rows")).alias("rows")), ["doc_id"], "rows", "seg_name")


def messages(docs: DataFrame, mapping: DataFrame, run_ts: str, obs_ts: str, tz: str = "PST",
             max_compiled: int = MAX_COMPILED_ROWS) -> DataFrame:
    """G11+G12: ``(doc_id, status, error, n_segments, hl7_message)``.  The
    whole message is built inside the document's row - headers, the section
    rows, BTS - and joined with ``\r`` (D9).  An unparseable record gets
    status ``error``; the batch goes on."""
    h = header_segments(docs, run_ts, obs_ts, tz)
    if mapping.count() <= max_compiled:
        staged = h.withColumn("body", R.segments_text(F.col("text"), _compiled(mapping, obs_ts)))
    else:
        rows = _with_rows(h, mapping, obs_ts)
        staged = rows.withColumn("body", F.struct(F.size("rows").alias("n"), F.nullif(F.array_join(
            F.transform("rows", lambda r: r["segment"]), "\r"), F.lit("")).alias("text")))
    head = ["bhs", "msh", "pid", "pv1", "orc", "fixed_obr", "nte1", "nte2"]
    n = F.lit(len(head) + 1) + F.col("device_obx").isNotNull().cast("int") + F.col("body.n")
    return staged.select(
        "doc_id", F.when(F.col("parsed"), "success").otherwise("error").alias("status"),
        F.when(~F.col("parsed"), F.lit("Error generating HL7 message: record is not valid JSON")).alias("error"),
        F.when(F.col("parsed"), n).alias("n_segments"),
        F.when(F.col("parsed"), F.concat_ws("\r", *head, "device_obx", "body.text", "bts")).alias("hl7_message"))


def gen_totals(msgs: DataFrame) -> DataFrame:
    """Processed / successful / failed."""
    return msgs.agg(F.count(F.lit(1)).alias("total_processed"),
                    F.count_if(F.col("status") == "success").alias("successful"),
                    F.count_if(F.col("status") != "success").alias("failed"))


def file_manifest(msgs: DataFrame, prefix: str = "hl7_output") -> DataFrame:
    """File name and body of each successful message (``{prefix}_{seq:03d}.hl7``);
    they go out with ``sources.sinks.write_message_files``."""
    return msgs.where(F.col("status") == "success").select(
        F.col("doc_id").alias("sequence"),
        F.format_string(f"{prefix}_%03d.hl7", F.col("doc_id")).alias("file_name"),
        F.length("hl7_message").alias("n_chars"), "hl7_message")


# ------------------------------------------------------------------ G13, G14, G16 (text); G15 and XML: hl7_groups.py
def oru_segments(patients: DataFrame, orders: DataFrame, observations: DataFrame, run_ts: str) -> DataFrame:
    """One ORU^R01 per order from relational parts.

    ``patients(patient_id, name, dob, sex)``, ``orders(order_id, patient_id,
    service, observed_ts, status)``, ``observations(order_id, seq, value_type,
    code, value, unit, range, status)``.  Observations are grouped per order -
    the only shuffle besides the two key joins - and sorted by ``seq``; OBX.1
    runs 1..n.  Returns ``(msg_id, order_id, patient_id, segs array<string>)``."""
    grouped = observations.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "value_type", "code", "value", "unit", "range",
                                             "status"))).alias("obs"))
    e = lambda c: F.coalesce(H.escape_value(c), F.lit(""))
    # orders meet their patient before they are as wide as their observations
    j = orders.join(patients, "patient_id", "left").join(grouped, "order_id", "left")
    msg_id = F.col("order_id").cast("string")
    msh = F.concat(F.lit(f"MSH|^~\\&|{M.APP_FIELDS}|{run_ts}||ORU^R01^ORU_R01|"), msg_id,
                   F.lit(f"|P|{M.HL7_VERSION}"))
    pid = F.concat(F.lit("PID|1||"), e(F.col("patient_id")), F.lit("||"), e(F.col("name")), F.lit("||"),
                   e(F.col("dob")), F.lit("|"), e(F.col("sex")))
    pv1 = F.lit("PV1|1|O")
    obr = F.concat(F.lit("OBR|1|"), e(F.col("order_id")), F.lit("||"), e(F.col("service")), F.lit("|||"),
                   e(F.col("observed_ts")), F.lit("|" * 18), e(F.col("status")))
    obx = F.transform(F.coalesce("obs", F.array()), lambda o, i: F.concat(
        F.lit("OBX|"), (i + 1).cast("string"), F.lit("|"), e(o["value_type"]), F.lit("|"), e(o["code"]),
        F.lit("||"), e(o["value"]), F.lit("|"), e(o["unit"]), F.lit("|"), e(o["range"]), F.lit("||||"),
        e(o["status"])))
    return j.select(msg_id.alias("msg_id"), "order_id", "patient_id", "observed_ts",
                    F.concat(F.array(msh, pid, pv1, obr), obx).alias("segs"))


def oru_messages(segs: DataFrame) -> DataFrame:
    """G16 ER7: segments joined with ``\\r``."""
    return segs.select("msg_id", F.array_join("segs", "\r").alias("raw"))


def oru_multi_patient(segs: DataFrame, group: Column, run_ts: str) -> DataFrame:
    """Several patients per message: the per-order groups (PID, PV1,
    OBR, OBX...) of one ``group`` key concatenated under one MSH, ordered by
    patient then order.  ``group`` must bound the message (e.g. a day and a
    key block), as a message is one row."""
    body = segs.select(group.alias("batch_key"), "patient_id", "order_id",
                       F.slice("segs", F.lit(2), F.size("segs") - 1).alias("body"))
    g = body.groupBy("batch_key").agg(
        F.array_sort(F.collect_list(F.struct("patient_id", "order_id", "body"))).alias("parts"))
    msh = F.concat(F.lit(f"MSH|^~\\&|{M.APP_FIELDS}|{run_ts}||ORU^R01^ORU_R01|B"),
                   F.col("batch_key").cast("string"), F.lit(f"|P|{M.HL7_VERSION}"))
    segs_all = F.concat(F.array(msh), F.flatten(F.transform("parts", lambda p: p["body"])))
    return g.select(F.col("batch_key").cast("string").alias("msg_id"),
                    F.size(F.array_distinct(F.transform("parts", lambda p: p["patient_id"]))).alias("n_patients"),
                    F.size(segs_all).alias("n_segments"), F.array_join(segs_all, "\r").alias("raw"))
