"""HL7 v2 parsing operators.

Input ``messages(msg_id, raw)``: one row per message.  Parsing is ``split``
plus ``posexplode``; nothing leaves the JVM and nothing shuffles, because
every segment of a message is derived from its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordchecks.functions import hl7 as H
from recordchecks.functions.arrays import occurrences
from recordchecks.functions.gen import explode_kept, inline_kept
from recordchecks.rules.hl7_rules import (EXPECTED_MESSAGE_TYPE, LENIENT_PARSE_ERROR,
                                          STRICT_PARSE_ERROR)


def parse(messages: DataFrame, id_col: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """Messages to ``(msg_id, segs)``, ``segs`` the split segment arrays."""
    return messages.select(F.col(id_col).alias("msg_id"),
                           H.parse_segments(F.col(raw_col)).alias("segs"))


def _with_occurrence(parsed: DataFrame) -> DataFrame:
    """Attach, per segment, its 1-based occurrence among same-named segments,
    computed inside the message row (no window, no shuffle) from one sort of
    the segment names."""
    staged = parsed.select("msg_id", "segs", occurrences(F.transform("segs", H.seg_name)).alias("occ"))
    tagged = F.transform(
        F.arrays_zip("segs", "occ"),
        lambda z, i: F.struct((i + 1).alias("seg_pos"), H.seg_name(z["segs"]).alias("seg_name"),
                              z["occ"].alias("seg_occ"), z["segs"].alias("parts")))
    return explode_kept(staged, ["msg_id"], tagged, "s").select("msg_id", "s.*")


def segments(messages: DataFrame, **kw) -> DataFrame:
    """H1: ``(msg_id, seg_pos, seg_name, seg_occ, n_fields, seg_text)``."""
    s = _with_occurrence(parse(messages, **kw))
    return s.select("msg_id", "seg_pos", "seg_name", "seg_occ",
                    (F.size("parts") - 1).alias("n_fields"),
                    F.array_join("parts", "|").alias("seg_text"))


def fields(messages: DataFrame, **kw) -> DataFrame:
    """H2: one row per field, ``field_no`` positional as in the rules
    (MSH.1 is the separator), with repetition count and first component."""
    s = _with_occurrence(parse(messages, **kw))
    numbered = F.when(
        F.col("seg_name") == "MSH",
        F.concat(F.array(F.struct(F.lit(1).alias("field_no"), F.lit("|").alias("value"))),
                 F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
                             lambda v, i: F.struct((i + 2).alias("field_no"), v.alias("value")))),
    ).otherwise(
        F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
                    lambda v, i: F.struct((i + 1).alias("field_no"), v.alias("value"))))
    out = inline_kept(s, ["msg_id", "seg_pos", "seg_name", "seg_occ"], numbered, "field_no")
    return out.select("*", (F.length("value") - F.length(F.replace("value", F.lit("~"), F.lit(""))) + 1).alias("n_reps"),
                      H.first_component(F.col("value")).alias("first_component"))


def available_fields(messages: DataFrame, **kw) -> DataFrame:
    """H3: fields that hold a non-blank value."""
    return (fields(messages, **kw).where(H.present(F.col("value")))
            .select("msg_id", "seg_pos", "seg_name", "seg_occ", "field_no", "value"))


def field_preview(messages: DataFrame, **kw) -> DataFrame:
    """H4: available fields with a 50-character preview."""
    return available_fields(messages, **kw).select(
        "msg_id", "seg_pos", "seg_name", "field_no", H.preview(F.col("value")).alias("preview"))


def availability(messages: DataFrame, **kw) -> DataFrame:
    """Available field count per segment occurrence.  Counted inside the
    segment array, so it needs no group-by shuffle."""
    s = _with_occurrence(parse(messages, **kw))
    # every part after the name is a field; MSH adds MSH.1, the separator
    body = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    n = F.size(F.filter(body, H.present)) + F.when(F.col("seg_name") == "MSH", 1).otherwise(0)
    return s.select("msg_id", "seg_pos", "seg_name", "seg_occ", n.alias("n_available"))


def message_type(messages: DataFrame, expected: str = EXPECTED_MESSAGE_TYPE, **kw) -> DataFrame:
    """H5: discovered ``MSH.9`` and a warning when it does not contain the
    expected type (D11: the warning is kept)."""
    p = parse(messages, **kw)
    msh = H.first_segment(F.col("segs"), "MSH")
    t = H.field(msh, "MSH", 9)
    found = F.when(H.present(t), t)
    warn = F.when(found.isNotNull() & ~found.contains(expected),
                  F.concat(F.lit(f"Expected message type {expected}, but found "), found))
    return p.select("msg_id", found.alias("message_type"), warn.alias("type_warning"))


def unparseable(messages: DataFrame, **kw) -> DataFrame:
    """H6: messages whose first segment is not MSH, one error each."""
    p = parse(messages, **kw)
    return (p.where(~H.starts_with_msh(F.col("segs")))
            .select("msg_id", F.lit(STRICT_PARSE_ERROR).alias("strict_error"),
                    F.lit(LENIENT_PARSE_ERROR).alias("lenient_error")))
