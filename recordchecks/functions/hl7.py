"""Column helpers for HL7 v2 text: parsing to arrays, positional field access.

A message is one row.  ``segs`` is ``array<array<string>>``: one inner array
per non-blank segment line, split on ``|``.  Rules are positional: in MSH,
field 1 is the separator itself so ``MSH.n`` is ``parts[n-1]``; in every other
segment ``SEG.n`` is ``parts[n]`` (0-based).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordchecks.rules.hl7_rules import ENVELOPE_SEGMENTS


def segment_lines(raw: Column) -> Column:
    """Non-blank lines of a message (``\\r``, ``\\n`` and ``\\r\\n`` all end
    a segment).  Cut at one plain character: a pattern of line ends would be
    compiled and searched anew for each message, and of ``\\r\\n`` only a
    blank line is left, which is dropped like any other."""
    return F.filter(F.split(F.replace(raw, F.lit("\n"), F.lit("\r")), "\r", -1), lambda s: F.trim(s) != F.lit(""))


def parse_segments(raw: Column) -> Column:
    """H1+H2: message text to ``array<array<string>>`` (lines as in
    ``segment_lines``).  NULL text gives []."""
    return F.transform(segment_lines(F.coalesce(raw, F.lit(""))), line_fields)


def line_fields(line: Column) -> Column:
    """The parts of a segment line, its name first."""
    return F.split(line, r"\|", -1)


def line_name(line: Column) -> Column:
    """``seg_name`` of a line that is not split."""
    return F.substring_index(line, "|", 1)


def seg_name(a: Column) -> Column:
    return F.get(a, 0)


def field(a: Column, seg: str, n: int) -> Column:
    """Field ``SEG.n`` of segment array ``a`` (NULL when past the end)."""
    if seg == "MSH":
        return F.when(a.isNotNull(), F.lit("|")) if n == 1 else F.get(a, n - 1)
    return F.get(a, n)


def blank(v: Column) -> Column:
    """Absent, NULL or only whitespace: one state for HL7."""
    return F.coalesce(F.trim(v), F.lit("")) == F.lit("")


def present(v: Column) -> Column:
    return ~blank(v)


def first_segment(segs: Column, name: str) -> Column:
    """First occurrence of segment ``name`` (NULL when there is none)."""
    return F.get(F.filter(segs, lambda a: seg_name(a) == F.lit(name)), 0)


def segments_named(segs: Column, name: str) -> Column:
    return F.filter(segs, lambda a: seg_name(a) == F.lit(name))


def first_component(v: Column) -> Column:
    """First component of the first repetition."""
    return F.substring_index(F.substring_index(v, "~", 1), "^", 1)


def preview(v: Column, n: int = 50) -> Column:
    """First ``n`` characters and ``...`` when longer."""
    return F.when(F.length(v) > n, F.concat(F.left(v, F.lit(n)), F.lit("..."))).otherwise(v)


def valid_yyyymmdd(v: Column) -> Column:
    """First 8 characters form a calendar date ``yyyyMMdd``."""
    return F.try_to_timestamp(F.substring(v, 1, 8), F.lit("yyyyMMdd")).isNotNull()


def escape_value(v: Column) -> Column:
    """Escape the HL7 delimiters inside a value (``\\`` first)."""
    out = F.replace(v.cast("string"), F.lit("\\"), F.lit("\\E\\"))
    for ch, esc in (("|", "\\F\\"), ("^", "\\S\\"), ("~", "\\R\\"), ("&", "\\T\\")):
        out = F.replace(out, F.lit(ch), F.lit(esc))
    return out


def starts_with_msh(segs: Column) -> Column:
    """H6: the first segment, batch envelope (FHS/BHS) skipped, is MSH."""
    names = F.filter(F.transform(segs, seg_name), lambda n: ~n.isin(*ENVELOPE_SEGMENTS))
    return F.coalesce(F.get(names, 0) == F.lit("MSH"), F.lit(False))


def unescape_value(v: Column) -> Column:
    """Inverse of ``escape_value`` in one left-to-right pass: the text is
    cut into escape sequences ``\\X\\`` and plain runs, and each sequence is
    mapped back (``F | S ^ R ~ T & E \\``).  Replacing sequence by
    sequence would be wrong: ``\\E\\F\\E\\`` contains ``\\F\\``."""
    tokens = F.regexp_extract_all(v, F.lit(r"(\\[FSRTE]\\|[^\\]+|\\)"), 1)
    back = {"\\F\\": "|", "\\S\\": "^", "\\R\\": "~", "\\T\\": "&", "\\E\\": "\\"}
    def one(t):
        out = t
        for esc, ch in back.items():
            out = F.when(t == F.lit(esc), F.lit(ch)).otherwise(out)
        return out
    return F.when(v.isNotNull(), F.array_join(F.transform(tokens, one), ""))
