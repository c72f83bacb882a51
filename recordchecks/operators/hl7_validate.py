"""HL7 v2 ORU^R01 validation, strict and lenient profiles.

Every rule is an expression over the parsed message row; all findings of a
message are built in one projection as ``array<struct>`` and exploded once
(U3: one scan, no union of per-check scans).  The verdict (A10) sums the same
conditions without building the findings.  Validation needs no shuffle at all:
it scales with the number of messages, and a message is bounded by its own size.

Finding: ``(check_no, occ, severity, code, location, message)``; ``check_no``
orders the checks the way the rules list them, ``occ`` is the OBX index (or
the PID.3 repetition) for repeated checks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordchecks.functions import hl7 as H
from recordchecks.functions.gen import inline_kept
from recordchecks.rules import hl7_rules as R

PROFILES = ("strict", "lenient")


def _finding(check_no: int, severity: str, code: str, location, message, occ=None) -> Column:
    loc = F.lit(location) if isinstance(location, str) else location
    msg = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(check_no).alias("check_no"),
                    (occ if occ is not None else F.lit(0)).cast("int").alias("occ"),
                    F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                    loc.cast("string").alias("location"), msg.cast("string").alias("message"))


class _Checks:
    """Accumulates ``when(cond, finding)`` entries in rule order; with
    ``codes``, of these codes only, and of a code that has ``places``, at those
    only (the numbers stay)."""

    def __init__(self, codes: Sequence[str] | None = None, places: Mapping[str, Sequence[str]] | None = None):
        self.parts: list[Column] = []
        self.n, self.codes, self.places = 0, codes, places or {}

    def wanted(self, code: str, location: str | None = None) -> bool:
        return (self.codes is None or code in self.codes) and (code not in self.places or location in self.places[code])

    def add(self, cond: Column, severity, code, location, message):
        self.n += 1
        if self.wanted(code, location):
            self.parts.append(F.array(F.when(cond, _finding(self.n, severity, code, location, message))))

    def repeats(self, bad: Column, severity, code, location, message):
        """One finding for each element of the array ``bad``."""
        self.n += 1
        no = self.n
        if self.wanted(code):
            self.parts.append(F.transform(bad, lambda r, i: _finding(no, severity, code, location, message, occ=i + 1)))

    def obx_group(self, obx: Column, specs) -> None:
        """All per-OBX checks in one pass over the OBX list: ``specs`` is a
        list of ``(cond_fn, severity, code, field_no, msg_fn)``; each keeps
        its own check number."""
        numbered = [(self.n + i, *sp) for i, sp in enumerate(specs, 1) if self.wanted(sp[2])]
        self.n += len(specs)
        if numbered:
            self.parts.append(F.flatten(F.transform(obx, lambda o, i: F.array(*[
                F.when(cond(o), _finding(no, sev, code, _obx_loc(i, n), msg(o, i), occ=i + 1))
                for no, cond, sev, code, n, msg in numbered]))))

    def column(self) -> Column:
        none = F.array().cast("array<struct<check_no:int,occ:int,severity:string,code:string,location:string,message:string>>")
        return F.array_compact(F.concat(*self.parts)) if self.parts else none


class _Counts(_Checks):
    """Counts findings by severity without building them."""

    def __init__(self):
        super().__init__()
        self.sums: dict[str, list[Column]] = {"error": [F.lit(0)], "warning": [F.lit(0)]}

    def add(self, cond: Column, severity, code, location, message):
        self.sums[severity].append(_one_if(cond))

    def repeats(self, bad: Column, severity, code, location, message):
        self.sums[severity].append(F.size(bad))

    def obx_group(self, obx: Column, specs) -> None:
        for severity in {sp[1] for sp in specs}:
            conds = [sp[0] for sp in specs if sp[1] == severity]
            self.sums[severity].append(F.aggregate(obx, F.lit(0), lambda a, o: reduce(
                add, [_one_if(cond(o)) for cond in conds], a)))  # noqa: B023

    def column(self) -> Column:
        return F.struct(*[reduce(add, cols).alias(k) for k, cols in self.sums.items()])


def _one_if(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _ts_checks(ck: _Checks, v: Column, loc: str, strict: bool):
    fmt_ok = v.rlike(R.TIMESTAMP_PATTERN)
    date_bad = (F.length(v) >= 8) & ~H.valid_yyyymmdd(v)
    ck.add(H.present(v) & ~fmt_ok, "warning", "ts_format", loc,
           F.concat(F.lit(f"{loc} timestamp format may be invalid: "), v))
    cond = H.present(v) & date_bad if strict else H.present(v) & fmt_ok & date_bad
    ck.add(cond, "warning", "ts_date", loc,
           F.concat(F.lit(f"{loc} contains invalid date: "), v))


def _code_set(ck: _Checks, v: Column, loc: str, values, text: str, guard: Column | None = None):
    cond = H.present(v) & ~v.isin(*values)
    if guard is not None:
        cond = guard & cond
    ck.add(cond, "warning", "code_set", loc,
           F.concat(F.lit(f"{loc} {text} '"), v, F.lit(f"' not in standard values {R.pylist(values)}")))


def _obx_loc(i: Column, n) -> Column:
    return F.concat(F.lit("OBX["), (i + 1).cast("string"), F.lit(f"].{n}"))


def _context(segs: Column) -> dict[str, Column]:
    names = F.transform(segs, H.seg_name)
    ctx = {"names": names, "obx": H.segments_named(segs, "OBX")}
    for s in ("MSH", "PID", "PV1", "ORC", "OBR"):
        ctx[s] = H.first_segment(segs, s)
    ctx["parsed"] = H.starts_with_msh(segs)
    return ctx


def _has(c: dict, s: str) -> Column:
    return F.array_contains(c["names"], F.lit(s))


def strict_findings(c: dict[str, Column], ck: _Checks | None = None) -> Column:
    ck = ck or _Checks()
    f = H.field
    msh, pid, pv1, orc, obr, obx = c["MSH"], c["PID"], c["PV1"], c["ORC"], c["OBR"], c["obx"]
    # structure (L1)
    for s in R.STRICT_REQUIRED_SEGMENTS:
        ck.add(~_has(c, s), "error", "segment_missing", s, f"Required segment {s} is missing")
    ck.add(F.size(obx) == 0, "error", "no_obx", "OBX",
           "At least one OBX segment is required for ORU_R01")
    # MSH (L3, L8, L9, L11)
    for n, desc in R.MSH_REQUIRED:
        ck.add(H.blank(f(msh, "MSH", n)), "error", "required", f"MSH.{n}",
               f"MSH.{n} ({desc}) is required")
    t = f(msh, "MSH", 9)
    ck.add(H.present(t) & (t != F.lit(R.EXPECTED_MESSAGE_TYPE)), "warning", "msg_type", "MSH.9",
           F.concat(F.lit(f"Expected message type {R.EXPECTED_MESSAGE_TYPE}, found "), t))
    ver = f(msh, "MSH", 12)
    ck.add(H.present(ver) & ~ver.isin(*R.STRICT_VERSIONS), "warning", "version", "MSH.12",
           F.concat(F.lit("Unsupported HL7 version: "), ver))
    _ts_checks(ck, f(msh, "MSH", 7), "MSH.7", strict=True)
    # PID (L4, L5, L10, L11)
    has_pid = _has(c, "PID")
    for n, desc in R.PID_REQUIRED:
        ck.add(has_pid & H.blank(f(pid, "PID", n)), "error", "required", f"PID.{n}",
               f"PID.{n} ({desc}) is required")
    pid3 = f(pid, "PID", 3)
    guard = has_pid & H.present(pid3)
    ck.repeats(F.filter(F.split(F.coalesce(pid3, F.lit("")), "~", -1),
                        lambda r: guard & H.blank(F.get(F.split(r, r"\^", -1), 0))),
               "error", "pid3_id", "PID.3", "PID.3 patient identifier value is required")
    _ts_checks(ck, F.when(has_pid, f(pid, "PID", 7)), "PID.7", strict=True)
    _code_set(ck, f(pid, "PID", 8), "PID.8", R.SEX_CODES, "sex code", has_pid)
    # PV1
    has_pv1 = _has(c, "PV1")
    for n, desc in R.PV1_REQUIRED:
        ck.add(has_pv1 & H.blank(f(pv1, "PV1", n)), "error", "required", f"PV1.{n}",
               f"PV1.{n} ({desc}) is required")
    _code_set(ck, f(pv1, "PV1", 2), "PV1.2", R.PATIENT_CLASSES, "patient class", has_pv1)
    # ORC, OBR
    _code_set(ck, f(orc, "ORC", 1), "ORC.1", R.ORDER_CONTROLS, "order control", _has(c, "ORC"))
    has_obr = _has(c, "OBR")
    for n, desc in R.OBR_REQUIRED:
        ck.add(has_obr & H.blank(f(obr, "OBR", n)), "error", "required", f"OBR.{n}",
               f"OBR.{n} ({desc}) is required")
    _code_set(ck, f(obr, "OBR", 25), "OBR.25", R.RESULT_STATUSES, "result status", has_obr)
    _ts_checks(ck, F.when(has_obr, f(obr, "OBR", 7)), "OBR.7", strict=True)
    _code_set(ck, f(obr, "OBR", 5), "OBR.5", R.PRIORITIES, "priority", has_obr)
    # OBX, per occurrence (L4, L10, L12, L13), one pass over the OBX list
    specs = []
    for n, desc in R.OBX_REQUIRED:
        specs.append((lambda o, n=n: H.blank(f(o, "OBX", n)), "error", "required", n,
                      lambda o, i, n=n, desc=desc: F.concat(_obx_loc(i, n), F.lit(f" ({desc}) is required"))))
    for n, values, text in ((2, R.STRICT_VALUE_TYPES, "value type"), (11, R.OBX_STATUSES, "result status")):
        specs.append((lambda o, n=n, values=values: H.present(f(o, "OBX", n)) & ~f(o, "OBX", n).isin(*values),
                      "warning", "code_set", n,
                      lambda o, i, n=n, values=values, text=text: F.concat(
                          _obx_loc(i, n), F.lit(f" {text} '"), f(o, "OBX", n),
                          F.lit(f"' not in standard values {R.pylist(values)}"))))
    specs.append((lambda o: H.present(f(o, "OBX", 6)) & ~f(o, "OBX", 6).rlike(R.STRICT_UNITS_PATTERN),
                   "warning", "units", 6,
                   lambda o, i: F.concat(_obx_loc(i, 6), F.lit(" units format may be invalid: "), f(o, "OBX", 6))))
    specs.append((lambda o: H.present(f(o, "OBX", 7)) & ~f(o, "OBX", 7).rlike(R.RANGE_PATTERNS[0])
                   & ~f(o, "OBX", 7).rlike(R.RANGE_PATTERNS[1]), "warning", "ref_range", 7,
                   lambda o, i: F.concat(_obx_loc(i, 7), F.lit(" reference range format may be invalid: "),
                                         f(o, "OBX", 7))))
    specs.append((lambda o: H.present(f(o, "OBX", 3)) & ~f(o, "OBX", 3).contains("^"),
                   "warning", "obx3_component", 3,
                   lambda o, i: F.concat(F.lit("OBX observation identifier should use component separator: "),
                                         f(o, "OBX", 3))))
    ck.obx_group(obx, specs)
    # cross-field
    both = _has(c, "ORC") & has_obr
    for n, what in ((2, "placer"), (3, "filler")):
        a, b = f(orc, "ORC", n), f(obr, "OBR", n)
        ck.add(both & H.present(a) & H.present(b) & (a != b), "warning", "order_mismatch",
               f"ORC.{n}", f"ORC.{n} and OBR.{n} {what} order numbers should match")
    return ck.column()


def lenient_findings(c: dict[str, Column], ck: _Checks | None = None) -> Column:
    ck = ck or _Checks()
    f = H.field
    msh, pid, pv1, orc, obr, obx = c["MSH"], c["PID"], c["PV1"], c["ORC"], c["OBR"], c["obx"]
    for s in R.LENIENT_REQUIRED_SEGMENTS:
        ck.add(~_has(c, s), "error", "segment_missing", s, f"Required segment {s} is missing")
    for s in R.LENIENT_EXPECTED_SEGMENTS:
        ck.add(~_has(c, s), "warning", "segment_expected", s, f"Expected segment {s} is missing")
    ck.add(F.size(obx) == 0, "error", "no_obx", "OBX",
           "At least one OBX segment is required for ORU_R01")
    for n in R.LENIENT_MSH_RECOMMENDED:
        ck.add(H.blank(f(msh, "MSH", n)), "warning", "recommended", f"MSH.{n}",
               f"MSH.{n} is missing but recommended")
    t = f(msh, "MSH", 9)
    ck.add(H.present(t) & ~t.contains(R.EXPECTED_MESSAGE_TYPE), "warning", "msg_type", "MSH.9",
           F.concat(F.lit(f"MSH.9 should be '{R.EXPECTED_MESSAGE_TYPE}', found: "), t))
    ver = f(msh, "MSH", 12)
    ck.add(H.present(ver) & ~ver.isin(*R.LENIENT_VERSIONS), "warning", "version", "MSH.12",
           F.concat(F.lit("Unsupported HL7 version: "), ver))
    _ts_checks(ck, f(msh, "MSH", 7), "MSH.7", strict=False)
    has_pid = _has(c, "PID")
    for n in R.LENIENT_PID_RECOMMENDED:
        ck.add(has_pid & H.blank(f(pid, "PID", n)), "warning", "recommended", f"PID.{n}",
               f"PID.{n} is missing but recommended for patient identification")
    _ts_checks(ck, F.when(has_pid, f(pid, "PID", 7)), "PID.7", strict=False)
    _code_set(ck, f(pid, "PID", 8), "PID.8", R.SEX_CODES, "sex code", has_pid)
    _code_set(ck, f(pv1, "PV1", 2), "PV1.2", R.PATIENT_CLASSES, "patient class", _has(c, "PV1"))
    _code_set(ck, f(orc, "ORC", 1), "ORC.1", R.ORDER_CONTROLS, "order control", _has(c, "ORC"))
    has_obr = _has(c, "OBR")
    for n in R.LENIENT_OBR_CRITICAL:
        ck.add(has_obr & H.blank(f(obr, "OBR", n)), "error", "critical", f"OBR.{n}",
               f"OBR.{n} is required for ORU_R01 messages")
    _code_set(ck, f(obr, "OBR", 25), "OBR.25", R.RESULT_STATUSES, "result status", has_obr)
    _ts_checks(ck, F.when(has_obr, f(obr, "OBR", 7)), "OBR.7", strict=False)
    specs = []
    for n in R.LENIENT_OBX_CRITICAL:
        specs.append((lambda o, n=n: H.blank(f(o, "OBX", n)), "error", "critical", n,
                      lambda o, i, n=n: F.concat(_obx_loc(i, n), F.lit(" is required for observation data"))))
    for n, values, text in ((2, R.LENIENT_VALUE_TYPES, "value type"), (11, R.OBX_STATUSES, "result status")):
        specs.append((lambda o, n=n, values=values: H.present(f(o, "OBX", n)) & ~f(o, "OBX", n).isin(*values),
                      "warning", "code_set", n,
                      lambda o, i, n=n, values=values, text=text: F.concat(
                          _obx_loc(i, n), F.lit(f" {text} '"), f(o, "OBX", n),
                          F.lit(f"' not in standard values {R.pylist(values)}"))))
    specs.append((lambda o: H.present(f(o, "OBX", 6)) & ~f(o, "OBX", 6).rlike(R.LENIENT_UNITS_PATTERN),
                   "warning", "units", 6,
                   lambda o, i: F.concat(_obx_loc(i, 6), F.lit(" units format may be invalid: "), f(o, "OBX", 6))))
    ck.obx_group(obx, specs)
    a, b = f(orc, "ORC", 2), f(obr, "OBR", 2)
    ck.add(_has(c, "ORC") & has_obr & H.present(a) & H.present(b) & (a != b), "warning",
           "order_mismatch", "ORC.2", "ORC.2 and OBR.2 placer order numbers should match")
    return ck.column()


_BUILDERS = {"strict": (strict_findings, R.STRICT_PARSE_ERROR), "lenient": (lenient_findings, R.LENIENT_PARSE_ERROR)}


def _staged(messages: DataFrame, id_col: str, raw_col: str) -> tuple[DataFrame, dict[str, Column]]:
    """The message parsed once and its context (segment names, first
    MSH/PID/PV1/ORC/OBR, the OBX list) staged once; every rule then reads
    columns instead of searching the segment array again."""
    from recordchecks.operators.hl7_parse import parse
    ctx = _context(F.col("segs"))
    staged = parse(messages, id_col=id_col, raw_col=raw_col).select("msg_id", *[v.alias(f"c_{k}") for k, v in ctx.items()])
    return staged, {k: F.col(f"c_{k}") for k in ctx}


def validated(messages: DataFrame, profiles=PROFILES, codes: Sequence[str] | None = None, id_col="msg_id",
              raw_col="raw") -> DataFrame:
    """``(msg_id, f_<profile> array<struct>...)``: every profile's findings, or
    those of ``codes``, built on the same row.  A message that does not start
    with MSH gets one error, no checks (H6)."""
    staged, c = _staged(messages, id_col, raw_col)

    def of(profile: str) -> Column:
        build, parse_error = _BUILDERS[profile]
        bad = _Checks(codes)
        bad.n = -1  # the parse error is check 0
        bad.add(F.lit(True), "error", "parse", "MSH", parse_error)
        return F.when(c["parsed"], build(c, _Checks(codes))).otherwise(bad.column())
    return staged.select("msg_id", *[of(pr).alias(f"f_{pr}") for pr in profiles])


def findings(messages: DataFrame, profiles=PROFILES, codes: Sequence[str] | None = None, **kw) -> DataFrame:
    """Findings of all profiles, one row each."""
    v = validated(messages, profiles, codes, **kw)
    per = F.array(*[F.struct(F.lit(pr).alias("profile"), F.col(f"f_{pr}").alias("fs"))
                    for pr in profiles])
    return inline_kept(inline_kept(v, ["msg_id"], per, "profile"), ["msg_id", "profile"], "fs",
                       "check_no")


def verdict(messages: DataFrame, profiles=PROFILES, id_col="msg_id", raw_col="raw") -> DataFrame:
    """A10: per message and profile: valid iff no error; counts.  The rules'
    conditions are summed on the row; no finding or text is built, and clean
    messages appear without a join."""
    staged, c = _staged(messages, id_col, raw_col)
    bad = F.struct(F.lit(1).alias("error"), F.lit(0).alias("warning"))
    counted = staged.select("msg_id", *[F.when(c["parsed"], _BUILDERS[pr][0](c, _Counts())).otherwise(bad).alias(f"n_{pr}")
                                        for pr in profiles])
    per = F.array(*[F.struct(F.lit(pr).alias("profile"), F.col(f"n_{pr}.error").alias("error_count"),
                             F.col(f"n_{pr}.warning").alias("warning_count")) for pr in profiles])
    out = inline_kept(counted, ["msg_id"], per, "profile")
    return out.select("msg_id", "profile", (F.col("error_count") == 0).alias("is_valid"),
                      F.col("error_count").cast("bigint").alias("error_count"),
                      F.col("warning_count").cast("bigint").alias("warning_count"))


def findings_of(messages: DataFrame, group: str, profiles=PROFILES, **kw) -> DataFrame:
    """Findings of one rule group (the L operator keys); only its checks are compiled."""
    return findings(messages, profiles, R.CODE_GROUPS[group], **kw)
