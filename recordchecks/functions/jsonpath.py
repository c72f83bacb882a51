"""Rule paths (``A.B[0].C``, ``A[*].B``) to Variant paths, and look-ups.

Keys may hold spaces, ``-`` and ``/``; every step is emitted quoted
(``$["Actual Therapy"][0]["Cycle Type"]``).  A wildcard splits the path into
an array prefix and a per-element rest (V2)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\[([^\]]*)\]|([^.\[\]]+)")


def steps(path: str) -> list[str | int]:
    """``A.B[0].C`` -> ``['A', 'B', 0, 'C']``; ``[*]`` -> ``'*'`` marker kept
    as the string ``'[*]'``; a negative index is kept (it finds nothing, D29)."""
    out: list[str | int] = []
    for idx, key in _TOKEN.findall(path):
        if key:
            out.append(key)
        elif idx.strip() == "*":
            out.append("[*]")
        else:
            try:
                out.append(int(idx))
            except ValueError as e:
                raise ValueError(f"Invalid array index: {idx}") from e
    return out


def variant_path(st: list[str | int]) -> str:
    parts = ["$"]
    for s in st:
        if isinstance(s, int):
            parts.append(f"[{s}]")
        else:
            parts.append('["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]')
    return "".join(parts)


def lookup(v: Column, st: list[str | int]) -> Column:
    """Value at a wildcard-free path as Variant; NULL when any step is
    missing, of the wrong kind, or a negative index."""
    if any(isinstance(s, int) and s < 0 for s in st):
        return F.lit(None).cast("variant")
    return F.try_variant_get(v, variant_path(st), "variant")


def targets(v: Column, path: str) -> Column:
    """``array<struct<field_path string, value variant>>``: one entry for a
    plain path, one per array element (path shown with its index) for a
    wildcard path.  Nested wildcards flatten depth first (D19)."""
    st = steps(path)
    return _targets(v, st, [])


def _fmt(prefix: list) -> str:
    s = ""
    for p in prefix:
        if isinstance(p, int):
            s += f"[{p}]"
        else:
            s += ("." if s else "") + p
    return s


def _targets(v: Column, st: list, done: list) -> Column:
    if "[*]" not in st:
        return F.array(F.struct(F.lit(_fmt(done + st)).alias("field_path"),
                                lookup(v, st).alias("value")))
    k = st.index("[*]")
    head, rest = st[:k], st[k + 1:]
    arr = F.try_variant_get(v, variant_path(head), "array<variant>")
    base = _fmt(done + head)
    # not an array (or absent): one target holding NULL, path as written
    missing = F.array(F.struct(F.lit(_fmt(done + st).replace(".[*]", "[*]")).alias("field_path"),
                               F.lit(None).cast("variant").alias("value")))
    return F.when(arr.isNull(), missing).otherwise(_each(arr, base, rest))


def _each(arr: Column, base: str, rest: list) -> Column:
    if "[*]" not in rest:
        rest_path = _fmt(rest)
        return F.transform(arr, lambda e, i: F.struct(
            F.concat(F.lit(base + "["), i.cast("string"),
                     F.lit("]" + ("." + rest_path if rest_path else ""))).alias("field_path"),
            (lookup(e, rest) if rest else e).alias("value")))
    # nested wildcard: recurse per element and flatten
    return F.flatten(F.transform(arr, lambda e, i: F.transform(
        _targets(e, rest, []), lambda t: F.struct(
            F.concat(F.lit(base + "["), i.cast("string"), F.lit("]."), t["field_path"]).alias("field_path"),
            t["value"].alias("value")))))


def targets_path(path: str) -> str:
    """The field path a plain (wildcard-free) rule reports: its steps
    re-joined, as ``targets`` shows it."""
    return _fmt(steps(path))
