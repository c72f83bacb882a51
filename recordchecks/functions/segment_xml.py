"""Segments of HL7 text as XML elements and back, by Arrow kernels.

A field costs a few compiled passes over a batch instead of an interpreted
expression of its own.  Batches are cut by bytes, so that a task holds the
parts of a few megabytes of text at a time, whatever the messages' lengths.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

# executors need not hold this package: its functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 4 << 20
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
TAG = re.compile(r"([A-Z][A-Z0-9]{2})(?:\.([0-9]+))?")


def _by_bytes(texts: pa.Array, use: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``use`` of all texts, at most ``BATCH_BYTES`` or one text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, start = [], 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BATCH_BYTES, "right")))
        out.append(use(texts.slice(start, stop - start)))
        start = stop
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _joined(pieces: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """The pieces of each of ``n`` groups as one text; ``group`` ascends."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pieces), "")


def _repeated(numbers: np.ndarray, text: Callable[[int], str]) -> pa.Array:
    """``text`` of each number, made once for equal ones."""
    distinct, which = np.unique(numbers, return_inverse=True)
    return pa.array([text(int(n)) for n in distinct], pa.string()).take(pa.array(which))


def _replaced(texts: pa.Array, pairs) -> pa.Array:
    for old, new in pairs:
        texts = pc.replace_substring(texts, old, new)
    return texts


def _concat(*texts) -> pa.Array:
    return pc.binary_join_element_wise(*texts, "")


def elements(lines: pa.Array) -> pa.Array:
    """The element of each segment line: non-empty fields only, text escaped;
    MSH.1 is the separator."""
    name = pc.list_element(pc.split_pattern(lines, "|", max_splits=1), 0)
    msh = pc.equal(name, "MSH")
    parts = pc.split_pattern(_replaced(lines, ENTITIES), "|")
    line = pc.list_parent_indices(parts).to_numpy()
    number = np.arange(len(line)) - np.searchsorted(line, np.arange(len(lines)))[line]
    values = parts.flatten()
    held = (number > 0) & pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    line, number, values = line[held], number[held], values.filter(pa.array(held))
    number = number + msh.to_numpy(zero_copy_only=False)[line]
    tag = _concat(name.take(pa.array(line)), _repeated(number, lambda n: f".{n}>"))
    fields = _joined(_concat("<", tag, values, "</", tag), line, len(lines))
    return _concat("<", name, pc.if_else(msh, "><MSH.1>|</MSH.1>", ">"), fields, "</", name, ">")


def raws(xml: pa.Array) -> pa.Array:
    """The message of each XML text, null of null.

    A segment is opened by an element named as one, and a field stands at its
    number whatever the order of the elements; other elements are passed over."""
    tokens = pc.split_pattern(xml, "<")
    message = pc.list_parent_indices(tokens).to_numpy()
    cut = pc.split_pattern(tokens.flatten(), ">", max_splits=1)
    whole = pc.equal(pc.list_value_length(cut), 2)
    cut, message = cut.filter(whole), message[whole.to_numpy(zero_copy_only=False)]
    tag, value = pc.list_element(cut, 0).dictionary_encode(), pc.list_element(cut, 1)

    # tags are read once each: -1 is no segment's, 0 opens one, others are field numbers
    read = [TAG.fullmatch(t) for t in tag.dictionary.to_pylist()]
    number = np.array([-1 if not m or m[2] and int(m[2]) == 0 else int(m[2] or 0) for m in read], np.int64)
    is_msh = np.array([bool(m) and m[0] == "MSH" for m in read], bool)
    ends = [t.startswith("/") and TAG.fullmatch(t[1:]) for t in tag.dictionary.to_pylist()]
    closing = np.array([bool(m) and not m[2] for m in ends], bool)
    which = tag.indices.to_numpy()
    number = number[which]
    opens = number == 0
    # a segment is known by the place of its tag; outside of one, that of the last end or -1
    segment = np.maximum.accumulate(np.where(opens | closing[which], np.arange(len(which)), -1))
    of_msh = is_msh[which]
    at = np.flatnonzero((number >= 0) & (segment >= 0))
    at = at[opens[segment[at]] & (message[segment[at]] == message[at]) & ~(of_msh[segment[at]] & (number[at] == 1))]
    if np.any((np.diff(segment[at]) == 0) & (np.diff(number[at]) <= 0)):
        at = at[np.lexsort((number[at], segment[at]))]
        if np.any((np.diff(segment[at]) == 0) & (np.diff(number[at]) == 0)):
            raise ValueError("a field stands twice in one segment")
    message, number, opens = message[at], number[at], opens[at]

    # a segment starts a line, a field follows as many separators as its number is higher;
    # MSH.1 is itself the first separator
    from_number = np.where(opens, of_msh[segment[at]], number)
    bars = np.where(opens, -1, number - np.concatenate(([0], from_number[:-1])))
    bars[np.concatenate(([True], np.diff(message) != 0))[:len(bars)]] = 0
    before = _repeated(bars, lambda n: "\r" if n < 0 else "|" * n)
    body = pc.if_else(pa.array(opens), tag.dictionary.take(tag.indices.take(pa.array(at))), value.take(pa.array(at)))
    raw = _replaced(_joined(_concat(before, body), message, len(xml)), [(new, old) for old, new in reversed(ENTITIES)])
    return pc.if_else(pc.is_null(xml), pa.scalar(None, pa.string()), raw)


def _elements(lines: pa.Array) -> pa.Array:
    counts = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _by_bytes(lines.flatten(), elements))


def _raws(xml: pa.Array) -> pa.Array:
    return _by_bytes(xml, raws)


def _mapped(df: DataFrame, source: str, use: Callable[[pa.Array], pa.Array], name: str, kind: DataType) -> DataFrame:
    """``df`` with ``use`` of one column as another.  A step of its own in the
    plan: Spark does not take apart a Python function of another one's value
    with an array expression between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, use(b.column(source))], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema, StructField(name, kind)]))


def with_elements(messages: DataFrame) -> DataFrame:
    """``segs``, the elements of the message's ``lines``."""
    return _mapped(messages, "lines", _elements, "segs", ArrayType(StringType()))


def with_raw(messages: DataFrame) -> DataFrame:
    """``raw``, the message that the text ``xml`` holds."""
    return _mapped(messages, "xml", _raws, "raw", StringType())
