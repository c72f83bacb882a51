"""OBR and OBX rows of device records, by plain loops over Arrow batches.

A record costs one pass over its text instead of an interpreted expression a node
and level.  What counts as JSON and how a number reads is Spark's to say:
``record_text`` gives only records that it parses, and those with numbers or texts
that another reader could see otherwise as Spark writes them.  Batches are cut by
bytes: a task holds the rows of a few megabytes of text at a time.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# executors need not hold this package: its functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 4 << 20
# keys and look-ups remembered by a task; more are forgotten and found again
MAX_KNOWN = 100_000
ROW = "sec_seq int, item int, obr_set_id int, obx_set_id int, seg_name string, identifier string, value string, segment string"
# exponents, and numbers of more digits than a decimal holds
ODD = r"[0-9](?:[eE][-+0-9]|[0-9.]{38})"
AS_WRITTEN = "="
_KEY = str.maketrans(" -", "__")
_DELIMITERS = "\\|^~&"
_ESCAPED = str.maketrans({"\\": "\\E\\", "|": "\\F\\", "^": "\\S\\", "~": "\\R\\", "&": "\\T\\"})
Found = tuple[int, int, str, int]  # item, rank of the entry, value, number of the entry


def record_text(json_text: Column, v: Column) -> Column:
    """A record as ``Rows`` reads it: its own text, that of the parsed record ``v`` behind a
    mark where the two could read differently, NULL where it is not JSON."""
    odd = json_text.rlike(ODD) | json_text.contains("\\ud") | json_text.contains("\\uD")  # surrogates
    own = F.when(odd, F.concat(F.lit(AS_WRITTEN), F.to_json(v))).otherwise(F.make_valid_utf8(json_text))
    return F.when(v.isNotNull(), own)


def _integer(text: str) -> str:
    """A number as Spark writes it."""
    return "0" if text == "-0" else text


def _decimal(text: str) -> str:
    """A number with a point as Spark writes it."""
    return _integer(text.rstrip("0").rstrip("."))


def _reader() -> Callable[[str], object]:
    """Reads a record; a scalar's value is the text that Spark has for it."""
    own = json.JSONDecoder(parse_int=_integer, parse_float=_decimal).raw_decode
    as_written = json.JSONDecoder(parse_int=str, parse_float=str).decode

    def read(text: str):
        # what follows the first value is not part of the record
        return as_written(text[1:]) if text.startswith(AS_WRITTEN) else own(text.lstrip(" \t\r\n"))[0]

    return read


class _Known(dict):
    """``make`` of each key, remembered."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MAX_KNOWN:
            self.clear()
        made = self[key] = self.make(key)
        return made


class Rows:
    """A mapping, compiled: ``lookup`` is look-up key to entries (dicts), ``sections`` the
    OBR sections in order."""

    def __init__(self, lookup: dict[str, list[dict]], sections: list[dict], obs_ts: str):
        self.sections, self.obs_ts = sections, obs_ts
        self.entries = [e for es in lookup.values() for e in es]
        number = iter(range(len(self.entries)))
        # entries that compare equal have one rank: their values decide
        order = [tuple((x is not None, x or type_()) for x, type_ in (
            (e["sequence"], int), (e["attr"], str), (e["identifier"], str), (e["display_name"], str), (e["data_type"], str), (e["unit"], str)))
            for e in self.entries]
        ranks = {key: i for i, key in enumerate(sorted(set(order)))}
        self.lookup = {k: [(e["section"], ranks[order[n]], n) for e in es for n in (next(number),)] for k, es in lookup.items()}
        self.parts = [None if e["identifier"] is None or e["display_name"] is None else
                      (f"|{e['data_type']}|{e['identifier']}^{e['display_name']}|", f"|{e['unit']}|||||F") for e in self.entries]
        self.heads = [None if s["identifier"] is None or s["display_name"] is None else
                      f"|||{s['identifier']}^{s['display_name']}|||{obs_ts}" for s in sections]

    def _hidden(self, found: dict[str, list[Found]]) -> None:
        """First found wins: a value from the root hides those under the section."""
        for name, values in found.items():
            root = {self.entries[n]["attr"] for item, _, _, n in values if item < 0 and self.entries[n]["prio"] == 1}
            found[name] = [f for f in values if f[0] >= 0 or self.entries[f[3]]["prio"] == 1 or self.entries[f[3]]["attr"] not in root]

    def known(self) -> tuple[Callable, _Known, _Known]:
        """What a task makes once: the reader; for path and key the path below, the normalised
        key and its entries; for top key and key of a list's item its entries."""
        def below(of: tuple):
            path, key = of
            name = key.translate(_KEY).upper()
            here = f"{path}.{name}" if path != "" else name
            return here, name, self.lookup.get(here, ())

        def of_item(of: tuple):
            top, key = of
            name = key.translate(_KEY).upper()
            return name, self.lookup.get(f"{name if top is None else top}|{name}", ())

        return _reader(), _Known(below), _Known(of_item)

    def found(self, text: str, known: tuple) -> dict[str, list[Found]]:
        """Mapped values of a record by section."""
        read, below, of_item = known
        found = defaultdict(list)

        def take(entries, item: int, x) -> None:
            if x is not None:
                value = x if type(x) is str else "true" if x else "false"
                for section, rank, n in entries:
                    found[section].append((item, rank, value, n))

        # value, path, top key, last key; in items of a first-level array the index for the path
        stack, items = [(read(text), "", None, None)], []
        while stack:
            v, path, top, leaf = stack.pop()
            kind = type(v)
            if kind is dict:
                for k, x in v.items():
                    here, name, entries = below[path, k]
                    if type(x) is dict or type(x) is list:
                        stack.append((x, here, name if top is None else top, name))
                    elif entries:
                        take(entries, -1, x)
            elif kind is not list:
                take(self.lookup.get(path, ()), -1, v)
            elif "[" in path:
                stack.extend((x, f"{path}[{i}]", top, leaf) for i, x in enumerate(v))
            else:
                items.extend((x, i, top, leaf) for i, x in enumerate(v))
        if found:
            self._hidden(found)
        while items:
            v, i, top, leaf = items.pop()
            kind = type(v)
            if kind is dict:
                for k, x in v.items():
                    name, entries = of_item[top, k]
                    if type(x) is dict or type(x) is list:
                        items.append((x, i, name if top is None else top, name))
                    elif entries:
                        take(entries, i, x)
            elif kind is list:
                items.extend((x, i, top, leaf) for x in v)
            elif top is not None:
                take(self.lookup.get(f"{top}|{leaf}", ()), i, v)
        return found

    def rows(self, text: str, known: tuple) -> list[tuple]:
        """``(section number, item, obr_set_id, obx_set_id, entry number, value, segment)`` in message order."""
        found, parts, out = self.found(text, known), self.parts, []
        plain = not any(c in text for c in _DELIMITERS)
        obr_id = 1
        for s, section in enumerate(self.sections):
            mine, head = found.get(section["section"], ()), self.heads[s]
            if not mine:
                obr_id += 1
                out.append((s, -1, obr_id, 0, -1, None, head and f"OBR|{obr_id}{head}"))
                continue
            mine.sort()
            run = None
            for item, _, value, n in mine:
                if item != run:
                    run, j = item, 0
                    obr_id += 1
                    out.append((s, item, obr_id, 0, -1, None, head and f"OBR|{obr_id}{head}"))
                j += 1
                part = parts[n]
                out.append((s, item, obr_id, j, n, value, part and f"OBX|{j}{part[0]}{obr_id}|{value if plain else value.translate(_ESCAPED)}{part[1]}"))
        return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most ``BATCH_BYTES`` of text, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BATCH_BYTES, "right")))
        yield start, stop
        start = stop


def section_rows(records: DataFrame, rows: Rows) -> DataFrame:
    """``doc_id`` and ``ROW`` of ``(doc_id, text)``; no row where the text is NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rows.known()
        section_names = pa.array([s["identifier"] for s in rows.sections], pa.string())
        section_seqs = pa.array([s["sec_seq"] for s in rows.sections], pa.int32())
        names = pa.concat_arrays([section_names, pa.array([e["identifier"] for e in rows.entries], pa.string())])
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for start, stop in _slices(texts):
                counts, out = [], []
                for text in texts.slice(start, stop - start).to_pylist():
                    before = len(out)
                    if text is not None:
                        out.extend(rows.rows(text, known))
                    counts.append(len(out) - before)
                if not out:
                    continue
                section, item, obr_id, obx_id, entry, value, segment = map(list, zip(*out, strict=True))
                section, entry = np.array(section, np.int32), np.array(entry, np.int32)
                which = np.where(entry < 0, section, entry + len(rows.sections))
                of = pa.array(np.repeat(np.arange(start, stop), counts))
                yield pa.RecordBatch.from_arrays([
                    ids.take(of), section_seqs.take(pa.array(section)), pa.array(item, pa.int32()), pa.array(obr_id, pa.int32()),
                    pa.array(obx_id, pa.int32()), pa.array(["OBR", "OBX"]).take(pa.array((entry >= 0).astype(np.int8))),
                    names.take(pa.array(which)), pa.array(value, pa.string()), pa.array(segment, pa.string())],
                    names=schema.names)

    schema = StructType([records.schema["doc_id"], *StructType.fromDDL(ROW)])
    return records.select("doc_id", "text").mapInArrow(run, schema)


def segments_text(text: Column, rows: Rows) -> Column:
    """``struct<n int, text string>``: how many section rows a record has and their segments
    joined with ``\\r`` (NULL without any); NULL of NULL."""
    def one(record: str | None, known) -> dict | None:
        if record is None:
            return None
        segments = [r[6] for r in rows.rows(record, known)]
        told = [s for s in segments if s is not None]
        return {"n": len(segments), "text": "\r".join(told) if told else None}

    kind = pa.struct([("n", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = rows.known()
        for texts in batches:
            out = [pa.array([one(t, known) for t in texts.slice(start, stop - start).to_pylist()], kind) for start, stop in _slices(texts)]
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    # typed here: the annotations of a nested function are read from the module that holds it
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n int, text string")(text)
