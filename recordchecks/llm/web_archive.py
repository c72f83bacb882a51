"""Web archives inside ZIP packages (operator 6).

Writing: pages become WARC records, each its own gzip member, in packages with
the stored members ``archive/data.warc.gz`` and ``indexes/index.cdxj``.  Of
records with equal payloads of ``MIN_DEDUP`` bytes or more the one with the
largest page id is a response, the others are revisits that name it.  A task
streams its rows into packages of at most ``PACKAGE_BYTES`` (one record more at
the end), and its output rows are the list of packages; that list is a written
table, so a package of a lost or repeated attempt is never read.

Reading: no member is extracted.  The end record at the tail of a package, with
its ZIP64 locator where the sizes need one, leads to the central directory; the
local header of a stored member gives the offset of its data.  Every member under
``indexes/`` is read (plain or gzip, JSON lines or CDXJ), a line names its archive
member, offset and length, and records are read by byte ranges, one in several
indexes once.  Archive members that no index names are walked record by record.

Files are opened through ``pyarrow.fs``, so the shared folder may be any store
that it knows.

Defined results: null html is an empty payload; a null page id is written and
read back as null and is the smallest; equal payloads under the same largest id
are all responses; rows are written one by one, repeated or not; other columns
than id, url and html are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.llm.common import read_table, small_batches, store
from recordchecks.session import shared_path

MIN_DEDUP = 1000
PACKAGE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_AHEAD = 4 << 20
RECORD_COLUMNS = "page_id, payload_bytes, payload_digest, record_type, refers_to"


def filesystem(path: str):
    """File system and path of a URI or local path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit has the headers of its response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Target-URI: {''.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    def fields(text: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class Package:
    """Writer of one package; the index waits in memory (a line a record)."""

    def __init__(self, folder: str):
        fs, path = filesystem(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{self.path.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.bytes = [], 0

    def add(self, url: str, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"url": url, "filename": DATA.rpartition("/")[2], "offset": self.bytes, "length": len(packed)}))
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index)


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and size of the data of every stored member of an open package, by its central directory."""
    tail_size = min(size, 65_557 + 20)  # end record, longest comment, ZIP64 locator
    tail = f.read_at(tail_size, size - tail_size)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP package: no end record")
    count, length, offset = struct.unpack("<HII", tail[end + 10:end + 20])
    locator = tail[end - 20:end] if end >= 20 else b""
    if (count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and locator[:4] == b"PK\x06\x07":
        at, = struct.unpack("<Q", locator[8:16])
        count, length, offset = struct.unpack("<32xQQQ", f.read_at(56, at))
    directory, at, found = f.read_at(length, offset), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10:at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        start, = struct.unpack("<I", directory[at + 42:at + 46])
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: those of the three that did not fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                start = next(wide) if start == 0xFFFFFFFF else start
            extra = extra[4 + n:]
        if method == 0:  # its own name and extra field may differ in length from the directory's
            own_name, own_extra = struct.unpack("<HH", f.read_at(4, start + 26))
            found[name] = start + 30 + own_name + own_extra, packed
        at += 46 + n_name + n_extra + n_comment
    return found


def index_entries(f, found: dict[str, tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Archive member, offset and length of every line of every index member."""
    archives = [n for n in found if is_archive(n)]
    for name in sorted(n for n in found if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdxj", ".cdx"))):
        start, size = found[name]
        lines: io.BufferedIOBase = io.BytesIO(f.read_at(size, start))
        if name.endswith(".gz"):
            lines = gzip.GzipFile(fileobj=lines)
        for line in lines:
            _, brace, fields = line.partition(b"{")  # CDXJ puts a key and a time before the JSON
            if not brace:
                continue
            entry = json.loads(brace + fields)
            named = entry.get("filename")
            if named is None and len(archives) != 1:
                raise ValueError(f"{name}: a line names none of {len(archives)} archives")
            archive = next((n for n in archives if named is None or n in (named, f"archive/{named}")), None)
            if archive is None:
                raise ValueError(f"{name}: no archive member {named}")
            yield archive, int(entry["offset"]), int(entry["length"])


def is_archive(name: str) -> bool:
    return name.startswith("archive/") and name.removesuffix(".gz").endswith(".warc")


def indexed(f, found: dict[str, tuple[int, int]], seen: dict[str, set[int]]) -> Iterator[tuple[str, int, bytes]]:
    """Archive member, offset and bytes of the records that indexes name; ``seen`` gathers them."""
    held, held_at, held_of = b"", 0, None
    for name, offset, length in index_entries(f, found):
        if offset in seen.setdefault(name, set()):
            continue
        seen[name].add(offset)
        base, data_size = found[name]
        if held_of != name or not held_at <= offset <= offset + length <= held_at + len(held):  # neighbours come in one range
            held, held_at, held_of = f.read_at(min(max(length, READ_AHEAD), data_size - offset), base + offset), offset, name
        raw = held[offset - held_at:offset - held_at + length]
        yield name, offset, zlib.decompress(raw, 31) if name.endswith(".gz") else raw


def walked(f, start: int, size: int, packed: bool) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records of an archive member, in ranges from its start."""
    held, at, read = b"", 0, 0
    while at < size:
        decoder, record, used, whole = zlib.decompressobj(31), bytearray(), 0, False
        while not whole:
            if used == len(held) or not packed:
                more = f.read_at(min(READ_AHEAD, size - read), start + read)
                read, held = read + len(more), held + more
            if packed:
                record += decoder.decompress(held[used:])
                used, whole = len(held) - len(decoder.unused_data), decoder.eof
            else:
                head, found, _ = held.partition(b"\r\n\r\n")
                lengths = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                used = len(head) + 8 + int(lengths[0]) if found else 0
                whole = bool(found) and used <= len(held)
                record[:] = held[:used]
            if not whole and read == size and (not packed or used == len(held)):
                raise ValueError(f"archive member ends inside a record at {at}")
        yield at, bytes(record)
        held, at = held[used:], at + used


def read_package(path: str) -> Iterator[tuple]:
    """``RECORD_COLUMNS`` of the records of a package, by byte ranges."""
    import hashlib
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        found, seen = members(f, f.size()), {}

        def records() -> Iterator[tuple[str, int, bytes]]:
            yield from indexed(f, found, seen)
            for name in sorted(n for n in found if is_archive(n) and n not in seen):
                yield from ((name, at, raw) for at, raw in walked(f, *found[name], name.endswith(".gz")))

        for name, offset, raw in records():
            warc, http, payload = parse_record(raw)
            if warc["warc-type"] not in ("response", "revisit"):  # descriptions of the archive itself
                continue
            digest = warc["warc-payload-digest"].removeprefix("sha1:")
            if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload digest differs in {path}, {name} at {offset}")
            yield page_of(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], page_of(warc.get("warc-refers-to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_dedup: int = MIN_DEDUP, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages under ``folder``; returns their ``path, records``."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    # short payloads have no owner; keys of their own spread them
    rows = rows.withColumn("strong", F.when(F.col("size") >= min_dedup, F.sha2("payload", 256)).otherwise(
        F.hex(F.xxhash64("page_id", "url", "digest"))))
    # one row a payload that occurs twice, by partial aggregation: a hot group stays one row
    owner = rows.where(F.col("size") >= min_dedup).select("strong", "page_id").groupBy("strong").agg(
        F.count(F.lit(1)).alias("times"), F.max("page_id").alias("owner")).where("times > 1").select("strong", "owner", F.lit(True).alias("shared"))
    rows = rows.join(owner, "strong", "left").select("page_id", "url", "payload", "digest", "owner", (
        F.coalesce("shared", F.lit(False)) & (F.col("size") >= min_dedup) & ~F.col("page_id").eqNullSafe(F.col("owner"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in small_batches(batches, 500):
            for page_id, url, body, digest, owner_, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                package = package or Package(folder)
                package.add(url, warc_record(page_id, url, body, digest, owner_, revisit))
                if package.bytes >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.record_batch({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return rows.mapInArrow(write, "path string, records long")


def read_archives(packages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the packages."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORD_COLUMNS.split(", ")
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                held = []
                for row in read_package(path):
                    held.append(row)
                    if len(held) == 5000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    spark = packages.sparkSession
    # a package a task, as far as the cluster's partitions go
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(tasks, "path").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "web-archives")
    return read_archives(store(write_archives(read_table(spark, sf_dir, "pages"), folder), "web-packages"))


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
o as (select html, max(page_id) as owner from p where octet_length(encode(html)) >= {MIN_DEDUP} group by html)
select p.page_id, octet_length(encode(p.html)) as payload_bytes, sha1(encode(p.html)) as payload_digest,
       case when o.owner is not null and o.owner <> p.page_id then 'revisit' else 'response' end as record_type,
       case when o.owner is not null and o.owner <> p.page_id then o.owner end as refers_to
from p left join o on p.html = o.html
"""
