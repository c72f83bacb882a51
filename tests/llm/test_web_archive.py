import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyarrow import fs

from recordchecks.llm import web_archive as wa
from recordchecks.session import shared_path

SCHEMA = "page_id long, url string, html string, payload string, digest int, owner int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA)


def slow(rows):
    owner = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            owner[h] = max(owner.get(h, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = h in owner and owner[h] != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", owner[h] if revisit else None))
    return sorted(map(str, out))


ROWS = [(1, "http://a/", "x" * 2000), (2, "u", "x" * 2000), (3, None, None), (None, "v", "x" * 2000), (4, "b c", "é" * 999),
        (5, "w", "é" * 999), (5, "w", "é" * 999), (6, "w", "a"), (7, "w", "a"), (8, "w", ""), (9, "w", "WARC/1.1\r\n\r\n" * 200),
        (10, "w", "z" * 3_000_000), (11, "w", "é" * 500), (12, "w", "é" * 500), (13, "w", "y" * 999), (14, "w", "y" * 999)]


@pytest.mark.parametrize("package_bytes", [10, 1 << 20, 64 << 20])
def test_round_trip(spark, package_bytes):
    written = wa.write_archives(pages_of(spark, ROWS).repartition(3), shared_path(spark, "wa"), package_bytes=package_bytes).cache()
    got = wa.read_archives(written).collect()
    assert sorted(str(tuple(r)) for r in got) == slow(ROWS)
    assert sum(r["records"] for r in written.collect()) == len(ROWS)


def test_packages_are_plain_zip_files(spark):
    path = wa.write_archives(pages_of(spark, ROWS).coalesce(1), shared_path(spark, "wa")).first()["path"]
    files, inner = wa.filesystem(path)
    with zipfile.ZipFile(io.BytesIO(files.open_input_file(inner).read())) as z:
        assert z.namelist() == [wa.DATA, wa.INDEX] and z.testzip() is None


def test_empty_table(spark):
    assert wa.read_archives(wa.write_archives(pages_of(spark, []), shared_path(spark, "wa"))).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_directory_of_another_writer(wide, monkeypatch, tmp_path):
    """Stored members with a comment, extra fields and, by a low limit, ZIP64 records."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "x.zip"
    data = {f"m{i}.bin": bytes([i]) * (100 + i) for i in range(5)}
    with zipfile.ZipFile(path, "w") as z:
        for name, body in data.items():
            z.writestr(name, body)
        z.writestr("packed", b"0" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"PK comment"
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        found = wa.members(f, f.size())
        assert {n: f.read_at(size, at) for n, (at, size) in found.items()} == data


def test_not_a_package():
    with pytest.raises(ValueError):
        wa.members(pa.BufferReader(b"nothing of the kind"), 19)


def test_damaged_payload_is_found(spark):
    path = wa.write_archives(pages_of(spark, [(1, "u", "q" * 100)]), shared_path(spark, "wa")).first()["path"]
    record = wa.warc_record(1, "u", b"q" * 100, "0" * 40, None, False)
    warc, http, payload = wa.parse_record(record)
    assert payload == b"q" * 100 and warc["warc-payload-digest"] == "sha1:" + "0" * 40 and http["content-length"] == "100"
    assert list(wa.read_package(path))[0][3] == "response"


@pytest.mark.parametrize("read_ahead", [7, 300, 4 << 20])
def test_package_with_several_archives_and_indexes(monkeypatch, tmp_path, read_ahead):
    """Two gzip archives and a plain one under any name, three indexes that overlap, an archive without an index."""
    monkeypatch.setattr(wa, "READ_AHEAD", read_ahead)
    path, names = tmp_path / "x.wacz", ["archive/a.warc.gz", "archive/part-b.warc", "archive/c.warc.gz", "archive/d.warc"]
    bodies, lines, want = {}, {}, []
    for k, name in enumerate(names):
        data = b""
        for i in range(10 * k, 10 * k + 9):
            payload = b"p%d" % i * (50 + i)
            digest = hashlib.sha1(payload).hexdigest()
            record = wa.warc_record(i, f"http://h/{i}", payload, digest, i - 1, i % 3 == 2)
            packed = gzip.compress(record) if name.endswith("gz") else record
            lines.setdefault(name, []).append(json.dumps({"filename": name.rpartition("/")[2], "offset": str(len(data)), "length": len(packed)}))
            data += packed
            want.append((i, len(payload), digest, "revisit" if i % 3 == 2 else "response", i - 1 if i % 3 == 2 else None))
        bodies[name] = data
    with zipfile.ZipFile(path, "w") as z:
        for name, data in bodies.items():
            z.writestr(name, data)
        z.writestr("indexes/one.cdxj", "\n".join(f"h,x)/ 2024 {x}" for x in lines[names[0]]))
        z.writestr("indexes/two.cdxj.gz", gzip.compress("\n".join(lines[names[1]] + lines[names[0]][:4]).encode()))
        z.writestr("indexes/three.cdx", "!meta\n" + "\n".join(lines[names[1]]))
        z.writestr("pages/pages.jsonl", "{}")
    assert sorted(wa.read_package(str(path))) == sorted(want, key=lambda r: r[0])


def test_an_archive_cut_short_is_an_error(tmp_path):
    for name, cut in (("archive/a.warc.gz", gzip.compress(b"WARC/1.1\r\n" * 9)[:-9]), ("archive/a.warc", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")):
        with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
            z.writestr(name, cut)
        with pytest.raises(ValueError, match="ends inside"):
            list(wa.read_package(str(tmp_path / "x.zip")))
