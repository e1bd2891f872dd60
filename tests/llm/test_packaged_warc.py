from __future__ import annotations

import hashlib
import io
import random
import zipfile
import zlib

import pytest

from panelcast.llm import packaged_warc, zip_directory
from panelcast.llm.packaged_warc import ArchiveReader, Package, read_archives, write_archives
from panelcast.llm.zip_directory import BadArchive, members


def in_memory(raw):
    return (lambda offset, size: raw[offset : offset + size]), len(raw)


def package(parts, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


PARTS = [("a.txt", b"one"), ("dir/é中.bin", bytes(range(256)) * 4), ("empty", b"")]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 9])
@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 that looks like an end record"])
def test_members(monkeypatch, wide, before, comment):
    if wide:  # every size, place and count in its ZIP64 field
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = package(PARTS, comment)
    assert (zip_directory.END64 in raw) == wide
    raw = before + raw
    found = members(*in_memory(raw))
    assert [(m.name, raw[m.start : m.start + m.size]) for m in found] == PARTS


def test_written_without_seeking_back():
    """Sizes that follow the data, as streams have them."""

    class Stream(io.BytesIO):
        def seek(self, *_):
            raise OSError

    out = Stream()
    with zipfile.ZipFile(out, "w") as z, z.open("x", "w", force_zip64=True) as f:
        f.write(b"abc")
    raw = out.getvalue()
    [m] = members(*in_memory(raw))
    assert raw[m.start : m.start + m.size] == b"abc"


def test_no_archive_and_parts_of_one(monkeypatch):
    raw = package(PARTS)
    for wide in (False, True):
        if wide:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
            raw = package(PARTS)
        for cut in range(len(raw)):
            with pytest.raises(BadArchive):
                members(*in_memory(raw[:cut]))
        for cut in range(30, len(raw), 7):
            with pytest.raises(BadArchive):
                members(*in_memory(raw[cut:]))
    with pytest.raises(BadArchive):
        members(*in_memory(b"PK\x05\x06 is all there is"))


def test_packed_members_cannot_be_read_in_place():
    [m] = members(*in_memory(package([("x", b"a" * 99)], method=zipfile.ZIP_DEFLATED)))
    with pytest.raises(BadArchive):
        m.in_place()


def plainly(rows, least=1000):
    """``(page_id, html)`` to the contract's rows, pair by pair."""
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        same = [i for i, h in rows if (h or "") == (html or "") and i is not None]
        last = max(same, default=None)
        again = len(payload) >= least and last is not None and page_id != last
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(),
                    "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_back(pages, how=Package(), **more):
    archives = write_archives(pages, how, **more)
    rows = read_archives(archives, how, payload=True)
    return archives, rows


def _checked(pages, how=Package()):
    _, back = read_back(pages, how)
    rows = back.collect()
    given = [(r["page_id"], r["html"]) for r in pages.collect()]
    assert sorted((tuple(r[c] for c in COLS) for r in rows), key=repr) == plainly(given, how.least)
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None
    return rows


def test_rows(spark, sf_dir):
    _checked(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ODD = "page_id long, url string, html string, digest string, archive string, payload string, refers_to string"


def odd_pages(spark):
    rng = random.Random(5)
    long = ["é" * 500, "x" * 1000, "<p>" + "a b\r\n\r\nc" * 300, "y" * 999, "".join(map(chr, rng.choices(range(1, 3000), k=4000)))]
    urls = ["http://a.example/é?x=1\r\nWARC-Type: revisit", None, "", "http://b.example/a b"]
    rows = [(i, rng.choice(urls), rng.choice([*long, "", None, "short"])) for i in range(-20, 60)]
    rows += [(None, None, long[0]), (None, "u", "only here " * 200), (None, "u", "only here " * 200)]
    rows += [(59, "again", r[2]) for r in rows if r[0] == 59]
    rows += [(1000 + i, "http://hot.example", "hot " * 400) for i in range(300)]
    rows += [(7, "http://large.example", "word " * 400000)]
    return spark.createDataFrame([(*r, "d", "a", "p", "r") for r in rows], ODD)


def test_odd(spark):
    pages = odd_pages(spark)
    rows = _checked(pages)
    assert {r["target_uri"] for r in rows if r["page_id"] is None} >= {"u"}
    assert all("\r" not in r["target_uri"] for r in rows)
    empty = pages.limit(0)
    archives, back = read_back(empty)
    assert archives.count() == 0 and back.count() == 0


def test_many_archives_and_ranges(spark, monkeypatch):
    """Small archives and ranges, hot payloads by broadcast, other limits."""
    monkeypatch.setattr(packaged_warc, "HOT_SHARE", 0.0)
    pages = odd_pages(spark)
    how = Package(least=3, archive_records=7, archive_bytes=2000, span_bytes=900, task_bytes=5000, level=9)
    _checked(pages, how)
    archives, _ = read_back(pages, how)
    assert archives.count() > 50 and archives.agg({"records": "sum"}).first()[0] == pages.count()


def test_the_archive_is_a_plain_zip_with_plain_records(spark, tmp_path):
    pages = odd_pages(spark).filter("page_id between 0 and 40")
    archives, _ = read_back(pages, folder=str(tmp_path / "out"))
    names, kinds = set(), []
    for row in archives.collect():
        path = row["archive"].removeprefix("file://")
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            names |= set(z.namelist())
            raw = zlib.decompressobj(31).decompress(z.read(packaged_warc.RECORDS))
            kinds.append(raw.split(b"\r\n")[1])
            assert row["size"] == len(open(path, "rb").read())
    assert names == {packaged_warc.RECORDS, packaged_warc.INDEX}
    assert set(kinds) == {b"WARC-Type: warcinfo"}


def test_one_record_and_no_index(spark, tmp_path):
    pages = odd_pages(spark).filter("page_id between 0 and 40").coalesce(1)
    archives, back = read_back(pages, folder=str(tmp_path / "out"))
    [uri] = [r["archive"] for r in archives.collect()]
    want = {r["page_id"]: r.asDict() for r in back.collect()}
    reader = ArchiveReader(uri)
    for page_id in (0, 33, 40):
        assert reader.read_page(page_id) == want[page_id]
    assert reader.read_page(12345) is None

    bare = tmp_path / "bare.zip"
    with zipfile.ZipFile(uri.removeprefix("file://")) as z, zipfile.ZipFile(bare, "w") as new:
        new.writestr(packaged_warc.RECORDS, z.read(packaged_warc.RECORDS))
    alone = spark.createDataFrame([(f"file://{bare}",)], "archive string")
    assert {r["page_id"]: r.asDict() for r in read_archives(alone, payload=True).collect()} == want


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text " * 500)], "page_id long, url string, html string")
    archives, _ = read_back(pages, Package(level=0), folder=str(tmp_path / "out"))
    uri = archives.first()["archive"]
    path = uri.removeprefix("file://")
    raw = open(path, "rb").read()
    other = raw.replace(b"text text", b"texT text", 1)
    crc_free = tmp_path / "bad.zip"
    crc_free.write_bytes(other)
    with pytest.raises((BadArchive, zlib.error)):
        ArchiveReader(f"file://{crc_free}").read_page(1)
    cut = tmp_path / "cut.zip"
    cut.write_bytes(raw[:-40])
    with pytest.raises(BadArchive):
        ArchiveReader(f"file://{cut}")
    assert packaged_warc.parse_record(packaged_warc._framed([("WARC-Type", "metadata")], b"")) is None
    record = packaged_warc.record(5, "u", b"abc", None, "2020-01-01T00:00:00Z")
    with pytest.raises(BadArchive):
        packaged_warc.parse_record(record.replace(b"abc", b"abd"))
    with pytest.raises(BadArchive):
        packaged_warc.parse_record(record[:-8])
