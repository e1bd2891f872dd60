"""WARC records in ZIP archives, read in place.

Pages are written as one gzip member per WARC record into ``archive/records.warc.gz``, a
stored member of a ZIP archive that also holds the index of its records.  Reading parses
the archive's directories, finds index and records, and reads ranges of whole records;
nothing is extracted.  Archives go through ``pyarrow.fs``, so their folder must be on a file
system that it knows (local and shared folders, HDFS, the common object stores).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import bounded
from panelcast.llm.zip_directory import BadArchive, Member, members
from panelcast.session import scratch_dir, stage

RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.cdxj"
# A payload held by more than this share of the pages is joined by broadcast: there are
# fewer than 1 / HOT_SHARE such payloads, whatever the input.
HOT_SHARE = 0.001
GZIP = 31  # zlib's window bits for a gzip member
STREAM = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Package:
    """``least``: payload bytes from which equal payloads are written once.  An archive is
    closed at ``archive_bytes`` or ``archive_records``; ranges of about ``span_bytes`` are
    read at once and ``task_bytes`` by a task."""

    least: int = 1000
    level: int = 3
    archive_bytes: int = 1 << 30
    archive_records: int = 50_000
    span_bytes: int = 4 << 20
    task_bytes: int = 64 << 20
    date: str = "1970-01-01T00:00:00Z"


# --- which records repeat a payload ----------------------------------------------------------


def _payload(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def narrow_pages(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        _payload(text_col).alias("payload"),
    )


def repeats(narrow: DataFrame, least: int) -> DataFrame:
    """``digest, page_id, refers_to``, one row per id that repeats a payload of a larger id.

    Only ids and digests are shuffled, combined per payload and id before; a payload with
    a large share of the pages meets them by broadcast.
    """
    long_ones = narrow.filter(F.octet_length("payload") >= least).select(
        "page_id", F.unhex(F.sha2("payload", 256)).alias("digest")
    )
    each = stage(long_ones, "payload-digests")
    groups = stage(
        each.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("refers_to").isNotNull()),
        "payload-groups",
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > max(1000, total * HOT_SHARE)
    hot = F.broadcast(groups.filter(large).select("digest", "refers_to"))
    rest = each.join(hot.select("digest"), "digest", "left_anti")
    pairs = each.join(hot, "digest").unionByName(
        rest.join(groups.filter(~large).select("digest", "refers_to"), "digest")
    )
    return pairs.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


# --- writing ---------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    if not record.startswith("<urn:page:"):
        raise ValueError(f"no record of a page: {record}")
    number = record[len("<urn:page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or f"urn:page:{page_id}", safe=_PRINTABLE)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _framed(fields, block)


_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def _framed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _zipped(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(raw) + packer.flush()


class ArchiveWriter:
    """One archive: records as they come, then their index."""

    def __init__(self, store: fs.FileSystem, path: str, how: Package):
        self.path, self.how, self.size, self.lines = path, how, 0, []
        self.store = store
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(self._info(RECORDS), "w", force_zip64=True)
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                 ("WARC-Date", how.date), ("Content-Type", "application/warc-fields"),
                 ("Content-Length", "0")]
        self._put(_framed(about, b""))

    def _info(self, name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def _put(self, raw: bytes) -> tuple[int, int]:
        packed = _zipped(raw, self.how.level)
        self.data.write(packed)
        self.size += len(packed)
        return self.size - len(packed), len(packed)

    def add(self, page_id, url, payload, refers_to) -> None:
        offset, length = self._put(record(page_id, url, payload, refers_to, self.how.date))
        kind = "response" if refers_to is None else "revisit"
        line = {"type": kind, "offset": offset, "length": length}
        self.lines.append(f"{record_id(page_id)[1:-1]} {json.dumps(line)}\n")

    @property
    def full(self) -> bool:
        return self.size >= self.how.archive_bytes or len(self.lines) >= self.how.archive_records

    def close(self) -> tuple[str, int, int]:
        """``path, size, records``."""
        self.data.close()
        with self.zip.open(self._info(INDEX), "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode())
        self.zip.close()
        self.out.close()
        return self.path, self.store.get_file_info(self.path).size, len(self.lines)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI: a bare path belongs to the cluster's default file system."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    uri = place.getFileSystem(conf).makeQualified(place).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and "://" not in uri else uri


def write_archives(
    pages: DataFrame,
    how: Package = Package(),
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """Writes every page into archives in ``folder``; returns ``archive, size, records``.

    Of pages with equal payloads of ``how.least`` bytes or more, the one with the largest id
    is a response and the others revisit it; a null id counts as the smallest, and where a
    payload has no other id, all its pages are responses, as are rows that repeat the
    largest id.  A null text is an empty payload, a null url the record's own name.  An
    empty table writes nothing.

    A task writes archives under names of its own; the table returned lists those of the
    attempts that counted, so a lost or repeated attempt leaves at most an unlisted file.
    """
    spark = pages.sparkSession
    root = qualified(spark, folder or scratch_dir(spark, "packaged-warc"))
    narrow = narrow_pages(pages, id_col, url_col, text_col)
    again = stage(repeats(narrow, how.least), "payload-repeats")
    # by payload and id, so that a payload with many pages spreads over all tasks
    keyed = narrow.withColumn(
        "digest", F.when(F.octet_length("payload") >= how.least, F.unhex(F.sha2("payload", 256)))
    )
    again = again.withColumnRenamed("page_id", "id").withColumnRenamed("digest", "of")
    same = (keyed["digest"] == again["of"]) & keyed["page_id"].eqNullSafe(again["id"])
    marked = keyed.join(again, same, "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        writer = None
        for batch in batches:
            for part in bounded(batch, 2):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        writer = ArchiveWriter(store, f"{base}/{uuid.uuid4().hex}.zip", how)
                    writer.add(*row)
                    if writer.full:
                        yield _manifest(root, writer)
                        writer = None
        if writer:
            yield _manifest(root, writer)

    return stage(marked.mapInArrow(run, "archive string, size long, records long"), "archives")


def _manifest(root: str, writer: ArchiveWriter) -> pa.RecordBatch:
    path, size, records = writer.close()
    uri = f"{root}/{path.rsplit('/', 1)[-1]}"
    return pa.RecordBatch.from_pylist([{"archive": uri, "size": size, "records": records}])


# --- reading ---------------------------------------------------------------------------------


class ArchiveReader:
    """Ranged reads of one archive."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.uri = uri
        self.file = store.open_input_file(path)
        try:
            found = {m.name: m for m in members(self.read_at, self.file.size())}
        except BadArchive as e:
            raise BadArchive(f"{uri}: {e}") from e
        if RECORDS not in found:
            raise BadArchive(f"{uri}: no {RECORDS}")
        self.records: Member = found[RECORDS].in_place()
        self.index: Member | None = found[INDEX].in_place() if INDEX in found else None

    def read_at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def entries(self) -> Iterator[tuple[str, dict]]:
        """(record name, ``type, offset, length``) from the index."""
        lines = self.read_at(self.index.start, self.index.size).decode().splitlines()
        for line in lines:
            name, _, about = line.partition(" ")
            yield name, json.loads(about)

    def spans(self, most: int) -> Iterator[tuple[int, int, list[int] | None]]:
        """Start and size of runs of whole records, with the size of each record; without an
        index, all records as one run whose sizes show as it is read."""
        if self.index is None:
            yield self.records.start, self.records.size, None
            return
        start, end, sizes = 0, 0, []
        for _, at in self.entries():
            if at["offset"] < 0 or at["offset"] + at["length"] > self.records.size:
                raise BadArchive(f"{self.uri}: the index points beyond the records")
            if sizes and (at["offset"] != end or end + at["length"] - start > most):
                yield self.records.start + start, end - start, sizes
                sizes = []
            if not sizes:
                start = at["offset"]
            sizes.append(at["length"])
            end = at["offset"] + at["length"]
        if sizes:
            yield self.records.start + start, end - start, sizes

    def raw_records(self, start: int, size: int, sizes: list[int] | None) -> Iterator[bytes]:
        """The unpacked records of a run."""
        if sizes is None:
            yield from self._streamed(start, size)
            return
        run = memoryview(self.read_at(start, size))
        at = 0
        for length in sizes:
            yield zlib.decompress(run[at : at + length], GZIP)
            at += length

    def _streamed(self, start: int, size: int) -> Iterator[bytes]:
        end, held, parts = start + size, b"", []
        unpacker = zlib.decompressobj(GZIP)
        while held or start < end:
            if not held:
                held = self.read_at(start, min(STREAM, end - start))
                start += len(held)
            parts.append(unpacker.decompress(held))
            held = unpacker.unused_data if unpacker.eof else b""
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(GZIP), []
        if parts:
            raise BadArchive(f"{self.uri}: the last record is cut off")

    def read_page(self, page_id: int | None) -> dict | None:
        """The record of one page, by the index; None if there is none."""
        if self.index is None:
            raise BadArchive(f"{self.uri}: no {INDEX}")
        name = record_id(page_id)[1:-1]
        for found, at in self.entries():
            if found == name:
                raw = self.read_at(self.records.start + at["offset"], at["length"])
                return parse_record(zlib.decompress(raw, GZIP))
        return None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(raw: bytes) -> dict | None:
    """A response or revisit as a row; other kinds of records are passed over.

    Lengths and digest are checked against the payload that was read.
    """
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise BadArchive("no WARC record")
    about = _fields(head)
    kind = about["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    size = int(about["content-length"])
    if len(rest) < size:
        raise BadArchive(f"{about['warc-record-id']} is cut off")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(_fields(http)["content-length"])
    digest = base64.b32decode(about["warc-payload-digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload), hashlib.sha1(payload).digest()) != (length, digest):
        raise BadArchive(f"{about['warc-record-id']}: the payload is not the one written")
    return {
        "page_id": page_of(about["warc-record-id"]),
        "target_uri": about["warc-target-uri"],
        "payload_bytes": length,
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": page_of(about["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


ROW = (
    "page_id long, target_uri string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def spans_of(archives: DataFrame, how: Package) -> DataFrame:
    """``archive, start, size, sizes``: the ranges to read, from directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
                           ("sizes", pa.list_(pa.int64()))])
        for batch in batches:
            for uri in batch["archive"].to_pylist():
                rows = [dict(zip(kinds.names, (uri, *s), strict=True))
                        for s in ArchiveReader(uri).spans(how.span_bytes)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    wide = archives.select("archive").repartition(_tasks(archives.sparkSession, archives.count()), "archive")
    found = wide.mapInArrow(run, "archive string, start long, size long, sizes array<long>")
    return stage(found, "archive-spans")


def _tasks(spark: SparkSession, wanted: int) -> int:
    return max(1, min(wanted, 2 * spark.sparkContext.defaultParallelism))


def read_archives(archives: DataFrame, how: Package = Package(), payload: bool = False) -> DataFrame:
    """One row per response or revisit in ``archives`` (column ``archive``).

    ``page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to`` and, if
    asked for, ``payload`` (null for revisits).  Digests are lowercase hexadecimal SHA-1.  An
    archive that is cut off, and a record that does not hold what its digest says, raise.
    Ranges of whole records are spread over tasks, so a large archive is read by many.
    """
    spark = archives.sparkSession
    spans = spans_of(archives, how)
    count, size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(_tasks(spark, count), -(-size // how.task_bytes))
    schema = ROW + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                reader, rows, held = ArchiveReader(span["archive"]), [], 0
                for raw in reader.raw_records(span["start"], span["size"], span["sizes"]):
                    row = parse_record(raw)
                    if row is None:
                        continue
                    rows.append({n: row[n] for n in names})
                    held += len(raw) if payload else 200
                    if held > how.span_bytes:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return spans.repartition(tasks, "archive", "start").mapInArrow(run, schema)
