"""WARC archives: writer with revisit records, and a splittable reader (operator 2).

Writing: every record is a gzip member of its own, so archives can be read
from the middle. Of payloads of at least ``MIN_REVISIT`` bytes that are equal
(SHA-256), the page with the smallest id is written whole, the others as
revisit records that refer to it. Which ones these are is found on (digest,
id) rows alone; pages are written by the tasks that hold them. A task writes
files of at most about ``FILE_BYTES`` under fresh names and reports them in
the manifest; files of failed attempts are never read, because only the
manifest of the attempts that succeeded names files.

Reading: files are cut into byte ranges of ``RANGE_BYTES``. A task looks for
gzip magic in its range, decodes the beginning of each candidate and takes it
for a record only if it starts with a WARC version line and its whole member
decodes; it owns the records that start inside its range and reads past the
end of the range to finish the last. After a record the next is expected where
it ends. Memory is bounded by a range and the longest record.

Files are opened through ``pyarrow.fs``, by the scheme of the folder's URI, so
the archives may lie in any store that the executors share.

Ranges are dealt to as many tasks as there are ranges (``MOST_TASKS`` at most),
a fixed number, because adaptive execution would merge their few bytes into one.

Defined cases: a null payload is empty; pages without an id are always whole
and read back with a null id; equal pages that share the smallest id are all
whole; a null url has no target header; an empty table gives no files; a record
without a usable Content-Length is read to its member's end and marked as not
``well_formed``. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from .common import batches

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
MOST_TASKS = 100_000
#: duplicate digests that may be broadcast (about 80 bytes each)
SMALL_DIGESTS = 200_000
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder URI and the folder's path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 date: str) -> bytes:
    """One WARC record as a gzip member."""
    name = RECORD_ID.format(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            b"WARC-Record-ID: " + name.encode(), b"WARC-Date: " + date.encode(),
            b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if url is not None:
        # control characters and blanks would break the header
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url).encode())
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body += payload
    else:
        head += [b"WARC-Profile: " + REVISIT.encode(), b"WARC-Refers-To: " + RECORD_ID.format(refers_to).encode()]
    head.append(b"Content-Length: %d" % len(body))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _writer(folder: str, date: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out, path, size, records = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])],
                                              names=["path", "bytes", "records"])

        for b in batches(it):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                r = record_bytes(page_id, url, html, digest, refers_to, date)
                out.write(r)
                size, records = size + len(r), records + 1
                if size >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()
    return run


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages (page_id, url, html)`` and return the stored manifest
    ``path, bytes, records``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    first = (p.filter((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull())
              .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("digest", "first_id"))
    first = stored(first, "digests")
    if first.count() <= SMALL_DIGESTS:
        marked = p.join(F.broadcast(first), "digest", "left")
    else:   # digests meet without their pages; only ids of revisits come back, and no digest is a hot key for html
        again = p.select("page_id", "digest").join(first, "digest").filter("page_id != first_id").distinct()
        marked = p.join(again, ["page_id", "digest"], "left")
    marked = marked.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")))
    return stored(marked.mapInArrow(_writer(folder, date), "path string, bytes long, records long"), "manifest")


def decode_member(read, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and where it ends; None unless
    it is a whole member that holds a WARC record. ``read(offset, size)`` gives
    bytes of the file."""
    z = zlib.decompressobj(31)
    parts, head, pos, step = [], b"", at, 1 << 14
    try:
        while not z.eof:
            data = read(pos, step)
            if not data:
                return None
            parts.append(z.decompress(data))
            pos += len(data)
            if len(head) < 8:
                head += parts[-1][:8]
                if not b"WARC/1.1".startswith(head[:8]) and not b"WARC/1.0".startswith(head[:8]):
                    return None
            step = min(step * 4, 1 << 20)
    except zlib.error:
        return None
    return (b"".join(parts), pos - len(z.unused_data)) if len(head) == 8 else None


def records_from(read, start: int, stop: int) -> Iterator[bytes]:
    """The records of a file that start in [start, stop)."""
    pos, chunk, base = start, b"", start
    while pos < stop:
        if pos < base or pos + len(MAGIC) > base + len(chunk):
            base, chunk = pos, read(pos, 1 << 20)
            if len(chunk) < len(MAGIC):
                return
        hit = chunk.find(MAGIC, pos - base)
        if hit < 0:
            pos = base + len(chunk) - len(MAGIC) + 1
            continue
        pos = base + hit
        if pos >= stop:
            return
        found = decode_member(read, pos)
        if found is None:
            pos += 1
        else:
            record, pos = found
            yield record


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bool]:
    """Headers (lower-case names) and payload of a response or revisit record,
    and whether its length was as stated."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    sound = length.isascii() and length.isdigit() and len(length) < 19 and int(length) <= len(rest)
    body = rest[:int(length)] if sound else rest.removesuffix(b"\r\n\r\n")
    return headers, body.partition(b"\r\n\r\n")[2], sound


_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def _page_of(name: str | None) -> int | None:
    m = _PAGE.fullmatch(name or "")
    return int(m[1]) if m else None


FIELDS = ("page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, "
          "stated_digest string, refers_to long, payload binary, well_formed boolean")


def _reader(with_payload: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, scheme, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                store, _ = open_store(scheme)
                with store.open_input_file(path) as f:
                    size = f.size()
                    read = lambda at, n: f.read_at(min(n, size - at), at) if at < size else b""  # noqa: B023, E731
                    rows, held = [], 0
                    for record in records_from(read, start, stop):
                        h, payload, sound = parse_record(record)
                        rows.append((_page_of(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"),
                                     len(payload), hashlib.sha256(payload).hexdigest(),
                                     h.get("warc-payload-digest", "").removeprefix("sha256:"),
                                     _page_of(h.get("warc-refers-to")), payload if with_payload else None, sound))
                        held += len(payload) if with_payload else 200
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                      names=[f.split()[0] for f in FIELDS.split(", ")])


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's files, one row each, as they stand in the
    archive: a revisit has no payload of its own."""
    ranges = manifest.select("path", F.lit(folder).alias("scheme"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("path", "scheme", "start", F.least(F.col("start") + RANGE_BYTES, F.col("bytes")).alias("stop"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / RANGE_BYTES))).first()[0] or 1
    spread = ranges.repartition(min(int(tasks), MOST_TASKS))
    return spread.mapInArrow(_reader(with_payload), FIELDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the full payload's size and digest: a revisit takes them
    from the response that it refers to."""
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to")
    wanted = again.select(F.col("refers_to").alias("page_id")).distinct()
    target = (whole.join(wanted, "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to"))
                   .agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")))
    return whole.select(cols).unionByName(again.join(target, "refers_to", "left").select(cols))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = stored(read_warc(write_warc(pages, folder), folder, with_payload=False).drop("payload"), "records")
    return resolve_revisits(records)
