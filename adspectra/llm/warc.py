"""WARC archives: a writer, and a sequential reader.

Writing: a page's payload is its html in UTF-8.  Of pages with equal payloads the one with the
largest id becomes a ``response`` record and the others ``revisit`` records that refer to it.  The
groups are found on (digest, id) rows; the pages themselves are shuffled once, by id.  Each task
writes archives of gzip members, one per record, under a name of its own attempt to the shared folder, and returns
the names; these are checkpointed, so a lost executor or a second attempt leaves at most a file
that no row names.

Reading: an archive is read from start to end.  Each gzip member is inflated piece by piece, its
header block parsed, its block framed by Content-Length, and the block and payload digests are
verified.  Nothing but the record at hand is held.

Defined cases: null html is an empty payload; a null id sorts below all others; rows that repeat
both id and payload are equal records of one type; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at the first record that ends beyond this.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A malformed or damaged archive."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member: header lines, block, two line ends."""
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str) -> bytes:
    """A page's response, or its revisit of the page ``refers_to``: the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Page-ID", "" if page_id is None else str(page_id)),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return record(headers, block)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def members(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The inflated bytes of each gzip member in turn."""
    held = read(READ_BYTES)
    while held:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not held:
                held = read(READ_BYTES)
                if not held:
                    raise WarcError("the archive ends within a gzip member")
            try:
                parts.append(unpacker.decompress(held))
            except zlib.error as e:
                raise WarcError(str(e)) from e
            held = unpacker.unused_data
        yield b"".join(parts)
        held = held or read(READ_BYTES)


def fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines.decode().split("\r\n") if ":" in x)}


def records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """The verified records of an archive."""
    for data in members(read):
        head, gap, rest = data.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"WARC/"):
            raise WarcError("no WARC header")
        headers = fields(head.partition(b"\r\n")[2])
        size = int(headers.get("content-length", -1))
        if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise WarcError("Content-Length doesn't frame the block")
        out = Record(headers, rest[:size])
        if headers.get("warc-block-digest") not in (None, f"sha1:{digest(out.block)}"):
            raise WarcError("the block digest differs")
        if headers.get("content-type", "").startswith("application/http"):
            http, _, out.payload = out.block.partition(b"\r\n\r\n")
            out.http = fields(http.partition(b"\r\n")[2])
            if headers.get("warc-type") == "response" and headers.get("warc-payload-digest") not in (None, f"sha1:{digest(out.payload)}"):
                raise WarcError("the payload digest differs")
        yield out


def store(uri: str):
    """(file system, path) of a URI that all executors can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url and html as archives under ``folder``; gives (archive, records)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    key = rows.select(F.sha1("html").alias("d"), F.octet_length("html").alias("n"), F.col("page_id").alias("p"))
    largest = key.groupBy("d", "n").agg(F.max("p").alias("largest"))
    # The groups that hold a record to be revisited; all others need no word from here.
    smaller = key.join(largest, ["d", "n"]).where("p < largest or (p is null and largest is not null)")
    revisits = smaller.select("p", "largest", "d").distinct().withColumnsRenamed({"p": "__asx_p", "largest": "__asx_r", "d": "__asx_d"})
    same = F.col("page_id").eqNullSafe(F.col("__asx_p")) & (F.sha1("html") == F.col("__asx_d"))
    told = rows.join(revisits, same, "left").select("page_id", "url", "html", "__asx_r")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        files.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        names, counts = [], []

        def close():
            out.close()
            names.append(name)
            counts.append(n)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                data = page_record(page_id, url, payload, refers_to, digest(payload))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return cut(told.mapInArrow(write, "archive string, records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the named archives: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    A revisit's payload isn't stored; its size is the one its HTTP header tells.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for r in records(source.read):
                        h = r.headers
                        response = h["warc-type"] == "response"
                        number = lambda k: int(h[k]) if h.get(k) else None
                        rows.append((number("warc-page-id"), h["warc-target-uri"], h["warc-type"], r.payload if response else None, len(r.payload) if response else int(r.http["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), number("warc-refers-to-page-id")))
                        held += len(r.payload)
                        if held > 8 << 20:
                            yield to_batch(rows)
                            rows, held = [], 0
                yield to_batch(rows)

    return archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism)).mapInArrow(read, READ)


READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives, by default below the shared folder, and reads them back."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)
