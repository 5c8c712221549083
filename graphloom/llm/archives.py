"""Legacy archive converter: ARC records in, WARC records out.

An ARC file is a version block, whose second line names the version and whose body lists the header
fields, and then records: one header line with the fields of that version and the record's declared
length, then so many bytes.  ``read_arc`` parses both versions by their declared lengths; ``to_warc``
synthesises what WARC needs and ARC lacks: record ids, types, ISO timestamps and digests.

WARC files hold one gzip member for each record.  A task writes a file of its own, under a name that
no other attempt uses, to the shared folder; only the files that committed tasks reported are read, so a
lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, split_join

#: Fields of a header line by version of the format (fixed values of the format).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives that are gathered before they are converted and written.
CHUNK = 4 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """URN that holds all 64 bits of the page id (RFC 9562, version 8); a random one for a record without an id."""
    if page_id is None:
        return f"urn:uuid:{uuid.uuid4()}"
    bits = page_id & ((1 << 64) - 1)
    return f"urn:uuid:{uuid.UUID(int=(0x6C6F6F6D << 96) | (8 << 76) | (bits >> 62 << 64) | (2 << 62) | (bits & ((1 << 62) - 1)))}"


def page_of(urn: str) -> int | None:
    whole = uuid.UUID(urn.removeprefix("urn:uuid:")).int
    if whole >> 96 != 0x6C6F6F6D or whole >> 76 & 15 != 8:
        return None
    bits = (whole >> 64 & 3) << 62 | whole & ((1 << 62) - 1)
    return bits - (1 << 64) if bits >> 63 else bits


def arc_header(version: int, name: str) -> bytes:
    """Version block of an ARC file."""
    body = f"{version} 0 converter\n{' '.join(FIELDS[version])}\n\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, block: bytes, name: str = "-", at: int = 0, kind: str = "text/html") -> bytes:
    """One ARC record; what would break the line's fields is percent-encoded in the URL."""
    line = {"URL": quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]"), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(at), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of every record; raises ValueError where the file breaks the format."""
    fields: list[str] | None = None
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"ARC header line without a length: {line[:80]!r}")
        block = stream.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError("ARC record is shorter than its declared length")
        if parts[0].startswith("filedesc://"):
            head = block.decode("utf-8", "replace").split("\n")
            version = int(head[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = head[1].split() if len(head) > 1 and head[1].strip() else FIELDS[version]
            continue
        if fields is None:
            raise ValueError("ARC file without a version block")
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line with {len(parts)} fields, not {len(fields)}")
        yield dict(zip(fields, parts)), block


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, payload and header fields of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return b"", block, {}
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return head + found, payload, {k.strip().lower(): v.strip() for k, _, v in pairs}


def to_warc(header: dict, block: bytes, page_id: int | None, first: int | None = None, urn: str | None = None) -> bytes:
    """WARC/1.1 record of an ARC record; a revisit of page ``first`` if that is another page.

    A block without an HTTP head becomes a resource record of the ARC line's content type.
    """
    head, payload, _ = split_http(block)
    date = header["Archive-date"].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    revisit = first is not None and first != page_id
    body = head if revisit else block
    rows = [
        ("WARC-Type", "revisit" if revisit else "response" if head else "resource"),
        ("WARC-Record-ID", f"<{urn or record_id(page_id)}>"),
        ("WARC-Target-URI", header["URL"]),
        ("WARC-Date", stamp),
        ("WARC-IP-Address", header["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(body)}"),
        ("Content-Type", "application/http; msgtype=response" if head else header["Content-type"]),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        rows[3:3] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(first)}>")]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in rows), "\r\n"]).encode() + body + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a WARC file of gzip members, one member at a time."""
    raw = b""
    while True:
        engine, out = zlib.decompressobj(31), []
        while not engine.eof:
            raw = raw or stream.read(1 << 20)
            if not raw:
                if out:
                    raise ValueError("WARC file ends inside a record")
                return
            out.append(engine.decompress(raw))
            raw = engine.unused_data if engine.eof else b""
        record = b"".join(out)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        header = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield header, rest[: int(header["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    engine = zlib.compressobj(4, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_archives(pages: DataFrame, folder: str, date: str = "20240101000000", least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files under folder; a row (path, records) for each file.

    Every page is laid down as an ARC record first (version 1 for even page ids, 2 for odd ones) and
    goes through the converter.  Of records with equal payloads of at least ``least`` bytes, the one
    with the smallest page_id becomes a response and the others revisits of it; shorter payloads are
    all responses.  A null html is an empty payload, a null url "-".  Rows that repeat a page_id with
    the same html are written again with the same type.  A row without a page_id is a record without one: a
    revisit where a page with an id has its payload, else a response.
    """
    text = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(text).alias("digest"))
    marks = pages.select(F.col("page_id").cast("long"), F.sha1(text).alias("digest"), F.length(text).alias("bytes")).where(F.col("bytes") >= least)
    groups = cut(marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    typed = split_join(marked, groups, "digest", "copies", pages.count(), "left")

    def run(batches):
        system, at = _filesystem(folder)
        task = TaskContext.get()
        path = f"{at}/{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, records = None, 0
        pending: dict[int, list] = {1: [], 2: []}
        held = 0

        def flush():
            nonlocal out, records, held
            for version, rows in pending.items():
                if not rows:
                    continue
                arc = b"".join([arc_header(version, "pages.arc"), *(r[0] for r in rows)])
                for (header, block), (_, page, first) in zip(read_arc(io.BytesIO(arc)), rows, strict=True):
                    if out is None:
                        out = system.open_output_stream(path, compression=None)
                    out.write(_gzip(to_warc(header, block, page, first)))
                    records += 1
                rows.clear()
            held = 0

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first"))):
                page, payload = page.as_py(), (html.as_py() or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                version = 1 + ((page or 0) & 1)
                pending[version].append((arc_record(version, url.as_py(), date, head + payload), page, first.as_py()))
                held += len(payload)
                if held > CHUNK:
                    flush()
        flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

    return cut(typed.select("page_id", "url", "html", "first").mapInArrow(run, "path string, records long"))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the listed WARC files.

    payload_bytes and payload_digest are those of the full payload, also for revisits.
    """

    def run(batches):
        system, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for header, block in read_warc(stream):
                        _, payload, http = split_http(block)
                        revisit = header["WARC-Type"] == "revisit"
                        digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and sha1_base32(payload) != digest:
                            raise ValueError(f"payload digest of {header['WARC-Record-ID']} does not hold")
                        rows.append((
                            page_of(header["WARC-Record-ID"].strip("<>")), int(http["content-length"]) if revisit else len(payload),
                            digest, header["WARC-Type"], page_of(header["WARC-Refers-To"].strip("<>")) if revisit else None,
                            header["WARC-Target-URI"],
                        ))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"],
                )

    return files.select("path").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    )


def _opened(system, path: str):
    """Stream of an ARC file, gzip members (one for each record, as the format has them) or plain."""
    raw = system.open_input_stream(path, compression=None)
    first = raw.read(2)
    raw.close()
    if first != b"\x1f\x8b":
        return io.BufferedReader(system.open_input_stream(path, compression=None))
    return gzip.GzipFile(fileobj=io.BufferedReader(system.open_input_stream(path, compression=None)))


def convert_files(files: DataFrame, folder: str) -> DataFrame:
    """Convert the ARC files listed in ``files(path)``, plain or gzipped, to WARC files under ``folder``.

    One WARC file for each ARC file; returns a row (arc, path, records) for each.  Record ids are made from
    the file's path and the record's place in it, so a repeated task gives the same records.  Records
    stream through, so memory holds one at a time.  A broken file raises ValueError; an empty list gives
    an empty result.  Paths and folder are on a file system that all executors share.
    """
    folder = _uri(folder)
    made, made_at = _filesystem(folder)
    made.create_dir(made_at)

    def run(batches):
        for batch in batches:
            for arc in batch.column("path").to_pylist():
                system, at = _filesystem(_uri(arc))
                out_system, out_at = _filesystem(folder)
                name = f"{out_at}/{hashlib.sha1(arc.encode()).hexdigest()}-{uuid.uuid4().hex}.warc.gz"
                n = 0
                try:
                    with _opened(system, at) as stream, out_system.open_output_stream(name, compression=None) as out:
                        for header, block in read_arc(stream):
                            own = uuid.uuid5(uuid.NAMESPACE_URL, f"{arc}#{n}")
                            out.write(_gzip(to_warc(header, block, None, urn=f"urn:uuid:{own}")))
                            n += 1
                except (EOFError, gzip.BadGzipFile, zlib.error) as broken:
                    raise ValueError(f"{arc} is broken after record {n}: {broken}") from broken
                yield pa.RecordBatch.from_arrays([pa.array([arc]), pa.array([name]), pa.array([n], pa.int64())], ["arc", "path", "records"])

    return cut(files.select("path").mapInArrow(run, "arc string, path string, records long"))


def convert(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the archives and read them back; ``folder`` is a shared one (default: the checkpoint folder).

    An empty table gives an empty result; the written archives stay where they are.
    """
    spark = pages.sparkSession
    folder = _uri(f"{(folder or checkpoint_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}")
    system, at = _filesystem(folder)
    system.create_dir(at)
    files = write_archives(pages, folder, least=least)
    return read_archives(files.repartition(max(1, files.count())), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (CAST(('0x' || substr(p.h, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM g.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS NOT DISTINCT FROM g.first THEN NULL ELSE g.first END AS refers_to
FROM p JOIN g USING (h)
"""
