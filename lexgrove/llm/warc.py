"""WARC archives: an index first, then coalesced byte-range reads of the records that are wanted.

Files are read through pyarrow file systems, so that a folder may be local or in any store that pyarrow knows by its address: gzip files
with a member for each record, as archives are, or plain ones. Of `write`'s own records all fields come back; archives of other tools
may have records of any type, any record ids, and payload digests of other kinds or none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.shared import filesystem

INDEX = "path string, offset long, length long, page_id long, url string, digest string, type string, record_id string, date string"
GAP, RANGE, READ = 64 << 10, 16 << 20, 1 << 20


KNOWN = ("md5", "sha1", "sha256", "sha512")


def encode(page_id: int | None, url: str | None, html: str | None) -> tuple[bytes, str]:
    """One gzip member with a response record, and the SHA-256 of its payload. A null has no header, a null payload a marker."""
    body = (html or "").encode()
    digest = hashlib.sha256(body).hexdigest()
    head = ["WARC/1.1", "WARC-Type: response", "X-Lexgrove: 1", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if html is None:
        head.append("WARC-Truncated: unspecified")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head.append(f"Content-Length: {len(http) + len(body)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http + body + b"\r\n\r\n") + z.flush(), digest


def dechunk(body: bytes) -> bytes:
    """The content of a body in HTTP chunks; what isn't in chunks is returned as it is."""
    out, at = [], 0
    while True:
        line, _, _ = body[at:].partition(b"\r\n")
        try:
            n = int(line.split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        at += len(line) + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2


def inflate(body: bytes, coding: str) -> bytes:
    """Content under its HTTP content coding; unknown codings and damaged content are returned as they are."""
    try:
        if coding in ("gzip", "x-gzip"):
            return zlib.decompressobj(47).decompress(body)
        if coding == "deflate":
            return zlib.decompressobj(-15 if body[:1] and body[0] & 15 != 8 else 15).decompress(body)
    except zlib.error:
        pass
    return body


def same_digest(digest: str, body: bytes) -> bool:
    """Whether a digest (sha256 in hexadecimal, or algorithm:value in hexadecimal or base 32) is that of body. Unknown algorithms can't tell."""
    kind, _, value = digest.rpartition(":")
    kind = (kind or "sha256").lower().replace("-", "")
    if kind not in KNOWN:
        return True
    found = hashlib.new(kind, body).digest()
    return value.lower() == found.hex() or value.rstrip("=").upper() == base64.b32encode(found).decode().rstrip("=")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with a blank continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip() if last != "warc-target-uri" else value.removeprefix(" ")
    return out


def decode(record: bytes) -> dict:
    """Headers and payload of one record.

    page_id is the number of an id <urn:page:N>, null for all others; digest is what the record says, of the payload or else of
    the block, in hexadecimal alone if it is SHA-256, and the SHA-256 of the payload if it says nothing. html is null for what has no payload (no
    response, resource or conversion) and for truncated records without a byte; raw is the payload as it was sent.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n")[1:])
    block = rest[: int(fields.get("content-length") or len(rest))]
    kind, body, http = fields.get("warc-type", ""), block, {}
    if kind in ("response", "request", "revisit") and block[:5].upper() == b"HTTP/":
        top, _, body = block.partition(b"\r\n\r\n")
        http = _fields(top.split(b"\r\n")[1:])
    if "chunked" in http.get("transfer-encoding", "").lower():
        plain = dechunk(body)
    else:
        plain = body
    url, rid = fields.get("warc-target-uri"), fields.get("warc-record-id")
    own = re.fullmatch(r"<urn:page:(-?\d+)>", rid or "")
    if url is not None:
        url = url.removeprefix("<").removesuffix(">") if not own and url[:1] == "<" else url
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if own or "x-lexgrove" in fields else url
    digest = fields.get("warc-payload-digest")
    covered = [body, plain]
    if digest is None and fields.get("warc-block-digest"):
        digest, covered = fields["warc-block-digest"], [block]
    if digest is None:
        digest = hashlib.sha256(body).hexdigest()
    if digest.lower().startswith("sha256:") and len(digest) == 71:
        digest = digest[7:].lower()
    charset = re.search(r"charset=[\"']?([\w.:-]+)", http.get("content-type", fields.get("content-type", "")), re.I)
    content = inflate(plain, http.get("content-encoding", "").lower())
    try:
        html = content.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = content.decode("utf-8", "replace")
    none = kind not in ("response", "resource", "conversion") or ("warc-truncated" in fields and not body)
    return {
        "page_id": int(own[1]) if own else None, "url": url, "digest": digest, "type": kind, "record_id": rid, "date": fields.get("warc-date"),
        "html": None if none else html, "right": "warc-truncated" in fields or kind == "revisit" or any(same_digest(digest, x) for x in covered),
    }


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files in `folder`, one for each partition; (path, records) of each file.

    Every row is a record, repeated ones too; payloads of any length, nulls and empty values come back as they are. Other columns are
    ignored, whatever their names. An empty table gives no file.

    A file's name is new for each attempt, and only files of attempts that succeed are listed, so a task that is
    run again leaves no half file in the result. Run it once (write or checkpoint the result): each run writes files.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        path, n, out = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(filesystem(path)[1], compression=None)
                out.write(encode(*r)[0])
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "records"])

    return src.mapInArrow(run, "path string, records long")


def members(read, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file, in one pass with bounded reads; read(offset, bytes)."""
    at = start = 0
    buf, z, got = b"", zlib.decompressobj(31), []
    while True:
        if not buf:
            if at >= size:
                break
            buf = read(at, min(READ, size - at))
            at += len(buf)
        got.append(z.decompress(buf))
        buf = z.unused_data if z.eof else b""
        if z.eof:
            end = at - len(buf)
            yield start, end - start, b"".join(got)
            start, z, got = end, zlib.decompressobj(31), []


def plain_records(read, size: int) -> Iterator[tuple[int, int, bytes]]:
    """As members, of a file that isn't compressed: a record ends where its Content-Length says."""
    at = 0
    while at < size:
        buf, n = b"", 1 << 14
        while b"\r\n\r\n" not in buf and len(buf) < size - at:
            buf, n = read(at, min(n, size - at)), 2 * n
        skip = len(buf) - len(buf.lstrip(b"\r\n"))
        if skip == len(buf):
            return
        head, mark, _ = buf[skip:].partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise ValueError(f"no record starts at byte {at + skip}")
        length = len(head) + 4 + int(_fields(head.split(b"\r\n")[1:]).get("content-length", 0))
        yield at + skip, length, read(at + skip, min(length, size - at - skip))
        at += skip + length


def records(read, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the records of a file, compressed or plain."""
    return members(read, size) if read(0, min(2, size)) == b"\x1f\x8b" else plain_records(read, size)


def index(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, offset, length, page_id, url, digest, type, record_id, date) of every record of files(path), whatever its type.

    A file that is named twice is indexed twice. No file gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows = []
                with fs.open_input_file(at) as f:
                    for offset, length, record in records(lambda o, n, f=f: f.read_at(n, o), f.size()):
                        r = decode(record)
                        rows.append((path, offset, length, *(r[c] for c in ("page_id", "url", "digest", "type", "record_id", "date"))))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").where("path is not null").repartition(parts, "path").mapInArrow(run, INDEX)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])


def select(idx: DataFrame) -> DataFrame:
    """One record for each digest: of equal payloads the one with the smallest url, then page_id (nulls last), then place.

    Only records that have a payload of their own are chosen: responses, resources and conversions."""
    idx = idx.where(F.col("type").isin("response", "resource", "conversion"))
    order = W.partitionBy("digest").orderBy(F.asc_nulls_last("url"), F.asc_nulls_last("page_id"), "path", "offset")
    return idx.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def coalesce(offset: np.ndarray, length: np.ndarray, gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, int, int]]:
    """(begin, end, first record, last record + 1) of reads over records sorted by offset: neighbours with at most `gap`
    bytes between them share a read of at most `most` bytes (a longer record is a read of its own)."""
    out: list[list[int]] = []
    for i, (o, n) in enumerate(zip(offset.tolist(), length.tolist(), strict=True)):
        if out and o - out[-1][1] <= gap and max(o + n, out[-1][1]) - out[-1][0] <= most:
            out[-1][1], out[-1][3] = max(out[-1][1], o + n), i + 1
        else:
            out.append([o, o + n, i, i + 1])
    return [tuple(x) for x in out]


def _unpacked(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def read(wanted: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """page_id, url, digest, html of the records of wanted(path, offset, length).

    Records of a file are read in order of offset by as few ranges as `gap` and `most` allow. A payload that
    doesn't match its digest raises an error; truncated records and digests of unknown kinds aren't compared. Rows that repeat a place are
    read as often. Other columns are ignored, whatever their names; an empty table gives no row.
    """
    spark = wanted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = np.array(batch.column(0).to_pylist(), dtype=object)
            offset, length = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            edge = np.flatnonzero(np.append(True, path[1:] != path[:-1])) if len(path) else []
            for a, z in zip(edge, [*edge[1:], len(path)], strict=True):
                fs, at = filesystem(path[a])
                with fs.open_input_file(at) as f:
                    for begin, end, i, j in coalesce(offset[a:z], length[a:z], gap, most):
                        raw = f.read_at(end - begin, begin)
                        rows = [decode(_unpacked(raw[o - begin : o - begin + n])) for o, n in zip(offset[a + i : a + j].tolist(), length[a + i : a + j].tolist(), strict=True)]
                        for r in rows:
                            if not r["right"]:
                                raise ValueError(f"{path[a]}: a record doesn't match its digest {r['digest']}")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[c] for r in rows], k) for c, k in (("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("html", pa.string()))],
                            names=["page_id", "url", "digest", "html"],
                        )

    return (
        wanted.select("path", "offset", "length")
        .repartition(parts, "path")
        .sortWithinPartitions("path", "offset")
        .mapInArrow(run, "page_id long, url string, digest string, html string")
    )
