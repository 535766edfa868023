"""WARC archives: a writer, and a reader that salvages what damage has left.

Writer: one gzip member a record; records are gathered into archives of about ARCHIVE bytes, each
a binary cell of a table in the shared folder. Payloads of at least ``least`` bytes that are equal are
stored once: the record with the largest id is the response, the others are revisit records that
refer to it.

Reader: walks an archive (members of gzip, or plain records). A record counts only if its version line,
header block, lengths, closing line breaks and those digests that it states (they are optional in the format; the
writer states both) are right. After a failed check it
searches on from the next byte for a place where a valid member or version line starts, and logs the
bytes in between as a quarantined gap with the reason of the failure. Within what a member holds, and what one cut off
at the archive's end still gives (but for a record that ends just where it does), it searches on alike; a whole member of which a record failed is logged as
one gap, though its other records count. A member that fails its own checksum gives nothing, since no digest
covers the headers of its records. Valid records of other types than response and revisit are skipped without a gap.

Scale: payloads are not moved. The digests that several pages have are joined with the pages as ids; while they are few
they are broadcast, so that a page that a third of the rows share stays where it is read; beyond that the join splits
such a key (AQE).

Defined results: a null payload counts as empty; null ids and URLs leave their header out and are
read back as null; among equal payloads a null id is smaller than any other, and all rows that
share the largest id are responses; repeated rows are repeated records; an empty table gives no
archives and an empty result; only the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, few, lean, written

#: Packed bytes per archive, least payload that is stored once, zlib level.
ARCHIVE, LEAST, LEVEL = 4 << 20, 1000, 6
VERSION = b"WARC/1.1"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """The bytes of a response record, or, with refers_to, of a revisit record."""
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP % len(payload) + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("WARC-Block-Digest", _sha1(block)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page is not None:
        lines.append(("X-Page-ID", str(page)))
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    if revisit:
        lines += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    lines.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Damage(ValueError):
    """A record that fails a check."""


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block, and the place after the record that starts at ``at``."""
    if not data.startswith(b"WARC/1.", at):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("headers do not end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damage("no length")
    block = data[end + 4 : (stop := end + 4 + int(length))]
    if len(block) < int(length) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("wrong length")
    if (digest := headers.get("warc-block-digest")) and digest != _sha1(block):
        raise Damage("block digest differs")
    return headers, block, stop + 4


def page_of(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, str, int, str, int | None, bytes | None] | None:
    """page_id, url, record_type, payload_bytes, payload_digest (hex), refers_to, payload; None for other types of record."""
    kind = headers.get("warc-type", "")
    if not kind:
        raise Damage("no record type")
    if kind not in ("response", "revisit"):
        return None
    payload = None
    stated = headers.get("warc-payload-digest", "")
    if kind == "response":
        head, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise Damage("no HTTP head")
        if stated and stated != _sha1(payload):
            raise Damage("payload digest differs")
    number = lambda name: int(headers[name]) if name in headers else None
    try:
        digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else hashlib.sha1(payload or b"").hexdigest()
        size = len(payload) if payload is not None else number("x-payload-length") or 0
        return number("x-page-id"), headers.get("warc-target-uri"), kind, size, digest, number("x-refers-to-page"), payload
    except ValueError as e:
        raise Damage(f"bad header value: {e}") from None


def _member_at(data: bytes) -> tuple[bytes, int | None]:
    """What the member that data starts with holds, and its length; None if it is cut."""
    unpack = zlib.decompressobj(31)
    try:
        out = unpack.decompress(data)
    except zlib.error as e:
        raise Damage(f"bad member: {e}") from None
    return out, len(data) - len(unpack.unused_data) if unpack.eof else None


def _packed_length(data: bytes, size: int) -> int:
    """How many bytes of a member give its first size bytes unpacked (up to 255 more)."""
    unpack, at = zlib.decompressobj(31), 0
    while size > 0 and at < len(data):
        size -= len(unpack.decompress(data[at : at + 256]))
        at += 256
    return min(at, len(data))


#: What may start a record: a gzip member, or a version line.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
#: A member is unpacked from a window of so many bytes first, so that walking an archive stays linear.
_WINDOW = 1 << 15


def _inside(data: bytes, cut: bool) -> tuple[list[tuple], int, str]:
    """The pages of the valid records of a member's bytes, where the last of them ends, and the first failure.
    In a cut member a record counts only if more was unpacked after it."""
    pages: list[tuple] = []
    at, stop, why = 0, 0, ""
    while 0 <= at < len(data):
        try:
            headers, block, after = parse(data, at)
            page = page_of(headers, block)
            if cut and after == len(data):
                raise Damage("cut member")
        except Damage as e:
            why = why or str(e)
            at = data.find(b"WARC/1.", at + 1)
            continue
        pages += [page] if page else []
        at = stop = after
    return pages, stop, why


def _read_at(data: bytes, at: int) -> tuple[list[tuple], int, tuple[int, str] | None]:
    """The pages of the member or plain record at ``at``, the place after it, and where a gap starts and why."""
    if data.startswith(b"\x1f\x8b", at):
        window = _WINDOW
        while True:
            piece = data[at : at + window]
            inside, length = _member_at(piece)
            if length is not None or at + window >= len(data):
                break
            window *= 8
        pages, stop, why = _inside(inside, length is None)
        if length is None:
            if not stop:
                raise Damage("cut member")
            after = at + _packed_length(piece, stop)
            return pages, after, (after if after < len(data) else at, "cut member")
        if why and not stop:
            raise Damage(why)
        return pages, at + length, (at, why) if why else None
    headers, block, stop = parse(data, at)
    page = page_of(headers, block)
    return [page] if page else [], stop, None


def salvage(data: bytes) -> tuple[list[tuple], list[tuple[int, int, str]]]:
    """Pages of the valid records, and the gaps between them as (from, to, reason)."""
    pages: list[tuple] = []
    gaps: list[tuple[int, int, str]] = []
    at, began, why = 0, None, ""
    while at < len(data):
        try:
            found, after, lost = _read_at(data, at)
        except Damage as e:
            if began is None:
                began, why = at, str(e)
            start = _START.search(data, at + 1)
            at = start.start() if start else len(data)
            continue
        if began is not None:
            gaps.append((began, at, why))
            began = None
        if lost:
            began, why = lost
        pages += found
        at = after
    if began is not None:
        gaps.append((began, len(data), why))
    return pages, gaps


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    size = 0
    out = lambda: pa.record_batch([pa.array([b"".join(parts)], pa.binary())], names=["content"])
    for batch in batches:
        for page, url, html, digest, refers in zip(*[batch.column(i) for i in range(5)], strict=True):
            parts.append(member(record(page.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers.as_py())))
            size += len(parts[-1])
            if size >= ARCHIVE:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (binary), digest (binary SHA-1) and refers_to: null for responses."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    base = base.withColumn("digest", F.unhex(F.sha1("html")))
    large = F.octet_length("html") >= least
    kept = base.where(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null").select(F.col("digest").alias("_digest"), "kept")
    kept = few(written(kept, "warc-kept"))
    joined = base.join(kept, large & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per archive: content (binary), written to the shared folder and read back."""
    bounded_batches(pages.sparkSession)
    packed = roles(pages, least).mapInArrow(lean(_pack), "content binary")
    return written(packed, "warc", "uncompressed")


PAGES = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
GAPS = "gap_from bigint, gap_to bigint, reason string"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def read(archives: DataFrame, content: str = "content", payload: bool = False, strict: bool = False) -> DataFrame:
    """PAGES (and payload, null for revisits) of all records that could be read. Also takes what
    Spark's binaryFile source gives. strict: damage is an error; else it is only in ``gaps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES.split(", ")] + ["payload"] * payload
        for batch in batches:
            for value in batch.column(0):
                found, lost = salvage(value.as_py()) if value.is_valid else ([], [])
                if strict and lost:
                    raise Damage(f"bytes {lost[0][0]} to {lost[0][1]} of an archive: {lost[0][2]}")
                yield pa.record_batch([pa.array([r[i] for r in found], _KINDS[i]) for i in range(len(names))], names=names)

    return archives.select(content).mapInArrow(lean(run), PAGES + ", payload binary" * payload)


def gaps(archives: DataFrame, name: Column | str = "path", content: str = "content") -> DataFrame:
    """The quarantine log: archive, GAPS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in zip(batch.column(0), batch.column(1), strict=True):
                found = salvage(value.as_py())[1] if value.is_valid else []
                columns = [pa.array([at.as_py()] * len(found), pa.string())] + [pa.array([g[i] for g in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.record_batch(columns, names=["archive", "gap_from", "gap_to", "reason"])

    named = F.col(name) if isinstance(name, str) else name
    return archives.select(named.cast("string").alias("archive"), content).mapInArrow(run, "archive string, " + GAPS)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (
  SELECT digest, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN k.kept IS NULL OR k.kept IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.kept IS NOT DISTINCT FROM p.page_id THEN NULL ELSE k.kept END AS refers_to
FROM p LEFT JOIN k ON p.n >= 1000 AND p.digest = k.digest
"""
