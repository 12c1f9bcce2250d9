"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing: payloads are digested in the plan; pre-aggregated digests name the first page of each group
of equal payloads, the others become revisits. Records go through Spark's own text writer, so any
file system that Spark reaches will do. That writer ends each row with a newline, which is the last
byte of a record (``\\r\\n\\r\\n``), or of the skippable frame that follows each zstd member.

Reading: an archive is a chain of members (zstd frame, gzip member or plain record). A member counts
only if it can be decompressed, holds one whole record and its digests agree. Where a check fails the
reader looks for the next place from which a member or version line is valid, reports the bytes
between as a quarantined gap, and goes on from there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, small_batches, table, with_least

RECORDS_PER_FILE = 1000
SMALL_RECORD = 1 << 18  # bytes of payload and url up to which a file has that many; half as many for each doubling
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ZSTD, GZIP = b"\x28\xb5\x2f\xfd", b"\x1f\x8b\x08"
SKIP = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18", re.DOTALL)
START = re.compile(rb"\x28\xb5\x2f\xfd|\x1f\x8b\x08|WARC/1\.[01]\r\n")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base32(hashlib.sha1(payload).digest())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Record(NamedTuple):
    kind: str
    page_id: int | None
    url: str | None
    refers_to: int | None
    payload: bytes | None  # None: a revisit
    payload_bytes: int
    payload_digest: str


class Damaged(ValueError):
    pass


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that begins at ``at``, and where it ends. Raises Damaged if any check fails."""
    if data[at : at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        raise Damaged("no version line")
    head, pos = {}, at + 10
    # of any length; a line that is no field ends the search
    while (stop := data.find(b"\r\n", pos)) != pos:
        if stop < 0:
            raise Damaged("header without end")
        name, colon, value = data[pos:stop].decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header line without colon")
        head[name.strip().lower()] = value.strip()
        pos = stop + 2
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    begin, end = stop + 2, stop + 2 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record without end")
    block = data[begin:end]
    if (want := head.get("warc-block-digest")) and want != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise Damaged("block digest differs")
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    payload, size = None, head.get("x-payload-length", "0")
    if kind == "response":
        _, blank, payload = block.partition(b"\r\n\r\n")
        own = base32(hashlib.sha1(payload).digest())
        if not blank or digest not in ("", own):
            raise Damaged("payload digest differs")
        digest, size = own, str(len(payload))
    elif not size.isdigit():
        raise Damaged("no payload length")
    return Record(kind, _page(head.get("warc-record-id")), head.get("warc-target-uri"), _page(head.get("warc-refers-to")), payload, int(size), digest), end + 4


def parse_member(data: bytes, at: int) -> tuple[Record | None, int]:
    """The member that begins at ``at`` (None: it holds no record by design), and where it ends."""
    if SKIP.match(data, at):
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if end > len(data):
            raise Damaged("frame without end")
        return None, end
    if data.startswith(b"WARC/", at):
        return parse_record(data, at)
    try:
        if data.startswith(ZSTD, at):
            d = zstandard.ZstdDecompressor().decompressobj()
        elif data.startswith(GZIP, at):
            d = zlib.decompressobj(31)
        else:
            raise Damaged("no member")
        parts, pos = [], at
        while not d.eof and pos < len(data):
            parts.append(d.decompress(data[pos : pos + 65536]))
            pos += 65536
    except (zlib.error, zstandard.ZstdError) as e:
        raise Damaged("member can't be decompressed") from e
    if not d.eof:
        raise Damaged("member without end")
    raw = b"".join(parts)
    record, end = parse_record(raw)
    if end != len(raw):
        raise Damaged("bytes after the record")
    return record, min(pos, len(data)) - len(d.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record or the reason for which these bytes are quarantined), in order, without overlap."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            record, end = parse_member(data, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            found = START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            if record is None:  # four bytes say little; only records end a gap
                found = START.search(data, at + 1)
                at = found.start() if found else len(data)
                continue
            yield bad, at - bad, why
            bad = None
        if record is not None:
            yield at, end - at, record
        at = end
    if bad is not None:
        yield bad, len(data) - bad, why


def _records(compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        for batch in batches:
            rows = []
            for page, url, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = build_record(page, url, payload, first)
                # without its last byte, which the writer adds
                rows.append(pack(raw) + b"\x50\x2a\x4d\x18\x01\x00\x00\x00" if compress else raw[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    compress: bool = True,
    per_file: int = RECORDS_PER_FILE,
) -> None:
    """A record for every row of ``pages``, in files below ``path`` of at most ``per_file`` records.

    Readers take a file whole, so files are bounded by bytes too: pages of more than ``SMALL_RECORD`` bytes are
    written apart, by size, with fewer to a file (down to one), in a pass for each doubling that occurs.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least
    ``least_bytes`` bytes the smallest id is a response and the others are revisits that refer to it;
    smaller ones are all responses. Rows that repeat the smallest id are all responses. A page
    without id is a response. An empty table gives no records; other columns are ignored. A header line can't hold
    line ends, nor white space at its ends: those of a URL are left out of its record.
    """
    spark, payload = small_batches(pages.sparkSession), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    size = F.length("payload") + F.coalesce(F.octet_length("url"), F.lit(0))
    doublings = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) / SMALL_RECORD)), F.lit(0)).cast("int")
    may_refer = F.col("page").isNotNull() & (F.length("payload") >= least_bytes)
    digests, digest_path = table(rows.select(F.when(may_refer, F.col("page")).alias("page"), F.sha1("payload").alias("sha1"), doublings.alias("doublings")), "warc-digests")
    known = digests.where("page is not null").select("page", "sha1")
    firsts = with_least(known, ["sha1"], "page").where("page <> least")
    again, again_path = table(firsts.select("page", "sha1", F.col("least").alias("first")).distinct(), "warc-revisits")
    present = sorted(r[0] for r in digests.select("doublings").distinct().collect())  # a row for each doubling, 31 at most
    for k in present or [0]:
        of_size = rows.where(doublings == k) if len(present) > 1 else rows
        marked = of_size.withColumn("sha1", F.sha1("payload")).join(again.hint("merge"), ["page", "sha1"], "left").select("page", "url", "payload", "first")
        made = marked.mapInArrow(_records(compress), "value binary").select(F.col("value").cast("string"))
        made.write.option("maxRecordsPerFile", max(1, per_file >> k)).option("lineSep", "\n").text(f"{path}/size-{k}")
    forget(spark, [digest_path, again_path])


SCHEMA = "path string, offset long, length long, gap string, kind string, page_id long, url string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _salvaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            path, rows = batch.column(0)[k].as_py(), []
            for offset, length, got in salvage(batch.column(1)[k].as_py() or b""):
                if isinstance(got, str):
                    rows.append((path, offset, length, got, *[None] * 7))
                else:
                    rows.append((path, offset, length, None, *got))
                if len(rows) >= 200:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every quarantined gap (``gap`` says why; null: a record) of the files below ``path``.

    One row each: file, offset, length, and for records kind, page, url, page referred to, payload
    (null: a revisit), and size and SHA-1 (base32) of the full payload. Records of damaged files
    that come after the damage are returned. A file is read whole, so files should be bounded, as
    those of ``write_archives`` are.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, SCHEMA)
