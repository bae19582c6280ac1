"""Operator 2: WARC archives, written with revisit records and read back by a salvaging reader.

Writing: every page is a gzip member of its own; of pages with equal payloads of at least `least_bytes` the one with the
least page_id is a response, the others are revisits that refer to it. A task's archives roll over at ROLL_BYTES; the
manifest, written with Spark's commit, names just those of tasks that were committed.

Reading: gzip members, of one record or many, and plain records may follow each other in a file. A record counts if its
version line and header are well formed, its length holds, its block digest agrees, and its member's stream goes on past it
or ends with the right checksum; without a block digest the whole member must inflate with the right checksum. After a
failed check the reader searches for the next version line in the inflated stream, and where that can't be read for the
next member that inflates to a version line or the next plain version line; it logs the gap of bytes between as quarantined.
Of a member's records and gaps the last has the member's length and the others 0; inner is where each begins in the inflated
stream. A reader holds two records at a time.

Nulls and empties: a null html is an empty payload; a null url has no target header; a null page_id comes after all others
and reads back as null; rows with equal page_id and payload are alike (both response or both revisit); an empty table gives
no archive and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, write_table

ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 18
#: Compressed bytes inflated at a time; what comes out of a piece is lost with it.
PIECE = 1 << 12
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MARKS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
SALTS = 16
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "path string, offset long, length long, inner long, reason string, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response, or a revisit with the same HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~' + chr(39))}")
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member; the same bytes on every run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Broken(Exception):
    pass


class Damaged(Broken):
    """A record within a stream that can still be read."""


@dataclass
class Record:
    offset: int
    length: int
    header: dict[str, str]
    block: bytes
    inner: int = 0

    @property
    def http(self) -> tuple[bytes, bytes]:
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return head, payload


@dataclass
class Gap:
    offset: int
    length: int
    reason: str
    inner: int = 0


class Source:
    """Random access to a file, in pieces."""

    def __init__(self, file):
        self._file, self.size = file, file.size()

    def at(self, offset: int, n: int = READ_BYTES) -> bytes:
        self._file.seek(offset)
        return self._file.read(n)


def _unfinished(raw: bytes) -> bool:
    """Whether the header goes on: no blank line yet, and every whole line so far is a field."""
    return b"\r\n\r\n" not in raw and all(b":" in line for line in raw.split(b"\r\n")[1:-1])


def _parse(raw: bytes) -> tuple[dict[str, str], int, int]:
    """Header fields, where the block begins, and its length."""
    if not VERSION.match(raw):
        raise Broken("no version line")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("unfinished header")
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("malformed header")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise Broken("no content length")
    return fields, end + 4, int(fields["content-length"])


def _checked(fields: dict[str, str], block: bytes, tail: bytes) -> None:
    if len(block) < int(fields["content-length"]) or tail != b"\r\n\r\n":
        raise Broken("wrong length")
    kind, _, told = fields.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and told != sha1_base32(block):
        raise Broken("wrong block digest")


def _inflate(source: Source, at: int, least: int) -> bytes:
    """A member's first bytes."""
    m = _Member(source, at)
    m.fill(least)
    return bytes(m.buffer)


class _Member:
    """The inflated stream of a gzip member from `base` on, as far as asked for."""

    def __init__(self, source: Source, at: int):
        self._source, self._pos, self._raw, self._z = source, at, b"", zlib.decompressobj(31)
        self.buffer, self.base, self.end = bytearray(), 0, at

    def fill(self, n: int) -> bool:
        """Whether n bytes are left; raises if the member breaks off before."""
        while len(self.buffer) < n and not self._z.eof:
            if not self._raw:
                self._raw = self._source.at(self._pos)
                if not self._raw:
                    raise Broken("cut short")
                self._pos += len(self._raw)
            piece, self._raw = self._raw[:PIECE], self._raw[PIECE:]
            try:
                self.buffer += self._z.decompress(piece)
            except zlib.error as e:
                raise Broken(f"gzip: {str(e)[:60]}") from None
            if self._z.eof:
                self.end = self._pos - len(self._raw) - len(self._z.unused_data)
        return len(self.buffer) >= n

    def drop(self, n: int) -> None:
        del self.buffer[:n]
        self.base += n

    def seek_version(self) -> None:
        """Goes on to the next version line after the first byte, or to the end."""
        self.drop(1)
        while self.fill(10):
            found = self.buffer.find(b"WARC/1.")
            if found < 0:
                self.drop(len(self.buffer) - 9)
            else:
                self.drop(found)
                if self.fill(10) and VERSION.match(self.buffer):
                    return
                self.drop(1)
        self.drop(len(self.buffer))


def _intact(source: Source, at: int) -> bool:
    m = _Member(source, at)
    try:
        while m.fill(1):
            m.drop(len(m.buffer))
    except Broken:
        return False
    return True


def _inner(source: Source, m: _Member, at: int) -> Record:
    """The record that begins where the stream stands; goes past it if it is whole."""
    while _unfinished(m.buffer) and m.fill(len(m.buffer) + 1):
        pass
    try:
        fields, begin, n = _parse(bytes(m.buffer))
    except Broken as e:
        raise Damaged(str(e)) from None
    m.fill(begin + n + 4)
    block = bytes(m.buffer[begin : begin + n])
    try:
        _checked(fields, block, bytes(m.buffer[begin + n : begin + n + 4]))
    except Broken as e:
        raise Damaged(str(e)) from None
    if not fields.get("warc-block-digest", "").lower().startswith("sha1:") and not _intact(source, at):
        raise Damaged("no block digest in a broken member")
    record = Record(at, 0, fields, block, m.base)
    m.drop(begin + n + 4)
    return record


def _zipped(source: Source, at: int) -> Iterator[Record | Gap]:
    """Records and gaps of the member at `at`, and returns where to go on."""
    m, last = _Member(source, at), None
    try:
        while m.fill(1):
            if last is not None:
                yield last
            try:
                last = _inner(source, m, at)
            except Damaged as e:
                last = Gap(at, 0, str(e), m.base)
                m.seek_version()
    except Broken as e:
        after = _next(source, at + 1)
        yield Gap(at, after - at, str(e), last.inner if last else 0)
        return after
    last = last or Gap(at, 0, "empty member")
    last.length = m.end - at
    yield last
    return m.end


def _plain(source: Source, at: int) -> Record:
    raw = source.at(at)
    while _unfinished(raw) and at + len(raw) < source.size:
        raw += source.at(at + len(raw))
    fields, begin, n = _parse(raw)
    if at + begin + n + 4 > source.size:
        raise Broken("cut short")
    whole = source.at(at + begin, n + 4)
    _checked(fields, whole[:n], whole[n:])
    return Record(at, begin + n + 4, fields, whole[:n])


def _next(source: Source, at: int) -> int:
    """Where the next member with a version line, or the next plain version line, begins; else the end of the file."""
    while at < source.size:
        for mark in MARKS.finditer(source.at(at, READ_BYTES + 16)):
            found = at + mark.start()
            try:
                if VERSION.match(_inflate(source, found, 16) if mark[0][:1] == b"\x1f" else source.at(found, 10)):
                    return found
            except Broken:
                pass
        at += READ_BYTES
    return source.size


def salvage(source: Source) -> Iterator[Record | Gap]:
    """All records that pass the checks and all gaps between them, in order; together they cover the file."""
    at = 0
    while at < source.size:
        if source.at(at, 2) == b"\x1f\x8b":
            at = yield from _zipped(source, at)
            continue
        try:
            record = _plain(source, at)
        except Broken as e:
            after = _next(source, at + 1)
            yield Gap(at, after - at, str(e))
            at = after
        else:
            yield record
            at += record.length


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to, the page_id whose equal payload stands for this one's (null: its own)."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"_sha": F.sha1("payload"), "_salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))})
    firsts = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    spread = firsts.select("_sha", "_first", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))).alias("_salt"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(spread, ["_sha", "_salt"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and returns their manifest, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        out, done, n, size = None, [], 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((name, n, size))

        name = ""
        for b in batches:
            for page, url, payload, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = member(make_record(f"urn:page:{page.as_py()}", url.as_py(), payload.as_py(), f"urn:page:{refers.as_py()}" if refers.is_valid else None))
                if out is None or size + len(data) > ROLL_BYTES:
                    close()
                    name = f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, n, size = where.open_output_stream(name, compression=None), 0, 0
                out.write(data)
                n, size = n + 1, size + len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0].rsplit('/', 1)[1]}" for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return write_table(mark_revisits(pages, least_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in `paths` (path); a gap has a reason and no record_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, base = _open(path)
                held, size = [], 0
                with where.open_input_file(base) as file:
                    for found in salvage(Source(file)):
                        held.append(_row(path, found, with_payload))
                        size += len(held[-1][-1] or b"") + 200
                        if size > 8 << 20:
                            yield _batch(held)
                            held, size = [], 0
                if held:
                    yield _batch(held)

    dealt = paths.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return dealt.mapInArrow(run, RECORDS)


def _row(path: str, found: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(found, Gap):
        return (path, found.offset, found.length, found.inner, found.reason, *[None] * 7)
    h = found.header
    head, payload = found.http
    kind, refers = h.get("warc-type"), h.get("warc-refers-to")
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        n, digest, payload = int(told[1]) if told else None, h.get("warc-payload-digest", "").rpartition(":")[2] or None, None
    else:
        n, digest = len(payload), sha1_base32(payload)
    return (path, found.offset, found.length, found.inner, None, h.get("warc-record-id", "").strip("<>"), kind, refers.strip("<>") if refers else None, h.get("warc-target-uri"), n, digest, payload if with_payload else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_roundtrip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: one row per page."""
    spark = pages.sparkSession
    manifest = write_archives(pages, fresh_path(spark, "warc"), least_bytes)
    read = read_archives(spark, manifest, with_payload=False).filter("reason IS NULL")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))


#: DuckDB SQL of the query: digests, and who stands for whom.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', x[i]) - 1), 4, '0')), 'string_agg', '') AS bits FROM f)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_reduce(list_transform(range(1, 6), lambda j: CAST(bits[i * 5 + j] AS INTEGER)), lambda s, d: 2 * s + d)]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
