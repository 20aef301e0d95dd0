"""WARC archives: one record for each row, and a reader that salvages damaged files.

Writing. Of rows with equal payloads of ``min_bytes`` or more, told by SHA-256
and counted where they are, the one with the greatest id is a ``response`` and
the others are ``revisit`` records that refer to it and hold the head of the
response only. Each record is a gzip member of its own, with digests of its
block and payload. Spark's text writer puts the members into files, with an
empty member as its line end, so a file is what any gzip or WARC reader takes;
tasks that are lost are written anew, and the folder is committed as a whole.

Reading. Spark's text reader cuts files at every place that looks like the
start of a member (or, in plain files, of a version line), wherever its own
splits fall; the pieces of a file come together in one task, in order, and flow
through it. A piece is tried as a record, together with the pieces after it as
far as it asks for them, since compressed data and payloads can look like a
start. What must hold: the checksum of the member, the version line, the
header, the stated length, the empty lines at the end, the digests of block and
payload. If anything fails, one piece is set aside and the next start is tried,
so that all whole records after a damage are found again. The bytes between
them are logged as gaps: rows with the file, the place, the length and the
first ``fault``. A record that would need more than ``max_record`` bytes is a
fault. Files named ``.gz`` would be unpacked by Spark's reader, and a damaged
one not at all: they are read as a whole, so one must fit in a worker.

Nulls and odd input: a null payload is an empty one. A null id is written and
read back as null, and comes after all others. Rows that repeat the greatest id
of their payload are each a response. A null url leaves its header out; control
characters in urls are percent-encoded. An empty table gives an archive without
records. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of a gzip member, and of a version line.
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a record, head and block, that are tried at most.
MAX_RECORD = 256 << 20
#: Bytes of a record's header at most.
MAX_HEAD = 1 << 20
#: Bytes of a batch of records.
BATCH = 8 << 20

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-row:"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}

FIELDS = "file string, offset bigint, length bigint, fault string, record_type string, record_id string, refers_to string, uri string, payload_bytes bigint, payload_digest string, payload binary"


def _packed(data: bytes, level: int = 6) -> bytes:
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


#: Stands between members.
_EMPTY = _packed(b"")


# -- writing ------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}"


def record(row_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, date: str) -> bytes:
    """A record without the empty lines that end it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if row_id is None else row_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <{URN}{'' if keeper is None else keeper}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def marked(rows: DataFrame, min_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows as id, url, payload, keeper (the greatest id of an equal payload) and whether they revisit it."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    copies = rows.filter(F.length("payload") >= min_bytes).groupBy("key").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    joined = rows.join(copies.filter("n > 1"), "key", "left")
    return joined.select("id", "url", "payload", "keeper", (F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))).alias("revisit"))


def write_archives(
    rows: DataFrame, path: str, min_bytes: int = 1000, compress: bool = True, date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> None:
    """A record for each row, in a new folder of archives."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("id", "url", "payload", "keeper", "revisit")]
                data = record(*row, date)
                out.append(_packed(data + b"\r\n\r\n") if compress else data)
                size += len(out[-1])
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = marked(rows, min_bytes, id_col, url_col, payload_col).mapInArrow(pack, "value binary")
    end = _EMPTY if compress else b"\r\n\r\n"
    records.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path)


# -- reading ------------------------------------------------------------------


class Record(NamedTuple):
    record_type: str | None
    record_id: str | None
    refers_to: str | None
    uri: str | None
    payload_bytes: int | None
    payload_digest: str | None
    payload: bytes | None


class Found(NamedTuple):
    """A record, or a gap with its fault."""

    offset: int
    length: int
    fault: str | None
    record: Record | None


class Taken(NamedTuple):
    """What stands at the start of some bytes, and how many of them it is."""

    found: list[tuple[str | None, Record | None]]
    used: int


class More(NamedTuple):
    """The bytes are too few; at least so many are needed."""

    needed: int


class Bad(NamedTuple):
    fault: str


def _digest_fails(stated: str | None, data: bytes) -> bool:
    """Whether a stated digest is of other bytes; algorithms that are not known tell nothing."""
    name, _, value = (stated or "").partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return False
    real = hashlib.new(name.lower(), data, usedforsecurity=False)
    return value.lower() != real.hexdigest() and value.upper().rstrip("=") != base64.b32encode(real.digest()).decode().rstrip("=")


def _fields(head: bytes) -> dict[str, str] | None:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        out.setdefault(name.strip().lower(), value.strip())
    return out


def take_record(data: bytes, max_record: int = MAX_RECORD) -> Taken | More | Bad:
    """The record at the start of ``data``."""
    if not re.match(rb"WARC/1\.\d+\r\n", data):
        return Bad("no version line")
    end = data.find(b"\r\n\r\n", 0, MAX_HEAD)
    if end < 0:
        return More(len(data) + 1) if len(data) < MAX_HEAD else Bad("header without end")
    fields = _fields(data[:end])
    if fields is None or not fields.keys() >= MANDATORY or not re.fullmatch("[0-9]{1,18}", fields["content-length"]):
        return Bad("no header")
    a, b = end + 4, end + 4 + int(fields["content-length"])
    if b > max_record:
        return Bad("too long")
    if len(data) < b + 4:
        return More(b + 4)
    if data[b : b + 4] != b"\r\n\r\n":
        return Bad("length")
    block = data[a:b]
    if _digest_fails(fields.get("warc-block-digest"), block):
        return Bad("block digest")
    kind = fields.get("warc-type")
    payload: bytes | None = block
    size: int | None = len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            stated = (_fields(head) or {}).get("content-length", "")
            size = int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None
    if kind == "revisit":
        name, _, value = fields.get("warc-payload-digest", "").partition(":")
        payload, digest = None, None
        if name.lower() == "sha1":
            try:
                digest = value.lower() if len(value) == 40 else base64.b32decode(value).hex()
            except ValueError:
                return Bad("payload digest")
    else:
        if _digest_fails(fields.get("warc-payload-digest"), payload):
            return Bad("payload digest")
        digest = hashlib.sha1(payload).hexdigest()
    names = [x and x.strip("<>") for x in (fields.get("warc-record-id"), fields.get("warc-refers-to"))]
    return Taken([(None, Record(kind, *names, fields.get("warc-target-uri"), size, digest, payload))], b + 4)


def take_member(data: bytes, max_record: int = MAX_RECORD) -> Taken | More | Bad:
    """The gzip member at the start of ``data``, with the records in it."""
    packer = zlib.decompressobj(31)
    try:
        inside = packer.decompress(data, max_record + MAX_HEAD)
    except zlib.error:
        return Bad("member")
    if not packer.eof:
        return Bad("too long") if packer.unconsumed_tail else More(len(data) + 1)
    used = len(data) - len(packer.unused_data)
    found = [(x.fault, x.record) for x in salvage(inside.split(VERSION), VERSION, take_record, max_record)]
    if found and all(r is None for _, r in found):
        return Bad(found[0][0] or "member")
    return Taken(found, used)


def salvage(pieces: Iterable[bytes], start: bytes, take: Callable[[bytes, int], Taken | More | Bad], max_record: int = MAX_RECORD) -> Iterator[Found]:
    """Records and gaps of a file that is cut at every ``start``; the first piece comes before the first one."""
    pieces = iter(pieces)
    at, gap = 0, None  # gap: where it began, its fault
    ahead: deque[bytes] = deque()

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            ahead.append(start + piece)
        return piece is not None

    first = next(pieces, b"")
    if first:
        at, gap = len(first), (0, "no start")
    while ahead or fill():
        data, n = ahead[0], 1
        while isinstance(got := take(data, max_record), More):
            if got.needed > 2 * max_record:
                got = Bad("too long")
                break
            parts, size = [data], len(data)
            while size < got.needed and (n < len(ahead) or fill()):
                parts.append(ahead[n])
                size += len(ahead[n])
                n += 1
            if size < got.needed:
                got = Bad("cut off")
                break
            data = b"".join(parts)
        if isinstance(got, Bad):
            gap = gap or (at, got.fault)
            at += len(ahead.popleft())
            continue
        if gap:
            yield Found(gap[0], at - gap[0], gap[1], None)
            gap = None
        for fault, held in got.found:
            yield Found(at, got.used, fault, held)
        for _ in range(n):
            ahead.popleft()
        if got.used < len(data):
            gap = (at + got.used, "no start")
        at += len(data)
    if gap:
        yield Found(gap[0], at - gap[0], gap[1], None)


def read_archives(spark: SparkSession, path: str, compressed: bool = True, payloads: bool = True, max_record: int = MAX_RECORD) -> DataFrame:
    """A row for each record, with a null ``fault``, and for each gap, with nothing but its place and fault.

    Without ``payloads`` they are checked and not returned.
    """
    start, take = (MEMBER, take_member) if compressed else (VERSION, take_record)
    # Marks of what is told apart by Spark: the reader's splits of a file, and the order of pieces in each.
    cut = spark.read.option("encoding", "ISO-8859-1").option("lineSep", start.decode("latin-1")).option("pathGlobFilter", "*[!z]").text(path)
    pieces = cut.select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("piece"))
    pieces = pieces.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "place").select("file_path", "piece", F.lit(False).alias("whole"))
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    pieces = pieces.unionByName(packed.select(F.col("path").alias("file_path"), F.col("content").alias("piece"), F.lit(True).alias("whole")))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, bool]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        stream = files(batches)
        ahead = next(stream, None)

        def of_file(name: str) -> Iterator[bytes]:
            nonlocal ahead
            while ahead and ahead[0] == name:
                piece, whole = ahead[1:]
                ahead = next(stream, None)
                yield from piece.split(start) if whole else (piece,)

        while ahead:
            name = ahead[0]
            for x in salvage(of_file(name), start, take, max_record):
                held = x.record or Record(*[None] * 7)
                rows.append((name, x.offset, x.length, x.fault, *(held if payloads else held[:-1])))
                size += 200 + len(held.payload or b"") * payloads
                if size > BATCH:
                    yield _batch(rows, payloads)
                    rows, size = [], 0
        yield _batch(rows, payloads)

    return pieces.mapInArrow(read, FIELDS if payloads else FIELDS.rpartition(",")[0])


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    fields = [f.split() for f in FIELDS.split(", ")][: None if payloads else -1]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def row_id(name: str):
    """The id of the row behind a record's id."""
    return F.regexp_extract(name, f"^{URN}(-?[0-9]+)$", 1).try_cast("bigint")


def with_payloads(found: DataFrame) -> DataFrame:
    """Records with the payload of the response that they revisit, where they have none of their own.

    Gaps are left out, and a revisit whose response is lost keeps a null payload.
    """
    records = found.filter("fault IS NULL")
    responses = records.filter("record_type = 'response'").dropDuplicates(["record_id", "payload_digest"])
    kept = responses.select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("payload").alias("full"))
    revisits = records.filter("record_type = 'revisit'").join(kept, ["refers_to", "payload_digest"], "left")
    resolved = revisits.withColumn("payload", F.col("full")).select(*found.columns)
    return records.filter("record_type IS DISTINCT FROM 'revisit'").unionByName(resolved)
