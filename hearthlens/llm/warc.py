"""WARC archives: writing with segmented and chunked records, reading with reassembly.

A payload is the body of an HTTP response in chunked transfer framing. A block longer than a segment is
written as a first record and continuation records, which may land in different archive files. Of
records with equal payloads that with the largest key is a response, the others revisit it without a
body. Reading groups the segments of a record by origin identifier, orders them by segment number,
verifies the total length and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.llm.common import ship, stored

VERSION = b"WARC/1.1"
END = b"\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records of an archive file; times the segment size this bounds a file.
FILE_RECORDS = 2048
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
NAMESPACE = uuid.UUID("8f0b9a52-7b43-4a0e-9d4e-2f6c1d5a7e10")

RECORD = ("record_id string, record_type string, origin string, segment int, total long, key long, refers_to long, "
          "digest string, block binary")
PAYLOAD = "key long, record_type string, refers_to long, digest string, payload binary, problem string"


def digest_text(raw: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def base32(sha1_hex):
    """The same of a column with a SHA-1 in hex, four letters for every five hex digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for group in range(8):
        number = F.conv(F.substring(sha1_hex, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            groups.append(F.substring(letters, F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*groups)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x" % len(part), END, part, END]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.find(END, at)
        if line < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != END:
            raise ValueError("a chunk is not as long as it says")
        parts.append(body[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """One record, without the last line end, which the writer of lines adds."""
    lines = [VERSION] + [f"{name}: {value}".encode() for name, value in fields if value is not None]
    lines.append(b"Content-Length: %d" % len(block))
    return END.join(lines) + END + END + block + END


def records(key: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str, date: str,
            segment_bytes: int) -> Iterator[bytes]:
    """The records of one page. ``refers_to`` is null for a response."""
    digest = digest_text(payload)
    kind = "response" if refers_to is None else "revisit"
    block = HTTP_HEAD + chunked(payload) if refers_to is None else b""
    record_id = f"<{uuid.uuid5(NAMESPACE, name).urn}>"
    shared = [("WARC-Date", date), ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else None),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("X-Source-Key", key), ("X-Refers-To-Key", refers_to),
              ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers_to is not None else None)]
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", kind), ("WARC-Record-ID", record_id), *shared], block)
        return
    starts = range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, start=1):
        part = block[at:at + segment_bytes]
        if number == 1:
            yield record([("WARC-Type", kind), ("WARC-Record-ID", record_id), *shared, ("WARC-Segment-Number", 1)], part)
        else:
            own = f"<{uuid.uuid5(NAMESPACE, f'{name}/{number}').urn}>"
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", date),
                          ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", number),
                          ("WARC-Segment-Total-Length", len(block) if number == len(starts) else None)], part)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record of an archive."""
    at = 0
    while at < len(archive):
        if not archive.startswith(VERSION[:5], at):
            raise ValueError(f"no record at byte {at}")
        end = archive.index(END + END, at)
        lines = archive[at:end].split(END)[1:]
        fields = {name.strip().lower().decode(): value.strip().decode() for name, _, value in (line.partition(b":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if archive[stop:stop + 4] != END + END:
            raise ValueError(f"the record at byte {at} is not as long as it says")
        yield fields, archive[start:stop]
        at = stop + 4


def _roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(key, digest, refers) of each distinct key and payload: ``refers`` is the largest key with the
    payload, null for that key itself and for payloads below ``least_bytes``."""
    small = pages.select("__key", F.sha1("__payload").alias("__digest"), F.octet_length("__payload").alias("__n")).distinct()
    first = small.groupBy("__digest").agg(F.max("__key").alias("__first"))
    both = small.join(first, "__digest")
    refers = F.when((F.col("__n") >= least_bytes) & ~F.col("__key").eqNullSafe(F.col("__first")), F.col("__first"))
    return both.select(F.col("__key").alias("__role_key"), F.col("__digest").alias("__role_digest"), refers.alias("__refers"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS,
               date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes a record per row as compressed archive files.

    A null page is an empty payload, a null address is left out. Of rows with the same payload the one
    with the largest key is the response, and so is a repeated row of that key; a null key is smaller
    than any other. Payloads below ``least_bytes`` are never revisits. Other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("__key"), F.col(url).cast("string").alias("__url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("__payload"))
    roles = _roles(rows, least_bytes)
    # pages move once, by their key; what they revisit comes from rows without the text
    with_role = rows.withColumn("__digest", F.sha1("__payload")).join(
        roles, F.col("__key").eqNullSafe(F.col("__role_key")) & (F.col("__digest") == F.col("__role_digest")))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for name, address, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for raw in records(name, address, payload, refers, f"{name}/{part}/{number}", date, segment_bytes):
                    out.append(raw)
                    held += len(raw)
                number += 1
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (with_role.select("__key", "__url", "__payload", "__refers").mapInArrow(written, "value binary")
     .select(F.col("value").cast("string")).write
     .option("maxRecordsPerFile", file_records).option("lineSep", "\r\n").option("compression", "gzip").text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archive files, segments as they are stored."""
    ship(spark)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                content = raw.as_buffer().to_pybytes()
                if content[:2] == b"\x1f\x8b":
                    content = _unzipped(content)
                rows, held = [], 0
                for fields, block in parse(content):
                    get = fields.get
                    rows.append((get("warc-record-id"), get("warc-type"), get("warc-segment-origin-id"),
                                 _number(get("warc-segment-number")), _number(get("warc-segment-total-length")),
                                 _number(get("x-source-key")), _number(get("x-refers-to-key")),
                                 (get("warc-payload-digest") or "").removeprefix("sha1:") or None, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, _RECORD_TYPES)
                        rows, held = [], 0
                yield _batch(rows, _RECORD_TYPES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, RECORD)


def _unzipped(content: bytes) -> bytes:
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(parts)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


_RECORD_TYPES = [("record_id", pa.string()), ("record_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()),
                 ("total", pa.int64()), ("key", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())]
_PAYLOAD_TYPES = [("key", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()),
                  ("payload", pa.binary()), ("problem", pa.string())]


def _batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [n for n, _ in types])


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    end = block.find(END + END)
    if end < 0:
        raise ValueError("the block has no HTTP head")
    body = block[end + 4:]
    return dechunked(body) if b"transfer-encoding: chunked" in block[:end].lower() else body


def _payload(segments: list[tuple]) -> tuple:
    """The row of one record, from its segments in order."""
    first = segments[0]
    key, kind, refers, digest = first[5], first[1], first[6], first[7]
    problem, payload = None, None
    numbers = [s[3] for s in segments]
    if kind == "continuation":
        problem = "the first segment is missing"
    elif numbers != [None] and numbers != list(range(1, len(segments) + 1)):
        problem = "a segment is missing or repeated"
    else:
        block = b"".join(s[8] or b"" for s in segments)
        if numbers != [None] and segments[-1][4] != len(block):
            problem = "the segments are not as long as they say"
        elif kind == "response":
            try:
                payload = decoded(block)
                if digest and digest_text(payload) != digest:
                    problem = "the payload has another digest"
            except ValueError as error:
                problem = str(error)
    return key, kind, refers, digest, payload, problem


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from rows ordered by origin and segment number, one record held at a time."""
    origin, segments, out, held = None, [], [], 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            own = row[2] or row[0]
            if segments and (own != origin or row[3] is None):
                out.append(_payload(segments))
                held += len(out[-1][4] or b"")
                segments = []
                if held > 4 << 20:
                    yield _batch(out, _PAYLOAD_TYPES)
                    out, held = [], 0
            origin = own
            segments.append(row)
    if segments:
        out.append(_payload(segments))
    yield _batch(out, _PAYLOAD_TYPES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key, record_type, refers_to, digest, payload and problem of every record of the archives.

    Whole records are decoded where they are read; only segments are moved, by the identifier of their
    origin. A revisit has no payload. A record with missing, repeated or short segments, broken framing
    or another digest keeps its row, with the problem named and no payload to rely on.
    """
    found = read_records(spark, path)
    whole = found.where(F.col("segment").isNull()).mapInArrow(_reassembled, PAYLOAD)
    origin = F.coalesce("origin", "record_id")
    segments = (found.where(F.col("segment").isNotNull()).repartition(origin).sortWithinPartitions(origin, "segment")
                .mapInArrow(_reassembled, PAYLOAD))
    return whole.unionByName(segments)


def resolved(found: DataFrame) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to, revisits with the length and
    digest of the response they refer to. Raises on a record with a problem."""
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("long")).otherwise(
        F.octet_length("payload").cast("long"))
    small = stored(found.select("key", "record_type", "refers_to", checked.alias("payload_bytes"),
                                F.when(F.col("record_type") == "response", base32(F.sha1("payload"))).otherwise(F.col("digest")).alias("payload_digest")))
    responses = small.where("record_type = 'response'")
    known = responses.groupBy(F.col("payload_digest").alias("__digest")).agg(F.first("payload_bytes").alias("__bytes"))
    revisits = small.where("record_type = 'revisit'").drop("payload_bytes").join(known, F.col("payload_digest") == F.col("__digest"), "left")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("__bytes", F.raise_error(F.lit("a revisit refers to nothing")).cast("long")))
    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(*columns))
