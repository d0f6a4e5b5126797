"""Secrets in texts: three patterns, and values that are confirmed by their own structure.

The patterns report assignments, access ids and long hex strings as they stand. Beyond them, long base64
and hex strings are candidates only: they are decoded, and reported if what comes out is a private key
whose nested lengths fit to the last byte, or a signed token whose header and claims are JSON.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import ship

#: Kinds of findings, in the order in which those with one start are listed. The first three are patterns.
KINDS = ("assign", "access", "hex", "der", "openssh", "token")
FOUND_TYPE = "array<struct<kind:string,start:bigint,end:bigint,detail:string>>"

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: The shortest strings that are decoded: a token with the smallest header, and the smallest private key.
LEAST_TOKEN_RUN, LEAST_KEY_RUN = 20, 56
#: Nested elements of a key are read to this depth.
MOST_DEPTH = 16

# texts are scanned in lower case of A-Z, so letters of the names match in either case
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_NAMES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----((?:[A-Za-z0-9+/=:,\s]|\\[nr]|-(?!-))*)-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_PEM_HEADER = re.compile(rb"^[A-Za-z-]+:.*$", re.M)
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_KEY_RUN)
_HEX_KEY = re.compile(rb"[0-9A-Fa-f]{%d,}" % (2 * 40))
_PART = re.compile(rb"[A-Za-z0-9_-]+")
_KEY_START = re.compile(rb"M(?=[A-P])")
_OPENSSH_MAGIC = b"openssh-key-v1\x00"
_OPENSSH_START = base64.b64encode(_OPENSSH_MAGIC)
_PEM_START = base64.b64encode(b"-----BEGIN")[:12]


def _table(members: bytes) -> bytes:
    return bytes(120 if byte in members else 32 for byte in range(256))


_HEX_MASK = _table(b"0123456789abcdef")
_RUN_MASK = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_.-")


def _runs(data: bytes, mask: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches of a mask's bytes that have the least length."""
    marked, wanted = data.translate(mask), b"x" * least
    begin = marked.find(wanted)
    while begin >= 0:
        end = marked.find(b" ", begin)
        end = len(data) if end < 0 else end
        yield begin, end
        begin = marked.find(wanted, end)


def patterns(data: bytes) -> list[tuple[int, int, int, str | None]]:
    """(start, end, kind, detail) in bytes of the three patterns: the leftmost matches that do not overlap, and
    of these the ones that are long enough."""
    found = []
    lowered = data.lower()
    if any(name in lowered for name in _NAMES):
        found += [(m.start(), m.end(), 0, m.group(1).decode()) for m in _ASSIGN.finditer(lowered) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1, None) for m in _ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(begin, end, 2, None) for begin, end in _runs(data, _HEX_MASK, LEAST_HEX)]
    return found


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """The definite length at a place, in its shortest form, and where the content begins."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = first & 0x7F
    if not 1 <= size <= 4 or at + 1 + size > len(data):
        return None
    value = int.from_bytes(data[at + 1:at + 1 + size])
    if value < 0x80 or value >> (8 * (size - 1)) == 0:
        return None
    return value, at + 1 + size


def elements(data: bytes, begin: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the elements that fill a stretch exactly, or None. Constructed elements have to be
    filled exactly as well."""
    found = []
    while begin < end:
        read = _length(data, begin + 1)
        if read is None or read[1] + read[0] > end or depth > MOST_DEPTH:
            return None
        tag, start, stop = data[begin], read[1], read[1] + read[0]
        if tag & 0x1F == 0x1F or (tag & 0x20 and elements(data, start, stop, depth + 1) is None):
            return None
        found.append((tag, start, stop))
        begin = stop
    return found


def key_kind(data: bytes) -> str | None:
    """Which private key the bytes are, if they are one to the last byte."""
    top = elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    parts = elements(data, *top[0][1:]) or []
    tags = [tag for tag, _, _ in parts]
    values = [data[begin:end] for _, begin, end in parts]
    if any(not value for tag, value in zip(tags, values) if tag == 2):
        return None
    if tags == [2] * 9 and values[0] in (b"\x00", b"\x01"):
        return "rsa"
    if tags == [2] * 6 and values[0] == b"\x00":
        return "dsa"
    if tags[:2] == [2, 4] and values[0] == b"\x01" and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and len(values[1]) >= 20:
        return "ec"

    def algorithm(i: int) -> bytes | None:
        inner = elements(data, *parts[i][1:])
        return data[inner[0][1]:inner[0][2]] if inner and inner[0][0] == 6 and len(inner) <= 2 else None

    if tags[:3] == [2, 0x30, 4] and values[0] in (b"\x00", b"\x01") and algorithm(1) and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        return "pkcs8"
    # encryption under a password: PKCS 5 and PKCS 12
    if tags == [0x30, 4] and (algorithm(0) or b"").startswith((bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))):
        return "pkcs8 encrypted"
    return None


def openssh_kind(data: bytes) -> str | None:
    """The cipher of an OpenSSH private key file whose length-prefixed fields fill it exactly."""
    if not data.startswith(_OPENSSH_MAGIC):
        return None
    at = len(_OPENSSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at:at + 4]) if at + 4 <= len(data) else len(data)
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size:at]

    cipher, kdf, options = field(), field(), field()
    if cipher is None or kdf is None or options is None or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at:at + 4])
    at += 4
    if not 1 <= keys <= 64 or any(field() is None for _ in range(keys)):
        return None
    secret = field()
    if not secret or at != len(data):
        return None
    if cipher == b"none" and secret[:4] != secret[4:8]:
        return None
    return "openssh " + cipher.decode("ascii", "replace")


def _decoded(text: bytes) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not."""
    text = text.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _confirmed(data: bytes | None) -> tuple[int, str] | None:
    if not data:
        return None
    kind = openssh_kind(data)
    if kind:
        return 4, kind
    kind = key_kind(data) if data[0] == 0x30 else None
    return (3, kind) if kind else None


def _pem(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """Keys between their markers, over several lines or with escaped line ends."""
    if b"PRIVATE KEY-----" in data:
        for m in _PEM.finditer(data):
            body = re.sub(rb"\\[nr]", b"\n", m.group(1))
            kept = _PEM_HEADER.sub(b"", body)
            confirmed = _confirmed(_decoded(re.sub(rb"\s", b"", kept)))
            if confirmed:
                yield m.start(), m.end(), *confirmed
            elif kept != body and re.search(rb"^Proc-Type:\s*4,ENCRYPTED", body, re.M):
                yield m.start(), m.end(), 3, "pem encrypted"


def _declared(head: bytes) -> int | None:
    """Bytes of the whole element of which the first bytes are given."""
    read = _length(head, 1)
    return read[0] + read[1] if read else None


def _bare_keys(data: bytes, begin: int, end: int) -> Iterator[tuple[int, int, int, str]]:
    """Keys in base64 without markers. A key may follow other letters, as in a path; its outermost length says
    at once whether it would end where the letters do."""
    for m in _BASE64.finditer(data, begin, end):
        stop = len(m.group().rstrip(b"=")) + m.start()
        nested = data.find(_PEM_START, m.start(), stop)
        if nested >= 0:
            inner = next(_pem(_decoded(data[nested:stop]) or b""), None)
            if inner:
                yield nested, m.end(), inner[2], inner[3]
                continue
        start = data.find(_OPENSSH_START, m.start(), stop)
        if start >= 0:
            confirmed = _confirmed(_decoded(data[start:stop]))
            if confirmed:
                yield start, m.end(), *confirmed
                continue
        for s in _KEY_START.finditer(data, m.start(), stop - LEAST_KEY_RUN + 3):
            head = _decoded(data[s.start():s.start() + 8])
            whole = _declared(head) if head and head[0] == 0x30 else None
            if whole is not None and (4 * whole + 2) // 3 == stop - s.start():
                confirmed = _confirmed(_decoded(data[s.start():stop]))
                if confirmed:
                    yield s.start(), m.end(), *confirmed
                    break
    for m in _HEX_KEY.finditer(data, begin, end):
        at = m.group().lower().find(_OPENSSH_MAGIC.hex().encode())
        confirmed = _confirmed(bytes.fromhex(m.group()[at:].decode())) if at >= 0 and (m.end() - m.start() - at) % 2 == 0 else None
        if confirmed:
            yield m.start() + at, m.end(), *confirmed
            continue
        at = data.find(b"30", m.start(), m.end())
        while at >= 0:
            head = bytes.fromhex(data[at:at + 12].decode()) if at + 12 <= m.end() else b""
            whole = _declared(head) if head else None
            if whole is not None and 2 * whole == m.end() - at:
                confirmed = _confirmed(bytes.fromhex(data[at:m.end()].decode()))
                if confirmed:
                    yield at, m.end(), *confirmed
                    break
            at = data.find(b"30", at + 1, m.end())


def _object(text: bytes) -> dict | None:
    decoded = _decoded(text)
    if not decoded or not decoded.lstrip().startswith(b"{"):
        return None
    try:
        value = json.loads(decoded)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _tokens(data: bytes, begin: int, end: int) -> Iterator[tuple[int, int, int, str]]:
    """Signed tokens: a JSON header that names its algorithm, JSON claims and a signature, joined by dots; and
    encrypted ones of five parts."""
    parts = [(m.start(), m.end()) for m in _PART.finditer(data, begin, end)]
    after = begin
    for i, (start, stop) in enumerate(parts):
        if start < after or stop - start < 12 or data[stop:stop + 1] != b".":
            continue
        header = _object(data[start:stop])
        if not header or not isinstance(header.get("alg"), str):
            continue
        row = [(start, stop)]
        for s, e in parts[i + 1:i + 5]:
            if s != row[-1][1] + 1 or data[s - 1:s] != b".":
                break
            row.append((s, e))
        if "enc" in header and len(row) >= 4 and all(_decoded(data[s:e]) is not None for s, e in row[1:5]):
            last = row[min(4, len(row) - 1)][1]
        elif len(row) >= 2 and _object(data[slice(*row[1])]) is not None:
            last = row[1][1]
            if len(row) > 2:
                if not _decoded(data[slice(*row[2])]):
                    continue
                last = row[2][1]
            elif data[last:last + 1] == b"." and header["alg"].lower() == "none":
                last += 1
            else:
                continue
        else:
            continue
        after = last
        yield start, last, 5, header["alg"]


def structures(data: bytes) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, detail) in bytes of what is confirmed by its structure."""
    found = list(_pem(data))
    ends, begins = [f[1] for f in found], [f[0] for f in found]
    for begin, end in _runs(data, _RUN_MASK, LEAST_TOKEN_RUN):
        marked = bisect.bisect_right(ends, begin)
        if marked < len(ends) and begins[marked] <= begin:
            continue  # the body of a marked key
        if data.find(b".", begin, end) >= 0:
            found.extend(_tokens(data, begin, end))
        if end - begin >= LEAST_KEY_RUN:
            found.extend(_bare_keys(data, begin, end))
    return found


def scan_text(data: bytes) -> list[dict]:
    """All findings of a text by start and kind, in code points, ends exclusive."""
    found = sorted(patterns(data) + structures(data), key=lambda f: (f[0], f[2], f[1]))
    if not found or data.isascii():
        return [dict(kind=KINDS[kind], start=start, end=end, detail=detail) for start, end, kind, detail in found]
    places, at, chars = {}, 0, 0
    for place in sorted({f[0] for f in found} | {f[1] for f in found}):
        chars += len(data[at:place].decode("utf-8"))
        places[place], at = chars, place
    return [dict(kind=KINDS[kind], start=places[start], end=places[end], detail=detail) for start, end, kind, detail in found]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found) of every row, where it is: nothing is shuffled. ``found`` are structs of kind, start, end
    (code points, end exclusive) and detail, by start and kind.

    A null or empty text has no findings; a null key and repeated rows stay; texts are scanned whole;
    other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_buffer().to_pybytes()) if t.is_valid else [] for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, found_type)], ["key", "found"])

    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
            .mapInArrow(scanned, f"key {kind}, found {FOUND_TYPE}").withColumnRenamed("key", key))
