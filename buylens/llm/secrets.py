"""Secret scan with structural confirmation.

Patterns find candidates; what they cannot tell is decided by decoding: base64 or hex is decoded, also over line breaks and from every place inside a run where a key can
begin, and parsed as a private key (nested DER lengths, length-prefixed OpenSSH fields, or encoded armor), and dotted base64url is a signed token only if its header and claims are JSON with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as tx

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key")

# On UTF-8 bytes, so that ignoring case means ASCII letters only.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
#: The claims of a signed token: between two dots, and encoded JSON, whose first byte is ``{``. Places in a run where its header can begin as well.
CLAIMS = re.compile(rb"\.(?=(e[w-z0-9_-][A-Za-z0-9_-]*)\.)")
BRACE = re.compile(rb"(?=e[w-z0-9_-])")
URL_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SIGNATURE = re.compile(rb"[A-Za-z0-9_-]*")
#: Characters of a signature whose algorithm has one length only.
SIGNED_BY = {"hs256": 43, "hs384": 64, "hs512": 86, "es256": 86, "es256k": 86, "es384": 128, "es512": 176, "eddsa": 86, "none": 0}
ARMOR = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
#: Header lines of an armored key and the empty line after them.
HEADERS = re.compile(rb"\s*((?:[A-Za-z0-9-]+:[^\n]*\n)+)")
CIPHER = re.compile(rb"DEK-Info:\s*[A-Z0-9-]+,((?:[0-9A-Fa-f]{2}){8,})\s")
_BREAK = rb"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*"
RUN = re.compile(rb"[A-Za-z0-9+/_-]+(?:" + _BREAK + rb"[A-Za-z0-9+/_-]+)*")
HEX_RUN = re.compile(rb"[0-9A-Fa-f]+(?:" + _BREAK + rb"[0-9A-Fa-f]+)*")
BREAK = re.compile(_BREAK)
#: Bytes of the shortest key that ``is_der_key`` takes, an EC scalar of 16 bytes: sequence, version, octets.
SHORTEST = 2 + 3 + 2 + 16
#: Shortest run, without its breaks and padding, that is tried as base64 and as hex.
LEAST, HEX_LEAST = -(-SHORTEST * 8 // 6), 2 * SHORTEST
BEGIN = b"-----BEGIN "
_core = lambda k: base64.b64encode(bytes(k) + BEGIN + bytes(3))[(0, 2, 3)[k]:(k + len(BEGIN)) * 8 // 6]
#: Where a key can begin in base64: a DER sequence, OpenSSH's magic, or armor at each of the three places in a group; and how far before it the group begins.
STARTS = re.compile(b"(?=(?:(M[A-I])|(b3BlbnNzaC1rZXktdj)|(%s)|(%s)|(%s)))" % tuple(re.escape(_core(k)) for k in range(3)))
BACK = (0, 0, 0, 2, 3)
HEX_STARTS = re.compile(b"(?=(30)|(6f70656e7373682d6b65792d7631)|(%s))" % BEGIN.hex().encode())


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of each element; None unless definite lengths fill the data exactly."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or len(data) - at < n:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if len(data) - at < size:
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def der_end(data: bytes) -> int:
    """Where the element that ``data`` begins with ends by its length; -1 unless it begins as a private key does."""
    if len(data) < 5 or data[0] != 0x30:
        return -1
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80 or len(data) < 5 + n:
        return -1
    size = int.from_bytes(data[2:2 + n], "big") if n else data[1]
    return 2 + n + size if data[2 + n] == 0x30 or data[2 + n:4 + n] == b"\2\1" else -1


def is_der_key(data: bytes) -> bool:
    """A private key: RSA or DSA integers, an EC scalar, a wrapped key, or an encrypted wrapped key."""
    outer = der(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der(outer[0][1])
    tags = [tag for tag, _ in inner or []]
    algorithm = lambda content: bool(parts := der(content)) and parts[0][0] == 0x06
    if tags[:1] == [0x02] and len(inner[0][1]) == 1:
        if len(tags) >= 6 and set(tags) == {0x02}:
            return len(inner[1][1]) >= 32
        if tags[1:2] == [0x04]:
            return inner[0][1] == b"\x01" and len(inner[1][1]) >= 16
        return tags[1:3] == [0x30, 0x04] and algorithm(inner[1][1]) and len(inner[2][1]) >= 16
    return tags == [0x30, 0x04] and algorithm(inner[0][1]) and len(inner[1][1]) >= 16


def openssh_end(data: bytes, start: int = 0) -> int:
    """Where an OpenSSH key that begins at ``start`` ends: magic, then cipher, derivation, options, a count, public keys and the private part, each with its
    length; -1 if it is none."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic, start):
        return -1
    at = start + len(magic)
    for _ in range(3):
        at = _skip(data, at)
        if at < 0:
            return -1
    count, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return -1
    for _ in range(count + 1):
        at = _skip(data, at)
        if at < 0:
            return -1
    return at


def is_openssh_key(data: bytes) -> bool:
    return openssh_end(data) == len(data)


def _skip(data: bytes, at: int) -> int:
    if len(data) - at < 4:
        return -1
    end = at + 4 + int.from_bytes(data[at:at + 4], "big")
    return end if end <= len(data) else -1


def decoded(raw: bytes) -> bytes:
    """Base64 of either alphabet with or without padding; empty if it is none."""
    body = raw.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def is_armored(match: re.Match[bytes]) -> bool:
    """A key, or by its headers an encrypted one: whole blocks of a named cipher."""
    body = re.sub(rb"\\r\\n|\\n|\\r|\r", b"\n", match[2])
    headers = HEADERS.match(body)
    data = decoded(re.sub(rb"[\s\\]", b"", body[headers.end():] if headers else body))
    if is_key(data):
        return True
    cipher = headers and b"ENCRYPTED" in headers[1] and CIPHER.search(headers[1])
    return bool(cipher and len(data) >= 16 and len(data) % (len(cipher[1]) // 2) == 0)


def joined(span: bytes, start: int) -> tuple[bytes, list[int], list[int]]:
    """A run without its line breaks, and for each of its lines where it begins there and in the text."""
    parts, there, here, at, total = [], [], [], 0, 0
    for m in [*BREAK.finditer(span), None]:
        part = span[at:m.start() if m else len(span)]
        parts.append(part)
        there.append(total)
        here.append(start + at)
        total += len(part)
        at = m.end() if m else at
    return b"".join(parts), there, here


def key_spans(raw: bytes) -> list[tuple[int, int]]:
    """Keys in base64 and hex, from every place inside a run where one can begin."""
    out = []
    for pattern, least, starts, per, width in ((RUN, LEAST, STARTS, 6, 4), (HEX_RUN, HEX_LEAST, HEX_STARTS, 4, 2)):
        for run in pattern.finditer(raw):
            if run.end() - run.start() < least:
                continue
            body, there, here = joined(run[0], run.start())
            if len(body) < least:
                continue
            body = body.lower() if width == 2 else body.replace(b"-", b"+").replace(b"_", b"/")

            aligned: dict[int, bytes] = {}  # the run decoded once for each place in a group where something begins

            def decode(a: int) -> tuple[bytes, int]:
                """What the run holds from ``a`` on: decoded bytes and where in them ``a`` is."""
                if a % width not in aligned:
                    part = body[a % width:]
                    if width == 2:
                        aligned[a % width] = bytes.fromhex(part[:len(part) // 2 * 2].decode())
                    else:
                        part = part[:-1] if len(part) % 4 == 1 else part
                        aligned[a % width] = base64.b64decode(part + b"=" * (-len(part) % 4))
                return aligned[a % width], (a - a % width) * per // 8

            for m in starts.finditer(body):
                kind = m.lastindex - 1
                a, n = m.start(), -1
                if kind == 0:
                    data, at = decode(a)
                    n = der_end(data[at:at + 12])
                    n = n if n > 0 and at + n <= len(data) and is_der_key(data[at:at + n]) else -1
                elif kind == 1:
                    data, at = decode(a)
                    n = openssh_end(data, at) - at
                elif width == 2 or a >= BACK[kind]:
                    a -= BACK[kind] if width == 4 else 0
                    data, at = decode(a)
                    begin = data.find(BEGIN, at, at + len(BEGIN) + 3)
                    armor = ARMOR.match(data, begin) if begin >= 0 else None
                    n = armor.end() - at if armor and is_armored(armor) else -1
                if n > 0:
                    last = a + -(-n * 8 // per) - 1
                    place = lambda x: here[k := bisect_right(there, x) - 1] + x - there[k]
                    end = place(last) + 1
                    pad = -(last + 1 - a) % 4 if width == 4 else 0
                    while pad and raw[end:end + 1] == b"=":
                        end, pad = end + 1, pad - 1
                    out.append((place(a), end))
    return out


def _json(data: bytes) -> dict | None:
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def token_spans(raw: bytes) -> list[tuple[int, int]]:
    """Signed tokens: a header and claims that are JSON objects, the header with an algorithm, and a signature as long as that needs.

    The header may begin anywhere in its run of characters; the first place at which it is one counts. A signature of a known length ends there, whatever follows.
    """
    out: list[tuple[int, int]] = []
    for m in CLAIMS.finditer(raw):
        dot, end = m.start(), m.end(1)
        first = dot
        while first and raw[first - 1] in URL_SAFE:
            first -= 1
        run, places = raw[first:dot], {}
        for place in BRACE.finditer(run):
            # From here to the dot must be whole: one decoding for each place in a group tells all others of it.
            a = place.start()
            if a % 4 not in places:
                data = decoded(run[a:])
                places[a % 4] = (a, data if data.rstrip().endswith(b"}") else b"")
            base, data = places[a % 4]
            head = _json(data[(a - base) // 4 * 3:]) if data else None
            if head is None or not isinstance(head.get("alg"), str):
                continue
            if _json(decoded(m[1])) is None:
                break
            found = SIGNATURE.match(raw, end + 1).end() - end - 1
            size = SIGNED_BY.get(head["alg"].lower(), found)
            if found >= min(size, 22) and (size or head["alg"].lower() == "none"):  # 16 bytes, where the algorithm asks for any
                out.append((first + a, end + 1 + min(found, size)))
                break
    return out


def found(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(raw) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(raw) if len(m[0]) >= 24]
    out += [("token", *s) for s in token_spans(raw)]
    keys = [m.span() for m in ARMOR.finditer(raw) if is_armored(m)] + key_spans(raw)
    whole: list[tuple[int, int]] = []
    for a, b in sorted(set(keys), key=lambda s: (s[0], -s[1])):  # an armored key contains its base64
        if not whole or b > whole[-1][1]:
            whole.append((a, b))
    out += [("key", a, b) for a, b in whole]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def in_points(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code points, in one walk."""
    at, points, known = 0, 0, {}
    for cut in sorted({x for _, a, b in spans for x in (a, b)}):
        points += len(raw[at:cut].decode())
        at = cut
        known[cut] = points
    return [(kind, known[a], known[b]) for kind, a, b in spans]


def spans_of(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for i, text in enumerate(texts.to_pylist()):
        raw = text.encode()
        spans = found(raw)
        if spans:
            out[i] = in_points(raw, spans)
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets``: array of kind, start, end in code points (end exclusive), by start, then kind in the order of KINDS.

    Null and empty texts have none. Repeated rows are scanned alike. An extra column named ``secrets`` is replaced; the others stay.
    """
    source = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "secrets"])
    names = source.columns
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, names[at]):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in spans_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*names, "secrets"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *T._parse_datatype_string(
        "secrets array<struct<kind:string,start:int,end:int>>").fields]))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans become one. ``n_chars`` follows where it is a column."""
    names, schema = docs.columns, docs.schema
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    size_at = next((i for i, c in enumerate(names) if c.lower() == "n_chars"), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, names[at]):
            spans = spans_of(batch.column(at))
            if any(spans):
                columns, texts = batch.columns, batch.column(at).to_pylist()
                sizes = columns[size_at].to_pylist() if size_at is not None else None
                for i, own in enumerate(spans):
                    if own:
                        texts[i] = _masked(texts[i], own, mark)
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
                batch = pa.RecordBatch.from_arrays(columns, names=names)
            yield batch

    return docs.mapInArrow(run, schema)


def _masked(value: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [value[at:a], mark]
        at = max(at, b)
    return "".join([*out, value[at:]])
