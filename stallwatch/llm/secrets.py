"""Secrets in whole texts: patterns first, then candidates whose decoded structure proves what they are."""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwatch.llm.common import per_row, text_bytes

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the whole run
ASSIGNED, ACCESS_LENGTH = 8, 16

# Candidates of the structural kinds: dotted tokens, armoured keys, and long base64 or hex runs.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]{16,}?)-----END \1-----")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_=-])")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Za-z])")
# The same broken over lines of 16 or more characters, the last of any length; a break is real or escaped, with indentation.
BREAK = r"[\x20\t]*(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{BREAK}[A-Za-z0-9+/_-]{{16,}})*{BREAK}[A-Za-z0-9+/_-]+={{0,2}}")
HEX_LINES = re.compile(rf"(?<![0-9A-Za-z])[0-9A-Fa-f]{{16,}}(?:{BREAK}[0-9A-Fa-f]{{16,}})*{BREAK}[0-9A-Fa-f]+(?![0-9A-Za-z])")
BASE64_PART, HEX_PART = re.compile(r"\\r\\n|\\n|([A-Za-z0-9+/_-]+)"), re.compile(r"\\r\\n|\\n|([0-9A-Fa-f]+)")
KINDS = ("assign", "access", "hex", "signed", "armour", "encoded", "hexkey")


def decode64(text: str) -> bytes | None:
    """Strictly decoded base64 of either alphabet, padding optional; None if it is neither."""
    bare = text.rstrip("=")
    if len(bare) % 4 == 1 or ("-" in bare or "_" in bare) and ("+" in bare or "/" in bare):
        return None
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def decode16(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def der_items(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, or None where a length does not fit."""
    end, items = len(data) if end is None else end, []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80 or size >> 8 * (width - 1) == 0:
                return None  # not the shortest form
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def is_der_private_key(data: bytes) -> bool:
    """One SEQUENCE that fills the data and holds a private key: RSA or DSA integers, an EC key, or either wrapped (PKCS 8, encrypted or not)."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(data, *outer[0][1:])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    body = [data[a:b] for _, a, b in parts]
    if all(t == 0x02 for t in tags) and len(tags) in (6, 9, 10):  # version and numbers, each positive and in shortest form
        return body[0] in (b"\x00", b"\x01") and all(b and not b[0] & 0x80 and (len(b) == 1 or b[0] or b[1] & 0x80) for b in body)
    if tags[:2] == [0x02, 0x04]:  # EC: version 1, the secret number, then the curve
        return body[0] == b"\x01" and 16 <= len(body[1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [0x02, 0x30, 0x04]:  # wrapped: the algorithm starts with an object id
        algorithm = der_items(data, *parts[1][1:])
        return body[0] in (b"\x00", b"\x01") and bool(algorithm) and algorithm[0][0] == 0x06 and len(body[2]) >= 16
    if tags == [0x30, 0x04]:  # encrypted
        algorithm = der_items(data, *parts[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(body[1]) >= 16
    return False


def ssh_private_key_size(data: bytes) -> int:
    """Bytes of the key that ``data`` starts with, 0 if none: the magic word, then cipher, key derivation, options, one or more public keys and the private block, by nested lengths."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = struct.unpack_from(">I", data, at)[0]
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(take() is None for _ in range(3)) or at + 4 > len(data):
        return 0
    keys = struct.unpack_from(">I", data, at)[0]
    at += 4
    return at if 1 <= keys <= 16 and all(take() is not None for _ in range(keys)) and take() else 0


def is_ssh_private_key(data: bytes) -> bool:
    return bool(data) and ssh_private_key_size(data) == len(data)


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_private_key(data) or is_ssh_private_key(data))


def armoured_keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of armoured private keys whose body is one."""
    for m in ARMOUR.finditer(text) if "PRIVATE KEY-----" in text else ():
        if is_private_key(decode64(re.sub(r"\\[nr]|\s", "", m[2]))):
            yield m.span()


def holds_private_key(data: bytes | None) -> bool:
    """A private key, or a text with an armoured one (as base64 of a whole PEM file has)."""
    return is_private_key(data) or bool(data) and b"-----BEGIN" in data and any(armoured_keys(data.decode("latin-1")))


def der_size(data: bytes) -> int:
    """Bytes of the DER value that ``data`` starts with by its own length, 0 where there is none of up to four bytes."""
    width = data[1] & 0x7F if len(data) > 6 and data[1] & 0x80 else 0
    if len(data) <= 6 or width > 4:
        return 0
    return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])


def first_key_size(data: bytes) -> int:
    """Bytes of the private key that ``data`` starts with, or up to the end of the first armoured one in it; 0 if none."""
    if data[:1] == b"\x30":
        size = der_size(data)
        return size if size <= len(data) and is_der_private_key(data[:size]) else 0
    if data.startswith(b"openssh-key-v1"):
        return ssh_private_key_size(data)
    return next((b for _, b in armoured_keys(data.decode("latin-1"))), 0) if b"-----BEGIN" in data else 0


def keys_over_lines(text: str, lines: re.Pattern, part: re.Pattern, opens: tuple[str, ...], decode: Callable[[str], bytes | None], unit: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """(start, end) of keys whose encoding is broken over lines; each has to end where a line's run ends.

    Tried from lines that open like a key, and from the first two, as a text may stand before the armour. ``unit`` is (characters, bytes).
    """
    chars, size = unit
    for m in lines.finditer(text):
        runs = [p.span(1) for p in part.finditer(text, *m.span()) if p[1]]
        whole, ends = "".join(text[a:b] for a, b in runs), [0]
        for a, b in runs:
            ends.append(ends[-1] + b - a)
        done, width, last, barren = 0, 0, 0, set()
        for i, (start, _) in enumerate(runs[:-1]):
            if i < done or i > 1 and not text.startswith(opens, start):
                continue
            at = ends[i]
            if text.startswith(opens[0], start):  # DER tells its own length: no more than that is decoded
                need = -(-der_size(decode(whole[at : at + 24]) or b"") * chars // size)
                tries = [need] if 0 < need <= len(whole) - at else []
            else:  # lines of one width, then with or without a shorter one
                now = ends[i + 2] - ends[i + 1]
                if now != width or i >= last:  # the same block of lines ends at the same line
                    width, last = now, next((k for k in range(i + 1, len(runs)) if ends[k + 1] - ends[k] < now), len(runs) - 1)
                head = decode(whole[at : at + 16 * chars]) or b""
                if (last, at % chars) in barren and not head.startswith(b"openssh") and b"-----BEGIN" not in head[:16]:
                    continue  # the same bytes, with more before them, held no armoured key
                tries = [ends[last + 1] - at, ends[last] - at]
            data, held = b"", 0
            for need in tries:
                data = decode(whole[at : at + need]) or b""
                if held := first_key_size(data):
                    break
            armoured = data[:1] != b"\x30" and not data.startswith(b"openssh-key-v1")
            if not held and armoured:
                barren.add((last, at % chars))
            to = at + -(-held * chars // size)
            j = bisect_left(ends, to)
            if held and j > i + 1 and (ends[j] == to or armoured):  # behind an armoured key a line break may follow
                done = j
                yield start, m.end() if j == len(runs) else runs[j - 1][1]


def is_signed_token(token: str) -> bool:
    """A header naming its algorithm, claims that are an object, and a signature unless the algorithm is "none"."""
    parts = [decode64(p) for p in token.split(".")]
    if parts[0] is None or parts[1] is None or parts[2] is None and token.rpartition(".")[2]:
        return False
    try:
        header, claims = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(claims, dict):
        return False
    return header["alg"].lower() == "none" or bool(parts[2]) and len(parts[2]) >= 16


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the three patterns alone, left to right for each kind."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def _apart(found: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose decoded form parses as a signed token or a private key."""
    found = [(m.start(), "signed", m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[0])] if "eyJ" in text else []
    found += [(a, "armour", b) for a, b in armoured_keys(text)]
    inside = _apart(found)

    def free(start: int, end: int) -> bool:
        """Whether a span meets none of ``inside``, which are in order and apart from each other."""
        at = bisect_left(inside, (end,))
        return at == 0 or inside[at - 1][1] <= start

    found += [(m.start(), "encoded", m.end()) for m in BASE64_RUN.finditer(text) if holds_private_key(decode64(m[0])) and free(m.start(), m.end())]
    found += [(m.start(), "hexkey", m.end()) for m in HEX_RUN.finditer(text) if holds_private_key(bytes.fromhex(m[0])) and free(m.start(), m.end())]
    inside = _apart(found)
    found += [(a, "encoded", b) for a, b in keys_over_lines(text, BASE64_LINES, BASE64_PART, ("M", "b3BlbnNzaC1rZXkt", "LS0tLS"), decode64, (4, 3)) if free(a, b)]
    inside = _apart(found)
    found += [(a, "hexkey", b) for a, b in keys_over_lines(text, HEX_LINES, HEX_PART, ("30", "6f70656e737368", "6F70656E737368", "2d2d2d2d2d", "2D2D2D2D2D"), decode16, (2, 1)) if free(a, b)]
    return found


def _ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))



def find_secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, secrets array<struct<kind, start, end, value>> and base array<struct<kind, start, end>>.

    ``base`` has what the patterns for assignments, access keys and hex runs match; ``secrets`` has the same and the
    structurally confirmed ones: signed tokens (header, claims and signature decoded), armoured private keys, and bare base64
    or hex whose DER or OpenSSH lengths nest exactly or which holds an armoured key, in one run or over lines of 16 or more characters. Offsets are code points, ends exclusive, ordered by start and kind.
    Null and empty texts give empty lists; rows that share an id each get a row; an empty table gives none; other
    columns are not read.
    """
    base = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("secrets", pa.list_(pa.struct([*base, ("value", pa.string())]))), ("base", pa.list_(base))])

    def one(row: dict) -> Iterator[dict]:
        body = row["body"].decode("utf-8", "replace")
        plain = _ordered(base_spans(body))
        every = _ordered(plain + confirmed_spans(body))
        yield {
            "doc_id": row["doc_id"],
            "secrets": [{"kind": k, "start": a, "end": b, "value": body[a:b]} for a, k, b in every],
            "base": [{"kind": k, "start": a, "end": b} for a, k, b in plain],
        }

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), text_bytes(text).alias("body"))
    found = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return rows.mapInArrow(per_row(one, schema), f"doc_id bigint, secrets {found}, base array<struct<kind: string, start: bigint, end: bigint>>")
