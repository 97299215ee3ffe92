"""Secret scans with structural confirmation (operator 10).

Three plain patterns report candidates; on top of them, base64 and hex candidates are decoded and
reported only if what they hold is built like a key or a token:

* ``pem``: an armoured private key whose body decodes to one of the two encodings below. Header lines
  and escaped line ends (as in JSON or source code) are taken out of the body first; a key whose
  headers name a cipher must be whole blocks of it;
* ``der``: nested lengths that fill the value exactly, starting with a version integer;
* ``openssh``: the magic string of that key file followed by length-prefixed fields;
* ``jwt``: a signed token whose header is JSON with an algorithm, whose payload is JSON.

Base64 wrapped at one width over several lines is one candidate. Every step is linear in the text, so
very long texts and long runs of one pattern are scanned whole. Nesting too deep to be read as JSON
or as nested lengths is no secret.

Defined results: null and empty texts have no spans; repeated rows are each reported; spans of
different kinds that start at one place are listed in the order of KINDS; offsets are in code points,
end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks, tune

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
LINE_END = re.compile(r"\\r\\n|\\[nr]|\r\n|[\r\n]")
ARMOUR_HEADER = re.compile(r"([A-Za-z0-9-]+):[ \t]*(.*)")
CIPHER = re.compile(r"(AES-[0-9]+|DES|DES-EDE3|CAMELLIA-[0-9]+)-(?:CBC|ECB|CFB|OFB),([0-9A-Fa-f]+)")
TOKEN_PART = re.compile(r"[A-Za-z0-9_-]+")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
NEXT_LINE = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_-]+={0,2})")
ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
#: Base64 characters of the least header that names an algorithm.
LEAST_HEADER = 14
OPENSSH = b"openssh-key-v1\x00"


def _base64(text: str) -> bytes:
    raw = re.sub(r"\\[nr]|[\s=]", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _der(b: bytes, at: int, end: int, depth: int) -> bool:
    """Whether tags and lengths fill b[at:end] exactly, constructed values included."""
    while at < end:
        if at + 2 > end:
            return False
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return False
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > end or (tag & 0x20 and (depth > 16 or not _der(b, at, at + n, depth + 1))):
            return False
        at += n
    return True


def key_encoding(b: bytes, *, sealed: bool = False) -> str | None:
    """``der`` or ``openssh`` if the bytes are a private key in that encoding; ``sealed``: an encrypted one."""
    if b.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):  # cipher, kdf, kdf options
            n = int.from_bytes(b[at : at + 4], "big")
            if at + 4 + n > len(b):
                return None
            at += 4 + n
        return "openssh" if at + 4 <= len(b) and 1 <= int.from_bytes(b[at : at + 4], "big") < 256 else None
    if len(b) < 24 or b[0] != 0x30 or not _der(b, 0, len(b), 0):
        return None
    at = 2 + (b[1] & 0x7F if b[1] & 0x80 else 0)
    if sealed:  # an algorithm's sequence comes first
        return "der" if b[at] == 0x30 else None
    return "der" if b[at : at + 2] == b"\x02\x01" and b[at + 2] in (0, 1) and len(b) > at + 3 else None


def _armoured_key(label: str, body: str) -> bool:
    """Whether the body of an armour holds a key: headers are read, the rest must be base64."""
    cipher, code = None, []
    for line in LINE_END.split(body):
        header = ARMOUR_HEADER.match(line.strip())
        if header:
            cipher = CIPHER.fullmatch(header[2].strip()) or cipher
        else:
            code.append(line.strip())
    raw = _base64("".join(code))
    if cipher:
        block = 8 if cipher[1].startswith("DES") else 16
        return len(raw) >= 32 and len(raw) % block == 0 and len(cipher[2]) == 2 * block
    return key_encoding(raw, sealed=label == "ENCRYPTED ") is not None


def _armours(text: str) -> list[tuple[int, int]]:
    begins, out = list(BEGIN.finditer(text)), []
    for m, after in zip(begins, [*(n.start() for n in begins[1:]), len(text)], strict=True):
        end = f"-----END {m[1]}PRIVATE KEY-----"
        at = text.find(end, m.end(), after)
        if at >= 0 and _armoured_key(m[1], text[m.end() : at]):
            out.append((m.start(), at + len(end)))
    return out


def _encoded_keys(text: str) -> list[tuple[int, str, int]]:
    """(start, encoding, end) of base64 keys: lines of one width, the last perhaps shorter, or one run."""
    out, tried = [], 0
    for m in ENCODED.finditer(text):
        if out and m.start() < out[-1][2]:
            continue
        code, width, end = [m[0]], len(m[0]), m.end()
        if m.start() >= tried:
            while len(code[-1]) == width and not code[-1].endswith("=") and (n := NEXT_LINE.match(text, end)) and len(n[1]) <= width:
                code.append(n[1])
                end = n.end()
            tried = end
        kind = key_encoding(_base64("".join(code))) if len(code) > 1 else None
        if kind:
            out.append((m.start(), kind, end))
        elif kind := key_encoding(_base64(m[0])):
            out.append((m.start(), kind, m.end()))
    return out


def _is_json(part: str, test) -> bool:
    try:
        return test(json.loads(_base64(part)))
    except (ValueError, RecursionError):
        return False


def signed_token(head: str, body: str) -> bool:
    return _is_json(head, lambda x: isinstance(x, dict) and isinstance(x.get("alg"), str)) and _is_json(body, lambda x: isinstance(x, dict))


def _tokens(text: str) -> list[tuple[int, int]]:
    """Signed tokens: three parts joined by dots, the last perhaps empty. A header starts at the first
    or the last ``eyJ`` of its part, so each part is decoded a bounded number of times."""
    out, parts = [], [m.span() for m in TOKEN_PART.finditer(text)]
    for i, ((a, b), (c, d)) in enumerate(zip(parts, parts[1:], strict=False)):
        if b - a < LEAST_HEADER or c != b + 1 or text[b] != "." or text[d : d + 1] != "." or (out and a < out[-1][1]):
            continue
        for at in sorted({text.find("eyJ", a, b), text.rfind("eyJ", a, b)} - {-1}):
            if signed_token(text[at:b], text[c:d]):
                last = parts[i + 2] if i + 2 < len(parts) else (0, 0)
                out.append((at, last[1] if last[0] == d + 1 else d + 1))
                break
    return out


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each finding; substring tests spare most texts the patterns."""
    low = raw.lower()
    long_word = max(map(len, raw.split()), default=0)
    assigned = (b":" in raw or b"=" in raw) and any(k in low for k in KEYWORDS)
    armoured, token = b"PRIVATE KEY-----" in raw, b"eyJ" in raw
    if not assigned and long_word < 20 and not armoured and not token:
        return []
    text, out = raw.decode("utf-8", "replace"), []
    if assigned:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if long_word >= 24:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    armours = _armours(text) if armoured else []
    out += [(a, KINDS.index("pem"), b) for a, b in armours]
    if long_word >= 32:
        found = [(m.start(), kind, m.end()) for m in ANY_HEX.finditer(text) if (kind := key_encoding(bytes.fromhex(m[0])))]
        found += _encoded_keys(text)
        starts = [a for a, _ in armours]
        for a, kind, b in found:
            k = bisect.bisect_right(starts, a) - 1
            if k < 0 or a >= armours[k][1]:
                out.append((a, KINDS.index(kind), b))
    if token:
        out += [(a, KINDS.index("jwt"), b) for a, b in _tokens(text)]
    return sorted(set(out))


def _listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id with counts, the digest of the plain findings and all spans; reads doc_id and text only."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def rows(batches):
        for b in batches:
            found = [scan(raw) for _, chunk in text_chunks(b) for raw in chunk]
            counts = [pa.array([sum(f[1] == k for f in x) for x in found], pa.int64()) for k in range(3)]
            base = pa.array([hashlib.sha256(_listed(f for f in x if f[1] < 3).encode()).hexdigest() for x in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, base, pa.array([_listed(x) for x in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.mapInArrow(rows, schema)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
