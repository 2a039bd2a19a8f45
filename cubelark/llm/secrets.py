"""Secret scans with structural confirmation.

Base patterns report what looks like an assignment of a secret, an access key or
a hex string.  Beyond these, candidates in base64 or hex are decoded and parsed;
only what has the structure of a key or token is reported: nested DER lengths,
key file framing, the length-prefixed fields of public-key wire formats, or the
JSON header of a signed token.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed: kinds in the order of the digest.  The first three are the base.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "pem", "der", "ssh")
KINDS = BASE_KINDS + ADDED_KINDS

#: Fixed base patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Fixed: candidates of the confirmed kinds.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,\\]|-(?!----))*)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
NEXT_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+)(={0,2})")
LONG_HEX = re.compile(r"(?:[0-9a-f]{2}){32,}|(?:[0-9A-F]{2}){32,}")
ENCRYPTED = re.compile(r"DEK-Info:\s*(AES|DES|CAMELLIA|BF|RC2)-[A-Z0-9-]+,\s*([0-9A-Fa-f]+)")
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH_MAGIC = b"openssh-key-v1\x00"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind; ends are exclusive."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    spans += [("hex", m.start(), m.end()) for m in _HEX_RUNS.finditer(text)]
    spans += confirmed(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Runs of the hex class of at least the least length are the matches of HEX that stay.
_HEX_RUNS = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded content parses as a key or token."""
    spans = []
    if "eyJ" in text:
        spans += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_token(m[1], m[2], m[3])]
    if "-----BEGIN" in text:
        spans += [("pem", m.start(), m.end()) for m in PEM.finditer(text) if is_private_key(m[2])]
    framed = [(a, b) for _, a, b in spans]
    found = [*_in_base64(text), *((_kind(bytes.fromhex(m[0])), m.start(), m.end()) for m in LONG_HEX.finditer(text))]
    return spans + [s for s in found if s[0] and not any(a <= s[1] < b for a, b in framed)]


def _kind(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    return "der" if is_key_structure(raw) else "ssh" if is_wire_key(raw) else None


def _in_base64(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 of either alphabet: in one run, or wrapped over lines of one length and a shorter last one."""
    at = 0
    while run := RUN.search(text, at):
        begin, ends = run.start(), [run.end()]
        while text[ends[-1] - 1] != "=" and (line := NEXT_LINE.match(text, ends[-1])) and len(line[1]) <= len(run[0]):
            ends.append(line.end())
            if len(line[1]) < len(run[0]):
                break
        at = ends[-1]
        # what follows on a line of its own may not belong to the key
        for end in ends[:-3:-1]:
            if kind := _kind(_base64("".join(text[begin:end].split()), url="-" in text[begin:end] or "_" in text[begin:end])):
                yield kind, begin, end
                break
        else:
            for m in BASE64.finditer(text, begin, at):
                if kind := _kind(_base64(m[0])):
                    yield kind, m.start(), m.end()


def _base64(value: str, url: bool = False) -> bytes | None:
    body = value.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token(header: str, payload: str, signature: str) -> bool:
    """A signed token: header and payload are JSON objects, the header names an algorithm."""
    try:
        head, body = (json.loads(_base64(part, url=True) or b"") for part in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return bool(signature) or head["alg"].lower() == "none"


def is_private_key(body: str) -> bool:
    """The body of a key file: headers aside, base64 of DER, of an OpenSSH key, or encrypted bytes."""
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").strip().splitlines()]
    headers = [x for x in lines if ":" in x]
    raw = _base64("".join(x for x in lines if ":" not in x))
    if not raw:
        return False
    if any("ENCRYPTED" in x for x in headers):
        # nothing shows but the cipher's name, its initial vector of one block (two ciphers take half), and whole blocks
        named = [m for x in headers if (m := ENCRYPTED.fullmatch(x))]
        block = 16 if named and named[0][1] == "AES" else 8
        return bool(named) and len(named[0][2]) == 2 * block and len(raw) % block == 0
    return is_openssh_key(raw) or is_key_structure(raw)


def der_items(raw: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER items that fill raw[at:end] exactly, else None."""
    end = len(raw) if end is None else end
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end or raw[at] == 0:
                return None
            size = int.from_bytes(raw[at : at + width], "big")
            if size < 0x80:
                return None
            at += width
        if at + size > end:
            return None
        items.append((tag, raw[at : at + size]))
        at += size
    return items


def is_key_structure(raw: bytes) -> bool:
    """DER: one sequence that fills the bytes, with the nested lengths of a key.

    Known forms: RSA or DSA (a small version, then five or more integers), EC (version 1,
    then an octet string), PKCS#8 (version, algorithm sequence, octet string) and its
    encrypted form (algorithm sequence, octet string), or public keys (algorithm, bit string).
    """
    outer = der_items(raw)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _ in items]
    version = items[0][1] in (b"\x00", b"\x01")
    if tags[0] == 0x02 and version and len(items) >= 6 and all(t == 0x02 for t in tags[:6]):
        return True
    if tags[:2] == [0x02, 0x04] and version:
        return len(items[1][1]) >= 16
    if tags[:3] == [0x02, 0x30, 0x04] and version:
        return _algorithm(items[1][1])
    if tags[:2] in ([0x30, 0x04], [0x30, 0x03]) and len(items) == 2:
        return _algorithm(items[0][1])
    return False


def _algorithm(content: bytes) -> bool:
    inner = der_items(content)
    return bool(inner) and inner[0][0] == 0x06 and 3 <= len(inner[0][1]) <= 16


def wire_fields(raw: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from `at` on, all or `most` of them, and where they end; None where a length leads out."""
    fields = []
    while len(fields) < most if most is not None else at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 > len(raw) or at + 4 + size > len(raw):
            return None
        fields.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_wire_key(raw: bytes) -> bool:
    """Length-prefixed fields that fill the bytes, the first a key type; or the OpenSSH container."""
    if raw.startswith(OPENSSH_MAGIC):
        return is_openssh_key(raw)
    read = wire_fields(raw)
    return read is not None and len(read[0]) >= 2 and read[0][0] in SSH_TYPES


def is_openssh_key(raw: bytes) -> bool:
    """The OpenSSH container: cipher, derivation and its options, public keys, and a private part that fills the rest.

    Unencrypted, the private part begins with one number twice and holds a key type; encrypted, it is whole blocks.
    """
    head = wire_fields(raw, len(OPENSSH_MAGIC), 3) if raw.startswith(OPENSSH_MAGIC) else None
    if head is None:
        return False
    (cipher, _, _), at = head
    keys = int.from_bytes(raw[at : at + 4], "big")
    if not 1 <= keys <= 64 or (rest := wire_fields(raw, at + 4, keys + 1)) is None or rest[1] != len(raw):
        return False
    *public, private = rest[0]
    if not all(map(is_wire_key, public)):
        return False
    if cipher != b"none":
        return bool(cipher) and len(private) > 0 and len(private) % 8 == 0
    inner = wire_fields(private, 8, 1)
    return private[:4] == private[4:8] and inner is not None and inner[0][0] in SSH_TYPES


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end) in code points.

    Spans come by start, then kind.  A null or empty text has none.  Scanning is
    local to the row, so nothing is shuffled.
    """

    def make():
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in batch.column("text").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

        return work

    return common.map_arrow(common.documents(df, id_col, text_col), make, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as one string."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
