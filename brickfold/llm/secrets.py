"""Secret scan with structural confirmation.

Three base patterns report by shape alone. Further candidates, base64 or hex runs and dotted tokens, are decoded and
parsed, and reported only when their structure holds: a key encoding whose nested lengths fill the data exactly, or a
signed token whose header and body are JSON objects and name an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BASE = ("assign", "access", "hex")
CONFIRMED = ("jwt", "pem", "key")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: One of these is in every text with an assignment; looking for them first spares most texts the pattern.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Whole runs with two dots or more, so that each is looked at once; a signed token is three neighbouring parts of one.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){2,}")
#: How base64 of a brace and a quote, and of a brace and a quote or white space begins.
QUOTED, HEADERS = "eyJ", ("ey", "ew")
#: Line ends stand as such or, as in JSON and settings files, written out.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,20}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])++)-----END \1-----")
LINE_ENDS = re.compile(r"\s+|\\[nr]")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")


def decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly, else None."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or end - at < width:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80 or size >> (8 * (width - 1)) == 0:
                return None  # DER wants the shortest form
        if size > end - at:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def der_key(data: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8, SEC1 or DSA form, or an encrypted one in PKCS#8 form."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = elements(data, 0, len(data))
    inner = elements(data, *outer[0][1:]) if outer and len(outer) == 1 else None
    if inner and [t for t, _, _ in inner] == [0x30, 0x04] and inner[1][2] - inner[1][1] >= 8:
        name = elements(data, *inner[0][1:])  # of the cipher, with its parameters
        return bool(name) and [t for t, _, _ in name] == [0x06, 0x30] and bool(elements(data, *name[1][1:]))
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    version, tags = data[inner[0][1]], [t for t, _, _ in inner]
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        name = elements(data, *inner[1][1:])
        return bool(name) and name[0][0] == 0x06
    if version == 0 and len(inner) in (6, 9) and set(tags) == {0x02}:
        return True
    return version == 1 and tags[1] == 0x04 and 16 <= inner[1][2] - inner[1][1] <= 72


def ssh_key(data: bytes) -> bool:
    """A private key in the OpenSSH form: nested length-prefixed fields that end with the data."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if len(data) - at < 4:
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return at <= len(data)

    if not (field() and field() and field()) or len(data) - at < 4:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 0 < keys <= 64 and all(field() for _ in range(keys + 1)) and at == len(data)


def key(data: bytes | None) -> bool:
    return data is not None and (der_key(data) or ssh_key(data))


def json_object(part: str) -> dict | None:
    try:
        value = json.loads(decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_tokens(run: str, at: int) -> list[tuple[str, int, int]]:
    """Spans of the signed tokens in a dotted run that starts at ``at``: a header that names an algorithm, a body, and a signature, maybe empty."""
    parts, out, i = run.split("."), [], 0
    start = at
    while i + 2 < len(parts):
        head, body, sign = parts[i : i + 3]
        skipped = 0 if head.startswith(HEADERS) else head.find(QUOTED)  # other letters may touch a header
        header = json_object(head[skipped:]) if body and skipped >= 0 else None
        if header is not None and isinstance(header.get("alg"), str) and json_object(body) is not None:
            end = start + len(head) + len(body) + len(sign) + 2
            out.append(("jwt", start + skipped, end))
            start, i = end + 1, i + 3
        else:
            start, i = start + len(head) + 1, i + 1
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then base kinds before confirmed ones in the order listed above."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(h in text for h in HEADERS) and "." in text:
        out += [t for m in DOTTED.finditer(text) for t in signed_tokens(m[0], m.start())]
    if "PRIVATE KEY" in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if key(decoded(LINE_ENDS.sub("", m[2])))]
    out += [("key", *m.span()) for m in RUN.finditer(text) if key(decoded(m[0]))]
    out += [("key", *m.span()) for m in HEX_RUN.finditer(text) if key(bytes.fromhex(m[0]))]
    order = {k: i for i, k in enumerate(BASE + CONFIRMED)}
    return sorted(set(out), key=lambda s: (s[1], order[s[0]], s[2]))


def spans_of(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans(t.as_py() or "")] for t in texts], kind)


def find_secrets(docs: DataFrame, text_column: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) in code points, end exclusive; NULL texts are empty and have none."""
    return docs.withColumn(out, F.arrow_udf(spans_of, SPANS)(text_of(text_column)))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row; repeated rows stay, other columns are not read."""
    own = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    found = find_secrets(own, "__text", "__spans").select("__id", "__spans")
    kinds = F.col("__spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("__id").alias("doc_id"), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans")
    )
