"""Secrets in whole texts: patterns, and encoded candidates confirmed by their structure.

Base kinds, each matched leftmost and without overlap, then filtered: ``assign`` (a named value whose
value has 8 characters or more), ``access`` (an access key id of 16 characters or more), ``hex`` (32 hex
digits or more). On top, runs of base64 or hex characters are decoded and reported only if the bytes parse:

* ``jwt``: three dot-separated base64url parts, the first a JSON object with a string ``alg``, the
  second a JSON object; any three neighbours of a longer chain of parts are tried;
* ``der``: one ASN.1 SEQUENCE whose length covers the bytes exactly and whose content is read by nested
  tags and lengths to its end, with an INTEGER or an algorithm identifier first, as key encodings have;
  an algorithm before an octet string only if it is one of password-based encryption;
* ``ssh``: an OpenSSH private key container, or a public key as length-prefixed fields that begin with
  its type and end with the bytes.

Base64 may be wrapped over lines, as in PEM blocks, with indentation, with single spaces in place of line breaks or
with breaks escaped as in JSON; the span is the encoded run with its breaks. A key is looked for wherever its first
characters stand, also behind others of the alphabet, up to the line end that its own lengths name, so words next
to it do no harm. Hex of odd length is tried without its first or its last digit.
Spans are ``kind:start:end`` in code points, the end exclusive, ordered by start and then by kind.
Null texts count as empty and have no spans. Repeated rows give repeated results. No shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.llm.text import plain_strings

# The patterns that results must agree with.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")

SHORTEST_CODED = 24
JWT_CHAIN = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
_BREAK = r"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*|[ \t]+)"
CODED = re.compile(
    r"(?:(?<=\\)n)?([A-Za-z0-9+/_-]{%d,}(?:%s[A-Za-z0-9+/_-]+)*={0,2})" % (SHORTEST_CODED, _BREAK)
)
CODED_LINE = re.compile(r"\\r\\n|\\n|([A-Za-z0-9+/_-]+)")
#: Base64 of the first bytes of a sequence, of an OpenSSH private key and of a public key's type.
KEY_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA|AAAA[BCE]")
HEX_KEY = re.compile(r"[0-9A-Fa-f]{64,}")
#: A text without any of these has no candidate of the method's kinds.
HINTS = r"[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2,}\.|[A-Za-z0-9+/_-]{%d}" % SHORTEST_CODED
#: Nested levels of ASN.1 that are read.
DEEPEST = 12

# The branches of object identifiers 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def unbase64(run: str) -> bytes | None:
    """Bytes of a base64 or base64url run, padded or not; None if it isn't one."""
    run = run.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """``(tag, content start, content end)`` of the ASN.1 element at ``at``, if it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + size], "big"), at + size
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _nested(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the elements that fill ``at:end`` exactly, constructed ones read to their ends; else None."""
    tags = []
    while at < end:
        found = _element(data, at, end)
        if not found or depth > DEEPEST:
            return None
        tag, begin, stop = found
        if tag & 0x1F == 0x1F or tag & 0x20 and _nested(data, begin, stop, depth + 1) is None:
            return None
        if tag == 0x02 and begin == stop or tag == 0x05 and begin != stop:
            return None
        tags.append(tag)
        at = stop
    return tags


def is_der_key(data: bytes) -> bool:
    """A private or public key: a sequence of version and parts, or of an algorithm and a bit string."""
    found = _element(data, 0, len(data))
    if not found or found[0] != 0x30 or found[2] != len(data) or len(data) < 16:
        return False
    tags = _nested(data, found[1], found[2])
    if not tags or len(tags) < 2:
        return False
    if tags[0] == 0x02:  # a version or a number first, then numbers, an algorithm or a key's bytes
        return all(t in (0x02, 0x03, 0x04, 0x30, 0xA0, 0xA1) for t in tags)
    algorithm = _element(data, found[1], found[2])
    if tags not in ([0x30, 0x03], [0x30, 0x04]) or not algorithm:
        return False
    inner = _element(data, algorithm[1], algorithm[2])
    if not inner or inner[0] != 0x06:
        return False
    # Before an octet string: an encrypted key, not a digest.
    return tags[1] == 0x03 or data[inner[1] : inner[2]].startswith(_PASSWORD_BASED)


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 3  # cipher, key derivation, its options
    else:
        at, fields = 0, None
    seen = []
    while at < len(data) and (fields is None or len(seen) < fields):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        seen.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if fields is not None:
        return len(seen) == fields and at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64
    return len(seen) >= 2 and seen[0] in _SSH_TYPES


def _ssh_end(data: bytes) -> int | None:
    """Where the fields that an OpenSSH private key declares end, if it is whole."""
    at, left, counted = 15, 3, False  # as in is_ssh_key; then a number of keys, the public ones and the private part
    while left or not counted:
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not left:
            left, counted = size + 1, True
            if size > 64:
                return None
            continue
        at, left = at + size, left - 1
        if at > len(data):
            return None
    return at


def _key_from(code: str, at: int, line_ends: dict[int, int]) -> tuple[int, int] | None:
    """``(kind, line)`` of the key whose code begins at ``at`` and ends with the line before ``line``."""

    def line_after(size: int) -> int | None:
        return line_ends.get(at - (-4 * size // 3))

    head = unbase64(code[at : at + SHORTEST_CODED])
    if head[0] == 0x30:
        length, more = head[1], head[1] & 0x7F
        size = 2 + length if length < 0x80 else 2 + more + int.from_bytes(head[2 : 2 + more], "big")
        line = line_after(size)
        return (4, line) if line and is_der_key(unbase64(code[at : at - (-4 * size // 3)])) else None
    private = head.startswith(b"openssh-key-v1\0")
    if not private and not any(t.startswith(head[4 : 4 + len(t)]) for t in _SSH_TYPES):
        return None
    data = unbase64(code[at : len(code) - ((len(code) - at) % 4 == 1)])
    if private:
        end = _ssh_end(data)
        if end and line_after(end) and is_ssh_key(data[:end]):
            return 5, line_after(end)
        # Cut short: all lines that decode.
        end = next((n for n in reversed(line_ends) if n > at and (n - at) % 4 != 1), at)
        return (5, line_ends[end]) if is_ssh_key(unbase64(code[at:end])) else None
    ends, to = [], 0
    while to + 4 <= len(data) and (to := to + 4 + int.from_bytes(data[to : to + 4], "big")) <= len(data):
        ends.append(to)
    line, end = max(((line_after(n) or 0, n) for n in ends[1:]), default=(0, 0))
    return (5, line) if line and is_ssh_key(data[:end]) else None


def _keys(run: str, start: int) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the keys in a run of lines, in order and without overlap."""
    lines = [m.span(1) for m in CODED_LINE.finditer(run) if m[1]]
    code = "".join(run[a:b] for a, b in lines)
    begins = [0, *accumulate(b - a for a, b in lines)]
    line_ends = {n: k for k, n in enumerate(begins)}
    spans, done = [], 0
    for m in KEY_START.finditer(code):
        at = m.start()
        k = bisect_right(begins, at) - 1
        if at < done or begins[k + 1] - at < SHORTEST_CODED:
            continue
        found = _key_from(code, at, line_ends)
        if found:
            kind, after = found
            end = lines[after - 1][1] if after < len(lines) else len(run)  # with its padding
            spans.append((start + lines[k][0] + at - begins[k], kind, start + end))
            done = begins[after]
    return spans


def _tokens(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of signed tokens, leftmost first and without overlap."""
    spans = []
    for m in JWT_CHAIN.finditer(text):
        parts = m[0].split(".")
        begins = [0, *accumulate(len(part) + 1 for part in parts)]
        k = 0
        while k + 2 < len(parts):
            if len(parts[k]) >= 8 and len(parts[k + 1]) >= 2 and is_jwt(".".join(parts[k : k + 3])):
                spans.append((m.start() + begins[k], 3, m.start() + begins[k + 3] - 1))
                k += 3
            else:
                k += 1
    return spans


def is_jwt(run: str) -> bool:
    header, payload, signature = run.split(".")
    try:
        head, body = json.loads(unbase64(header) or b"!"), json.loads(unbase64(payload) or b"!")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return head["alg"] == "none" or unbase64(signature) not in (None, b"")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, kind by its place in ``KINDS``."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def coded_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the confirmed candidates."""
    spans = _tokens(text) if "." in text else []
    for m in CODED.finditer(text):
        spans += _keys(m[1], m.start(1))
    for m in HEX_KEY.finditer(text):
        n = len(m[0])
        for a, b in ((0, n),) if n % 2 == 0 else ((1, n), (0, n - 1)):
            data = bytes.fromhex(m[0][a:b])
            kind = 4 if is_der_key(data) else 5 if is_ssh_key(data) else None
            if kind:
                spans.append((m.start() + a, kind, m.start() + b))
                break
    return spans


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scan(batches, others: list[str], redact: bool):
    base_hint = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|[0-9a-f]{32}"
    for batch in batches:
        for at in range(0, len(batch), 1000):
            column = plain_strings(batch.column("text").slice(at, 1000))
            maybe = pc.match_substring_regex(column, base_hint).to_pylist()
            coded = pc.match_substring_regex(column, HINTS).to_pylist()
            counts, base, found, texts = ([], [], []), [], [], []
            for i in range(len(column)):
                spans = more = ()
                text = column[i].as_py() if maybe[i] or coded[i] or redact else ""
                if maybe[i]:
                    spans = base_spans(text)
                if coded[i]:
                    more = coded_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                base.append(hashlib.sha256(_named(spans).encode()).hexdigest())
                both = sorted([*spans, *more])
                found.append(_named(both))
                if redact:
                    texts.append(_redacted(text, both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(at, 1000) for c in others]
                + [pa.array(c, pa.int64()) for c in counts]
                + [pa.array(base, pa.string()), pa.array(found, pa.string())]
                + ([pa.array(texts, pa.string())] if redact else []),
                names=[*others, "n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["redacted"] * redact,
            )


def scan_secrets(docs: DataFrame, redact: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns, counts of the base kinds, their digest and all spans.

    With ``redact`` a column ``redacted`` has the text with each span replaced by its kind in brackets;
    of overlapping spans the first one's kind stands for all.
    """
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string")).mapInArrow(
        lambda batches: _scan(batches, list(keep), redact),
        f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
        + ", redacted string" * redact,
    )
