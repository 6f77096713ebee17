"""Secrets in texts and in whatever is encoded in them, layer by layer."""

from __future__ import annotations

import base64
import binascii
import bz2
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import flat, pieces

#: Kinds of secrets: a literal that is searched for (in lower case if the flag is set) and the pattern that must match around it, within so many bytes before.
RULES: tuple[tuple[str, bytes, bool, int, re.Pattern[bytes]], ...] = tuple(
    (kind, anchor, fold, before, re.compile(pattern))
    for kind, anchor, fold, before, pattern in (
        ("aws_key", b"AKIA", False, 0, rb"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"),
        ("aws_key", b"ASIA", False, 0, rb"(?<![A-Z0-9])ASIA[A-Z0-9]{16}(?![A-Z0-9])"),
        *(("github_token", b"gh" + c + b"_", False, 0, rb"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}(?![A-Za-z0-9])") for c in (b"p", b"o", b"u", b"s", b"r")),
        ("slack_token", b"xox", False, 0, rb"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
        ("google_key", b"AIza", False, 0, rb"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
        ("stripe_key", b"_live_", False, 2, rb"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}"),
        ("jwt", b"eyJ", False, 0, rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        ("private_key", b"PRIVATE KEY-----", False, 32, rb"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
        *(("assigned_secret", word, True, 0, rb"(?i:" + re.escape(word) + rb")[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[^\s\"'<>,;&]{8,}") for word in (b"password", b"passwd", b"secret", b"api_key", b"apikey", b"api-key", b"access_token", b"auth_token")),
        # a bare "token" is also an ordinary word, so its value must look like one: long, without blanks, with a digit
        ("assigned_secret", b"token", True, 0, rb"(?i:token)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?(?=[A-Za-z_./+-]{0,64}[0-9])[A-Za-z0-9_./+-]{16,}"),
    )
)
#: Shorter runs aren't taken for base64.
BASE64_RUN = 20
#: A layer that decompresses to more bytes is taken in windows of so many, each with the last OVERLAP bytes of the one before it.
LAYER_BYTES, OVERLAP = 16 << 20, 4 << 20

_B64 = np.zeros(256, np.bool_)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_":
    _B64[_c] = True
_HEX = np.zeros(256, np.bool_)
for _c in b"0123456789abcdefABCDEF":
    _HEX[_c] = True
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % BASE64_RUN)
_WRAPPED = re.compile(rb"(?:[A-Za-z0-9+/_-]{%d,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}" % BASE64_RUN)
_BREAK = re.compile(rb"\r?\n[ \t]*")
_BOUNDARY = re.compile(rb"[/_-]")
_PERCENT_ONE = re.compile(rb"%([0-9A-Fa-f]{2})")
_UNICODE_ONE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BLANK = re.compile(rb"\s")
_PRINT = frozenset(range(32, 127)) | {9, 10, 13}
_TABLE = bytes(sorted(_PRINT))


def secrets(data: bytes) -> list[tuple[int, int, str]]:
    """Start, end and kind of the secrets in one layer; at a place the first kind of the list."""
    out: dict[tuple[int, int], str] = {}
    folded = None
    for kind, anchor, fold, before, pattern in RULES:
        if fold and folded is None:
            folded = data.lower()
        where = folded if fold else data
        at = where.find(anchor)
        while at >= 0:
            m = next((m for k in range(max(0, at - before), at + 1) if (m := pattern.match(data, k)) and m.end() > at), None)
            if m:
                out.setdefault(m.span(), kind)
            at = where.find(anchor, at + 1)
    found: list[tuple[int, int, str]] = []
    ends: dict[str, int] = {}
    for (a, b), kind in sorted(out.items(), key=lambda x: (x[0][0], -x[0][1])):
        if b > ends.get(kind, -1):  # access_token=... is one secret, not also token=...
            found.append((a, b, kind))
            ends[kind] = b
    return found


def _substituted(token: bytes, one: re.Pattern[bytes], value) -> tuple[bytes, np.ndarray]:
    """The token with its escapes decoded, and from where in it each byte comes (with the end at last)."""
    parts, places, at = [], [], 0
    for m in one.finditer(token):
        new = value(m)
        if new is None:
            continue
        parts += [token[at : m.start()], new]
        places += [np.arange(at, m.start()), np.full(len(new), m.start())]
        at = m.end()
    parts.append(token[at:])
    places.append(np.arange(at, len(token) + 1))
    return b"".join(parts), np.concatenate(places)


def _code_point(m: re.Match[bytes]) -> bytes | None:
    digits = next(g for g in m.groups() if g)
    point = int(digits, 10 if m.lastindex == 5 else 16)
    return chr(point).encode("utf-8", "surrogatepass") if point < 0x110000 else None


def _join_surrogates(data: bytes, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    if b"\xed" not in data:
        return data, places
    try:
        joined = data.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16").encode()
    except UnicodeDecodeError:
        return data, places
    # six bytes of two halves became four of one sign
    return joined, places if len(joined) == len(data) else np.concatenate((np.interp(np.arange(len(joined)) * len(data) / max(1, len(joined)), np.arange(len(data) + 1), places).astype(np.int64), places[-1:]))


def _inflated(data: bytes) -> tuple[str, Iterator[bytes]] | None:
    """Codec and content of a compressed layer, in windows; None if it isn't one."""
    if data[:2] == b"\x1f\x8b":
        codec, parts = "gzip", _deflated(zlib.decompressobj(31), data)
    elif len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        codec, parts = "zlib", _deflated(zlib.decompressobj(), data)
    elif data[:3] == b"BZh":
        codec, parts = "bzip2", _streamed(bz2.BZ2Decompressor(), data)
    elif data[:6] == b"\xfd7zXZ\x00":
        codec, parts = "xz", _streamed(lzma.LZMADecompressor(), data)
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        codec, parts = "zstd", _zstandard(data)
    else:
        return None
    windows = _windows(parts)
    first = next(windows, None)
    return None if first is None else (codec, itertools.chain((first,), windows))


def _deflated(machine, data: bytes) -> Iterator[bytes]:
    while data and not machine.eof:
        yield machine.decompress(data, 1 << 20)
        data = machine.unconsumed_tail


def _streamed(machine, data: bytes) -> Iterator[bytes]:
    while not machine.eof:
        part = machine.decompress(data, 1 << 20)
        data = b""
        yield part
        if not part and machine.needs_input:
            return


def _zstandard(data: bytes) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor().stream_reader(data) as reader:
        while part := reader.read(1 << 20):
            yield part


def _windows(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The parts in windows; what comes before damage is given, unless it is nothing."""
    held = bytearray()
    fresh = False
    try:
        for part in parts:
            held += part
            fresh = fresh or bool(part)
            if len(held) >= LAYER_BYTES:
                yield bytes(held)
                del held[: len(held) - OVERLAP]
                fresh = False
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    if fresh:
        yield bytes(held)


def _plausible(data: bytes) -> bool:
    """Text, as opposed to chance: all bytes printable, or UTF-8 without control signs. Other layers are scanned, but not unwrapped further."""
    if not data:
        return False
    if len(data.translate(None, _TABLE)) == 0:
        return True
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return all(c >= " " or c in "\t\n\r" for c in text)


def _base64(run: bytes) -> bytes | None:
    plain = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + b"=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _good(raw: bytes | None) -> bool:
    return raw is not None and (_plausible(raw) or _inflated(raw) is not None or bool(secrets(raw)) or bool((wide := _utf16(raw)) and (_plausible(wide) or secrets(wide))))


def _utf16(data: bytes) -> bytes | None:
    """The layer in UTF-8 if it may be UTF-16, with or without a byte order mark."""
    even, odd = data[::2].count(0), data[1::2].count(0)
    if 4 * max(even, odd) < len(data) // 2 and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return None
    big = data[:2] == b"\xfe\xff" or data[:2] != b"\xff\xfe" and even > odd
    return data.decode("utf-16-be" if big else "utf-16-le", "ignore").lstrip("\ufeff").encode()


def _opened(run: bytes) -> Iterator[tuple[int, bytes]]:
    """From where the run decodes, and to what: as a whole, else after its first inner boundary that gives sense, else at the alignments that show a secret."""
    whole = _base64(run)
    if _good(whole):
        yield 0, whole
        return
    for m in _BOUNDARY.finditer(run):
        k = m.end()
        head = _base64(run[k : k + 24])
        # what is wrong from its head on isn't decoded whole, so a long run stays linear
        if len(run) - k >= BASE64_RUN and head and (head[:2] in (b"\x1f\x8b", b"BZ", b"\xfd7", b"\x28\xb5") or head[0] & 15 == 8 or _plausible(head[:12])) and _good(raw := _base64(run[k:])):
            yield k, raw
            return
    plain = run.rstrip(b"=")
    for k in range(4):
        raw = _base64(plain[k : len(plain) - (len(plain) - k) % 4])
        if raw and (secrets(raw) or (wide := _utf16(raw)) and secrets(wide)):
            yield k, raw


def _runs(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Spans and characters of what may be base64: runs, and those that go on over line breaks without them."""
    done = 0
    for m in _RUN.finditer(data):
        yield *m.span(), m[0]
        if m.start() >= done and (w := _WRAPPED.match(data, m.start())):
            done = w.end()
            yield *w.span(), _BREAK.sub(b"", w[0])


def _words(data: bytes, one: re.Pattern[bytes]) -> Iterator[tuple[int, int]]:
    """Spans of the runs without white space that hold an escape, each once, in time linear in the data."""
    end = 0
    for m in one.finditer(data):
        if m.start() < end:
            continue
        back = max((data.rfind(c, end, m.start()) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")), default=-1)
        start = max(back + 1, end)
        blank = _BLANK.search(data, m.end())
        end = blank.start() if blank else len(data)
        yield start, end


def layers(data: bytes) -> Iterator[tuple[str, bytes, int, int, np.ndarray | None]]:
    """What is encoded in a layer: codec, content, the span in the layer, and for escapes where each byte comes from."""
    if b"%" in data:
        for a, b in _words(data, _PERCENT_ONE):
            new, places = _substituted(data[a:b], _PERCENT_ONE, lambda x: bytes([int(x[1], 16)]))
            yield "url", new, a, b, places
    if b"\\" in data or b"&#" in data:
        for a, b in _words(data, _UNICODE_ONE):
            new, places = _join_surrogates(*_substituted(data[a:b], _UNICODE_ONE, _code_point))
            yield "unicode", new, a, b, places
    for a, b, run in _runs(data):
        for k, raw in _opened(run):
            inner = _inflated(raw)
            if inner is not None:
                for part in inner[1]:
                    yield f"base64+{inner[0]}", part, a + k, b, None
            else:
                yield "base64", raw, a + k, b, None
                if wide := _utf16(raw):
                    yield "base64+utf16", wide, a + k, b, None
    inner = _inflated(data)
    if inner is not None:
        for part in inner[1]:
            yield inner[0], part, 0, len(data), None


def scan(data: bytes) -> list[tuple[str, str, int, int, int, bytes]]:
    """Kind, path of codecs, depth, start, end in the text's bytes, and the secret, of all layers.

    A worklist: every layer is scanned, and what it holds is put on the list
    unless its content has been there for this span, until nothing new
    comes up. So the depth has no bound, and a layer that decodes to itself
    ends.
    """
    out = {}
    seen: set[tuple[bytes, int, int]] = {(data, 0, len(data))}
    todo: list[tuple[bytes, str, int, np.ndarray | None, tuple[int, int]]] = [(data, "", 0, np.arange(len(data) + 1) if len(data) < 1 << 16 else None, (0, len(data)))]
    while todo:
        content, path, depth, places, whole = todo.pop()

        def span(a: int, b: int, depth=depth, places=places, whole=whole) -> tuple[int, int]:
            if depth == 0:
                return a, b
            if places is None:
                return whole
            return int(places[a]), max(int(places[b]), int(places[a]) + 1)

        for a, b, kind in secrets(content):
            out.setdefault((kind, *span(a, b), content[a:b]), (path, depth))
        if path.endswith("base64") and not _plausible(content) and _inflated(content) is None:
            continue
        for codec, new, a, b, inner in layers(content):
            at = span(a, b)
            where = f"{path}/{codec}" if path else codec
            if (new, *at) in seen or new == content:
                continue
            seen.add((new, *at))
            if inner is not None and (depth == 0 or places is not None):
                inner = inner + a if depth == 0 else places[np.minimum(inner + a, len(places) - 1)]
            else:
                inner = None
            todo.append((new, where, depth + 1, inner, at))
    return [(kind, path, depth, a, b, secret) for (kind, a, b, secret), (path, depth) in sorted(out.items(), key=lambda x: (x[0][1], x[0][2], x[1][1], x[0][0], x[0][3]))]


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold a rule's literal, an escape or a run that may be base64; all others have nothing to find."""
    n = len(raw)
    rows = np.zeros(len(offsets) - 1, np.bool_)
    if not n:
        return rows

    def mark(places: np.ndarray) -> None:
        rows[np.searchsorted(offsets, places, "right") - 1] = True

    data = raw.tobytes()
    folded = data.lower()
    for anchor, fold in dict.fromkeys((a, f) for _, a, f, _, _ in RULES):
        where = folded if fold else data
        at = where.find(anchor)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            rows[row] = True
            at = where.find(anchor, int(offsets[row + 1]) if at + len(anchor) <= offsets[row + 1] else at + 1)
    hexed = _HEX[raw]
    percent = np.flatnonzero(raw[:-2] == 37) if n > 2 else np.zeros(0, np.int64)
    mark(percent[hexed[percent + 1] & hexed[percent + 2]])
    if b"\\" in data:
        mark(np.flatnonzero(raw == 92))
    at = data.find(b"&#")
    while at >= 0:
        mark(np.array([at]))
        at = data.find(b"&#", at + 2)
    inside = np.concatenate(([False], _B64[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    long_ = end - start >= BASE64_RUN
    for a, b in zip(start[long_].tolist(), end[long_].tolist()):
        # a run may reach over the ends of rows
        row = np.searchsorted(offsets, [a, b - 1], "right") - 1
        if row[0] != row[1] or data[b : b + 1] in (b"\r", b"\n") or _decodes(data[a:b]):
            rows[row[0] : row[1] + 1] = True
    return rows


def _decodes(word: bytes) -> bool:
    return next(_opened(word), None) is not None


def found(docs: DataFrame) -> DataFrame:
    """Secrets of every document, on all layers.

    Returns doc_id, kind, path (the codecs from the outside in, empty for the
    text itself), depth, start and end (in bytes of the text in UTF-8; of an
    encoded secret the span that it was decoded from) and secret. Secrets that
    occur more often are reported each. Compressed data is recognised where it
    is base64 or a layer of its own.

    Null and empty texts have none; a null ``doc_id`` is reported as null;
    repeated rows are reported each; texts are scanned whole. An empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            raw, offsets = flat(piece.column("text"))
            ids = piece.column("doc_id")
            out = []
            for r in np.flatnonzero(suspects(raw, offsets)).tolist():
                doc = ids[r].as_py()
                out.extend((doc, *x) for x in scan(raw[offsets[r] : offsets[r + 1]].tobytes()))
            if out:
                doc, kind, path, depth, start, end, secret = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(kind), pa.array(path), pa.array(depth, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([s.decode("utf-8", "replace") for s in secret])],
                    ["doc_id", "kind", "path", "depth", "start", "end", "secret"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, kind string, path string, depth int, start long, end long, secret string")
