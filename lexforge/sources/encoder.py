"""Writes bit-coded dictionaries of every kind that :mod:`.formats` reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

from ..codecs.bits import BitWriter, PrefixCode, article_symbol, encipher, text_units, write_article, write_reference
from ..functions.text import DECODERS

#: Shortest and longest copy of an article.
LEAST, MOST = 3, 66


def steps(units: list[int], prefix: list[int]) -> list[tuple[str, int, int]]:
    """The longest copy from the prefix or from what is there already, or else a literal, again and again."""
    out: list[tuple[str, int, int]] = []
    at = 0
    while at < len(units):
        best = ("literal", units[at], 1)
        for kind, source in (("prefix", prefix), ("self", units[:at])):
            for start in range(len(source)):
                n = 0
                while n < MOST and start + n < len(source) and at + n < len(units) and source[start + n] == units[at + n]:
                    n += 1
                if n >= LEAST and n > best[2]:
                    best = (kind, start, n)
        out.append(best)
        at += best[2]
    return out


def _whole(values: Sequence[int], least: int = 1) -> PrefixCode:
    """A code of all numbers up to the greatest."""
    return PrefixCode.of([*values, *range(max([least, *values]) + 1)])


def _symbols(bits: BitWriter, values: Sequence[int], key: int) -> None:
    coded = [v ^ key for v in values]
    width = max(x.bit_length() for x in coded) or 1
    bits.write(len(coded), 32).write(width, 8)
    for x in coded:
        bits.write(x, width)


def dictionary(
    version: int, name: str, pages: Sequence[Sequence[tuple[str, int, Sequence[tuple[int, str]]]]], articles: Sequence[str], annotation: str = "", files: Sequence[tuple[str, bytes]] = (), prefix: str = "", languages: tuple[int, int] = (0, 0), icon: bytes = b""
) -> bytes:
    """A dictionary file: headings by page (text, number of their article, unsorted signs with their places), articles, annotation and embedded files."""
    kind = DECODERS[version]
    system, like_system, short = kind.startswith("system"), kind.startswith("system") or kind == "user_legacy", kind == "abbreviation"
    cipher = encipher if kind == "system_xor" else bytes
    shared = text_units(prefix)
    texts = [text_units(t) for t in (*articles, annotation)]
    plans = [steps(t, shared) for t in texts]
    symbols = sorted({article_symbol(*s, like_system) for plan in plans for s in plan}) or [0x80]
    code = _whole([symbols.index(article_symbol(*s, like_system)) for plan in plans for s in plan], len(symbols) - 1)
    bodies, places = b"", []
    for t, plan in zip(texts, plans):
        bits = BitWriter()
        write_article(t, plan, code, symbols, shared, like_system, bits)
        places.append(len(bodies))
        bodies += cipher(bits.data())

    rows, letters = [], sorted({u for page in pages for text, _, _ in page for u in text_units(text)}) or [0]
    for page in pages:
        known: list[int] = []
        for text, article, pairs in page:
            units = text_units(text)
            keep = next((k for k, (a, b) in enumerate(zip(known, units)) if a != b), min(len(known), len(units)))
            rows.append((keep, [letters.index(u) for u in units[keep:]], places[article], pairs))
            known = units
    letter_code, keep_code, rest_code = _whole([x for r in rows for x in r[1]], len(letters) - 1), _whole([r[0] for r in rows]), _whole([len(r[1]) for r in rows])
    most = max([1, *(r[2] for r in rows)])
    leaves, row = b"", iter(rows)
    for page in pages:
        bits = BitWriter().write(1, 1)
        for x in (0, 0, 0, 0, len(page)):
            bits.write(x, 16)
        bits.write(0, -bits.size % 8)
        for keep, rest, reference, pairs in (next(row) for _ in page):
            keep_code.encode(keep, bits)
            rest_code.encode(len(rest), bits)
            for x in rest:
                letter_code.encode(x, bits)
            write_reference(reference, most, bits)
            bits.write(bool(pairs), 1)
            if pairs:
                bits.write(len(pairs), 8)
                for place, sign in pairs:
                    bits.write(place, 8).write(ord(sign), 16)
        if len(bits.data()) > 512:
            raise ValueError("a page with too many headings")
        leaves += bits.data().ljust(512, b"\0")

    bits = BitWriter().write(len(shared), 32)
    for u in shared:
        bits.write(u ^ (0x879A if short else 0), 16)
    for values in (symbols, letters):
        _symbols(bits, values, 0x1325 if short else 0)
    code.table(bits)
    letter_code.table(bits)
    (rest_code if system else keep_code).table(bits)
    if system:
        bits.write(0, 32)
    (keep_code if system else rest_code).table(bits)
    tables = cipher(bits.write(most, 32).write(most, 32).data())

    blobs, listed = b"", struct.pack("<I", len(files))
    packed = [(n, data, zlib.compress(data)) for n, data in files]
    head = struct.calcsize("<8s9I4H") + 1 + 2 * len(text_units(name)) + 2 + 4 + (2 + len(icon)) * (version > 0x120000) + 4 * (version > 0x140000) + 8
    pages_at = head
    articles_at = pages_at + len(leaves)
    tables_at = articles_at + len(bodies)
    list_at = tables_at + len(tables)
    blobs_at = list_at + 4 + sum(1 + 2 * len(text_units(n)) + 16 for n, _, _ in packed)
    base = blobs_at if version > 0x140000 else 0
    for n, data, stored in packed:
        listed += bytes((len(text_units(n)),)) + n.encode("utf-16-le") + struct.pack("<4I", blobs_at - base + len(blobs), 0, len(data), len(stored))
        blobs += stored
    note_at = articles_at + places[-1] if annotation else 0
    out = struct.pack("<8s9I4H", b"LingVo\0", version, 0, 0, len(rows), note_at, tables_at, articles_at, pages_at, 0, len(pages) - 1, 0, *languages)
    out += bytes((len(text_units(name)),)) + name.encode("utf-16-le") + bytes(2) + bytes(4)
    if version > 0x120000:
        out += struct.pack("<H", len(icon)) + icon
    if version > 0x140000:
        out += bytes(4)
    out += struct.pack("<2I", list_at, blobs_at)
    return out + leaves + bodies + tables + listed + blobs
