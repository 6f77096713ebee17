"""Dictionary, index, archive and manifest files, as rows of plain values. No Spark here."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from ..codecs import charset
from ..codecs.bits import BitReader, CipheredReader, PrefixCode, interleave, read_article, read_reference, units_text
from ..codecs.deflate import inflate
from ..functions.text import DECODERS

BLOCK = 8192


class Cursor:
    """Little-endian fields of some bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError("the file has ended")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def until(self, stop: int) -> bytes:
        end = self.data.index(stop, self.at)
        out, self.at = self.data[self.at : end], end + 1
        return out


# bit-coded dictionaries
@dataclass
class Dictionary:
    version: int
    decoder: str
    entries: int
    source: int
    target: int
    name: str = ""
    icon: bytes = b""
    pages: int = 0
    pages_at: int = 0
    articles_at: int = 0
    annotation_at: int = 0
    tables_at: int = 0
    overlay_list: int = 0
    overlay_data: int = -1


def dictionary(data: bytes) -> Dictionary:
    """The header; an unsupported version has only its first fields."""
    if data[:7] != b"LingVo\0":
        raise ValueError("not a dictionary of this kind")
    version, _, _, entries, annotation, tables, articles, pages, _, last, _, source, target = struct.unpack_from("<9I4H", data, 8)
    d = Dictionary(version, DECODERS.get(version, "unsupported"), entries, source, target)
    if d.decoder == "unsupported":
        return d
    c = Cursor(data, 52)
    utf16 = lambda n: c.take(2 * n).decode("utf-16-le")
    d.name = utf16(c.number(1))
    utf16(c.number(1))
    utf16(c.number(1))
    utf16(c.number(4))
    if version > 0x120000:
        d.icon = c.take(c.number(2))
    if version > 0x140000:
        c.take(4)
    d.overlay_list, base = c.number(4), c.number(4)
    d.overlay_data = -1 if version < 0x120000 else 0 if version < 0x140000 else base
    d.pages, d.pages_at, d.articles_at, d.annotation_at, d.tables_at = last + 1, pages, articles, annotation, tables
    return d


class Decoder:
    """The tables of a dictionary; the order in which they are stored depends on its kind."""

    def __init__(self, data: bytes, d: Dictionary) -> None:
        self.data, self.d = data, d
        system, short = d.decoder.startswith("system"), d.decoder == "abbreviation"
        self.ciphered = d.decoder == "system_xor"
        bits = self.bits(d.tables_at)
        n = bits.read(32)
        self.prefix = [bits.read(16) ^ (0x879A if short else 0) for _ in range(n)]
        self.articles, self.letters = ([x ^ (0x1325 if short else 0) for x in _symbols(bits)] for _ in range(2))
        self.article_code, self.letter_code = PrefixCode.read(bits), PrefixCode.read(bits)
        first = PrefixCode.read(bits)
        if system:
            bits.read(32)
        second = PrefixCode.read(bits)
        self.prefix_code, self.rest_code = (second, first) if system else (first, second)
        self.most_1, self.most_2 = bits.read(32), bits.read(32)

    def bits(self, at: int) -> BitReader:
        """A fresh stream from there; a keystream starts anew with it."""
        return CipheredReader(self.data, at) if self.ciphered else BitReader(self.data, at)

    def article(self, reference: int) -> str:
        system = self.d.decoder.startswith("system") or self.d.decoder == "user_legacy"
        return read_article(self.bits(self.d.articles_at + reference), self.article_code, self.articles, self.prefix, system)

    def annotation(self) -> str:
        return self.article(self.d.annotation_at - self.d.articles_at)

    def page(self, number: int) -> Iterator[tuple[list[tuple[str, bool, bool]], int]]:
        """Characters and reference of a leaf page's headings; pages are independent of each other."""
        bits = BitReader(self.data, self.d.pages_at + 512 * number)
        leaf = bits.read(1)
        for _ in range(4):
            bits.read(16)
        count = bits.read(16)
        bits.align()
        known: list[int] = []
        for _ in range(count if leaf else 0):
            keep, more = self.prefix_code.decode(bits), self.rest_code.decode(bits)
            known = known[:keep] + [self.letters[self.letter_code.decode(bits)] for _ in range(more)]
            reference = read_reference(bits, self.most_2)
            pairs = [(bits.read(8), chr(bits.read(16))) for _ in range(bits.read(8))] if bits.read(1) else []
            yield interleave(units_text(known), pairs), reference


def page_ranges(data: bytes, d: Dictionary, pages: int) -> Iterator[tuple[int, int, bytes, int]]:
    """For each range of pages: first, last, the tables with just these pages, and where they begin in that."""
    after = [x for x in (d.pages_at, d.articles_at, d.annotation_at, d.overlay_list, len(data)) if x > d.tables_at]
    tables = data[d.tables_at : min(after)]
    for k in range(0, d.pages, pages):
        last = min(d.pages, k + pages)
        yield k, last, tables + data[d.pages_at + 512 * k : d.pages_at + 512 * last], len(tables)


def page_decoder(data: bytes, version: int, first: int, pages_at: int) -> Decoder:
    """The decoder of a range of :func:`page_ranges`, whose pages keep their numbers."""
    return Decoder(data, Dictionary(version, DECODERS[version], 0, 0, 0, pages_at=pages_at - 512 * first))


def _symbols(bits: BitReader) -> list[int]:
    n, width = bits.read(32), bits.read(8)
    return [bits.read(width) for _ in range(n)]


def overlay(data: bytes, d: Dictionary) -> Iterator[tuple[str, int, int, bytes]]:
    """Name, offset, size and content of embedded files that have one; a short stream is filled up with zeros."""
    if d.overlay_data == -1:
        return
    c = Cursor(data, d.overlay_list)
    for _ in range(c.number(4)):
        name = c.take(2 * c.number(1)).decode("utf-16-le")
        at, _, size, stored = struct.unpack("<4I", c.take(16))
        if size:
            at += d.overlay_data
            yield name, at, size, zlib.decompressobj().decompress(data[at : at + stored])[:size].ljust(size, b"\0")


# audio archives
def audio_entries(data: bytes) -> list[dict]:
    """Name, sample offset, sample size of the entries of an audio archive, and how many samples to read for each."""
    c = Cursor(data)

    def text() -> str:
        out = bytearray()
        while (a := c.number(1)) != 0xFF and (b := c.number(1)) != 0xFF:
            out += bytes((a, b))
        return out.decode("utf-16-le")

    if text() != "L9SA":
        raise ValueError("not an audio archive of this kind")
    out: list[dict] = []
    for k in range(c.number(4)):
        name, offset = text(), 0
        if k:
            offset, marker = c.number(4), c.number(1)
            if marker == 0:
                continue
            if marker != 0xFF:
                raise ValueError("a bad mark in an audio archive")
        out.append({"name": name.strip(), "sample_offset": offset, "sample_size": c.number(4)})
    for a, b in zip(out, out[1:] + [None]):
        a["read_size"] = b["sample_offset"] - a["sample_offset"] if b else a["sample_size"]
    return out


# hierarchical indexes
def index_node(data: bytes, at: int, version: int) -> list[dict]:
    """Entries of one node: leaves with type and text offset, or links to other nodes."""
    c = Cursor(data, at)
    out = []
    for _ in range(c.number(1)):
        raw = c.number(4)
        b = c.number(1) if version >= 6 else 0
        if raw & 1:
            child, count = (raw >> 1, b) if version >= 6 else (raw >> 9, raw >> 1 & 15)
            out.append({"kind": "node", "child_offset": child, "count": count, "delta": struct.unpack("<i", c.take(4))[0]})
        else:
            offset, kind = ((raw >> 1) - 1, b >> 4) if version >= 6 else ((raw >> 5) - 1, raw >> 1 & 15)
            out.append({"kind": "leaf", "type": kind, "text_offset": offset})
    before = b""
    for entry in out:
        raw_name = c.until(0)
        if raw_name and raw_name[0] < 0x20:
            raw_name = before[: raw_name[0]] + raw_name[1:]
        before = raw_name
        entry["heading"] = charset.decode(raw_name)
    return out


def hierarchy(data: bytes) -> tuple[str, int, list[dict]]:
    """Name, version and all entries, with the offset of their page and their place in it."""
    c = Cursor(data)
    if c.take(34) != b"compressed PC-Bibliothek Hierarchy":
        raise ValueError("not a hierarchical index")
    c.take(1)
    version = c.number(1)
    if version < 3:
        raise ValueError("an index that is too old")
    c.take({3: 0, 4: 14}.get(version, 18))
    headings, pages = c.number(4), c.number(4)
    c.take(11)
    name = c.take(c.number(1) - 1).decode("latin-1")
    c.take(1)
    rows: list[dict] = []
    starts = set()
    for _ in range(pages):
        page = c.at
        starts.add(page)
        size = c.number(2)
        rows += [{"page_offset": page, "pos": k} | e for k, e in enumerate(index_node(data, c.at, version))]
        c.at = page + size + 2
    if any(r["kind"] == "node" and r["child_offset"] not in starts for r in rows):
        raise ValueError("a link to a page that isn't there")
    if sum(r["kind"] == "leaf" for r in rows) != headings:
        raise ValueError("the header tells of another number of headings")
    return name, version, rows


# archives
def block_index(data: bytes) -> list[int]:
    return [x[0] for x in struct.iter_unpack("<I", data[: len(data) // 4 * 4])]


def blocks(content: bytes, index: list[int]) -> Iterator[tuple[int, bytes]]:
    """Decoded blocks of an archive up to the first empty one; the last number of the index is the decoded size."""
    for k, (a, b) in enumerate(zip(index[:-1], index[1:-1])):
        if a == b:
            return
        data = inflate(content[a:b])
        if len(data) > BLOCK:
            raise ValueError("a block that is too large")
        yield k, data


def resource_entries(data: bytes) -> list[tuple[str, int, int]]:
    """Name, offset, size of a resource directory; of entries with equal offset and size the first, in that order."""
    found: dict[tuple[int, int], str] = {}
    for k in range(1, int.from_bytes(data[0x12:0x14], "little") + 1):
        for name, offset, size in resource_block(data[k * 0x400 :]):
            found.setdefault((offset, size), name)
    return [(name, *key) for key, name in sorted(found.items())]


def resource_block(data: bytes) -> Iterator[tuple[str, int, int]]:
    c = Cursor(data)
    kind = c.number(2)
    c.take(4)
    count = c.number(2)
    if kind == 0xB:
        return
    if kind != 0xC:
        raise ValueError("an unknown kind of block")
    c.take(7)

    def text() -> tuple[bool, bytes]:
        end = next(i for i in range(c.at, len(data)) if data[i] in (0, 0xA1))
        out, c.at = data[c.at : end], end + 1
        return data[end] == 0xA1, out

    for _ in range(2 * count):
        offset = c.number(4)
        last, raw = text()
        if not raw:
            if not offset:
                return
            c.take(1)
            last, raw = text()
        m = re.fullmatch(rb"(.+?);(\d+)", raw, re.S)
        if not m:
            raise ValueError("an entry without a size")
        yield charset.windows(m[1]), offset, int(m[2])
        if last or data[c.at : c.at + 4] == b"\xa1" * 4:
            return
        c.take(1)


# manifests
@dataclass
class Descriptor:
    base: str = ""
    name: str = ""
    language: str = ""
    ranges: list[tuple[str, int, int]] = field(default_factory=list)
    references: list[tuple[str, str, str]] = field(default_factory=lambda: [("WEB", "Web", "W")])


def descriptor(data: bytes) -> Descriptor:
    out = Descriptor()
    for raw in data.split(b"\n"):
        line = charset.windows(raw.strip())
        kind, value = line[:1], line[1:]
        if kind in ("G", "g"):
            parts = value.split("|", 2)
            if len(parts) != 3:
                raise ValueError("a reference without three parts")
            out.references.append(tuple(parts))
        elif kind == "D":
            m = re.match(r"(.+?) (\d+) (\d+)", value)
            if not m:
                raise ValueError("a range without its bounds")
            out.ranges.append((m[1], int(m[2]), int(m[3])))
        elif kind in ("B", "S", "K"):
            setattr(out, {"B": "name", "S": "language", "K": "base"}[kind], value)
    return out


def _stem(name: str) -> str:
    return name.rpartition(".")[0] or name


def manifest(data: bytes, on_disk: dict[str, bytes]) -> list[dict]:
    """The dictionaries of a manifest with their archives; names are found in any case and given as they are on disk."""
    spelled = {n.lower(): n for n in on_disk}
    repair = lambda n, known: known.get(n.lower(), n)
    version, files, descriptors = 0, {}, []
    for raw in data.split(b"\n"):
        line = charset.windows(raw)
        if line[:1] == "V":
            version = int(line[2:].strip(), 16)
        elif line[:1] in ("L", "F"):
            _, found, value = line.partition(";") if line[0] == "F" else (line[:2], *line[2:].partition(" ")[1:])
            if not found:
                raise ValueError("a manifest line without a name")
            value = repair(value.strip("\r "), spelled)
            if line[0] == "L":
                descriptors.append(value)
            else:
                files.setdefault(value.lower(), value)
    out = []
    for name in descriptors:
        d = descriptor(on_disk[name])
        own = {e: repair(f"{b}.{e}", files) for e, b in (("hic", d.base), ("idx", _stem(name)), ("bof", _stem(name)))}
        out.append({"version": version, "ld": name, **own, "resources": []})
    for x in out:
        files.pop(x["bof"].lower(), None)
        files.pop(x["idx"].lower(), None)
    of = lambda have, e: sorted(n for n in have if n.endswith(f".{e}"))
    shared = None
    if of(files, "fsi"):
        fsi = of(files, "fsi")[0]
        bof, idx = _stem(fsi) + ".bof", _stem(fsi) + ".idx"
        if bof in files and idx in files:
            shared = {"fsi": files[fsi], "bof": files[bof], "idx": files[idx], "fsd": ""}
            del files[bof]
    for x in out:
        if shared:
            x["resources"].append(shared)
        for fsd in of(files, "fsd"):
            if (fsi := _stem(fsd) + ".fsi") not in files:
                raise ValueError("a resource blob without its directory")
            x["resources"].append({"fsi": files[fsi], "bof": "", "idx": "", "fsd": files[fsd]})
        for bof in of(files, "bof"):
            x["resources"].append({"fsi": files.get(_stem(bof) + ".fsi", ""), "bof": files[bof], "idx": repair(_stem(files[bof]) + ".idx", files), "fsd": ""})
    return out


def lines(data: bytes, separator: bytes = b"\n") -> Iterable[bytes]:
    """Lines without their separator; an empty one after the last separator isn't a line."""
    parts = data.split(separator)
    return parts if parts[-1] else parts[:-1]
