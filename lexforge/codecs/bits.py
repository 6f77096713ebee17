"""Bit streams, keystreams, prefix codes and the articles and headings that are made of them; each with its encoder."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Sequence

from .tables import PAD


class BitReader:
    """Bits of some bytes, the most significant first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise EOFError("the stream has ended")
        first, last = self.at >> 3, (end + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - end)
        self.at = end
        return value & ((1 << n) - 1)

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8

    def seek(self, at: int) -> None:
        self.at = 8 * at


class CipheredReader(BitReader):
    """Bits of a keystream that begins at a byte: each byte is deciphered when it is read, with the cipher byte before it."""

    def __init__(self, data: bytes, at: int = 0, key: int = 0x7F) -> None:
        super().__init__(data, at)
        self.start, self.key = at, key

    def read(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise EOFError("the stream has ended")
        first, last = self.at >> 3, (end + 7) >> 3
        value = 0
        for k in range(first, last):
            value = value << 8 | self.data[k] ^ (self.key if k == self.start else PAD[self.data[k - 1]])
        self.at = end
        return value >> (8 * last - end) & ((1 << n) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.whole, self.rest, self.size = bytearray(), 0, 0

    def write(self, value: int, n: int) -> BitWriter:
        many = self.size % 8 + n
        rest = self.rest << n | value & ((1 << n) - 1)
        self.whole += (rest >> many % 8).to_bytes(many // 8, "big")
        self.rest, self.size = rest & ((1 << many % 8) - 1), self.size + n
        return self

    def data(self) -> bytes:
        many = self.size % 8
        return bytes(self.whole) + (bytes((self.rest << (8 - many),)) if many else b"")


def bit_length(n: int) -> int:
    return max(1, n.bit_length())


def decipher(data: bytes, key: int = 0x7F) -> bytes:
    """Each byte is combined with a key that the cipher byte before it tells."""
    keys = bytes((key,)) + data[:-1].translate(PAD)
    return (int.from_bytes(data, "big") ^ int.from_bytes(keys[: len(data)], "big")).to_bytes(len(data), "big")


def encipher(data: bytes, key: int = 0x7F) -> bytes:
    out = bytearray()
    for c in data:
        out.append(c ^ key)
        key = PAD[out[-1]]
    return bytes(out)


class PrefixCode:
    """A code whose table lists symbols with their code lengths; each takes the leftmost free place of its depth."""

    def __init__(self, lengths: Sequence[tuple[int, int]]) -> None:
        self.codes: dict[int, tuple[int, int]] = {}
        #: Free subtrees as (code, depth), the leftmost last.
        free = [(0, 0)]
        for symbol, size in lengths:
            k = next((k for k in range(len(free) - 1, -1, -1) if free[k][1] <= size), -1)
            if k < 0:
                raise ValueError("the code lengths don't fit")
            code, depth = free.pop(k)
            right = []
            while depth < size:
                code, depth = code << 1, depth + 1
                right.append((code | 1, depth))
            free[k:k] = right
            self.codes[symbol] = code, size
        self._symbols = {place: symbol for symbol, place in self.codes.items()}

    @classmethod
    def read(cls, bits: BitReader) -> PrefixCode:
        n, width = bits.read(32), bits.read(8)
        wide = bit_length(n)
        return cls([(bits.read(wide), bits.read(width)) for _ in range(n)])

    @classmethod
    def of(cls, symbols: Sequence[int]) -> PrefixCode:
        """The best code for these symbols."""
        heap = [(n, s, {s: 0}) for s, n in Counter(symbols).items()]
        if len(heap) == 1:
            heap.append((0, -1, {}))
        heapq.heapify(heap)
        while len(heap) > 1:
            (n, s, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (n + m, s, {k: v + 1 for k, v in (a | b).items()}))
        return cls(sorted(heap[0][2].items(), key=lambda x: (x[1], x[0])))

    def table(self, bits: BitWriter) -> None:
        width = bit_length(max((n for _, n in self.codes.values()), default=0))
        bits.write(len(self.codes), 32).write(width, 8)
        for symbol, (_, size) in self.codes.items():
            bits.write(symbol, bit_length(len(self.codes))).write(size, width)

    @property
    def depth(self) -> int:
        return max((n for _, n in self.codes.values()), default=0)

    def decode(self, bits: BitReader) -> int:
        code = 0
        for n in range(1, self.depth + 1):
            code = code << 1 | bits.read(1)
            if (symbol := self._symbols.get((code, n))) is not None:
                return symbol
        raise ValueError("not a code word")

    def encode(self, symbol: int, bits: BitWriter) -> None:
        bits.write(*self.codes[symbol])


def read_reference(bits: BitReader, most: int) -> int:
    """A reference in as few bits as the greatest one takes, unless it is marked as a whole word."""
    head = bits.read(2)
    if head == 3:
        return bits.read(32)
    n = bit_length(most) - 2
    return head << n | bits.read(n) if n > 0 else head


def write_reference(value: int, most: int, bits: BitWriter) -> None:
    n = max(0, bit_length(most) - 2)
    if value >> n < 3:
        bits.write(value >> n, 2).write(value, n)
    else:
        bits.write(3, 2).write(value, 32)


def read_article(bits: BitReader, code: PrefixCode, symbols: Sequence[int], prefix: Sequence[int], system: bool) -> str:
    """An article of UTF-16 code units: literals, copies from the shared prefix, copies from itself.

    A copy takes what is there when it begins, so it never overlaps itself.
    """
    size = bits.read(16)
    if size == 0xFFFF:
        size = bits.read(32)
    out: list[int] = []
    while len(out) < size:
        s = symbols[code.decode(bits)]
        if system:
            kind = "prefix" if s < 0x40 else "self" if s < 0x80 else "literal"
            n, literal = {"prefix": s + 3, "self": s - 0x3D, "literal": 0}[kind], s - 0x80
        else:
            kind = "literal" if s < 0x10000 else "prefix" if s < 0x10040 else "self"
            n, literal = {"prefix": s - 0xFFFD, "self": s - 0x1003D, "literal": 0}[kind], s
        if kind == "literal":
            if literal > 0xFFFF:
                raise ValueError("a symbol outside of its range")
            out.append(literal)
            continue
        source = prefix if kind == "prefix" else list(out)
        start = bits.read(bit_length(len(prefix) if kind == "prefix" else size))
        if start > len(source):
            raise ValueError("a copy from beyond the end")
        out.extend(source[start : start + n])
    return units_text(out)


def write_article(units: Sequence[int], steps: Sequence[tuple[str, int, int]], code: PrefixCode, symbols: Sequence[int], prefix: Sequence[int], system: bool, bits: BitWriter) -> None:
    """An article of these units in steps (``literal``, unit, 0), or (``prefix`` or ``self``, start, length) for a copy."""
    bits.write(len(units), 16) if len(units) < 0xFFFF else bits.write(0xFFFF, 16).write(len(units), 32)
    for kind, a, n in steps:
        code.encode(symbols.index(article_symbol(kind, a, n, system)), bits)
        if kind != "literal":
            bits.write(a, bit_length(len(prefix) if kind == "prefix" else len(units)))


def article_symbol(kind: str, a: int, n: int, system: bool) -> int:
    """What stands for a step of :func:`write_article` in the table of symbols."""
    if kind == "literal":
        return a + 0x80 if system else a
    return n - 3 + (0x40 if kind == "self" else 0) + (0 if system else 0x10000)


def text_units(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[k] | raw[k + 1] << 8 for k in range(0, len(raw), 2)]


def units_text(units: Sequence[int]) -> str:
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")


def front_decode(coded: Sequence[tuple[int, Sequence]], join: Callable = lambda a, b: a + b) -> list:
    """Each item is the beginning of the one before it and a rest."""
    out: list = []
    for n, rest in coded:
        out.append(join(out[-1][:n] if out else rest[:0], rest))
    return out


def interleave(text: str, pairs: Sequence[tuple[int, str]]) -> list[tuple[str, bool, bool]]:
    """Characters of a heading: sorted ones, and between them, at their place in the whole, unsorted ones; a backslash among those escapes what follows."""
    extra, out, rest, place, k = list(pairs), [], list(text), 0, 0
    escaped = False
    while rest or k < len(extra):
        if k < len(extra) and (extra[k][0] == place or not rest):
            sign, unsorted = extra[k][1], True
            k += 1
        else:
            sign, unsorted = rest.pop(0), False
        place += 1
        if sign == "\\" and unsorted and not escaped:
            escaped = True
            continue
        out.append((sign, not unsorted, escaped))
        escaped = False
    return out
