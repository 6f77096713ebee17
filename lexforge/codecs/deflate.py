"""DEFLATE whose fixed blocks have code lengths of their own."""

from __future__ import annotations

import struct
import zlib

from .tables import FIXED_DISTANCES, FIXED_LITERALS

_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _ranges(n: int, step: int, first: int) -> list[tuple[int, int]]:
    """Base and extra bits of lengths or distances: each group of ``step`` has a bit more."""
    out, base = [], first
    for k in range(n):
        extra = max(0, k // step - 1)
        out.append((base, extra))
        base += 1 << extra
    return out


_LENGTHS = [*_ranges(28, 4, 3), (258, 0)]
_DISTANCES = _ranges(30, 2, 1)


def _codes(lengths: bytes | list[int]) -> dict[tuple[int, int], int]:
    """Symbols by code and length, shorter codes first, within a length by symbol."""
    out, code, size = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - size
        size = n
        out[code, n] = symbol
        code += 1
    return out


_FIXED = _codes(FIXED_LITERALS), _codes(FIXED_DISTANCES)


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.many = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.many < n:
            if self.at == len(self.data):
                raise EOFError("the block has ended")
            self.held |= self.data[self.at] << self.many
            self.at, self.many = self.at + 1, self.many + 8
        value = self.held & ((1 << n) - 1)
        self.held, self.many = self.held >> n, self.many - n
        return value

    def align(self) -> None:
        self.take(self.many % 8)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 16):
            code = code << 1 | self.take(1)
            if (s := codes.get((code, n))) is not None:
                return s
        raise ValueError("not a code word")


def _header() -> tuple[int, int]:
    """Bits, and their number, by which a dynamic block gives the code lengths of fixed ones; each length is a code word of four bits."""
    out, size = 0, 0
    for value, n in [(29, 5), (29, 5), (15, 4), *((0 if s > 15 else 4, 3) for s in _ORDER), *((int(f"{s:04b}"[::-1], 2), 4) for s in (*FIXED_LITERALS, *FIXED_DISTANCES))]:
        out, size = out | value << size, size + n
    return out, size


_FIXED_HEADER, _FIXED_SIZE = _header()


def _one_block(data: bytes, limit: int) -> bytes | None:
    """The content of a single block, by zlib: a fixed one is put as a dynamic one with its code lengths. None where that fails, or it is too large."""
    if not data or not data[0] & 1:
        return None
    if data[0] >> 1 & 3 == 1:
        rest = int.from_bytes(data, "little") >> 3
        data = ((rest << _FIXED_SIZE | _FIXED_HEADER) << 3 | 0b101).to_bytes(len(data) + _FIXED_SIZE // 8 + 1, "little")
    machine = zlib.decompressobj(-15)
    try:
        out = machine.decompress(data, limit + 1)
    except zlib.error:
        return None
    return out if machine.eof and len(out) <= limit else None


def inflate(data: bytes, limit: int = 32 << 10) -> bytes:
    """The content of a block of an archive; more than ``limit`` bytes is an error."""
    out = _one_block(data, limit)
    return _inflated(data, limit) if out is None else out


def _inflated(data: bytes, limit: int) -> bytes:
    """Any number of blocks, bit by bit; says what is wrong with bad ones."""
    bits, out, last = _Bits(data), bytearray(), False
    while not last:
        last, kind = bool(bits.take(1)), bits.take(2)
        if kind == 0:
            bits.align()
            n, check = bits.take(16), bits.take(16)
            if n != check ^ 0xFFFF:
                raise ValueError("a stored block with a wrong size")
            out += bytes(bits.take(8) for _ in range(n))
        elif kind == 3:
            raise ValueError("an unknown kind of block")
        else:
            literals, distances = _FIXED if kind == 1 else _tables(bits)
            while (s := bits.symbol(literals)) != 256:
                if s < 256:
                    out.append(s)
                    continue
                base, extra = _LENGTHS[s - 257]
                n = base + bits.take(extra)
                base, extra = _DISTANCES[bits.symbol(distances)]
                back = base + bits.take(extra)
                if back > len(out):
                    raise ValueError("a copy from before the beginning")
                for _ in range(n):
                    out.append(out[-back])
        if len(out) > limit:
            raise ValueError("a block that is too large")
    return bytes(out)


def _tables(bits: _Bits) -> tuple[dict, dict]:
    n, m, k = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    own = [0] * 19
    for i in _ORDER[:k]:
        own[i] = bits.take(3)
    codes, lengths = _codes(own), []
    while len(lengths) < n + m:
        s = bits.symbol(codes)
        if s < 16:
            lengths.append(s)
        else:
            value = lengths[-1] if s == 16 else 0
            lengths += [value] * (bits.take((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16])
    return _codes(lengths[:n]), _codes(lengths[n:])


_FIXED_WORDS = {s: f"{c:0{n}b}" for (c, n), s in _FIXED[0].items()}


def deflate_fixed(data: bytes) -> bytes:
    """Literals of one fixed block; bytes that have no code in it are an error."""
    try:
        words = "".join(map(_FIXED_WORDS.__getitem__, (*data, 256)))
    except KeyError:
        raise ValueError("a byte without a code in a fixed block") from None
    bits = "110" + words  # the first bit is the least one
    return int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")


def deflate_dynamic(data: bytes) -> bytes:
    """Blocks with codes of their own, where an ordinary compressor would make such, else a stored one."""
    machine = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = machine.compress(data) + machine.flush()
    # fixed blocks, which are others here, could only come first: all of it is one block up to 8 KiB
    return raw if raw[0] >> 1 & 3 == 2 else deflate_stored(data)


def deflate_stored(data: bytes) -> bytes:
    return b"\x01" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data
