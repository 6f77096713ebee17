"""The archives' character set: one to four bytes a character, with raw regions."""

from __future__ import annotations

from .tables import REMAPPED

#: Unassigned bytes of the Windows code page stand for themselves.
_WIN = [bytes((b,)).decode("cp1252", "ignore") or chr(b) for b in range(256)]
_ALONE = {0x25FF: 0xA0, 0x25FE: 0x2012, 0x25FD: 0x2014, 0x36E: 0x35C, 0x36F: 0}


def windows(data: bytes) -> str:
    return "".join(map(_WIN.__getitem__, data))


def _character(n: int) -> str:
    """The character of a number of one to four bytes; empty for none."""
    if n >= 0xA100:
        low = (n - 0x21) & 0xFF
        n = 0xBE * ((n + 0x5EDF & 0xFFFF) >> 8) + (low - 0x21 if low > 0x5E else low) + 0x100
    elif n >= 0xA000:
        n &= 0xFF
    n = _ALONE.get(n, REMAPPED[n - 0x203] if 0x203 <= n < 0x203 + len(REMAPPED) else n)
    return "" if n == 0 else _WIN[n] if n < 256 else chr(n)


def decode(data: bytes) -> str:
    """Text of an archive.

    After ``\\w{`` and ``\\S{;`` bytes stand for themselves up to a brace;
    ``@C`` without a per cent sign is in the Windows code page up to the line's
    end. Bytes that are no character give a question mark; data that ends
    within one is an error.
    """
    out: list[str] = []
    at, raw = 0, False

    def tail(n: int) -> str:
        return "".join(out[-n:])

    while at < len(data):
        first, size = data[at], 1
        if raw:
            sign = chr(first) if first else ""
        else:
            size = 4 if first >= 0xFC else 3 if first >= 0xF6 else 2 if first >= 0xA0 else 1
            if at + size > len(data):
                raise ValueError("the text ends within a character")
            number = int.from_bytes(data[at : at + size], "big")
            if number >= 0xF600:
                sign, size = "?", 1
            else:
                sign = _character(number)
        at += size
        if sign:
            out.append(sign)
        if out and out[-1] == "}":
            raw = False
        if tail(3) == "\\w{" or tail(4) == "\\S{;":
            raw = True
        if tail(2) == "@C":
            if at >= len(data):
                raise ValueError("the text ends within a character")
            if data[at] == 0x25:
                end = at + 1
            else:
                line = data.find(b"\n", at + 1)
                end = len(data) if line < 0 else line + 1
            out.extend(windows(data[at:end]))
            at = end
    return "".join(out)
