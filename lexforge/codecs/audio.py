"""ADPCM sound, four bits a sample, and WAV files."""

from __future__ import annotations

import io
import wave
from collections.abc import Sequence

import numpy as np

RATE = 21000
#: Steps grow by a tenth.
STEPS = [int(16 * 1.1**k) for k in range(49)]
_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def adpcm_decode(data: bytes) -> np.ndarray:
    """Samples, two a byte, the upper half first; the sum behind them isn't limited, only what comes out."""
    deltas, index = [], 0
    for byte in data:
        for code in (byte >> 4, byte & 15):
            step = STEPS[index]
            d = step * (code >> 2 & 1) + step / 2 * (code >> 1 & 1) + step / 4 * (code & 1) + step / 8
            deltas.append(-d if code & 8 else d)
            index = min(48, max(0, index + _MOVES[code & 7]))
    level = np.clip(np.cumsum(deltas), -32768.0, 32767.0)
    return (np.sign(level) * np.floor(np.abs(level) + 0.5)).astype(np.int16)


def adpcm_encode(samples: Sequence[int]) -> bytes:
    codes, level, index = [], 0.0, 0
    for x in samples:
        step = STEPS[index]
        options = [(abs(level + (-d if c & 8 else d) - x), c, -d if c & 8 else d) for c in range(16) for d in (step * (c >> 2 & 1) + step / 2 * (c >> 1 & 1) + step / 4 * (c & 1) + step / 8,)]
        _, code, d = min(options)
        codes.append(code)
        level, index = level + d, min(48, max(0, index + _MOVES[code & 7]))
    codes += [0] * (len(codes) % 2)
    return bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))


def wav(samples: np.ndarray, rate: int = RATE, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()
