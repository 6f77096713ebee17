import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.codecs import audio, bits, charset, deflate


@given(st.binary(max_size=300))
def test_keystream_round_trip(data):
    assert bits.decipher(bits.encipher(data)) == data


@settings(deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=200))
def test_prefix_code_round_trip(symbols):
    known = sorted(set(symbols))  # a table numbers its symbols
    symbols = [known.index(s) for s in symbols]
    code, out = bits.PrefixCode.of(symbols), bits.BitWriter()
    code.table(out)
    for s in symbols:
        code.encode(s, out)
    read = bits.BitReader(out.data())
    again = bits.PrefixCode.read(read)
    assert [again.decode(read) for _ in symbols] == symbols


@given(st.integers(0, 2**32 - 1), st.integers(0, 2**31))
def test_reference_round_trip(value, most):
    out = bits.BitWriter()
    bits.write_reference(value, most, out)
    assert bits.read_reference(bits.BitReader(out.data() + b"\0" * 8), most) == value


def test_article_copies_take_what_is_there():
    symbols = [ord("a"), ord("b"), 0x1003D + 5, 0xFFFD + 3]
    code, out = bits.PrefixCode([(0, 2), (1, 2), (2, 2), (3, 2)]), bits.BitWriter()
    out.write(6, 16)
    code.encode(0, out), code.encode(1, out)
    code.encode(2, out), out.write(0, 3)  # five from the start, but there are two
    code.encode(3, out), out.write(1, 2)  # three from place 1 of the prefix
    assert bits.read_article(bits.BitReader(out.data()), code, symbols, [ord(c) for c in "wxy"], False) == "ababxy"
    with pytest.raises(EOFError):
        bits.read_article(bits.BitReader(b"\xff"), code, symbols, [], False)


def test_interleaved_characters():
    assert bits.interleave("ab", [(1, "("), (2, "\\"), (3, "x")]) == [("a", True, False), ("(", False, False), ("x", False, True), ("b", True, False)]


def test_front_decode():
    assert bits.front_decode([(0, "word"), (3, "k"), (4, "er")]) == ["word", "work", "worker"]


def test_adpcm_follows_the_signal():
    wave = (3000 * np.sin(np.arange(2000) / 20)).astype(int)
    assert np.abs(audio.adpcm_decode(audio.adpcm_encode(wave)).astype(int) - wave).mean() < 150
    assert audio.STEPS[:5] == [16, 17, 19, 21, 23] and audio.STEPS[-1] == 1552
    assert audio.wav(np.zeros(10))[:4] == b"RIFF"


@given(st.binary(max_size=3000), st.integers(1, 9))
def test_inflate_of_ordinary_blocks(data, level):
    machine = zlib.compressobj(level, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY if level == 1 else zlib.Z_DEFAULT_STRATEGY)
    raw = machine.compress(data) + machine.flush()
    if raw[0] >> 1 & 3 != 1:  # fixed blocks are others here
        assert deflate.inflate(raw) == data
    assert deflate.inflate(deflate.deflate_stored(data)) == data


@given(st.text("abc defghij.", max_size=200))
def test_fixed_blocks(text):
    data = text.encode()
    assert deflate.inflate(deflate.deflate_fixed(data)) == data


def test_charset():
    assert charset.decode(b"abc") == "abc"
    assert charset.decode(b"\xa0\xe4") == "ä"
    assert charset.decode(b"\\w{\xe4}") == "\\w{ä}"
    assert charset.decode(b"@Cx\xe4\ny") == "@Cxä\ny"
    assert charset.decode(b"\xff\x00\x00\x00") == "?"
    with pytest.raises(ValueError):
        charset.decode(b"\xa0")


def test_dynamic_and_long_blocks():
    text = b"a block of some words, and more of the same words. " * 160
    raw = deflate.deflate_dynamic(text)
    assert raw[0] >> 1 & 3 == 2 and len(raw) < len(text) / 4 and deflate.inflate(raw) == text
    assert deflate.inflate(b"\x00" + deflate.deflate_stored(b"one")[1:] + deflate.deflate_fixed(b"cab")) == b"onecab"
    noise = bytes(range(256)) * 32
    assert deflate.inflate(deflate.deflate_dynamic(noise)) == noise


@given(st.lists(st.tuples(st.integers(0, 2**40), st.integers(0, 41)), max_size=60))
def test_bits_written_are_read(fields):
    out = bits.BitWriter()
    for value, n in fields:
        out.write(value, n)
    back = bits.BitReader(out.data())
    assert [back.read(n) for _, n in fields] == [v & ((1 << n) - 1) for v, n in fields] and len(out.data()) == -(-sum(n for _, n in fields) // 8)
