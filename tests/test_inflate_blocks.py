import pytest

from lexforge.codecs import deflate


def test_single_blocks_are_not_read_bit_by_bit(monkeypatch):
    read = []
    take = deflate._Bits.take
    monkeypatch.setattr(deflate._Bits, "take", lambda self, n: read.append(0) or take(self, n))
    text = b"one block of words, and some of the same words. " * 170
    for raw in (deflate.deflate_dynamic(text), deflate.deflate_stored(text), deflate.deflate_fixed(text)):
        assert deflate.inflate(raw) == text
    assert not read
    assert deflate.inflate(b"\x00" + deflate.deflate_stored(b"one")[1:] + deflate.deflate_fixed(b"cab")) == b"onecab" and read


def test_bad_blocks_say_what_is_wrong():
    text = b"words " * 100
    for raw in (deflate.deflate_dynamic(text), deflate.deflate_fixed(text), deflate.deflate_stored(text)):
        with pytest.raises(EOFError):
            deflate.inflate(raw[: len(raw) // 2])
        with pytest.raises(ValueError, match="too large"):
            deflate.inflate(raw, 599)
        assert deflate.inflate(raw + b"more", 600) == text
