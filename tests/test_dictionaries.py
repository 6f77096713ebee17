"""Dictionaries of every version, from our own encoder, by the decoder and by the readers."""

import pytest

from lexforge.codecs.bits import BitReader, CipheredReader, decipher, encipher
from lexforge.functions.text import DECODERS
from lexforge.sources import encoder, formats, readers

ARTICLES = ["one two three one two three", "", "the prefix of all texts, the prefix of all texts", "ü 字 \U0001f600 end", "x" * 300]
PAGES = [[("abc", 0, []), ("abcd", 1, [(0, "("), (5, ")")]), ("abd", 2, [])], [("b", 3, [(0, "\\"), (1, "[")]), ("büro", 4, [])], []]
FILES = [("a.bmp", b"BM" * 50), ("empty.wav", b""), ("ö.wav", bytes(range(256)))]


def _file(version, **change):
    return encoder.dictionary(version, **{"name": "Näme", "pages": PAGES, "articles": ARTICLES, "annotation": "a note on all texts", "files": FILES, "prefix": "the prefix of all texts", "languages": (1033, 1031), "icon": b"icon"} | change)


@pytest.mark.parametrize("version", sorted(DECODERS))
def test_every_version(version):
    data = _file(version)
    d = formats.dictionary(data)
    assert (d.version, d.decoder, d.name, d.entries, d.source, d.target, d.pages) == (version, DECODERS[version], "Näme", 5, 1033, 1031, 3)
    assert d.icon == (b"icon" if version > 0x120000 else b"")
    decoder = formats.Decoder(data, d)
    found = [(page, list(decoder.page(page))) for page in range(d.pages)]
    plain = [["".join(c for c, in_order, _ in chars if in_order) for chars, _ in rows] for _, rows in found]
    assert plain == [["abc", "abcd", "abd"], ["b", "büro"], []]
    whole = ["".join(c for c, _, _ in chars) for _, rows in found for chars, _ in rows]
    assert whole == ["abc", "(abcd)", "abd", "[b", "büro"]
    assert [c for c in found[1][1][0][0]] == [("[", False, True), ("b", True, False)]
    assert [decoder.article(r) for _, rows in found for _, r in rows] == ARTICLES
    assert decoder.annotation() == "a note on all texts"
    files = [(n, data) for n, _, _, data in formats.overlay(data, d)]
    assert files == ([] if version < 0x120000 else [(n, x) for n, x in FILES if x])


def test_readers_of_dictionaries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PAGES", 2)
    for version in DECODERS:
        (tmp_path / f"{version:x}.lsd").write_bytes(_file(version))
    (tmp_path / "bad.lsd").write_bytes(b"nothing of the kind")
    (tmp_path / "new.lsd").write_bytes(b"LingVo\0\0" + (0x999999).to_bytes(4, "little") + bytes(60))
    path = str(tmp_path)
    heads = {r.path.rpartition("/")[2]: r for r in readers.dictionaries(spark, path).collect()}
    assert heads["bad.lsd"].error and heads["new.lsd"].decoder == "unsupported" and heads["142001.lsd"].annotation == "a note on all texts"
    names = readers.headings(spark, path)
    rows = names.where("error is null").collect()
    assert len(rows) == 5 * len(DECODERS) and {(r.page, r.pos, r.ordinal) for r in rows} == {(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 65536), (1, 1, 65537)}
    texts = readers.articles(spark, path, names.where("error is null")).collect()
    assert sorted(r.body for r in texts) == sorted(ARTICLES * len(DECODERS))
    blobs = {(r.path, r.name): bytes(r.content) for r in readers.overlays(spark, path).where("error is null").collect()}
    assert len(blobs) == 2 * sum(v > 0x120000 for v in DECODERS) and set(blobs.values()) == {x for _, x in FILES if x}


def test_a_damaged_dictionary_is_an_error():
    data = _file(0x142001)
    d = formats.dictionary(data)
    with pytest.raises((ValueError, EOFError, IndexError)):
        formats.Decoder(data[: d.tables_at + 9], d)
    with pytest.raises(ValueError, match="too many"):
        _file(0x142001, pages=[[(f"{k} some long heading that isn't like others {k}", 0, []) for k in range(90)]])


def test_ciphered_bits_are_deciphered_from_any_byte():
    data = bytes(range(200, 256)) + encipher(bytes(range(100)))
    bits, plain = CipheredReader(data, 56), BitReader(decipher(data[56:]))
    for n in (1, 7, 32, 3, 16, 5, 8, 11, 200):
        assert bits.read(n) == plain.read(n)
    with pytest.raises(EOFError):
        bits.read(10_000)
