import struct

from lexforge.codecs import deflate
from lexforge.operators import variants
from lexforge.sinks import writers
from lexforge.sources import formats, readers


def _index(version=6):
    leaf = lambda offset, kind, name: struct.pack("<IB", (offset + 1) << 1, kind << 4)
    body = bytes((2,)) + leaf(5, 1, "") + leaf(9, 10, "") + b"word\0" + b"\x03k\0"
    head = b"compressed PC-Bibliothek Hierarchy" + b"\0" + bytes((version,)) + bytes(18) + struct.pack("<II", 2, 1) + bytes(11) + bytes((3,)) + b"ab" + b"\0"
    return head + struct.pack("<H", len(body)) + body


def test_hierarchy():
    name, version, rows = formats.hierarchy(_index())
    assert (name, version) == ("ab", 6)
    assert [(r["heading"], r["type"], r["text_offset"]) for r in rows] == [("word", 1, 5), ("work", 10, 9)]


def test_archive_blocks():
    parts = [deflate.deflate_stored(b"a" * 8192), deflate.deflate_stored(b"tail")]
    index = [0, len(parts[0]), len(parts[0]) + len(parts[1]), 8196]
    assert b"".join(b for _, b in formats.blocks(b"".join(parts), index)) == b"a" * 8192 + b"tail"


def test_resource_directory():
    block = struct.pack("<HIH", 0xC, 0, 2) + bytes(7) + struct.pack("<I", 16) + b"x.bmp;7\0" + b"\0" + struct.pack("<I", 16) + b"y.bmp;7\xa1"
    data = bytes(0x12) + struct.pack("<H", 1) + bytes(0x400 - 0x14) + block
    assert formats.resource_entries(data) == [("x.bmp", 16, 7)]


def test_manifest():
    inf = b"V 300\nL 1 MAIN.LD\nF 1;main.bof\r\nF 1;main.idx\nF 1;pics.fsi\nF 1;pics.bof\nF 1;pics.idx\nF 1;extra.bof\n"
    disk = {"Main.ld": b"KBase\nBTitle\nSdeu\nGA|B|C\nDfile 0 10 x\n", "main.BOF": b"", "main.idx": b"", "base.hic": b"", "pics.fsi": b"", "pics.bof": b"", "pics.idx": b"", "extra.bof": b""}
    (d,) = formats.manifest(inf, disk)
    assert (d["version"], d["ld"], d["bof"], d["idx"]) == (0x300, "Main.ld", "main.BOF", "main.idx")
    assert [r["bof"] for r in d["resources"]] == ["pics.bof", "extra.bof"]
    x = formats.descriptor(disk["Main.ld"])
    assert (x.base, x.name, x.language, x.ranges, len(x.references)) == ("Base", "Title", "deu", [("file", 0, 10)], 2)


def test_audio_directory():
    t = lambda s: s.encode("utf-16-le") + b"\xff"
    data = t("L9SA") + struct.pack("<I", 2) + t("a.wav ") + struct.pack("<I", 5) + t("b.wav") + struct.pack("<IBI", 8, 0xFF, 4)
    assert formats.audio_entries(data) == [{"name": "a.wav", "sample_offset": 0, "sample_size": 5, "read_size": 8}, {"name": "b.wav", "sample_offset": 8, "sample_size": 4, "read_size": 4}]


def test_readers_report_bad_files(spark, tmp_path):
    (tmp_path / "good.hic").write_bytes(_index())
    (tmp_path / "bad.hic").write_bytes(b"nothing")
    rows = readers.hierarchies(spark, str(tmp_path)).collect()
    assert sorted(r.error is None for r in rows) == [False, True, True]


def _chars(text):
    out, sorted_ = [], True
    for c in text:
        if c in "{}":
            sorted_ = c == "}"
        else:
            out.append((c, sorted_, False))
    return out


def test_variants():
    pair = [_chars("x{(s)}y"), _chars("x{(}s{)}y")]
    ((i, chars),) = variants.collapse(pair)
    assert i == 0 and chars == _chars("x(s)y")
    assert len(variants.collapse([_chars("a"), _chars("b")])) == 2
    # a heading that is gone still absorbs a third one, but not in strict mode
    three = [_chars("x{(s)}y"), _chars("x{(}s{)}y"), _chars("x{(s)}y")]
    assert len(variants.collapse(three)) == 1 and len(variants.collapse(three, strict=True)) == 2
    assert variants.fill([5, 5, 5, 1], 8) == [0, 0, 1, 1] and variants.fill([0], 3) == [None]


def test_text_dictionary(tmp_path):
    path = str(tmp_path / "a.dsl")
    writers.write_dsl(path, writers.dsl_lines("N", "German", "English", [(["a", "b"], "x\ny")]))
    raw = open(path, "rb").read()
    assert raw[:2] == b"\xff\xfe" and raw[2:].decode("utf-16-le").endswith("\na\nb\n\tx\n\ty\n")
    assert writers.write_zip(str(tmp_path / "z"), []) == 0 and not (tmp_path / "z").exists()
