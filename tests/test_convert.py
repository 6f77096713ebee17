"""Whole conversions, manifests, blobs and the small checks around them."""

import zipfile

from pyspark.sql import functions as F

from lexforge.operators import relational
from lexforge.plans import convert
from lexforge.sources import encoder, readers

ARTICLES = ["first body\nsecond line", "other body"]
PAGES = [[("abc", 0, []), ("abd", 1, [(0, "(")])], [("zz", 0, [])]]


def _file(version, **change):
    return encoder.dictionary(version, **{"name": "Title", "pages": PAGES, "articles": ARTICLES, "annotation": "note", "files": [("a.bmp", b"BM")], "languages": (1033, 1031), "icon": b"ico"} | change)


def test_dictionaries_become_text(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    out.mkdir()
    (source / "one.lsd").write_bytes(_file(0x142001))
    (source / "other.language.lsd").write_bytes(_file(0x142001, languages=(1049, 1031)))
    (source / "cut.lsd").write_bytes(_file(0x142001)[:300])
    (source / "new.lsd").write_bytes(b"LingVo\0\0" + (0x999999).to_bytes(4, "little") + bytes(36) + (1033).to_bytes(2, "little") + (1031).to_bytes(2, "little") + bytes(20))
    short = bytearray(_file(0x142001))
    short[20:24] = (9).to_bytes(4, "little")
    (source / "short.lsd").write_bytes(short)
    rows = {r.path.rpartition("/")[2]: r for r in convert.text_dictionaries(spark, str(source), str(out), source=1033).collect()}
    assert (rows["one.lsd"].status, rows["one.lsd"].headings, rows["one.lsd"].articles, rows["one.lsd"].files) == ("written", 3, 2, 1)
    assert rows["new.lsd"].status == "unsupported" and rows["short.lsd"].status == "decoding error" and rows["cut.lsd"].status not in ("written", "unsupported")
    assert "other.language.lsd" not in rows and sorted(p.name for p in out.iterdir()) == ["one.ann", "one.bmp", "one.dsl", "one.dsl.files.zip"]
    text = (out / "one.dsl").read_bytes().decode("utf-16")
    assert text.startswith('#NAME\t"Title"') and text.endswith("\nabc\nzz\n\tfirst body\n\tsecond line\n\n{(}abd\n\tother body\n")
    assert (out / "one.ann").read_bytes().decode("utf-16") == "note" and (out / "one.bmp").read_bytes() == b"ico"
    assert zipfile.ZipFile(out / "one.dsl.files.zip").read("a.bmp") == b"BM"
    (one,) = [r for r in convert.text_dictionaries(spark, str(source / "one.lsd"), str(out), dumb=True).collect()]
    text = (out / "one.dsl").read_bytes().decode("utf-16")
    assert one.articles == 3 and text.endswith("\nabc\n\tfirst body\n\tsecond line\n\n{(}abd\n\tother body\n\nzz\n\tfirst body\n\tsecond line\n")


def test_manifests_as_rows(spark, tmp_path):
    for name, data in (("A.INF", b"V 300\nL 1 MAIN.LD\nF 1;main.bof\nF 1;main.idx\n"), ("Main.ld", b"KBase\nBTitle\nSdeu\nGA|B|C\nDfile 0 10 x\n"), ("main.BOF", b"x"), ("b/bad.inf", b"F 1\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rpartition("/")[2]: r for r in readers.manifests(spark, str(tmp_path)).collect()}
    r = rows["A.INF"]
    assert (r.ld, r.bof, r.base, r.name, r.language, r.ranges[0].file, r.ranges[0].last, [x.code for x in r.references], r.error) == ("Main.ld", "main.BOF", "Base", "Title", "deu", "file", 10, ["W", "C"], None)
    assert rows["bad.inf"].error


def test_blobs(spark, tmp_path):
    (tmp_path / "x.fsd").write_bytes(bytes(range(10)))
    entries = spark.createDataFrame([("a", 2, 3), ("b", 8, 4), ("c", 50, 2)], "name string, offset int, size int").withColumn("path", F.lit(f"file:{tmp_path}/x.fsd"))
    got = {r.name: bytes(r.content) for r in readers.blobs(spark, str(tmp_path), entries).collect()}
    assert got == {"a": bytes((2, 3, 4)), "b": bytes((8, 9, 0, 0)), "c": bytes(2)}


def test_ranges_up_to_the_end_and_beyond(spark):
    text = "".join(chr(97 + k % 26) for k in range(20_000))
    blocks = relational.blocks_of(spark.createDataFrame([("k", text)], "key string, content string"), "key", "content")
    asked = [("k", 5, -1), ("k", 5, 10), ("k", 8190, 4), ("k", 19_990, 100), ("k", 20_000, -1), ("k", 20_001, 1), ("k", 99_999, -1), ("k", 7, 0), ("none", 0, 1)]
    got = {(r.key, r.offset, r.size): r.content for r in relational.read_ranges(spark.createDataFrame(asked, "key string, offset int, size int"), blocks, "key", "offset", "size").collect()}
    want = {(k, o, n): None if k == "none" or o > len(text) else text[o:] if n < 0 else text[o : o + n] for k, o, n in asked}
    assert got == want


def test_small_checks(spark):
    leaves = spark.createDataFrame([(1, 5), (10, -1), (2, 3), (1, 99), (None, None)], "type int, offset int")
    assert relational.articles_of(leaves).count() == 3
    good, bad = relational.within_archive(leaves, "offset", 50)
    assert (good.count(), bad.count()) == (2, 3)
    refs = spark.createDataFrame([("A.bmp",), ("gone.bmp",), (None,)], "name string")
    files = spark.createDataFrame([("a.BMP", b"x")], "file string, data binary")
    got = {r.name: (bytes(r.content), r.missing) for r in relational.with_files(refs, files, "name", "file", "data").collect()}
    assert got == {"A.bmp": (b"x", False), "gone.bmp": (b"", True), None: (b"", True)}
    assert relational.total_samples(spark.createDataFrame([(2**31 - 1,), (5,)], "sample_size int")).first()[0] == 2**31 + 4
    assert relational.total_samples(spark.createDataFrame([], "sample_size int")).first()[0] == 0
    images = spark.createDataFrame([("g", 3, 4), ("g", 5, 1)], "g string, w int, h int")
    assert tuple(relational.stacked(images, "g", "w", "h").first()) == ("g", 5, 5)
    marks = spark.createDataFrame([("ab@c",), ("x" * 0x1FF + "@",), ("x" * 0x200 + "@",), ("",)], "t string")
    assert [r[0] for r in marks.select(relational.first_mark("t")).collect()] == [2, 0x1FF, -1, -1]
