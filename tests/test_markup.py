import pytest

from lexforge.markup import tree


def test_tree_and_dsl():
    root = tree.parse(r"\b{a \i{b}}@;\F{_ADD}c\F{ADD_}\\d")
    assert tree.dsl(root) == "[b]a [i]b[/i][/b];(c)[br]\nd"
    assert tree.outline(root).splitlines()[:3] == ["TextRun", "  BoldFormattingRun", "    PlainRun: a "]


def test_sticky_regions_end_with_their_parent():
    assert tree.dsl(tree.parse("@1a@2b@0c")) == "[b]a[/b][i]b[/i]c"
    assert tree.dsl(tree.parse(r"\sup{@3a}b")) == "[sup][b][i]a[/i][/b][/sup]b"


def test_comments_and_ids():
    assert tree.dsl(tree.parse("@Cgone\nx@C%ID=5%\ny")) == "x y"


def test_breaks():
    assert tree.dsl(tree.parse("\n\na\n\nb\\\\\nc")) == "a b[br]\nc"


KNOWN = tree.Known(
    (("WEB", "Web", "W"), ("GMEDIA", "Tabellen", "T"), ("GMEDIA", "Bilder", "BB"), ("GWISSEN", "Wissensgebiet", "L")),
    (("main", 1, 122582529), ("pics", 620000000, 629000000), ("tabs", 660000000, 669000000)),
    {n.lower(): n for n in ("euro.bmp", "АбfD.BMP", "UNABKöMMLICH1V.WAV")},
)


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        (r"\S{Format;:025004230}", ["ArticleReferenceRun; offset=25004230", "  TextRun", "    PlainRun: Format"]),
        (r"\S{Tabelle: a name;.MT:660151833;Tabelle}", ["TableReferenceRun; offset=151833; file=tabs", "  TextRun", "    PlainRun: Tabelle: a name"]),
        (r"\S{;.MBB:620127616;Astana}", ["PictureReferenceRun; offset=127616; file=pics; cr=; image=", "  PlainRun: Astana"]),
        (r"\S{http://a.example.com/;.MW:004549700;b.example.com;http://b.example.com/}", ["WebReferenceRun; link=http://b.example.com/", "  TextRun", "    PlainRun: http://a.example.com/"]),
        (r"\S{;.Ieuro.bmp;T}", ["InlineImageRun; name=euro.bmp; secondary="]),
        (r"\S{;.Ispeaker.bmp;T;à la longue.Adp}", ["InlineImageRun; name=speaker.bmp; secondary=à la longue.wav"]),
        (r"\S{;.FWISSEN;68}", ["ReferencePlaceholderRun; code=FWISSEN; num=-1; num2=-1", "  TextRun", "  PlainRun: 68"]),
        (r"\S{a b;:06831017:05172-05835}", ["ArticleReferenceRun; offset=6831017", "  TextRun", "    PlainRun: a b"]),
        (r"\S{here is one; and more;.MT:660042728;Tabelle}", None),
    ],
)
def test_references_resolve(text, shown):
    root = tree.resolve(tree.parse(text), KNOWN)
    if shown:
        assert tree.outline(root) == "TextRun\n" + "".join(f"  {x}\n" for x in shown)
    assert tree.outline(tree.resolve(root, KNOWN)) == tree.outline(root)


@pytest.mark.parametrize(
    ("text", "dsl"),
    [
        (r"\S{;.Ieuro.bmp;T}", "[s]euro.bmp[/s]"),
        (r"\S{;.Ispeaker.bmp;T;à la longue.Adp}", "[s]à la longue.wav[/s]"),
        (r"\S{;.IаБFd.bmp;T}", "[s]АбfD.BMP[/s]"),
        (r"\S{;.Ispeaker.bmp;T;unabkömmlich1v.adp}", "[s]UNABKöMMLICH1V.WAV[/s]"),
        (r"\w{abgewöhnen_92.adp}", "[s]abgewöhnen_92.wav[/s] "),
        (r'\w{A1.adp "AA";B1.adp "BB";C1.adp}', '[s]A1.wav[/s] "AA", [s]B1.wav[/s] "BB", [s]C1.wav[/s] '),
        (r'\w{A1.adp "A@2AA@0@2";B1.adp "BB"}', '[s]A1.wav[/s] "A[i]AA[/i][i]"[/i], [s]B1.wav[/s] "BB" '),
    ],
)
def test_references_print(text, dsl):
    assert tree.dsl(tree.resolve(tree.parse(text), KNOWN)) == dsl


def test_article_references_show_headings():
    known = {619: ["Article", "Same"], 620: ["Long word", "Short"]}
    show = lambda text: tree.dsl(tree.resolve_articles(tree.resolve(tree.parse(text), KNOWN), lambda at, hint: hint if hint in known.get(at, ()) else known.get(at, ["unknown"])[0]))
    assert show(r"\S{. Same, ;:000620}") == ". [ref]Same[/ref], "
    assert show(r"\S{Other ;:000621}x") == "[ref]Long word[/ref] (Other) x"
    assert show(r"\S{Other;:7}") == "[ref]unknown[/ref] (Other)"
    assert tree.in_range([("f", 0, 10), ("g", 5, 20)], 7) == ("f", 7)
    with pytest.raises(tree.MarkupError):
        tree.in_range([], 1)
    with pytest.raises(tree.MarkupError):
        tree.resolve(tree.parse(r"\S{a;.MT:1000000000;b}"), KNOWN)


def test_outline_of_a_table():
    shown = tree.outline(tree.parse("\\tab{\\tcn2\\tln1\\tau\n\\tfl1-3\\tcc a@4b\\tcc @C%ID=7%\\tcc}")).splitlines()
    assert shown[:6] == ["TextRun", "  TableRun", "    TableTag 1; from=2; to=-1", "    TableTag 2; from=1; to=-1", "    TableTag 3; from=-1; to=-1", "    SoftLineBreakRun"]
    assert "    TableTag 5; from=1; to=3" in shown and "        PlainRun: b" in shown and "      IdRun: 7" in shown


def test_tables_and_pictures_are_read_in():
    files = {("pics", 166): ["Head \\b{line}", "@C%CR=© Somebody", "@C%File=b5.BMP", "@C%Type=x", "@Cignored", "What it shows", "not this"], ("tabs", 0): ["\\tab{\\tcn1\\tln1\\tcc a\\tcc}", '@C%MT="title"', "\\S{;:1}", "not this"]}
    read = lambda text: tree.inline(tree.resolve(tree.parse(text), KNOWN), lambda file, at: iter(files[file, at]))
    found = read(r"\S{;.MBB:620000166;Caption}")
    a = found.children[0].attrs
    assert (a["copyright"], a["image"], tree.dsl(a["description"])) == ("© Somebody", "b5.BMP", "What it shows")
    assert tree.dsl(found) == "\n----------\nHead [b]line[/b]\nWhat it shows\n[s]b5.BMP[/s]\n© Somebody\n----------\n"
    found = read(r"\S{Tabelle: n;.MT:660000000;Tabelle}")
    assert found.children[0].attrs["mt"] == "title" and tree.outline(found.children[0].attrs["content"]).splitlines()[1] == "  TableRun"
    assert tree.dsl(found).startswith("\n----------\nTabelle: n\n")
    files["tabs", 0] = ["no end"]
    with pytest.raises(tree.MarkupError):
        read(r"\S{Tabelle: n;.MT:660000000;Tabelle}")


def test_tables_keep_nested_cells_apart():
    root = tree.parse(r"\tab{\tcn2\tln1\tcc a\tcc \tab{\tcn1\tln1\tcc x\tcc}\tcc}z")
    outer = root.children[0]
    assert [len(r) for r in outer.attrs["grid"]] == [2]
    assert tree.html(root).count("<table>") == 2 and tree.html(root).endswith("z")


def test_errors():
    for bad in ("\\tcc", "\\S{a;:1:", "\\F{_Nothing}", "\\eb{}"):
        with pytest.raises(tree.MarkupError):
            tree.parse(bad)
    assert tree.dsl(tree.parse("")) == "" and tree.dsl(tree.parse("a\0b")) == "a"


def test_heading_is_taken_off():
    assert tree.dsl(tree.without_heading(tree.parse("\\b{word: }\\\\rest"), ["word"])).endswith("rest")
    assert tree.dsl_heading(tree.parse("a(b)")) == "a\\(b\\)"
