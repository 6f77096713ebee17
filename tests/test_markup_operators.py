"""Markup on columns is worked on in pieces, whatever Spark sends at once."""

import pyarrow as pa

from lexforge.markup import operators, tree

TEXTS = [None, "", r"\b{a}b", "\\tcc", "x" * 300_000, *(rf"\b{{{k}}} y" for k in range(700)), "\\\\" * 9000, "é" * 140_000]


def test_pieces_have_few_bytes():
    texts = pa.array(TEXTS)
    found = [(at, p.to_pylist()) for at, p in operators._pieces(texts)]
    assert [t for _, p in found for t in p] == TEXTS and all(TEXTS[at] == p[0] for at, p in found)
    assert len(found) > 3 and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= operators.TEXTS for _, p in found)
    assert list(operators._pieces(texts.slice(0, 0))) == []


def test_printed_in_pieces(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(1)
    got = {r.k: (r.x.out, r.x.error) for r in df.select("k", operators.printed(df.t, tree.html).alias("x")).collect()}
    assert len(got) == len(TEXTS) and got[0] == (None, None) and got[3][0] is None and got[3][1]
    assert all(got[k] == (tree.html(tree.parse(t)), None) for k, t in enumerate(TEXTS) if k not in (0, 3))


def test_parsed_in_pieces(spark):
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(TEXTS)], "k int, t string, more string").repartition(1)
    out = operators.parsed(df, "t", "k", "more")
    assert out.columns == ["k", "more", "error", "node_id", "parent_id", "pos", "depth", "kind", "text", "attrs"]
    assert "Generate" not in out._jdf.queryExecution().toString()  # no text's nodes travel as one array
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append(tuple(r)[2:])
    assert got[0] == [(None,) * 8] and len(got[3]) == 1 and got[3][0][0] and len(got[705]) == 9001 > operators.NODES
    for k, t in enumerate(TEXTS):
        if k not in (0, 3):
            assert sorted(got[k], key=lambda x: x[1]) == [(None, i, p, at, d, n.kind, n.text, n.attrs) for i, p, at, d, n in tree.parse(t).walk()]
