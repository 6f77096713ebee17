"""Steps whose groups grow with the input: their work grows no faster, and the results are those of the plain definition."""

import random

from pyspark.sql import functions as F

from lexforge.operators import relational as R
from lexforge.operators import variants

OPEN, CLOSE = ("(", False, False), (")", False, False)
FREE, SORTED = (" ", False, False), (" ", True, False)
PIECES = [
    [OPEN, ("s", True, False), CLOSE], [OPEN, ("s", False, False), CLOSE], [FREE, OPEN, ("s", False, False), CLOSE], [SORTED, OPEN, ("s", True, False), CLOSE],
    [SORTED, OPEN, ("s", False, False), CLOSE, FREE], [("a", True, False)], [SORTED], [("é", True, True)],
]


def first_pairs(headings, strict):
    """The first pair in order that merges does so, until none does."""
    now, gone = list(headings), set()
    while True:
        pairs = ((i, j) for i in range(len(now)) for j in range(i + 1, len(now)) if not (strict and {i, j} & gone))
        found = next(((i, j, m) for i, j in pairs if (m := variants.merged(now[i], now[j])) is not None), None)
        if found is None:
            return [(i, h) for i, h in enumerate(now) if i not in gone]
        now[found[0]] = found[2]
        gone.add(found[1])


def made(rng):
    return sum((rng.choice(PIECES) for _ in range(rng.randint(0, 3))), [])


def test_collapse_is_that_of_first_pairs():
    rng = random.Random(3)
    for _ in range(1500):
        headings = [made(rng) for _ in range(rng.randint(1, 8))]
        for strict in (False, True):
            assert variants.collapse(headings, strict) == first_pairs(headings, strict)


def test_collapse_looks_partners_up(monkeypatch):
    calls = []
    joined = variants._joined
    monkeypatch.setattr(variants, "_joined", lambda x, y: calls.append(0) or joined(x, y))
    headings = [PIECES[k % 2] for k in range(400)]
    assert len(variants.collapse(headings)) == 1 and len(calls) < 4 * len(headings)


def test_collapsed_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), k, made(rng)) for k in range(300)] + [(3, 1000, []), (3, 1001, [("ab", True, False), ("", False, True)])]
    df = spark.createDataFrame(rows, f"ref int, ord int, chars {variants.CHARS}").repartition(3)
    for strict in (False, True):
        want = {(ref, ords[i]): h for ref in (None, 1, 2, 3) if (ords := [o for r, o, _ in rows if r == ref]) is not None for i, h in first_pairs([h for r, _, h in rows if r == ref], strict)}
        got = {(r.ref, r.ord): [tuple(c) for c in r.chars] for r in variants.collapsed(df, "ref", "ord", "chars", strict).collect()}
        assert got == want
    assert variants.collapsed(df.where(F.lit(False)), "ref", "ord", "chars").collect() == []


def test_front_decoding_holds_no_page(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "p", "q"]), k, rng.choice([None, -1, 0, 1, 3, 9]), rng.choice([None, "", "ab", "é"])) for k in range(400)]
    want = {}
    for page in (None, "p", "q"):
        before = ""
        for _, k, n, rest in (r for r in rows if r[0] == page):
            want[page, k] = text = None if n is None or rest is None else before[: max(n, 0)] + rest
            before = text or ""
    rng.shuffle(rows)
    out = R.front_decoded(spark.createDataFrame(rows, "page string, k int, prefix_len int, suffix string"), "page", ["k"], ["k"])
    assert out.columns == ["page", "k", "text"] and {(r.page, r.k): r.text for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()
