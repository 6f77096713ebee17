"""Every operator against brute force, and on nulls, empty and long texts, ties, empty tables and clashing columns."""

import base64
import bz2
import functools
import gzip
import itertools
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from lexforge.llm import _setjoin, bpe, decontam, html_template, line_dedup, ngram_join, quality, secret_scan, sharding, toxicity, url_filter
from lexforge.llm import queries as llm
from lexforge.llm._text import WORD, word_hash

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, line int, first long, __id int, __gone int, jaccard double, owner int"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 0.5, 6) for i, t in zip(ids, texts)], SCHEMA)


def words(text):
    return re.findall(WORD, text.lower())


ODD = ["", None, "\n\n", "!!!", "one", "x " * 50_000, "same text here now", "same text here now", "ü ß 字 \U0001f600"]


def test_edge_cases(spark):
    labels = spark.createDataFrame([(0, 1, 0), (6, 1, 0), (5, 0, 1), (None, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text here now ok"), (2, None), (3, "")], "item_id long, text string")
    for table in (docs(spark, ODD), docs(spark, ["a", None], [None, 3]), docs(spark, [])):
        n = table.count()
        line_dedup.repeated_lines(table).collect()
        assert line_dedup.dedup_lines(table).columns == table.columns
        assert {r.doc_id for r in ngram_join.near_duplicates(table).collect()} == ({6, 7} if n == len(ODD) else set())
        assert ngram_join.one_of_each(table).columns == table.columns
        assert sharding.sharded(table).count() == n
        assert secret_scan.found(table).count() == 0
        assert quality.kept(table, quality.fit(table, labels)).count() <= n
        assert decontam.leaks(table, bench).count() == 0 and decontam.decontaminate(table, bench).count() == n
        model = toxicity.fit(table, labels)
        toxicity.passages(table, model).collect()
        assert toxicity.harmless(table, model).columns == table.columns
        assert bpe.encode(table).count() == n
    kept = {r.doc_id for r in ngram_join.one_of_each(docs(spark, ODD)).collect()}
    assert 6 in kept and 7 not in kept and {0, 1, 2, 3} <= kept
    pages = spark.createDataFrame([(1, None, None, 1), (2, "no url", "", 1), (None, "http://a.example.com/x", "<p>t", 1)], "page_id long, url string, html string, host int")
    assert [r.text for r in html_template.extracted(pages).orderBy("page_id").collect()] == ["t", None, ""]
    assert {r.action for r in url_filter.filtered(pages).collect()} == {"allow"}
    for f in (html_template.extracted, url_filter.filtered):
        assert f(pages.limit(0)).count() == 0


def test_sets_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 60, 30)]
        for _ in range(3):
            t = list(base)
            for k in rng.integers(0, 30, rng.integers(0, 6)):
                t[k] = f"w{rng.integers(0, 90)}"
            texts.append("\n".join(" ".join(t[k : k + 10]) for k in range(0, 30, 10)))
    df = docs(spark, texts)
    jac = lambda a, b: len(a & b) / len(a | b)
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == near_by_force(texts)
    lines = [((i, k), set(words(x))) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    want = {}
    for n, (at, s) in enumerate(lines):
        first = next((p for p, o in lines[:n] if jac(s, o) >= 0.8), None)
        if first:
            want[at] = first
    assert {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in line_dedup.repeated_lines(df).collect()} == want


def near_by_force(texts, t=0.6):
    """doc_id, class_id, copies, links, match_doc_id, jaccard of all texts with a copy or a near duplicate."""
    grams = [frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w) for w in map(words, texts)]
    first = {g: i for i, g in reversed(list(enumerate(grams)))}
    alike = {g: sorted((first[o], len(g & o) / len(g | o)) for o in first if o != g and len(g & o) >= t * len(g | o)) for g in first if g}
    return {(i, first[g], grams.count(g), len(alike[g]), *(alike[g][0] if alike[g] else (None, 1.0))) for i, g in enumerate(grams) if g and (grams.count(g) > 1 or alike[g])}


def clusters():
    """Near copies in groups of many sizes, exact copies among them, a passage that all of another group share, and a line that all texts have."""
    rng = np.random.default_rng(9)
    plain = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    texts = []
    for many in (2, 3, 9, 30, 70):
        base = plain(60)
        for _ in range(many):
            t = list(base)
            for k in rng.integers(0, 60, rng.integers(0, 9)):
                t[k] = f"w{rng.integers(0, 4000)}"
            texts.append(" ".join(t) + "\nthis line is in all of the texts here")
    passage = " ".join(plain(50))
    texts += [" ".join(plain(70)) + "\n" + passage for _ in range(40)] + texts[:20]
    return texts


@pytest.mark.parametrize("change", [{}, {"star": 1 << 30, "CELL_BYTES": 2000}, {"star": 1, "small_cell": 3, "CELL_BYTES": 2000, "hot": 8}, {"flush": 50, "pairs": 100, "PART": 500, "BROADCAST_BYTES": 0}])
def test_clusters_against_brute_force(spark, monkeypatch, change):
    for name, value in change.items():
        if name.isupper():
            monkeypatch.setattr(_setjoin, name, value)
    monkeypatch.setattr(ngram_join, "Spec", functools.partial(_setjoin.Spec, **{k: v for k, v in change.items() if k.islower()}))
    texts = clusters()
    got = [tuple(r) for r in ngram_join.near_duplicates(docs(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_force(texts)


def test_one_of_each_against_brute_force(spark):
    texts = clusters()
    above = list(range(len(texts)))

    def root(x):
        return x if above[x] == x else root(above[x])

    grams = [frozenset(zip(w, w[1:])) for w in map(words, texts)]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b]):
            x, y = sorted((root(a), root(b)))
            above[y] = x
    assert {r.doc_id for r in ngram_join.one_of_each(docs(spark, texts)).collect()} == {x for x in range(len(texts)) if root(x) == x}


def test_a_line_of_all_texts_is_sent_once_a_task(spark):
    texts = ["one two three four five six"] * 5000 + ["one two three four five six seven"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    spec = _setjoin.Spec(True, 1, 0.8)
    sent = list(_setjoin.emitted(iter([batch]), spec, np.zeros(1 << _setjoin.BUCKETS, np.uint8), 4))
    assert sum(sum(b.column("entries").to_pylist()) for b in sent) == 4
    got = {r.doc_id: (r.match_doc_id, r.jaccard) for r in line_dedup.repeated_lines(docs(spark, texts)).collect()}
    assert got == {**{k: (0, 1.0) for k in range(1, 5000)}, 5000: (0, 6 / 7)}


@pytest.mark.parametrize("name", ["line_dedup", "ngram_join"])
def test_workers_give_memory_back(spark, name):
    import corpus_pipeline

    def unused(batches):
        import ctypes

        held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024
        for _ in batches:
            pass
        before = held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_arrays([pa.array([before - held()])], ["mb"])

    # 20 MB of words in one task
    texts = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 999), k -> substr(md5(concat(id, ' ', k % 500)), 1, 9) || if(k % 10 = 0, '\\n', '')), ' ')").alias("text"))
    dict(corpus_pipeline.STAGES)[name](spark, texts, D).write.format("noop").mode("overwrite").save()
    left = [r.mb for r in spark.range(0, 8, 1, 4).mapInArrow(unused, "mb double").collect()]
    assert max(left) < 24, left


def test_lines_go_in_long_texts(spark):
    lines = [f"line number {k} of a long text with word{k} and more{k}" for k in range(300)]
    texts = ["\n".join(lines[:5] + lines[100:200]), "\n".join(["an own line", *lines, "", "the last line"]), None, ""]
    left = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert left[0].text == texts[0] and left[2].text is None and left[3].text == ""
    assert left[1].text.split("\n") == ["an own line", *lines[5:100], *lines[200:], "", "the last line"] and left[1].n_chars == len(left[1].text)


def test_bytes_that_are_no_utf8(spark):
    df = docs(spark, ["same text here now and more words"] * 2 + ["x", "y"]).withColumn("text", F.expr("case when doc_id = 2 then cast(unhex('61C328FF20C3') as string) when doc_id = 3 then cast(unhex('A9FF20') as string) else text end"))
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "here now")], "item_id long, text string")
    assert [r.doc_id for r in line_dedup.repeated_lines(df).collect()] == [1]
    assert {r.doc_id for r in ngram_join.near_duplicates(df).collect()} == {0, 1}
    assert sharding.sharded(df).count() == 4 and secret_scan.found(df).count() == 0
    assert quality.kept(df, quality.fit(df, labels)).count() <= 4 and decontam.leaks(df, bench).count() == 0
    assert toxicity.harmless(df, toxicity.fit(df, labels)).count() == 4
    encoded = bpe.encode(df)
    assert all(r.exact for r in encoded.collect())
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()}[2] == "a\ufffd(\ufffd \ufffd"


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60)], "u long, v long")
    assert {r.doc_id: r.first for r in ngram_join.groups(pairs).collect()} == {**{i: 0 for i in range(1, 21)}, 60: 50}


def test_suffix_matches_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 4, 300)) for _ in range(8)]
    items = [" ".join(f"v{x}" for x in rng.integers(0, 4, 40)) for _ in range(6)] + [" ".join(texts[2].split()[40:80]), "v1 v2 v3 v0 v1"]
    got = {(r.doc_id, r.item_id): r.match_words for r in decontam.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for (d, t), (i, x) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = t.split(), x.split()
        best = max((next(n for n in range(60) if p + n >= len(a) or q + n >= len(b) or a[p + n] != b[q + n]) for p in range(len(a)) for q in range(len(b))), default=0)
        if best >= min(13, len(b)):
            want[d, i] = best
    assert got == want and (2, 6) in got


def test_short_items_leak_only_as_whole_texts(spark):
    bench = spark.createDataFrame([(1, "Yes!"), (2, "of the"), (3, "five words are long enough")], "item_id long, text string")
    texts = ["yes", "yes of the day", "of, the", "these five words are long enough here", "of the of the"]
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, texts), bench).collect()} == {(0, 1), (2, 2), (3, 3)}


def test_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        scores = rng.normal(-0.3, 1, 14)
        at = [k for k in range(14) if scores[k] > 0]
        scores[scores <= 0] = -0.2
        found = toxicity.segments(at, [float(scores[k]) for k in at], -0.2)
        total = lambda a, b: float(scores[a:b].sum())
        if at:
            best = max(total(a, b) for a in range(14) for b in range(a + 1, 15))
            assert max(s for _, _, s in found) == pytest.approx(best)
        for (a, b, s), (c, d, _) in zip(found, found[1:]):
            assert b <= c and s == pytest.approx(total(a, b))


def test_all_maximal_segments_against_brute_force():
    rng = np.random.default_rng(6)

    def maximal(scores, a, b):
        """The definition, by recursion: the best segment, shortest first, and those of what is left and right of it."""
        best = max(((float(scores[i:j].sum()), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return [*maximal(scores, a, i), (i, j), *maximal(scores, j, b)]

    for _ in range(80):
        scores = rng.normal(-0.2, 1, 16)
        scores[scores <= 0] = -0.25
        at = np.flatnonzero(scores > 0).tolist()
        assert [(a, b) for a, b, _ in toxicity.segments(at, scores[at].tolist(), -0.25)] == maximal(scores, 0, 16)


def test_log_e_of_a_text():
    location, scale, n = 1.0, 1.5, 200
    one = (9.0 - location - scale * np.log(n)) / scale
    assert toxicity.doc_log_e([9.0], n, location, scale) == pytest.approx(-one)
    two = (12.0 - location - scale * np.log(n)) / scale
    both = one + two
    assert toxicity.doc_log_e([9.0, 12.0, 0.1], n, location, scale) == pytest.approx(min(-two, -both + np.log(both) - np.log(2)))


def test_isolation_forest_against_brute_force():
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(0, 1, (400, 3)), [[9.0, 9.0, 9.0], [0.0, -8.0, 0.0]]))
    forest = quality.grow(x, 60, 128, 5)

    def depth(k, row):
        at, n = 0, 0
        while forest.feature[k][at] >= 0:
            at = (forest.left if row[forest.feature[k][at]] < forest.split[k][at] else forest.right)[k][at]
            n += 1
        return n, forest.path[k][at]

    expected = 2 * (np.log(127) + 0.5772156649015329) - 2 * 127 / 128
    want = [2 ** (-np.mean([depth(k, row)[1] for k in range(60)]) / expected) for row in x]
    scores = forest.scores(x)
    assert scores == pytest.approx(want) and np.argmax(scores) == 400
    for k in range(60):
        leaves = {}
        # of the sample no leaf is empty, and a path has the leaf's depth at least
        for row in x[:50]:
            n, path = depth(k, row)
            assert n <= 7 and path >= n
            leaves[n] = path
    assert quality._expected(2) == 1.0 and quality._expected(1) == 0.0


def test_templates_of_random_pages_against_brute_force(spark):
    rng = np.random.default_rng(3)
    parts = [f"<div class=a{k}><p>part {k}</p></div>" for k in range(12)]
    rare = [1.0, 0.9, 0.5, 0.3, 0.2, 0.15, 0.12, 0.08, 0.05, 0.03, 0.02, 0.02]
    rows = []
    for host in ("one.example.com", "two.example.org"):
        for k in range(90):
            some = [p for p, r in zip(parts, rare) if rng.random() < r]
            rows.append((len(rows), f"http://{host}/{k}", f"<html><body>{''.join(some)}<p>own {len(rows)}</p></body></html>", some, host))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    # each page's content is its own, so a part is a template if five pages of the host and a tenth of them have it
    count = {(h, p): sum(p in r[3] for r in rows if r[4] == h) for h in {r[4] for r in rows} for p in parts}
    want = {r[0]: "\n".join([re.search("part [0-9]+", p)[0] for p in r[3] if count[r[4], p] < max(html_template.MIN_PAGES, html_template.SHARE * 90)] + [f"own {r[0]}"]) for r in rows}
    assert {r.page_id: r.text for r in html_template.extracted(pages).collect()} == want


def test_pages_and_urls_that_are_long_or_deep(spark):
    deep, wide = "<div>" * 20_000 + "in" + "</div>" * 20_000, "<p>" + "word " * 200_000 + "</p>"
    pages = spark.createDataFrame([(1, "http://a.example.com/" + "x/" * 50_000, deep), (2, "http://" + "a." * 20_000 + "example.com/", wide)] * 2, "page_id long, url string, html string")
    got = html_template.extracted(pages).collect()
    assert sorted((r.page_id, len(r.text)) for r in got) == [(1, 2), (1, 2), (2, 5 * 200_000 - 1), (2, 5 * 200_000 - 1)]
    assert [r.action for r in url_filter.filtered(pages, [("example.com", "block")]).collect()] == ["block"] * 4


def test_toxicity_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d, labels.where("doc_id % 2 = 0"))
    left = {r.doc_id for r in toxicity.harmless(d, model).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    bad, good = [r.doc_id for r in rest if r.toxic], [r.doc_id for r in rest if not r.toxic]
    assert sum(x not in left for x in bad) >= 0.8 * len(bad) and sum(x in left for x in good) >= 0.97 * len(good)


def test_toxicity_of_few_labels(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    d = spark.read.parquet(f"{D}/documents.parquet")
    left = {r.doc_id for r in toxicity.harmless(d, toxicity.fit(d, labels)).collect()}
    bad, good = [r.doc_id for r in labels.collect() if r.toxic], [r.doc_id for r in labels.collect() if not r.toxic]
    assert sum(x not in left for x in bad) >= 0.4 * len(bad) and sum(x in left for x in good) >= 0.97 * len(good)


def test_near_copies_give_no_toxic_words(spark):
    rng = np.random.default_rng(2)
    plain = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    chance = [f"c{k}" for k in range(40)]
    base = plain(60) + chance
    texts = [" ".join([*base, f"end{k}"]) for k in range(20)] + [" ".join(plain(60) + ["insult"]) for _ in range(40)] + [" ".join(plain(80)) for _ in range(300)]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts), labels)
    known = {toxicity_word(x) for x in ("insult", *chance)}
    assert {int(w) for w in model.words} & known == {toxicity_word("insult")}


def toxicity_word(word):
    return word_hash(word) >> 64 - toxicity.WORD_BITS


def test_quality_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = {r.doc_id for r in quality.kept(d, quality.fit(d, labels.where("doc_id % 2 = 0"))).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    bad, good = [r.doc_id for r in rest if not r.quality], [r.doc_id for r in rest if r.quality]
    assert sum(x in kept for x in good) >= 0.95 * len(good) and sum(x not in kept for x in bad) >= 0.5 * len(bad)


def test_quality_is_fitted_on_all_labels(spark, monkeypatch):
    n = 50_000
    h = lambda k, m: F.pmod(F.xxhash64("id", k), F.lit(m))
    word = lambda k: F.concat(F.lit("w"), F.translate(F.substring(h(k, 10**9).cast("string"), F.lit(1), (1 + h(k, 7)).cast("int")), "12345678", "abcdefgh"))
    # texts of 6 to 35 words; good ones have up to 3 signs, bad ones up to 40
    signs = F.when(F.col("id") % 10 == 0, h(F.lit(-2), 41)).otherwise(h(F.lit(-3), 4)).cast("int")
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), 6 + h(F.lit(-1), 30)), word), " "), F.repeat(F.lit(" #|"), signs))
    d = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))
    drawn = []
    grown = quality._grown
    monkeypatch.setattr(quality, "_grown", lambda samples, seed: drawn.append(samples) or grown(samples, seed))
    forest = quality.fit(d, labels)
    rows = d.orderBy("doc_id").collect()
    x, words = quality.statistics(pa.array([r.text for r in rows]))
    good = np.array([r.doc_id % 10 != 0 for r in rows])
    lengths = np.sort(words[good])[::-1]
    long = good & (words >= lengths[len(lengths) // 2 - 1])
    assert (forest.centre == np.median(x[long], 0)).all()
    # every tree draws from all good documents
    part = {tuple(r) for r in forest.shrunk(x[good], words[good]).tolist()}
    assert len(drawn[0]) == quality.TREES and all(s.shape == (quality.TREE_ROWS, len(quality.STATISTICS)) for s in drawn[0])
    assert all(tuple(r) in part for s in drawn[0] for r in s.tolist())
    # the threshold by trying every cut
    scores = forest.scores(forest.shrunk(x, words))
    best, want = 0.0, np.inf
    known = np.unique(scores)[::-1]
    bad_scores, good_scores = np.sort(scores[~good]), np.sort(scores[good])
    for s, after in zip(known, known[1:]):
        tp, fp = ((len(a) - np.searchsorted(a, s)) / len(a) for a in (bad_scores, good_scores))
        if fp > quality.FALSE_POSITIVES:
            break
        if tp - fp > best:
            best, want = tp - fp, (s + after) / 2
    assert np.isfinite(want) and forest.threshold == want
    # many labels are joined with the statistics instead, and parts of the table don't matter
    monkeypatch.setattr(quality, "small", lambda df, size: False)
    again = quality.fit(d.repartition(7), labels.union(labels.limit(0)))
    assert all(np.array_equal(getattr(forest, k), getattr(again, k)) for k in ("feature", "split", "left", "right", "path", "centre")) and forest.threshold == again.threshold


def test_quality_statistics_are_of_one_text():
    texts = ["so #", "# much |", "|", "", "", "\n", "#A 1", "1A|x", "x"]
    x, words = quality.statistics(pa.array(texts))
    for k, text in enumerate(texts):
        one, n = quality.statistics(pa.array([text]))
        assert (x[k] == one[0]).all() and words[k] == n[0]


def test_quality_draws_and_medians(spark):
    rng = np.random.default_rng(4)
    n = len(quality.STATISTICS)
    x = np.concatenate((rng.normal(0, 3, (301, n)), rng.integers(-2, 3, (100, n)).astype(float)))
    table = lambda x: spark.createDataFrame([(k % 90, 5 + k % 7, row) for k, row in enumerate(x.tolist())], "doc_id long, words long, x array<double>").repartition(5)
    for some in (x, x[:-1], x[:1], x[:2]):
        assert (quality._medians(table(some), len(some)) == np.median(some, 0)).all()
    got, words, draws = quality._drawn(table(x), 40, 300, 3)
    assert [len(set(d.tolist())) for d in draws] == [300] * 40 and len(got) == len(x)
    assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, x.tolist()))  # 40 draws of 300 out of 401 leave none out
    assert {tuple(r): w for r, w in zip(got.tolist(), words.tolist())} == {tuple(r): 5 + k % 7 for k, r in enumerate(x.tolist())}
    got, _, draws = quality._drawn(table(x[:9]), 2, 300, 3)
    assert len(got) == 9 and all(sorted(d.tolist()) == list(range(9)) for d in draws)


def test_quality_threshold(spark):
    rng = np.random.default_rng(6)
    for n, shift in ((2_000, 1.0), (150, 1.0), (900, 8.0), (500, -9.0)):
        good = rng.random(n) < 0.8
        scores = np.round(rng.normal(0, 1, n) + shift * ~good, 1 if n == 900 else 2)  # with ties
        want, best = np.inf, 0.0
        known = np.unique(scores)[::-1]
        for s, after in zip(known, known[1:]):
            tp, fp = (scores[~good] >= s).sum() / (~good).sum(), (scores[good] >= s).sum() / good.sum()
            if fp <= quality.FALSE_POSITIVES and tp - fp > best:
                best, want = tp - fp, (s + after) / 2
        table = spark.createDataFrame(list(zip(good.tolist(), scores.tolist())), "good boolean, score double").repartition(3)
        assert quality._threshold(table, int(good.sum())) == want
    only = spark.createDataFrame([(True, 0.5)], "good boolean, score double")
    assert quality._threshold(only, 1) == np.inf


def test_bpe_is_that_of_the_rank_file(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    import public_tokenizers as P

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "it's  we'll 12ab\n\n x", "字\U0001f600ü " * 9, "a" * 3000, "abab" * 200 + " tail"] + [r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    encoded = bpe.encode(docs(spark, texts))
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(got[i].tokens == e.encode_ordinary(t) and got[i].exact for i, t in enumerate(texts))
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == dict(enumerate(texts))


def test_sharding_keeps_groups_and_balance(spark):
    rows = sharding.sharded(spark.read.parquet(f"{D}/documents.parquet"), 4, 50).collect()
    shard, size = {}, [0] * 4
    for r in rows:
        assert shard.setdefault(r.group_id, r.shard) == r.shard
        size[r.shard] += r.n_bytes
    assert max(size) - min(size) < 0.05 * max(size)
    df = spark.read.parquet(f"{D}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert {r.doc_id: r.shard for r in sharding.sharded(df, 4, 50).collect()} == {r.doc_id: r.shard for r in rows}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    part = [x[0] for x in sharding.difference([(8,), (7,), (6,), (5,), (4,)], 2)]
    assert abs(sum(n * (1 - 2 * p) for n, p in zip((8, 7, 6, 5, 4), part))) == 2


def test_secrets_in_layers(spark):
    key = "AKIA" + "Q7" * 8
    hidden = base64.b64encode(base64.b64encode(gzip.compress(f"my {key} key".encode()))).decode()
    texts = [f"see {key}.", "x %41KIA" + "Q7" * 8, "y \\u0041KIA" + "Q7" * 8, f"blob {hidden} end", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a token: of thanks", "%25%32%35%25"]
    got = {r.doc_id: r for r in secret_scan.found(docs(spark, texts)).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0].depth == 0 and got[1].path == "url" and got[2].path == "unicode" and got[3].depth == 2
    assert texts[3].encode()[got[3].start : got[3].end].decode() == hidden


def test_sharding_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    rng = np.random.default_rng(4)
    texts = ["x" * int(n) + str(k % 90) for k, n in enumerate(rng.integers(1, 900, 120))] + ["same"] * 5
    rows = sharding.sharded(docs(spark, texts), 3, 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(125)) and len({r.shard for r in rows if texts[r.doc_id] == "same"}) == 1
    size = [sum(r.n_bytes for r in rows if r.shard == k) for k in range(3)]
    assert max(size) - min(size) < 0.05 * max(size)


def test_long_secrets_and_large_layers(monkeypatch):
    key = b"sk_live_" + b"a1B2" * 100
    assert [x[3:] for x in secret_scan.scan(b"see " + key + b" end")] == [(4, 4 + len(key), key)]
    monkeypatch.setattr(secret_scan, "LAYER_BYTES", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1024)
    aws = b"AKIA" + b"Q7" * 8
    for at in (100, 4090, 9000, 50_000):
        body = b"." * at + b" " + aws + b" " + b"-" * 20_000
        for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
            assert aws in found_in(base64.b64encode(pack(body)).decode()), (at, pack)


def found_in(text):
    data = text if isinstance(text, bytes) else text.encode()
    rows = secret_scan.suspects(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return {x[5] for x in secret_scan.scan(data)} if rows[0] else set()


def test_secrets_in_wrapped_and_prefixed_base64():
    key = b"AKIA" + b"Q7" * 8
    noise = np.random.default_rng(1).bytes(400).hex().encode()
    for body in (b"some words before it " * 3 + key + b" and after", gzip.compress(noise + b" " + key + b" " + noise)):
        one = base64.b64encode(body).decode()
        lines = [one[k : k + 64] for k in range(0, len(one), 64)]
        for text in ("\n".join(lines), "\r\n".join(lines), f"see /cb/{one}", f"x_{one}"):
            assert key in found_in(text), text[:80]


def test_secrets_in_binary_and_wide_base64():
    key = "AKIA" + "Q7" * 8
    for body in (f"the {key} key".encode("utf-16-le"), f"the {key} key".encode("utf-16"), f"the {key} key".encode("utf-16-be"), f"clé {key} été".encode("latin-1"), b"\0\1\xff" + key.encode() + b"\0\2"):
        assert key.encode() in found_in(base64.b64encode(body).decode()), body


def test_urls_by_trie_and_by_join(spark):
    rules = [("a.com", "block"), ("x.a.com/p", "allow"), ("a.com/p/q", "allow"), ("x.a.com", "block")]
    urls = ["http://A.com:80/", "http://x.a.com/p/1", "https://y.a.com/p/q", "http://x.a.com/p2", "http://ba.com", "ftp://u@x.a.com./p?z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.rule for r in url_filter.filtered(pages, rules).orderBy("page_id").collect()]
    assert got == ["a.com", "x.a.com/p", "a.com/p/q", "x.a.com", None, "x.a.com/p"]
    joined = url_filter.filtered_by_join(pages, url_filter.normal(rules))
    assert got == [r.rule for r in joined.orderBy("page_id").collect()]


def test_templates_against_brute_force(spark, monkeypatch):
    page = lambda k: f"<html><body><nav><a>menu</a></nav><p>own {k}</p><div>foot<b>er</b></div></body></html>"
    pages = spark.createDataFrame([(k, f"http://h.example.com/{k}", page(k)) for k in range(6)] + [(9, "http://o.example.com/", page(9))], "page_id long, url string, html string")
    want = {**{k: f"own {k}" for k in range(6)}, 9: "menu\nown 9\nfooter"}
    assert {r.page_id: r.text for r in html_template.extracted(pages).collect()} == want
    monkeypatch.setattr(html_template, "small", lambda *_: False)
    assert {r.page_id: r.text for r in html_template.extracted(pages).collect()} == want


def test_copies_and_chance_are_no_template(spark):
    page = lambda k, x: f"<html><body><script>n={k}</script><nav>menu</nav><article><p>{x}</p><p>by chance</p></article></body></html>" if k < 6 else f"<html><body><nav>menu</nav><p>{x}</p></body></html>"
    texts = ["copied"] * 6 + [f"own {k}" for k in range(60)]
    pages = spark.createDataFrame([(k, f"http://h.example.com/{k}", page(k, x)) for k, x in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extracted(pages).collect()}
    assert got == {k: f"{x}\nby chance" if k < 6 else x for k, x in enumerate(texts)}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    labels = spark.createDataFrame([(0, 1, 0), (6, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a benchmark item of several words"), (2, None)], "item_id long, text string")
    labels.write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    texts = [*ODD, "see: a benchmark item of several words", "same text here now"]
    full = docs(spark, texts).unionByName(docs(spark, ["lost", None], [None, None]))
    want = {
        "toxicity": [*range(11), None, None], "line_dedup": [0, 1, 2, 3, 4, 5, 6, 8, 9, None, None], "ngram_join": [0, 1, 2, 3, 4, 5, 6, 8, 9, None, None],
        "decontamination": [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, None, None], "bpe": [*range(11), None, None],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, sf)
        assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x)) == want[name], name
        assert name == "bpe" or out.columns == full.columns
        assert stage(spark, full.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, full, sf).where("doc_id = 5").first().text == texts[5]


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D)
    # stage by stage, each on what the one before it returned
    left = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, D).collect(), d.schema)
    assert {r.doc_id: r.tokens for r in out.collect()} == {r.doc_id: r.tokens for r in bpe.encode(left).collect()}
    assert {r.doc_id: r.text for r in bpe.decode(out).collect()} == {r.doc_id: r.text for r in left.collect()}
    assert 0 < out.count() <= d.count() and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    assert set(llm.queries()) >= {f for f in llm.oracles()}
