"""Toxic passages as maximum-scoring segments over word log-odds.

Words score by their log-odds between toxic and other labelled texts under an
informative Dirichlet prior. Those that score pass a false discovery rate over
the words tested, so the cut-off follows the size of the labels; near copies
count once, or each chance word of a text with many would pass. All other
words share one small negative score, the log-ratio of their classes' totals,
so scores are log-likelihood ratios with a negative mean. A linear-time scan
finds all maximal segments of a text. Segment scores of texts labelled as
harmless follow an extreme-value law whose location grows with the logarithm
of the length; it turns scores into E-values, which sum statistics combine for
a text. The law and the threshold are taken from labelled texts that the words
they are scored with have not been fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, mix, pieces, released, small, words

#: Size of a word's prior in documents, the false discovery rate of the words that score, and their least odds ratio.
PRIOR, FALSE, ODDS = 10.0, 0.1, 2.0
#: The E-value of a toxic text where labels are too few for a threshold: their parts by themselves have no words that score.
LEVEL = 0.05
#: Parts of the labelled texts, each of which is scored with the words of the others; words in a row that make a shingle.
FOLDS, SHINGLE = 5, 4
#: How often a word must occur so that it can be significant is looked for up to so many texts.
_OFTEN = 64
#: The model is fitted on at most so many labelled documents, those whose id has the least hash; that also bounds its words, which are broadcast.
FIT_ROWS = 200_000
#: Words are told apart by so many bits of their hash.
WORD_BITS = 52
_DOCS = 1 << (64 - WORD_BITS - 1)
_CLASS_BITS = (2 * FOLDS - 1).bit_length()
_EULER = 0.5772156649015329


@dataclass(frozen=True)
class Model:
    """Sorted words and their scores; ``drift`` of all others; the law of harmless scores; the greatest log E-value of a toxic text."""

    words: np.ndarray
    scores: np.ndarray
    drift: float
    location: float
    scale: float
    log_e: float


def segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text in which the words at ``positions`` score as given and all others ``drift`` < 0.

    The linear-time algorithm over disjoint candidates with their left and
    right cumulative totals; what lies between two positions is one step.
    """
    found: list[list[float]] = []  # start, end, total before, total after
    link: list[int] = []  # for each candidate the nearest earlier one with a smaller total before, or -1
    total, at = 0.0, 0
    for p, s in zip(positions, scores):
        total += drift * (p - at)
        at = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, left, right = p, p + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = link[j]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right])
                link.append(j)
                break
            start, left = int(found[j][0]), found[j][2]
            del found[j:], link[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in found]


def doc_log_e(scores: list[float], n: int, location: float, scale: float) -> float:
    """Log E-value of a text of n words: the best over r of the sum statistic of its r best segments."""
    best, total = math.inf, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = (s - location - scale * math.log(max(n, 1))) / scale
        if r > 1 and x <= 0:
            break
        total += x
        log_p = -total + ((r - 1) * math.log(max(total, 1e-300)) - math.lgamma(r + 1) - math.lgamma(r) if r > 1 else 0.0)
        best = min(best, log_p)
    return best


def _scored(piece: pa.RecordBatch, model: Model) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Row, words and segments of the piece's texts that have a significant word."""
    h, offsets = words(piece.column("text"))
    h >>= U64(64 - WORD_BITS)
    if not len(model.words):
        return
    spot = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
    hit = np.flatnonzero(model.words[spot] == h)
    row = np.searchsorted(offsets, hit, "right") - 1
    cuts = np.flatnonzero(np.diff(row)) + 1
    for k in np.split(np.arange(len(hit)), cuts) if len(hit) else ():
        r = int(row[k[0]])
        yield r, int(offsets[r + 1] - offsets[r]), segments((hit[k] - offsets[r]).tolist(), model.scores[spot[hit[k]]].tolist(), model.drift)


def _pairs(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text, toxic and hash h of the texts of at most ``fit_rows`` labelled documents."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    if small(labels, 24):
        labels = F.broadcast(labels)
    both = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).where("text is not null").join(labels, "__id")
    return both.select("toxic", "text", F.xxhash64("text").alias("h"))


def _sketches(column: pa.Array) -> np.ndarray:
    """The least hash of each text's shingles: near copies mostly have the same, other texts hardly ever."""
    h, offsets = words(column)
    shingle = h.copy()
    for k in range(1, SHINGLE):
        shingle[: len(h) - k] = shingle[: len(h) - k] * U64(0x9E3779B97F4A7C15) + h[k:]
    shingle = mix(shingle)
    return np.array([shingle[a : max(b - SHINGLE + 1, a + 1)].min() if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)


@dataclass(frozen=True)
class _Split:
    """Sorted hashes of the labelled texts, their folds (near copies share one), and which of them count (one of the near copies of a class)."""

    h: np.ndarray
    fold: np.ndarray
    counts: np.ndarray

    def at(self, h: pa.Array) -> np.ndarray:
        return np.searchsorted(self.h, h.to_numpy(zero_copy_only=False))


def _split(pairs: DataFrame) -> _Split:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), piece.column("h"), pa.array(_sketches(piece.column("text")).view(np.int64))], ["toxic", "h", "copy"])

    table = pairs.mapInArrow(released(sketch), "toxic int, h long, copy long").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("copy").alias("copy")).toArrow()
    h, toxic, copy = (table.column(c).to_numpy() for c in ("h", "toxic", "copy"))
    order = np.argsort(h)
    h, toxic, copy = h[order], toxic[order], copy[order]
    first = np.zeros(len(h), np.bool_)
    # np.unique names the first of equal rows, which has the least hash
    first[np.unique(np.stack((copy, toxic.astype(np.int64)), 1), axis=0, return_index=True)[1]] = True
    return _Split(h, (mix(copy.view(np.uint64)) % U64(FOLDS)).astype(np.int64), first)


def _log_p(y1, y, share, log=np.log, where=np.where):
    """Log of a bound (Chernoff's; exact if all are toxic) on the chance that y1 or more of y texts are toxic, of which ``share`` are expected."""
    f = y1 / y
    some = y1 * log(f / share) + where(y1 < y, (y - y1) * log(where(y1 < y, (1 - f) / (1 - share), 1.0)), 0.0)
    return where(f > share, -some, 0.0)


def _significant(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float, least: int, tests: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the words, which score, their scores, and the score of all others."""
    share = n1 / (n1 + n0)
    y = y1 + y0
    log_p = np.full(len(y), math.inf)
    often = (y >= least) & (y1 > 0)
    log_p[often] = _log_p(y1[often], y[often], share)
    ranked = np.sort(log_p)
    passed = np.flatnonzero(ranked <= np.log(FALSE * np.arange(1, len(ranked) + 1) / max(1, tests)))
    score = np.log((y1 + PRIOR * share) / (n1 + PRIOR * share)) - np.log((y0 + PRIOR * (1 - share)) / (n0 + PRIOR * (1 - share)))
    keep = (log_p <= (ranked[passed[-1]] if len(passed) else -math.inf)) & (score >= math.log(ODDS))
    f1, f0 = y1[keep].sum() / n1, y0[keep].sum() / n0
    return keep, score, min(math.log((1 - min(f1, 0.999)) / (1 - min(f0, 0.999))), -1e-4)


def _log_odds(labelled: DataFrame, split) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Words that score, their scores, and the score of all others: without each fold, and at last of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        entries = 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((token >> U64(_CLASS_BITS)).astype(np.int64)), pa.array((token & U64((1 << _CLASS_BITS) - 1)).astype(np.int32)), pa.array(n)], ["w", "class", "n"])

        for piece in pieces(batches, "text"):
            piece = piece.filter(pa.array(split.value.counts[split.value.at(piece.column("h"))]))
            kind = (split.value.fold[split.value.at(piece.column("h"))] * 2 + piece.column("toxic").to_numpy(zero_copy_only=False)).astype(np.uint64)
            h, offsets = words(piece.column("text"))
            row = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
            for low in range(0, piece.num_rows, _DOCS):
                i, j = np.searchsorted(row, [low, low + _DOCS])
                once = np.unique(((row[i:j] - low).astype(np.uint64) << U64(WORD_BITS)) | (h[i:j] >> U64(64 - WORD_BITS)))
                held.append(((once & U64((1 << WORD_BITS) - 1)) << U64(_CLASS_BITS)) | kind[(once >> U64(WORD_BITS)).astype(np.int64) + low])
                entries += len(once)
            if entries > 1 << 22:
                yield flush()
                held, entries = [], 0
        if entries:
            yield flush()

    names = [f"c{k}" for k in range(2 * FOLDS)]
    counts = labelled.mapInArrow(released(count), "w long, class int, n long").groupBy("w").agg(*(F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).cast("int").alias(c) for k, c in enumerate(names)))
    counts = counts.persist()
    total = np.array([float(x or 0) for x in counts.agg(*(F.sum(c) for c in names)).first()]).reshape(FOLDS, 2)
    folds = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    n1, n0 = [total[f, 1].sum() for f in folds], [total[f, 0].sum() for f in folds]
    sides = [(sum(F.col(names[2 * f + 1]) for f in some), sum(F.col(names[2 * f]) for f in some)) for some in folds]
    often = [F.least(a + b, F.lit(_OFTEN)) for a, b in sides]
    seen = np.zeros((len(folds), _OFTEN + 2))
    for r in counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("m"), y.alias("y")) for m, y in enumerate(often)))).alias("x")).groupBy("x.m", "x.y").count().collect():
        seen[r["m"], r["y"]] = r["count"]
    tests = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1]  # words in so many texts or more
    least = [1] * len(folds)
    wanted = F.lit(False)
    for m, (a, b) in enumerate(sides):
        if n1[m] and n0[m]:
            share = n1[m] / (n1[m] + n0[m])
            # rarer words can't be significant even if all their texts are toxic, so they don't count as tests
            while least[m] < _OFTEN and share ** least[m] > FALSE / max(1, tests[m, least[m]]):
                least[m] += 1
            log_p = _log_p(a.cast("double"), (a + b).cast("double"), share, F.log, lambda c, x, y: F.when(c, x).otherwise(y))
            wanted = wanted | ((a + b >= least[m]) & (a > 0) & (log_p <= math.log(FALSE)))
    top = counts.where(wanted).orderBy("w").toArrow()
    counts.unpersist()
    w = top.column("w").to_numpy().astype(np.uint64)
    c = np.stack([top.column(x).to_numpy().astype(np.float64) for x in names]).reshape(FOLDS, 2, len(w))
    out = []
    for m, some in enumerate(folds):
        if not n1[m] or not n0[m]:
            out.append((np.zeros(0, np.uint64), np.zeros(0), -1.0))
            continue
        keep, score, drift = _significant(c[some, 1].sum(0), c[some, 0].sum(0), n1[m], n0[m], least[m], int(tests[m, least[m]]))
        out.append((w[keep], score[keep], drift))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits words, extreme-value law and threshold on the labelled documents.

    At most ``fit_rows`` of them are used, those whose id has the least hash.
    Null labels and texts don't count, nor does a label without a document; of
    a document's labels the most toxic counts, and of equal texts. Without both
    kinds of labelled texts nothing is toxic.
    """
    pairs = _pairs(docs, labels, fit_rows)
    spark = docs.sparkSession
    split = spark.sparkContext.broadcast(_split(pairs))
    labelled = pairs.groupBy("h").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    *held, (w, s, drift) = _log_odds(labelled, split)
    if not len(w):
        return Model(w, s, drift, 0.0, 1.0, -math.inf)
    shared = spark.sparkContext.broadcast([Model(*x, 0.0, 1.0, 0.0) for x in held])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            n = np.diff(words(piece.column("text"))[1])
            found: list[list[float]] = [[] for _ in range(piece.num_rows)]
            fold = split.value.fold[split.value.at(piece.column("h"))]
            for k, model in enumerate(shared.value):
                rows = np.flatnonzero(fold == k)
                for r, _, some in _scored(piece.take(pa.array(rows)), model) if len(rows) else ():
                    found[rows[r]] = [x[2] for x in some]
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(n), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    scored = labelled.mapInArrow(released(score), "toxic int, n long, scores array<double>").persist()
    m, ln = F.coalesce(F.array_max("scores"), F.lit(0.0)), F.log(F.greatest("n", F.lit(1)).cast("double"))
    mean, mean_ln, var, cov, var_ln = scored.where("toxic = 0").agg(F.avg(m), F.avg(ln), F.var_pop(m), F.covar_pop(m, ln), F.var_pop(ln)).first()
    # moments of m - scale * ln(n), whose variance is (pi * scale) ** 2 / 6; log-likelihood ratios have a scale of 1 at least
    qa, qb, qc = var_ln - math.pi**2 / 6, -2 * cov, var
    root = max(qb * qb - 4 * qa * qc, 0.0)
    roots = [x for x in ((-qb + math.sqrt(root)) / (2 * qa), (-qb - math.sqrt(root)) / (2 * qa)) if x > 0] if abs(qa) > 1e-9 else []
    scale = max(1.0, min(roots, default=1.0))
    location = mean - scale * mean_ln - _EULER * scale

    def e_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [doc_log_e(x, n, location, scale) if x else math.inf for x, n in zip(batch.column("scores").to_pylist(), batch.column("n").to_pylist())]
            bins = [None if math.isinf(x) else max(-2000, min(2000, math.floor(x * 4))) for x in e]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bins, pa.int32())], ["toxic", "bin"])

    bins = scored.mapInArrow(released(e_values), "toxic int, bin int").groupBy("bin").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("y0")).collect()
    scored.unpersist()
    at = _threshold({r["bin"]: (r["y1"], r["y0"]) for r in bins})
    return Model(w, s, drift, location, scale, math.log(LEVEL) if math.isinf(at) else at)


def _threshold(bins: dict[int | None, tuple[int, int]]) -> float:
    """The log E-value under which toxic and harmless labelled texts are told apart best (by F1); in the middle of a gap."""
    toxic = sum(x[0] for x in bins.values())
    known = sorted(k for k in bins if k is not None)
    best, at, tp, fp = -1.0, -math.inf, 0, 0
    for i, k in enumerate(known):
        tp, fp = tp + bins[k][0], fp + bins[k][1]
        f1 = 2 * tp / (tp + fp + toxic)
        if f1 > best:
            after = known[i + 1] if i + 1 < len(known) else k + 1
            best, at = f1, (k + 1 + after) / 2 / 4
    return at


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage of every toxic document.

    Returns doc_id, passage (from 0), start_word and end_word (exclusive, in
    words from 0), score, log_e (of the passage) and doc_log_e. A document is
    toxic if its log E-value reaches the model's threshold; its passages are
    those that reach it themselves, or else the best one.

    Null and empty texts have no passage; a null ``doc_id`` is reported as
    null; repeated rows are reported each. An empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in pieces(batches, "text"):
            out: list[tuple] = []
            ids = piece.column("doc_id")
            for r, n, found in _scored(piece, m):
                doc = doc_log_e([x[2] for x in found], n, m.location, m.scale)
                if doc > m.log_e:
                    continue
                each = [doc_log_e([x[2]], n, m.location, m.scale) for x in found]
                good = [k for k, e in enumerate(each) if e <= m.log_e] or [min(range(len(each)), key=each.__getitem__)]
                out.extend((ids[r].as_py(), i, *found[k], each[k], doc) for i, k in enumerate(good))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "passage", "start_word", "end_word", "score", "log_e", "doc_log_e"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, passage int, start_word int, end_word int, score double, log_e double, doc_log_e double")


def harmless(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't toxic, all columns as they are; null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in pieces(batches, "text"):
            keep = np.ones(piece.num_rows, np.bool_)
            for r, n, found in _scored(piece, m):
                keep[r] = doc_log_e([x[2] for x in found], n, m.location, m.scale) > m.log_e
            yield piece.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema)
