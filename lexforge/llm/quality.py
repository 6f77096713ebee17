"""Quality rules: an isolation forest on rule statistics of documents.

Medians, the trees' draws and the threshold are taken from all labelled
documents: their statistics are stored as a table, on which counts are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import U64, dropped, flat, hashes, lower, pieces, small, spans, stored

#: Trees, and documents that each is grown on: the method isolates few documents at a time, drawn from all of them anew for each tree.
TREES, TREE_ROWS = 200, 256
#: At most this share of the good labelled documents may fall beyond the threshold.
FALSE_POSITIVES = 0.005
#: A statistic of few words is drawn towards its median over good documents, as if so many more words had that.
SHRINK = 20.0

#: Documents are numbered within so many parts, by the hash of their id.
PARTS = 1 << 16

STATISTICS = ("symbols", "upper", "digits", "word_length", "distinct_words", "top_word", "repeated_lines", "ragged_lines", "line_words", "bars", "joined_symbols", "spaces")

_KIND = np.zeros(256, np.uint8)  # 1 symbol, 2 upper, 3 lower, 4 digit, 5 white space
_KIND[33:128] = 1
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[9, 10, 13, 32]] = 2, 3, 4, 5
_PLAIN = np.zeros(256, np.bool_)  # signs of ordinary punctuation
_PLAIN[list(b".,;:!?'\"()-")] = True


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rule statistics of each text (rows by :data:`STATISTICS`), and its number of words."""
    n = len(column)
    raw, offsets = flat(column)
    kind = _KIND[raw]

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1)
    letters = per_row(kind == 2) + per_row(kind == 3)
    odd = (kind == 1) & ~_PLAIN[raw]
    joined = np.zeros(len(raw), np.bool_)
    if len(raw) > 1:
        joined[1:] = odd[1:] & odd[:-1]
        joined[offsets[:-1][np.diff(offsets) > 0]] = False  # the sign before is another text's
    low, low_offsets = flat(lower(column))
    start, end = spans(low, low_offsets)
    row = np.searchsorted(low_offsets, start, "right") - 1
    words = np.bincount(row, minlength=n).astype(float)
    many = np.maximum(words, 1)
    length = np.bincount(row, end - start, minlength=n)
    h = hashes(low, start, end)
    once = np.sort((row.astype(np.uint64) << U64(44)) | (h >> U64(20)))
    first = np.flatnonzero(np.concatenate(([True], once[1:] != once[:-1]))) if len(once) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(once)])))
    of = (once[first] >> U64(44)).astype(np.int64)
    distinct = np.bincount(of, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    # lines
    breaks = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    line_start = line_start[line_start < len(raw)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    stop = np.minimum(np.concatenate((line_start[1:], [len(raw)])), offsets[line_row + 1]) if len(line_start) else line_start
    ended = np.where(raw[np.maximum(stop - 1, 0)] == 10, stop - 1, stop) if len(stop) else stop
    filled = ended > line_start
    line_start, line_row, ended = line_start[filled], line_row[filled], ended[filled]
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    lh = np.sort((line_row.astype(np.uint64) << U64(44)) | (hashes(raw, line_start, ended) >> U64(20)))
    lines_once = np.bincount((lh[np.concatenate(([True], lh[1:] != lh[:-1]))] >> U64(44)).astype(np.int64), minlength=n) if len(lh) else np.zeros(n)
    last = raw[np.maximum(ended - 1, 0)]
    ragged = np.bincount(line_row, ~np.isin(last, list(b".!?:;\"')")), minlength=n)
    out = np.stack(
        (
            per_row(odd) / size,
            per_row(kind == 2) / np.maximum(letters, 1),
            per_row(kind == 4) / size,
            length / many,
            np.log1p(distinct) / np.log1p(many),
            top / many,
            1 - np.maximum(lines_once, 1) / lines,
            ragged / lines,
            np.log1p(words / lines),
            per_row((raw == 124) | (raw == 9)) / size,
            per_row(joined) / many,
            per_row(kind == 5) / size,
        ),
        1,
    )
    return out, words


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (statistic, split, left, right or, in a leaf, its path length); what short texts are drawn to; the greatest score of a good document."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    centre: np.ndarray
    rows: int
    threshold: float

    def shrunk(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (x * words[:, None] + self.centre * SHRINK) / (words[:, None] + SHRINK)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: two to the power of minus the mean path length over that of random data."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for k in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[k][at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] < self.split[k][at], self.left[k][at], self.right[k][at]), at)
            total += self.path[k][at]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(_expected(self.rows), 1e-9))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _draws(n: int, trees: int, size: int, seed: int) -> list[np.ndarray]:
    """For each tree, which of n rows it is grown on: each with equal chance, none twice."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [rng.choice(n, min(size, n), replace=False) for _ in range(trees)]


def grow(x: np.ndarray, trees: int, size: int, seed: int) -> Forest:
    """Isolation trees on random samples of x; a split is drawn evenly between the least and greatest value."""
    return _grown([x[rows] for rows in _draws(len(x), trees, size, seed)], seed)


def _grown(samples: list[np.ndarray], seed: int) -> Forest:
    """A tree on each of the samples, which have the same number of rows."""
    rng = np.random.Generator(np.random.PCG64([seed, 1]))
    trees, (size, columns) = len(samples), samples[0].shape
    limit = math.ceil(math.log2(max(size, 2)))
    width = 2 ** (limit + 1)
    feature = np.full((trees, width), -1, np.int16)
    split, path = np.zeros((trees, width)), np.zeros((trees, width))
    left, right = np.zeros((trees, width), np.int32), np.zeros((trees, width), np.int32)
    for k, x in enumerate(samples):
        free, todo = 1, [(0, np.arange(size), 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            able = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(able):
                path[k, at] = depth + _expected(len(rows))
                continue
            f = int(rng.choice(able))
            cut = rng.uniform(low[f], high[f])
            cut = cut if cut > low[f] else high[f]
            feature[k, at], split[k, at], left[k, at], right[k, at] = f, cut, free, free + 1
            side = x[rows, f] < cut
            todo += [(free, rows[side], depth + 1), (free + 1, rows[~side], depth + 1)]
            free += 2
    return Forest(feature, split, left, right, path, np.zeros(columns), size, 1.0)


def _measured(df: DataFrame, names: list[str], kinds: str) -> DataFrame:
    """The columns ``names`` with the words and statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x, words = statistics(piece.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), x.ravel())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(words.astype(np.int64)), lists], [*names, "words", "x"])

    return df.mapInArrow(run, f"{kinds}, words long, x array<double>")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(STATISTICS))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, words and statistics of every labelled text; many labels meet the statistics, so no text is shuffled."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(F.col("quality").cast("int")) > 0).alias("good"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    if small(labels, 24):
        return _measured(texts.join(F.broadcast(labels), "doc_id"), ["doc_id", "good"], "doc_id long, good boolean")
    return _measured(texts, ["doc_id"], "doc_id long").join(labels, "doc_id").select("doc_id", "good", "words", "x")


def _medians(rows: DataFrame, n: int) -> np.ndarray:
    """Exact medians of the statistics of n rows.

    A value's bits, in an order that is that of the values, are four digits.
    Counts of the first digit tell that of the median, counts of the next among
    the values that begin with it tell the next, and so on.
    """
    ranks = np.repeat([[(n - 1) // 2, n // 2]], len(STATISTICS), 0)
    known = np.zeros(ranks.shape, np.uint64)
    for shift in (48, 32, 16, 0):

        def count(batches: Iterator[pa.RecordBatch], known=known, shift=shift) -> Iterator[pa.RecordBatch]:
            total = np.zeros((known.size, 1 << 16), np.int64)
            for batch in batches:
                bits = _matrix(batch.column("x")).view(np.uint64)
                bits = np.where(bits >> U64(63), ~bits, bits | U64(1 << 63))
                for t, prefix in enumerate(known.ravel()):
                    of = bits[:, t // 2]
                    if shift < 48:
                        of = of[of >> U64(shift + 16) == prefix]
                    total[t] += np.bincount((of >> U64(shift)).astype(np.int64) & 0xFFFF, minlength=1 << 16)
            t, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[t, digit])], ["t", "digit", "n"])

        table = rows.select("x").mapInArrow(count, "t int, digit int, n long").groupBy("t", "digit").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((known.size, 1 << 16), np.int64)
        total[table.column("t").to_numpy(), table.column("digit").to_numpy()] = table.column("n").to_numpy()
        upto = np.cumsum(total, 1)
        digit = (upto <= ranks.reshape(-1, 1)).sum(1)
        ranks = ranks - np.where(digit > 0, upto[np.arange(known.size), digit - 1], 0).reshape(ranks.shape)
        known = (known << U64(16)) | digit.astype(np.uint64).reshape(known.shape)
    return np.where(known >> U64(63), known & U64((1 << 63) - 1), ~known).view(np.float64).mean(1)


def _drawn(good: DataFrame, trees: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Statistics and words of the rows that the trees draw from all rows of ``good``, and each tree's rows among them.

    Rows are numbered by part and, within it, by what they hold, so the draws
    don't depend on how the table is split up.
    """
    good = good.withColumn("part", F.xxhash64("doc_id").bitwiseAND(F.lit(PARTS - 1)))
    counts = good.groupBy("part").count().orderBy("part").toArrow()
    part, count = counts.column("part").to_numpy(), counts.column("count").to_numpy()
    ends = np.cumsum(count)
    draws = _draws(int(ends[-1]), trees, size, seed)
    number = np.unique(np.concatenate(draws))
    at = np.searchsorted(ends, number, "right")
    wanted = good.sparkSession.createDataFrame(pa.table({"number": number, "part": part[at], "place": (number - (ends - count)[at] + 1).astype(np.int32)}))
    placed = good.select("part", "words", "x", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "words", "x")).alias("place"))
    # trees * size rows at most
    got = placed.join(F.broadcast(wanted), ["part", "place"]).select("number", "words", "x").toArrow().combine_chunks()
    order = np.argsort(got.column("number").to_numpy())
    x, words = _matrix(got.column("x").combine_chunks())[order], got.column("words").to_numpy()[order]
    return x, words, [np.searchsorted(number, rows) for rows in draws]


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17) -> Forest:
    """Grows the forest on good labelled documents and sets its threshold on good and bad ones.

    All labelled documents are used. What short texts are drawn to are the
    medians over the good ones that are as long as half of them or longer. Each
    tree draws ``TREE_ROWS`` of all good ones. The threshold is the score that
    parts good and bad best (greatest true less false positive rate) among
    those that at most ``FALSE_POSITIVES`` of the good ones exceed. Null
    labels, ids and texts don't count; of a document's labels the worst counts;
    repeated rows count each. Without good labelled documents, nothing is an
    anomaly.
    """
    rows = stored(_labelled(docs, labels))
    good = rows.where("good")
    lengths = good.groupBy("words").count().orderBy(F.desc("words")).toArrow()  # few: n lengths take n * n / 2 words
    longer = np.cumsum(lengths.column("count").to_numpy())
    if not len(longer):
        dropped(rows)
        empty = grow(np.zeros((1, len(STATISTICS))), 1, 1, seed)
        return Forest(empty.feature, empty.split, empty.left, empty.right, empty.path, empty.centre, 1, math.inf)
    half = int(np.searchsorted(longer, max(1, longer[-1] // 2)))
    centre = _medians(good.where(F.col("words") >= int(lengths.column("words")[half].as_py())), int(longer[half]))
    x, words, draws = _drawn(good, TREES, TREE_ROWS, seed)
    x = (x * words[:, None] + centre * SHRINK) / (words[:, None] + SHRINK)
    forest = replace(_grown([x[k] for k in draws], seed), centre=centre)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(shared.value.shrunk(_matrix(batch.column("x")), batch.column("words").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(scores)], ["good", "score"])

    scored = stored(rows.select("good", "words", "x").mapInArrow(score, "good boolean, score double"))
    dropped(rows)
    threshold = _threshold(scored, int(longer[-1]))
    dropped(scored)
    return replace(forest, threshold=threshold)


def _threshold(scored: DataFrame, n: int) -> float:
    """The threshold of :func:`fit` by all scores, n of them good.

    The greatest good scores, one more than may exceed it, cut all scores into
    steps. In a step the bad ones only add up, so its best cut lies below its
    least bad score and above the good score that ends it.
    """
    few = int(FALSE_POSITIVES * n) + 1
    while few / n > FALSE_POSITIVES:
        few -= 1
    top = np.sort(scored.where("good").orderBy(F.desc("score")).limit(few + 1).toArrow().column("score").to_numpy())
    ends, before = np.unique(top, return_index=True)
    ends, before = ends[::-1], len(top) - np.concatenate((before[1:], [len(top)]))[::-1]  # and how many are greater than each

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least = np.zeros(len(ends), np.int64), np.full(len(ends), math.inf)
        for batch in batches:
            scores = batch.column("score").to_numpy()
            scores = scores[scores > ends[-1]]
            step = np.searchsorted(-ends, -scores, "right")  # a good score belongs to the step it begins
            np.add.at(n, step, 1)
            np.minimum.at(least, step, scores)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(least[some])], ["step", "n", "least"])

    bad = scored.where("not good")
    total = bad.count()
    table = bad.select("score").mapInArrow(steps, "step long, n long, least double").groupBy("step").agg(F.sum("n").alias("n"), F.min("least").alias("least")).orderBy("step").toArrow()
    step, least = table.column("step").to_numpy(), table.column("least").to_numpy()
    gain = np.cumsum(table.column("n").to_numpy()) / max(1, total) - before[step] / n
    if not (gain > 0).any():
        return math.inf
    best = int(np.argmax(gain))
    return float((least[best] + ends[step[best]]) / 2)


def kept(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents that are no anomalies: doc_id, score and words.

    Null texts and texts without a word are no documents and aren't kept; a
    null ``doc_id`` is; repeated rows are scored each. An empty table gives an
    empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x, words = statistics(piece.column("text"))
            scores = shared.value.scores(shared.value.shrunk(x, words))
            good = pa.array((scores <= shared.value.threshold) & (words > 0))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores), pa.array(words.astype(np.int32))], ["doc_id", "score", "words"]).filter(good)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "doc_id long, score double, words int")
