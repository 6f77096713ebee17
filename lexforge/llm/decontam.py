"""Benchmark decontamination by suffix arrays over the training texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, pieces, released, words

#: A verbatim match of so many words is a leak.
MIN_WORDS = 13
#: A shorter item leaks if the whole of it is found; one of fewer words than this only into a document that has nothing else.
SHORTEST = 5
#: Bytes of text in a suffix array; a longer document has one by itself.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark that are broadcast at once; a larger benchmark takes several passes over the documents.
BENCHMARK_BYTES = 32 << 20


@dataclass(frozen=True)
class Items:
    """Hashed words of all items one after the other; of item k from ``begin[k]`` to ``begin[k + 1]``."""

    ids: np.ndarray
    tokens: np.ndarray
    begin: np.ndarray
    min_words: int

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item number, start and least match of every suffix that is long enough to match."""
        size = np.diff(self.begin)
        need = np.minimum(self.min_words, size)
        many = np.where(size > 0, size - need + 1, 0)
        item = np.repeat(np.arange(len(size)), many)
        at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + self.begin[:-1][item]
        return item, at, need[item]


def suffix_array(ids: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first ``depth`` words at least, and their sorted leading keys of ``width`` words.

    ``ids`` are word numbers from 1, with 0 after each text. Prefix doubling;
    each round sorts only what is still tied.
    """
    n = len(ids)
    width = max(1, 63 // bits)
    padded = np.concatenate((ids, np.zeros(width, ids.dtype))).astype(np.uint64)
    key = padded[:n].copy()
    for k in range(1, width):
        key = (key << U64(bits)) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.concatenate((start, [n]))))
    tied = ~(new & np.concatenate((new[1:], [True])))
    at = np.flatnonzero(tied)
    reached = width
    while reached < depth and len(at):
        s = order[at]
        following = np.minimum(s + reached, n - 1)
        second = np.where(s + reached < n, rank[following] + 1, 0)
        both = (rank[s] << 31) | second
        o = np.argsort(both)
        both, s = both[o], s[o]
        order[at] = s
        new = np.concatenate(([True], both[1:] != both[:-1]))
        group = at[new]
        rank[s] = np.repeat(group, np.diff(np.concatenate((np.flatnonzero(new), [len(at)]))))
        at = at[~(new & np.concatenate((new[1:], [True])))]
        reached *= 2
    return order, key, width


def _bound(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, test: np.ndarray, at: np.ndarray, need: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: where those suffixes begin (or end) that share the first ``need`` words."""
    lo, hi = lo.copy(), hi.copy()
    span = np.arange(int(need.max(initial=0)))
    inside = span[None, :] < need[:, None]
    want = np.where(inside, test[np.minimum(at[:, None] + span, len(test) - 1)], 0)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        place = order[np.minimum(mid, len(order) - 1)][:, None] + span
        have = np.where(inside & (place < len(text)), text[np.minimum(place, len(text) - 1)], 0)
        differ = have != want
        first = differ.argmax(1)
        rows = np.arange(len(lo))
        sign = np.where(differ.any(1), np.sign(have[rows, first] - want[rows, first]), 0)
        right = (sign < 0) | ((sign == 0) & upper)
        lo = np.where(open_ & right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def shard_matches(items: Items, doc_words: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Of each document of the shard and item that leaks into it: document, item, words of the longest match, its start in the item and in the document."""
    lengths = np.concatenate([np.diff(o) for _, o in doc_words])
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    total = int(lengths.sum())
    item, at, need = items.suffixes()
    if not total or not len(item):
        return none
    known, inverse = np.unique(np.concatenate([h for h, _ in doc_words]), return_inverse=True)
    place = np.arange(total) + np.repeat(np.arange(len(lengths)), lengths)
    text = np.zeros(total + len(lengths), np.int64)
    text[place] = inverse + 1
    doc_of = np.repeat(np.arange(len(lengths)), lengths + 1)
    doc_start = np.cumsum(lengths + 1) - lengths - 1
    bits = int(len(known) + 2).bit_length()
    order, key, width = suffix_array(text, bits, int(np.diff(items.begin).max()))

    spot = np.minimum(np.searchsorted(known, items.tokens), len(known) - 1)
    test = np.where(known[spot] == items.tokens, spot + 1, len(known) + 1)  # a word that isn't there is greater than all
    head = np.minimum(width, need)
    first = np.zeros(len(at), np.uint64)
    last = np.zeros(len(at), np.uint64)
    for k in range(width):
        here = np.where(k < head, test[np.minimum(at + k, len(test) - 1)], 0).astype(np.uint64)
        first = (first << U64(bits)) | here
        last = (last << U64(bits)) | np.where(k < head, here, U64((1 << bits) - 1))
    lo, hi = np.searchsorted(key, first, "left"), np.searchsorted(key, last, "right")
    some = np.flatnonzero(lo < hi)
    item, at, need, lo, hi = (x[some] for x in (item, at, need, lo, hi))
    left = _bound(text, order, lo, hi, test, at, need, False)
    right = _bound(text, order, left, hi, test, at, need, True)
    many = right - left
    which = np.repeat(np.arange(len(many)), many)
    if not len(which):
        return none
    found = order[np.repeat(left, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
    # how far each match goes on
    item, at, size = item[which], at[which], need[which].copy()
    room = items.begin[item + 1] - at
    live = np.arange(len(size))
    while len(live):
        live = live[size[live] < room[live]]
        x = found[live] + size[live]
        live = live[(x < len(text)) & (text[np.minimum(x, len(text) - 1)] == test[np.minimum(at[live] + size[live], len(test) - 1)])]
        size[live] += 1
    doc, start = doc_of[found], at - items.begin[item]
    words_of = items.begin[item + 1] - items.begin[item]
    ok = (words_of >= min(SHORTEST, items.min_words)) | (lengths[doc] == words_of)
    doc, item, size, start, found = (x[ok] for x in (doc, item, size, start, found))
    if not len(doc):
        return none
    spot = found - doc_start[doc]
    o = np.lexsort((spot, start, -size, item, doc))
    doc, item, size, start, spot = (x[o] for x in (doc, item, size, start, spot))
    best = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    return tuple(x[best] for x in (doc, item, size, start, spot))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in pieces(batches, "text"):
        held.append(piece)
        size += piece.column("text").nbytes
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parts(benchmark: DataFrame, min_words: int) -> Iterator[Items]:
    """The benchmark in as many parts as its checked size asks for."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / BENCHMARK_BYTES))
    for k in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).distinct().orderBy("item_id", "text").toArrow()
        tokens, begin = words(part.column("text").combine_chunks()) if part.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        yield Items(np.array(part.column("item_id").to_pylist(), object), tokens, begin, min_words)


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Longest verbatim match of every benchmark item and every document that it leaks into.

    Returns doc_id, item_id, match_words, item_word and doc_word (where the
    match begins in either, in words from 0). Words are as in :mod:`._text`,
    so case and punctuation don't matter. Of equally long matches the first in
    the item, then in the document, is given.

    An item leaks through ``min_words`` words in a row, or as a whole if it is
    shorter; one of fewer than ``SHORTEST`` words, which would be found by
    chance, only into documents that have no other words. Empty and null texts
    leak nowhere. A null id is reported as null; repeated rows are reported each;
    items that repeat an id and text count once. Empty tables give an empty
    result; other columns are ignored.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _parts(benchmark, min_words):
        part = columns.mapInArrow(released(_report(docs.sparkSession.sparkContext.broadcast(items))), "doc_id long, item_id long, match_words int, item_word int, doc_word int")
        out = part if out is None else out.unionByName(part)
    return out


def _report(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for shard in _shards(batches):
            doc, item, size, start, spot = shard_matches(items, [words(p.column("text")) for p in shard])
            if len(doc):
                ids = pa.concat_arrays([p.column("doc_id") for p in shard]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(items.ids[item].tolist(), pa.int64()), *(pa.array(x, pa.int32()) for x in (size, start, spot))], ["doc_id", "item_id", "match_words", "item_word", "doc_word"])

    return run


def _clean(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            keep = np.ones(sum(p.num_rows for p in shard), np.bool_)
            keep[shard_matches(shared.value, [words(p.column("text")) for p in shard])[0]] = False
            at = 0
            for p in shard:
                yield p.filter(pa.array(keep[at : at + p.num_rows]))
                at += p.num_rows

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents into which no item leaks, all columns as they are; see :func:`leaks`."""
    for items in _parts(benchmark, min_words):
        docs = docs.mapInArrow(released(_clean(docs.sparkSession.sparkContext.broadcast(items))), docs.schema)
    return docs


def leak_sql(min_words: int = MIN_WORDS) -> str:
    words_of = r"regexp_extract_all(lower(text), '[^\x00-/:-@\[-^`{-\x7f]+')"
    return f"""
WITH item AS (SELECT item_id, w, least({min_words}, len(w)) AS m FROM (SELECT item_id, {words_of} AS w FROM benchmark) WHERE len(w) > 0),
item_gram AS (SELECT item_id, m, unnest(range(len(w) - m + 1)) AS i, w FROM item),
item_key AS (SELECT item_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS k FROM item_gram),
doc AS (SELECT doc_id, {words_of} AS w FROM documents),
doc_gram AS (SELECT doc_id, m, w, unnest(range(len(w) - m + 1)) AS d FROM doc, (SELECT DISTINCT m FROM item) WHERE len(w) = m OR len(w) > m AND m >= {min(SHORTEST, min_words)}),
doc_key AS (SELECT doc_id, m, d, array_to_string(w[d + 1:d + m], ' ') AS k FROM doc_gram),
hit AS (SELECT doc_id, item_id, m, i, d FROM doc_key JOIN item_key USING (m, k)),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d - i ORDER BY i) AS g FROM hit),
run AS (SELECT doc_id, item_id, count(*) + min(m) - 1 AS n, min(i) AS i, min(d) AS d FROM island GROUP BY doc_id, item_id, d - i, g),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, i, d) AS r FROM run)
SELECT doc_id, item_id, n::INTEGER AS match_words, i::INTEGER AS item_word, d::INTEGER AS doc_word FROM best WHERE r = 1"""
