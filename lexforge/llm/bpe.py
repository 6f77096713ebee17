"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct pre-tokens of a chunk of texts lie in one flat array of symbols.
In each round every unfinished word merges its leftmost pair of lowest rank;
only the pairs beside a merge are looked up anew, by binary search over the
sorted pair keys. Ids are those of the rank file, as of any encoder that
merges lowest ranks first.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, flat, hashes, pieces, released

#: Where the rank file is by default.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are encoded together.
CHUNK = 2 << 20
#: Words that a task keeps with their ids, so as to merge them once.
CACHE = 1 << 19
#: Longer words (in bytes) merge one by one along a heap.
LONG = 256
_NONE = np.int64(1) << np.int64(40)

_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(_SPACES)] = SPACE
        _classes.append(table)
    return _classes[0]


@dataclass
class Vocabulary:
    """Ranked tokens as arrays: bytes, sorted hashes of whole tokens, sorted pair keys with their ranks."""

    data: np.ndarray
    begin: np.ndarray
    whole: np.ndarray
    whole_id: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    byte_id: np.ndarray
    cache: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranked = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        size = max(ranked.values()) + 1
        tokens = [b""] * size
        for t, r in ranked.items():
            tokens[r] = t
        begin = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ids = np.array(sorted(ranked.values()))
        whole = hashes(data, begin[ids], begin[ids + 1])
        order = np.argsort(whole)
        pairs = {}
        for t, r in ranked.items():
            for k in range(1, len(t)):
                a, b = ranked.get(t[:k]), ranked.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        key = np.array(sorted(pairs), np.int64)
        return cls(data, begin, whole[order], ids[order], key, np.array([pairs[k] for k in key.tolist()], np.int64), np.array([ranked[bytes([b])] for b in range(256)], np.int64))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[spot] == key, self.ranks[spot], _NONE)


def merge(v: Vocabulary, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges words, given as their symbols one after the other and their sizes; ids one after the other and their numbers."""
    words = len(size)
    out_ids: list[np.ndarray] = []
    out_word: list[np.ndarray] = []
    name = np.arange(words)  # of each unfinished word
    word = np.repeat(np.arange(words), size)
    rank = np.full(len(symbols), _NONE)
    inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
    rank[inner] = v.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, begin)
        width = np.diff(np.concatenate((begin, [len(symbols)])))
        done = least == _NONE
        if done.any():
            over = np.repeat(done, width)
            out_ids.append(symbols[over])
            out_word.append(name[word[over]])
            symbols, rank = symbols[~over], rank[~over]
            width, least, name = width[~done], least[~done], name[~done]
            if not len(symbols):
                break
            word = np.repeat(np.arange(len(width)), width)
        hit = np.flatnonzero(rank == np.repeat(least, width))
        at = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]  # the leftmost of each word
        symbols[at] = least
        keep = np.ones(len(symbols), np.bool_)
        keep[at + 1] = False
        symbols, rank, word = symbols[keep], rank[keep], word[keep]
        at = at - np.arange(len(at))
        for k in (at - 1, at):
            ok = (k >= 0) & (k + 1 < len(word))
            ok[ok] = word[k[ok]] == word[k[ok] + 1]
            rank[k[ok]] = v.rank(symbols[k[ok]], symbols[k[ok] + 1])
            last = (k == at) & ~ok
            rank[k[last]] = _NONE
    if not out_ids:
        return np.zeros(0, np.int64), np.zeros(words, np.int64)
    ids, owner = np.concatenate(out_ids), np.concatenate(out_word)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=words)


def merge_long(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The same of one long word, along a heap of its pairs."""
    s = symbols.tolist()
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    found = v.rank(symbols[:-1], symbols[1:]).tolist()
    heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(found) if r != _NONE]
    heapq.heapify(heap)
    index = v.cache.setdefault("pairs", dict(zip(v.pairs.tolist(), v.ranks.tolist())))
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or s[i] != a or s[j] != b:
            continue
        s[i], alive[j] = r, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (x := index.get(r << 32 | s[after[j]])) is not None:
                heapq.heappush(heap, (x, i, r, s[after[j]]))
        if before[i] >= 0 and (x := index.get(s[before[i]] << 32 | r)) is not None:
            heapq.heappush(heap, (x, before[i], s[before[i]], r))
    return np.array([x for x, a in zip(s, alive) if a], np.int64)


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens begin, in bytes: contractions, runs of letters, of numbers or of other signs with one blank before them, and white space.

    A byte that is no UTF-8 is a sign of its own.
    """
    if len(offsets) > 2 and ((raw[offsets[:-1][offsets[:-1] < len(raw)]] & 0xC0) == 0x80).any():
        # a row begins within a character, so it can't be told from the end of the one before it
        return np.concatenate([a + pretokens(raw[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    point = np.frombuffer(raw.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(point):
        return np.zeros(0, np.int64)
    kind = classes()[point]
    wrong = (point >= 0xDC80) & (point <= 0xDCFF)
    place = np.cumsum(np.where(wrong, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)), dtype=np.int64)
    place = np.concatenate(([0], place))  # bytes before each code point
    row = np.zeros(len(point) + 1, np.bool_)
    row[np.searchsorted(place, offsets)] = True  # a row begins, or the last has ended
    fresh = np.concatenate(([True], kind[1:] != kind[:-1])) | row[:-1]
    solid = kind != SPACE
    last = np.zeros(len(point), np.bool_)  # white space right before something else of its row
    last[:-1] = ~solid[:-1] & solid[1:] & ~row[1:-1]
    blank = last & (point == 0x20)
    joined = np.zeros(len(point), np.bool_)
    joined[1:] = blank[:-1]
    start = (fresh & ~joined) | last
    quote = np.flatnonzero((point == 0x27) & start)
    if len(quote):
        padded = np.concatenate((point, np.zeros(3, np.uint32)))
        edge = np.concatenate((row, np.ones(3, np.bool_)))
        one, two = padded[quote + 1], padded[quote + 2]
        first = ~edge[quote + 1]
        single = first & np.isin(one, [ord(c) for c in "stmd"])
        double = first & ~edge[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[single | double] + 1] = False
        for some, width in ((single, 2), (double, 3)):
            after = quote[some] + width
            start[after[after < len(point)]] = True
    return place[:-1][start]


def encode_column(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, their n + 1 offsets, and the column's bytes and offsets."""
    raw, offsets = flat(column)
    begin = pretokens(raw, offsets)
    end = np.concatenate((begin[1:], [len(raw)])).astype(np.int64)
    h = hashes(raw, begin, end)
    known, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    ids, count = _words(v, raw, begin[first], end[first], known)
    at = np.cumsum(count) - count
    many = count[inverse]
    where = np.cumsum(many)
    tokens = ids[np.repeat(at[inverse] - (where - many), many) + np.arange(where[-1] if len(where) else 0)]
    of_row = np.searchsorted(begin, offsets)
    return tokens, np.concatenate(([0], where))[of_row], raw, offsets


def _words(v: Vocabulary, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of distinct words; ``known`` are their sorted hashes."""
    n = len(known)
    count = np.zeros(n, np.int64)
    source = np.zeros(n, np.int64)  # where a word's ids begin in the parts below
    spot = np.minimum(np.searchsorted(v.whole, known), len(v.whole) - 1)
    is_whole = v.whole[spot] == known
    is_whole &= v.begin[v.whole_id[spot] + 1] - v.begin[v.whole_id[spot]] == end - begin
    parts = [v.whole_id]
    count[is_whole], source[is_whole] = 1, spot[is_whole]
    filled = len(v.whole_id)
    left = np.flatnonzero(~is_whole)
    cached = v.cache.get("words")
    if cached is not None and len(left):
        keys, at, many, ids = cached
        spot = np.minimum(np.searchsorted(keys, known[left]), len(keys) - 1)
        got = keys[spot] == known[left]
        count[left[got]], source[left[got]] = many[spot[got]], at[spot[got]] + filled
        parts.append(ids)
        filled += len(ids)
        left = left[~got]
    size = end[left] - begin[left]
    for k in left[size > LONG].tolist():
        ids = merge_long(v, v.byte_id[raw[begin[k] : end[k]]])
        parts.append(ids)
        count[k], source[k], filled = len(ids), filled, filled + len(ids)
    left, size = left[size <= LONG], size[size <= LONG]
    if len(left):
        where = np.repeat(begin[left] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids, many = merge(v, v.byte_id[raw[where]], size)
        parts.append(ids)
        count[left], source[left] = many, filled + np.cumsum(many) - many
        if cached is None or len(cached[0]) < CACHE:
            keys, at = known[left], np.cumsum(many) - many
            if cached is not None:
                keys, at, many, ids = (np.concatenate(x) for x in ((cached[0], keys), (cached[1], at + len(cached[3])), (cached[2], many), (cached[3], ids)))
            order = np.argsort(keys)
            v.cache["words"] = (keys[order], at[order], many[order], ids)
    flat_ids = np.concatenate(parts)
    where = np.repeat(source - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return flat_ids[where], count


def decode_flat(v: Vocabulary, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of tokens one after the other, and how many each has."""
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(v.begin) - 1):
        raise ValueError("a token id outside of the vocabulary")
    size = v.begin[tokens + 1] - v.begin[tokens]
    where = np.repeat(v.begin[tokens] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return v.data[where], size


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Token ids of every document.

    Returns doc_id, tokens (array of int), n_tokens, n_bytes (of the text in
    UTF-8) and exact: whether the decoded ids are the text, byte for byte.

    Bytes that are no UTF-8 are encoded like any others, so ``exact`` holds for
    them, too. An empty text has no tokens; a null text has null tokens, n_tokens, n_bytes
    and exact; a null ``doc_id`` is kept; repeated rows are encoded each; texts
    are encoded whole. An empty table gives an empty result; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for piece in pieces(batches, "text", CHUNK):
            tokens, at, raw, offsets = encode_column(v, piece.column("text"))
            back, size = decode_flat(v, tokens)
            total = np.concatenate(([0], np.cumsum(size)))[at]
            exact = np.diff(total) == np.diff(offsets)
            if len(back) == len(raw):
                wrong = np.flatnonzero(back != raw)
                exact[np.searchsorted(offsets, wrong, "right") - 1] = False
            else:
                exact &= np.array([back[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(total, total[1:], offsets, offsets[1:])], np.bool_)
            null = piece.column("text").is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(null, False)), pa.array(tokens, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), lists, pa.array(np.diff(at), pa.int32(), mask=null), pa.array(np.diff(offsets), pa.int64(), mask=null), pa.array(exact, mask=null)], ["doc_id", "tokens", "n_tokens", "n_bytes", "exact"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, tokens array<int>, n_tokens int, n_bytes long, exact boolean")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and text of tokens; null tokens give a null text, none an empty one, bytes that are no UTF-8 are replaced, an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            column = batch.column("tokens")
            at = np.concatenate(([0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            back, size = decode_flat(v, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            total = np.concatenate(([0], np.cumsum(size)))[at]
            texts = [None if null else back[a:b].tobytes().decode("utf-8", "replace") for a, b, null in zip(total, total[1:], column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(released(run), "doc_id long, text string")
