"""Exact set-similarity self-join of the lines, or of the n-gram sets, of a corpus.

Elements are put into one global order, rare ones first. Two sets whose
Jaccard similarity reaches the threshold share an element of both prefixes, so
only prefixes are shuffled, by element; length, position, bitmap and suffix
filters thin out the pairs, and each pair left is verified once on its whole
sets.

The order need only be the same everywhere to be exact. It takes the frequency
of an element from a table of ``2**BUCKETS`` hashed counters over the whole
corpus, whose size doesn't grow with the vocabulary, and breaks ties by hash.
Elements are 45-bit hashes; equal sets are recognised by 128 bits and take part
once, so a passage copied a million times is one set here.

Near copies in a group of k have k * k / 2 pairs, each of which many elements
would find. Where an element's sets are mostly similar, only a star is sent on,
from one of them, the leader, to each: k rows. Sets of one leader meet in a
cell, where all their pairs are looked at; two sets that have several leaders
in common are counted with the least of them. So no pair is ever a row of a
shuffle between near copies, and none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BROADCAST_BYTES, U64, dropped, flat, hashes, lower, mix, partitions, pieces, released, spans, stored

BUCKETS = 24
SLICES = 64
HASH_BITS = 45
TOKEN_BITS = 51
MAX_SETS = 1 << (64 - TOKEN_BITS)
_TOKEN = U64((1 << TOKEN_BITS) - 1)
_HASH = U64((1 << HASH_BITS) - 1)
EPS = 1e-9

#: Packed prefixes of a task are sent on when they reach so many entries; a partition of them has about PART.
FLUSH, PART = 1 << 20, 1 << 21
#: Elements that occur so often by their counter have their sets spread over a grid of partitions.
HOT = 1 << 22
#: Elements that the prefixes of two documents must share, where both are long enough.
SHARED = 8
#: Bits of the bitmap of a large line.
MAX_BITS = 4096
#: Pairs that are looked at together within a partition; a quarter of them where each has many numbers.
PAIRS = 1 << 20
#: An element with fewer sets always gives pairs, not a star.
STAR = 16
#: Bytes of the sets of a cell; a group with more has as many cells as it needs, in a grid over both sides.
CELL_BYTES = 8 << 20
#: Cells of up to so many sets are verified together, larger ones each by itself.
SMALL_CELL = 24
_SIDE = 30


@dataclass(frozen=True)
class Spec:
    """Sets are the distinct words of a line (``lines``), or of a document its distinct n-grams of ``n`` words."""

    lines: bool
    n: int
    threshold: float
    hot: int = HOT
    star: int = STAR
    small_cell: int = SMALL_CELL
    flush: int = FLUSH
    pairs: int = PAIRS

    @property
    def least(self) -> int:
        """A smaller set can't reach the threshold with any set but its equal."""
        return max(1, math.ceil(self.threshold / (1 - self.threshold) - EPS)) if self.threshold < 1 else 1 << 62

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size - np.ceil(self.threshold * size - EPS).astype(np.int64) + 1

    def shared(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
        """How many elements that are followed by so many that ``need`` can still be reached two similar sets share at least, up to ``SHARED``."""
        return np.clip(need - np.ceil(self.threshold * np.maximum(a, b) - EPS) + 1, 1, 1 if self.lines else SHARED)

    def need(self, both: np.ndarray) -> np.ndarray:
        """Elements that two sets of so many in all must have in common."""
        return np.ceil(self.threshold / (1 + self.threshold) * both - EPS)


def elements(piece: pa.RecordBatch, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each element, and the set it is in (ascending); row and line number of each set."""
    raw, offsets = flat(lower(piece.column("text")))
    starts, ends = spans(raw, offsets)
    h = hashes(raw, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    if spec.lines:
        breaks = np.flatnonzero(raw == 10)
        before = np.searchsorted(breaks, offsets)  # line ends before each row's start
        lines = np.diff(before) + 1
        first = np.cumsum(lines) - lines
        at = first[row] + np.searchsorted(breaks, starts) - before[row]
        of = np.repeat(np.arange(len(lines)), lines)
        return h >> U64(64 - HASH_BITS), at, of, np.arange(len(of)) - first[of]
    begin = np.searchsorted(row, np.arange(piece.num_rows))
    count = np.bincount(row, minlength=piece.num_rows)
    acc, out, out_row = h.copy(), [], []
    for k in range(1, spec.n):
        short = begin[np.flatnonzero(count == k)]  # a text of fewer words than n is one element
        out.append(acc[short])
        out_row.append(row[short])
        acc[:-k] = mix(acc[:-k] * U64(0xD6E8FEB86659FD93) + h[k:])
    if len(h) >= spec.n:
        places = np.flatnonzero(row[: len(row) - spec.n + 1] == row[spec.n - 1 :])
        out.append(acc[places])
        out_row.append(row[places])
    at = np.concatenate([*out_row, np.zeros(0, np.int64)])
    every = np.concatenate([*out, np.zeros(0, np.uint64)])
    order = np.argsort(at, kind="stable")
    n = np.arange(piece.num_rows)
    return every[order] >> U64(64 - HASH_BITS), at[order], n, np.zeros(len(n), np.int64)


@dataclass(frozen=True)
class Sets:
    """Tokens in order, where each set begins and how many it has; its row, line and two signatures."""

    token: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    row: np.ndarray
    line: np.ndarray
    sig: np.ndarray
    sig2: np.ndarray


def sets(found: tuple[np.ndarray, ...], classes: np.ndarray | None) -> Iterator[Sets]:
    """For some of the sets of :func:`elements` at a time, those that aren't empty; a token is its hash below its class of rarity."""
    every, at, row, line = found
    if classes is not None:
        every = every | (classes[(every >> U64(HASH_BITS - BUCKETS)).astype(np.int64)].astype(np.uint64) << U64(HASH_BITS))
    for low in range(0, len(row), MAX_SETS):
        i, j = np.searchsorted(at, [low, low + MAX_SETS])
        if i == j:
            continue
        both = np.sort(((at[i:j] - low).astype(np.uint64) << U64(TOKEN_BITS)) | every[i:j])
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        which = (both >> U64(TOKEN_BITS)).astype(np.int64)
        token = both & _TOKEN
        begin = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        size = np.diff(np.concatenate((begin, [len(which)])))
        kept = which[begin] + low
        plain = token & _HASH
        one = mix(np.add.reduceat(mix(plain), begin) + size.astype(np.uint64))
        two = mix(np.add.reduceat(mix(plain ^ U64(0x5851F42D4C957F2D)), begin) ^ size.astype(np.uint64))
        yield Sets(token, begin, size, row[kept], line[kept], one.view(np.int64), two.view(np.int64))


def scanned(docs: DataFrame, spec: Spec) -> DataFrame:
    """Columns sig, sig2, doc_id, line, size of every set that isn't empty; and, in rows with a slice, that slice of a task's counters."""
    width = (1 << BUCKETS) // SLICES
    schema = "sig long, sig2 long, doc_id long, line int, size int, slice int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.uint32)  # a task has far fewer than 2**32 words
        for piece in pieces(batches, "text"):
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            found = elements(piece, spec)
            np.add.at(total, (found[0] >> U64(HASH_BITS - BUCKETS)).astype(np.int64), np.uint32(1))
            for s in sets(found, None):
                n = len(s.sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.sig), pa.array(s.sig2), pa.array(ids[s.row]), pa.array(s.line.astype(np.int32)), pa.array(s.size.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["sig", "sig2", "doc_id", "line", "size", "slice", "data"]
                )
        for k in range(SLICES):  # a batch each: packed all at once they'd be copied together
            part = total[k * width : (k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.nulls(1, pa.int32()) for _ in range(2)), pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], ["sig", "sig2", "doc_id", "line", "size", "slice", "data"]
                )

    return docs.mapInArrow(released(run), schema)


_CODEC = pa.Codec("zstd", 1)


def _packed(x: np.ndarray) -> bytes:
    return _CODEC.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), asbytes=True)


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    raw = np.frombuffer(_CODEC.decompress(data, 4 * n), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view(np.uint32).ravel()


def rarity(scan: DataFrame) -> tuple[np.ndarray, int]:
    """Logarithmic frequency class of each hashed counter, counted over all documents, and the elements in all; always ``2**BUCKETS`` bytes."""
    width = (1 << BUCKETS) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data")):
                totals.setdefault(k, np.zeros(width, np.int64))[:] += _unpacked(data.as_buffer(), width)
        data = [np.minimum(2 * np.log2(np.maximum(v, 1)), 63).astype(np.uint8).tobytes() for v in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(data, pa.binary()), pa.array([int(v.sum()) for v in totals.values()], pa.int64())], ["slice", "data", "total"])

    table = np.zeros(1 << BUCKETS, np.uint8)
    every = 0
    parts = scan.where("slice is not null").select("slice", "data")
    for k, data, total in parts.repartition(min(SLICES, partitions(scan.sparkSession)), "slice").mapInArrow(released(add), "slice int, data binary, total long").collect():
        table[k * width : (k + 1) * width] = np.frombuffer(data, np.uint8)
        every += total
    return table, every


def _width(size: np.ndarray, lines: bool) -> np.ndarray:
    """64-bit words of a set's bitmap: 0.6 to 1.2 bits an element for lines; none for documents, whose n-grams are too rare to need it."""
    if not lines:
        return np.zeros(len(size), np.int64)
    return (1 << np.ceil(np.log2(np.clip(size * 0.6, 64, MAX_BITS))).astype(np.int64)) >> 6


def _bitmaps(s: Sets, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parity of each set's elements in the classes of its bitmap; and the bitmaps' first words (n + 1)."""
    width = _width(s.size, lines)
    first = np.concatenate(([0], np.cumsum(width)))
    out = np.zeros(first[-1], np.uint64)
    if lines:
        word = np.repeat(first[:-1], s.size) + ((s.token >> U64(6)).astype(np.int64) & np.repeat(width - 1, s.size))
        np.bitwise_xor.at(out, word, U64(1) << (s.token & U64(63)))
    return out, first


def _differ(bits: np.ndarray, first: np.ndarray, width: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which two sets' bitmaps differ, the wider one folded onto the other: as many elements differ, at least."""
    out = np.zeros(len(left), np.int64)
    a, b = width[left], width[right]
    for w in np.unique(np.minimum(a, b)).tolist():
        some = np.flatnonzero(np.minimum(a, b) == w)
        for k in range(w):
            sides = []
            for side, wide in ((left[some], a[some]), (right[some], b[some])):
                word = bits[first[side] + k]
                for more in range(w, int(wide.max()), w):
                    has = wide > more
                    word = np.where(has, word ^ bits[np.minimum(first[side] + k + more, len(bits) - 1)], word)
                sides.append(word)
            out[some] += np.bitwise_count(sides[0] ^ sides[1])
    return out


@dataclass(frozen=True)
class Entries:
    """Prefix entries of a partition that share their element with another, by element and size: group, set, position, side, size and bitmap."""

    group: np.ndarray
    sig: np.ndarray
    pos: np.ndarray
    side: np.ndarray
    size: np.ndarray
    first: np.ndarray
    width: np.ndarray
    bits: np.ndarray

    def passing(self, left: np.ndarray, right: np.ndarray, spec: Spec) -> np.ndarray:
        """Which pairs may be similar by length, position and bitmap.

        Of the elements that two similar sets have in common, the k-th from
        the end is followed by k - 1 more in both. So as many as
        :meth:`Spec.shared` says lie before the last ``need``, in both
        prefixes; only those count.
        """
        a, b = self.size[left], self.size[right]
        p, q = self.pos[left], self.pos[right]
        need = spec.need(a + b)
        ok = np.minimum(a - p, b - q) > need - spec.shared(a, b, need)
        ok &= (self.side[left] == 0) | (self.side[left] != self.side[right])
        ok &= self.sig[left] != self.sig[right]
        if spec.lines:
            some = np.flatnonzero(ok)
            ok[some] = _differ(self.bits, self.first, self.width, left[some], right[some]) <= (a + b - 2 * need)[some]
        return ok


def _stars(e: Entries, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are of elements whose sets are mostly similar, judged by some of their pairs; and the leader of each such entry.

    A star costs its sets once in a cell, and the pairs a row each, for many of
    the elements that near copies share.
    """
    n = len(e.group)
    begin = np.flatnonzero(np.concatenate(([True], e.group[1:] != e.group[:-1])))
    many = np.diff(np.concatenate((begin, [n])))
    tried, good = np.zeros(len(begin)), np.zeros(len(begin))
    big = np.repeat(many > spec.star, many)
    for step in (1, 2, 4, 8):
        if step >= n:
            break
        left = np.flatnonzero(big[: n - step] & (e.group[: n - step] == e.group[step:]))
        if not len(left):
            continue
        ok = (e.size[left + step] <= np.floor(e.size[left] / spec.threshold + EPS)) & e.passing(left, left + step, spec)
        tried += np.bincount(e.group[left], minlength=len(begin))
        good += np.bincount(e.group[left], ok, minlength=len(begin))
    mean = np.add.reduceat(e.size, begin) / many
    star = (many > spec.star) & (good * many > 0.075 * mean * tried) & (good > tried / 16)
    inside = np.flatnonzero(np.repeat(star, many))
    # the set of least mixed signature leads, so elements of the same sets have the same leader
    rank = mix(e.sig.view(np.uint64))
    o = np.lexsort((rank[inside], e.group[inside]))
    lead = np.zeros(len(begin), np.int64)
    g = e.group[inside][o]
    top = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, np.bool_)
    lead[g[top]] = e.sig[inside][o][top]
    return inside, lead[e.group[inside]]


def _pairs(e: Entries, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of the same element that pass the filters."""
    n = len(e.group)
    # partners of i come after it in its group, and are at most size / t long
    wide = e.group << 32
    stop = np.searchsorted(wide + e.size, wide + np.floor(e.size / spec.threshold + EPS).astype(np.int64), "right")
    many = np.maximum(stop - np.arange(n) - 1, 0)
    total = np.cumsum(many)
    begin = 0
    while begin < n:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + spec.pairs // 4, "right")))
        left = np.repeat(np.arange(begin, end), many[begin:end])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[begin:end] - many[begin:end] - base, many[begin:end])
        ok = e.passing(left, right, spec)
        yield left[ok], right[ok]
        begin = end


MET = "a long, b long, m int, n int, c int"


def _entries(batches: Iterator[pa.RecordBatch], spec: Spec) -> Entries | None:
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for batch in batches:
        for heads, n, data in zip(batch.column("heads").to_pylist(), batch.column("entries").to_pylist(), batch.column("data")):
            data, at = data.as_buffer(), 0
            for into, (kind, m) in zip(columns, ((np.int64, heads), (np.uint32, heads), (np.uint32, heads), (np.uint32, n), (np.uint32, n))):
                if kind is np.int64:
                    into.append(np.frombuffer(data, kind, m, at).copy())
                else:
                    low, high = np.frombuffer(data, np.uint16, m, at), np.frombuffer(data, np.uint16, m, at + 2 * m)
                    into.append(low | high.astype(np.uint32) << np.uint32(16))
                at += m * np.dtype(kind).itemsize
            columns[5].append(np.frombuffer(data, np.uint64, -1, at) if len(data) > at else np.zeros(0, np.uint64))
    if not columns[0]:
        return None
    sig, size, many, key, pos, bits = (np.concatenate(x) for x in columns)
    del columns
    size = size.astype(np.int64)
    width = _width(size, spec.lines)
    first = np.cumsum(width) - width
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    shared = o[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    head = np.repeat(np.arange(len(sig)), many)[shared]
    key, pos = key[shared], pos[shared].astype(np.int64)
    o = np.lexsort((sig[head], size[head], key))
    key, pos, head = key[o], pos[o], head[o]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[head][1:] != sig[head][:-1]) | (size[head][1:] != size[head][:-1]) | (pos[1:] >> _SIDE != pos[:-1] >> _SIDE))) if len(key) else np.zeros(0, np.bool_)
    key, pos, head = key[fresh], pos[fresh], head[fresh]
    if not len(key):
        return None
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    return Entries(group, sig[head], pos & ((1 << _SIDE) - 1), pos >> _SIDE, size[head], first[head], width[head], bits)


def joined(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`met` of a partition."""
    e = _entries(batches, spec)
    if e is None:
        return
    known, which = np.unique(e.sig, return_inverse=True)
    inside, lead = _stars(e, spec)
    star = np.unique(np.searchsorted(known, lead) << 32 | which[inside]) if len(inside) else np.zeros(0, np.int64)
    for k in range(0, len(star), spec.pairs):
        x = star[k : k + spec.pairs]
        yield _rows(known[x >> 32], known[x & 0xFFFFFFFF], *(np.zeros(len(x), np.int64) for _ in range(3)))
    rest = np.ones(len(e.group), np.bool_)
    rest[inside] = False
    e = Entries(*(x[rest] for x in (e.group, e.sig, e.pos, e.side, e.size, e.first, e.width)), e.bits)
    which = which[rest]
    if not len(which):
        return
    size = np.zeros(len(known), np.int64)
    size[which] = e.size
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def counted() -> tuple[np.ndarray, np.ndarray]:
        key, n = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        o = np.argsort(key)
        key = key[o]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[begin], np.add.reduceat(n[o], begin)

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        a, b = key >> 32, key & 0xFFFFFFFF
        return _rows(known[a], known[b], size[a], size[b], n)

    for left, right in _pairs(e, spec):
        a, b = which[left], which[right]
        found.append((np.minimum(a, b) << 32 | np.maximum(a, b), np.ones(len(a), np.int64)))
        held += len(a)
        if held > 4 * spec.pairs:
            found = [counted()]
            held = len(found[0][0])
            if held > 2 * spec.pairs:
                yield rows(*found.pop())
                held = 0
    if held:
        yield rows(*counted())


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64 if k < 2 else np.int32)) for k, x in enumerate(columns)], ["a", "b", "m", "n", "c"])


class _Seen:
    """Signatures that a task has sent, as a few sorted arrays."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def fresh(self, sig: np.ndarray) -> np.ndarray:
        """Places of the signatures that weren't there, each once."""
        known, first = np.unique(sig, return_index=True)
        new = np.ones(len(known), np.bool_)
        for run in self.runs:
            new &= run[np.minimum(np.searchsorted(run, known), len(run) - 1)] != known
        known, first = known[new], first[new]
        if len(known):
            self.runs.append(known)
            while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
                self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]))]
        return np.sort(first)


def _planes(x: np.ndarray) -> bytes:
    return x.astype(np.uint16).tobytes() + (x >> 16).astype(np.uint16).tobytes()


def emitted(batches: Iterator[pa.RecordBatch], spec: Spec, classes: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Prefixes of the task's distinct sets, packed by partition: for each set its signature, size, number of entries and bitmap, and each entry's key and position."""
    seen = _Seen()
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    hot = math.ceil(2 * math.log2(spec.hot))

    def flush() -> pa.RecordBatch:
        base = np.cumsum([0, *(len(x[3]) for x in held[:-1])])
        token, which, pos = (np.concatenate([x[k] + b if k == 1 else x[k] for x, b in zip(held, base)]) for k in range(3))
        sig, size, bits = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
        width = _width(size, spec.lines)
        first = np.cumsum(width) - width
        mixed = mix(token * U64(0x9E3779B97F4A7C15) + U64(1))
        where = ((mixed >> U64(32)) % U64(parts)).astype(np.int64)
        order = np.argsort(where.astype(np.uint16) if parts < 1 << 16 else where, kind="stable")
        where, which, pos, key = where[order], which[order], pos[order], mixed[order].astype(np.uint32)
        head = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (which[1:] != which[:-1]))))
        many = np.diff(np.concatenate((head, [len(where)])))
        heads = np.searchsorted(where[head], np.arange(parts + 1))
        entries = np.searchsorted(where, np.arange(parts + 1))
        owner = which[head]
        used = np.flatnonzero(np.diff(entries))
        n = width[owner]
        ends = np.concatenate(([0], np.cumsum(n)))
        words = bits[np.repeat(first[owner] - ends[:-1], n) + np.arange(ends[-1])]
        data = []
        for k in used.tolist():
            h, e = slice(heads[k], heads[k + 1]), slice(entries[k], entries[k + 1])
            data.append(b"".join((sig[owner[h]].tobytes(), _planes(size[owner[h]]), _planes(many[h]), _planes(key[e]), _planes(pos[e]), words[ends[heads[k]] : ends[heads[k + 1]]].tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.diff(heads)[used].astype(np.int32)), pa.array(np.diff(entries)[used].astype(np.int32)), pa.array(data, pa.binary())], ["part", "heads", "entries", "data"])

    for piece in pieces(batches, "text"):
        for s in sets(elements(piece, spec), classes):
            good = seen.fresh(s.sig)
            good = good[s.size[good] >= spec.least]
            many = spec.prefix(s.size[good])
            which = np.repeat(np.arange(len(good)), many)
            pos = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            token = s.token[s.begin[good][which] + pos]
            kind = (token >> U64(HASH_BITS)).astype(np.int64)
            if len(some := np.flatnonzero(kind >= hot)):
                grid = np.ceil(2.0 ** ((kind[some] + 1) / 2) / spec.hot).astype(np.int64)
                keep = kind < hot
                i = np.repeat(some, grid)
                other = np.arange(len(i)) - np.repeat(np.cumsum(grid) - grid, grid)
                own = (mix(s.sig[good][which[i]].view(np.uint64)) % np.repeat(grid, grid).astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, other), np.maximum(own, other)
                side = np.where(own == other, 0, np.where(own < other, 1, 2))
                token = np.concatenate((token[keep], mix(token[i] * U64(3) + (low << 32 | high).astype(np.uint64) + U64(1))))
                which, pos = np.concatenate((which[keep], which[i])), np.concatenate((pos[keep], pos[i] | side << _SIDE))
                o = np.argsort(which, kind="stable")
                token, which, pos = token[o], which[o], pos[o]
            bits, first = _bitmaps(s, spec.lines)
            n = np.diff(first)[good]
            bits = bits[np.repeat(first[good] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            held.append((token, which, pos, s.sig[good], s.size[good], bits))
            count += len(which)
        if count >= spec.flush:
            yield flush()
            held, count = [], 0
    if count:
        yield flush()


def met(docs: DataFrame, spec: Spec, classes: np.ndarray, every: int) -> DataFrame:
    """Rows of :data:`MET`: pairs (a, b) of signatures whose prefixes share elements, with their sizes m, n and in c how many they share, in parts; and, with m = 0, stars from a to b."""
    spark = docs.sparkSession
    parts = max(partitions(spark), math.ceil(every * (1 - spec.threshold) / PART))
    table = spark.sparkContext.broadcast(classes)
    packed = docs.select("text").mapInArrow(released(lambda x: emitted(x, spec, table.value, parts)), "part int, heads int, entries int, data binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(released(lambda x: joined(x, spec)), MET)


def members(found: DataFrame, spec: Spec) -> DataFrame:
    """Distinct rows leader, sig: sets that meet in a cell.

    The elements of :meth:`Spec.shared` are counted for each pair; too few rule
    it out. A pair that is counted in part only, since a star has the rest,
    meets in the star's cell. A pair left
    meets with the least partner of its smaller side, so a group of near copies
    meets in one cell.
    """
    t = spec.threshold
    pairs = found.where("m > 0").groupBy("a", "b").agg(F.max("m").alias("m"), F.max("n").alias("n"), F.sum("c").alias("c"))
    if not spec.lines:
        need = F.ceil(t / (1 + t) * (F.col("m") + F.col("n")) - EPS)
        pairs = pairs.where(F.col("c") >= F.least(need - F.ceil(t * F.greatest("m", "n") - EPS) + 1, F.lit(SHARED)))
    pairs = pairs.select("a", "b")
    owner = pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("sig")).agg(F.least(F.min("b"), F.col("sig")).alias("leader"))
    owned = pairs.join(owner.withColumnRenamed("sig", "a"), "a").select(F.explode(F.array("a", "b")).alias("sig"), "leader")
    return found.where("m = 0").select(F.col("b").alias("sig"), F.col("a").alias("leader")).union(owned.select("sig", "leader")).distinct()


def common(a: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray, tokens: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """How many tokens the sets a[i] and b[i] have in common."""
    out = np.zeros(len(a), np.int64)
    cost = np.cumsum(size[a] + size[b])
    start = 0
    while start < len(a):
        base = cost[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(cost, base + limit, "right"))), start + MAX_SETS, len(a))
        side = np.concatenate((a[start:stop], b[start:stop]))
        n = size[side]
        at = np.repeat(begin[side] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.repeat(np.tile(np.arange(stop - start), 2), n).astype(np.uint64)
        both = np.sort((pair << U64(TOKEN_BITS)) | (tokens[at] & _TOKEN))
        same = both[1:][both[1:] == both[:-1]]
        out[start:stop] = np.bincount((same >> U64(TOKEN_BITS)).astype(np.int64), minlength=stop - start)
        start = stop
    return out


def possible(a: np.ndarray, b: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The suffix filter: no more can be common in each of 16 ranges of hashes than the smaller side has there."""
    table = np.zeros((len(size), 16), np.int32)
    np.add.at(table, (np.repeat(np.arange(len(size)), size), (tokens & U64(15)).astype(np.int64)), 1)
    step = 1 << 16
    return np.concatenate([np.minimum(table[a[i : i + step]], table[b[i : i + step]]).sum(1) for i in range(0, len(a), step)] or [np.zeros(0, np.int64)])


def _cell(begin: np.ndarray, size: np.ndarray, tokens: np.ndarray, side: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similar pairs of a large cell, whose sets are in order of their size, and what they have in common, by bit sets over its repeated tokens."""
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    _, number, many = np.unique(tokens[at], return_inverse=True, return_counts=True)
    if not (many > 1).any():
        return
    place = np.cumsum(many > 1) - 1
    keep = (many > 1)[number]
    owner, number = np.repeat(np.arange(len(size)), size)[keep], place[number[keep]]
    bits = np.zeros((len(size), (int(place[-1]) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, number >> 6), U64(1) << (number & 63).astype(np.uint64))
    left, right, both = [], [], []
    held = 0
    stop = np.searchsorted(size, np.floor(size / spec.threshold + EPS), "right")
    step = max(1, (1 << 20) // bits.shape[1])
    for i in range(len(size)):
        for low in range(i + 1, int(stop[i]), step):
            high = min(int(stop[i]), low + step)
            n = np.bitwise_count(bits[low:high] & bits[i]).sum(1, dtype=np.int64)
            ok = n / (size[low:high] + size[i] - n) >= spec.threshold
            if side[i]:
                ok &= side[low:high] != side[i]
            j = np.flatnonzero(ok)
            if len(j):
                left.append(np.full(len(j), i))
                right.append(j + low)
                both.append(n[j])
                held += len(j)
        if held > spec.pairs:
            yield np.concatenate(left), np.concatenate(right), np.concatenate(both)
            left, right, both, held = [], [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right), np.concatenate(both)


LINKS = "sig long, sig2 long, links long, match_doc long, match_line int, jaccard double, root_doc long"


def checked(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`LINKS` of a partition's cells, for each set and cell in which it has similar ones."""
    columns: list[list[np.ndarray]] = [[] for _ in range(9)]
    tokens_of: list[np.ndarray] = []
    leaders_of: list[np.ndarray] = []
    for batch in batches:
        for n, data in zip(batch.column("sets").to_pylist(), batch.column("data")):
            data, at = data.as_buffer(), 0
            for into in columns:
                into.append(np.frombuffer(data, np.int64, n, at))
                at += 8 * n
            leaders = int(columns[6][-1].sum())
            leaders_of.append(np.frombuffer(data, np.int64, leaders, at))
            raw = np.frombuffer(data, np.uint8, -1, at + 8 * leaders).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            tokens_of.append(wide.view(np.uint64).ravel())
    if not columns[0]:
        return
    cell, leader, sig, sig2, doc, line, many, size, side = (np.concatenate(x) for x in columns)
    tokens, leaders = np.concatenate(tokens_of), np.concatenate(leaders_of).view(np.uint64)
    del columns, tokens_of, leaders_of
    begin, first = np.cumsum(size) - size, np.cumsum(many) - many
    o = np.lexsort((sig2, sig, size, leader, cell))
    new = np.ones(len(o), np.bool_)
    new[1:] = (cell[o][1:] != cell[o][:-1]) | (leader[o][1:] != leader[o][:-1]) | (sig[o][1:] != sig[o][:-1]) | (sig2[o][1:] != sig2[o][:-1])
    o = o[new]
    cell, leader, sig, sig2, doc, line, many, size, side, begin, first = (x[o] for x in (cell, leader, sig, sig2, doc, line, many, size, side, begin, first))
    edge = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (leader[1:] != leader[:-1]))))
    width = np.diff(np.concatenate((edge, [len(cell)])))

    def result(left: np.ndarray, right: np.ndarray, both: np.ndarray) -> pa.RecordBatch | None:
        # a pair that has an earlier leader in common is counted there
        again = np.flatnonzero((many[left] > 1) & (many[right] > 1))
        if len(again):
            a, b = left[again], right[again]
            used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            n = many[used]
            at = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            earlier = leaders[at].view(np.int64) < np.repeat(leader[used], n)
            owner = np.repeat(np.arange(len(used)), n)[earlier]
            _, numbered = np.unique(leaders[at][earlier], return_inverse=True)
            n = np.bincount(owner, minlength=len(used))
            twice = common(place[: len(a)], place[len(a) :], np.cumsum(n) - n, n, numbered.astype(np.uint64)) > 0
            keep = np.ones(len(left), np.bool_)
            keep[again[twice]] = False
            left, right, both = left[keep], right[keep], both[keep]
        if not spec.lines:
            other = doc[left] != doc[right]  # rows that share an id are one document
            left, right, both = left[other], right[other], both[other]
        if not len(left):
            return None
        jaccard = both / (size[left] + size[right] - both)
        own, other, value = np.concatenate((left, right)), np.concatenate((right, left)), np.tile(jaccard, 2)
        o = np.lexsort((line[other], doc[other], own))
        own, other, value = own[o], other[o], value[o]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.diff(np.concatenate((at, [len(own)])))
        own, other, value = own[at], other[at], value[at]
        # components by the least position
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((line[own], doc[own]))] = np.arange(len(own))
        by_rank = own[np.argsort(rank)]
        label = rank.copy()
        a, b = np.searchsorted(own, left), np.searchsorted(own, right)
        owner = np.argsort(rank)
        while True:
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = np.minimum(label, label[owner[label]])
            if (label == before).all():
                break
        columns = (sig[own], sig2[own], n, doc[other], line[other].astype(np.int32), value, doc[by_rank[label]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "sig2", "links", "match_doc", "match_line", "jaccard", "root_doc"])

    small = width <= spec.small_cell
    left, right = [], []
    held = 0
    for k in [*np.unique(width[small]).tolist(), 0]:
        some = edge[small & (width == k)] if k > 1 else np.zeros(0, np.int64)
        if len(some):
            i, j = np.triu_indices(k, 1)
            left.append((some[:, None] + i).ravel())
            right.append((some[:, None] + j).ravel())
            held += len(left[-1])
        if held and (held > spec.pairs or k == 0):
            a, b = np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
            need = spec.need(size[a] + size[b])
            ok = (np.minimum(size[a], size[b]) >= need) & ((side[a] == 0) | (side[a] != side[b]))
            a, b, need = a[ok], b[ok], need[ok]
            used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            x, y = place[: len(a)], place[len(a) :]
            n = size[used]
            at = np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ok = possible(x, y, n, tokens[at]) >= need
            a, b, x, y = a[ok], b[ok], x[ok], y[ok]
            both = common(x, y, np.cumsum(n) - n, n, tokens[at])
            ok = both / (size[a] + size[b] - both) >= spec.threshold
            if (rows := result(a[ok], b[ok], both[ok])) is not None:
                yield rows
    for k in np.flatnonzero(~small).tolist():
        s = slice(edge[k], edge[k] + width[k])
        for a, b, both in _cell(begin[s], size[s], tokens, side[s], spec):
            if (rows := result(a + edge[k], b + edge[k], both)) is not None:
                yield rows


def sent(batches: Iterator[pa.RecordBatch], spec: Spec, parts: int) -> Iterator[pa.RecordBatch]:
    """The sets asked for in ``wanted``, packed by the partition of their cells."""
    held: list[list] = []
    size = 0

    def flush() -> pa.RecordBatch:
        by: dict[int, list] = {}
        for x in held:
            by.setdefault(x[0] % parts, []).append(x)
        data = []
        for rows in by.values():
            head = np.array([[*x[:6], len(x[8]), x[6], x[7]] for x in rows], np.int64).T
            leaders = np.concatenate([x[8] for x in rows])
            tokens = np.concatenate([x[9] for x in rows])
            data.append(head.tobytes() + leaders.tobytes() + np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([len(x) for x in by.values()], pa.int32()), pa.array(data, pa.binary())], ["part", "sets", "data"])

    for piece in pieces(batches, "text"):
        asked = [{(w["sig"], w["sig2"]): w for w in x} for x in piece.column("wanted").to_pylist()]
        done: set[tuple[int, int, int]] = set()
        for s in sets(elements(piece, spec), None):
            for k, (r, a, b) in enumerate(zip(s.row.tolist(), s.sig.tolist(), s.sig2.tolist())):
                w = asked[r].get((a, b))
                if w is None or (r, a, b) in done:
                    continue
                done.add((r, a, b))
                tokens = s.token[s.begin[k] : s.begin[k] + s.size[k]]
                leaders = np.array([c["leader"] for c in w["cells"]], np.int64)
                for c in w["cells"]:
                    grid = c["grid"]
                    own = int(mix(np.array([a], np.int64).view(np.uint64))[0] % U64(grid)) if grid > 1 else 0
                    for other in range(grid):
                        cell = int(mix(np.array([(c["leader"] ^ (min(own, other) << 32 | max(own, other))) & (2**64 - 1)], np.uint64))[0] >> U64(1))
                        held.append([cell, c["leader"], a, b, w["doc_id"], w["line"], len(tokens), 0 if own == other else 1 if own < other else 2, leaders, tokens])
                        size += 8 * len(tokens) + 100
        if size > 32 << 20:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def verified(docs: DataFrame, spec: Spec, meeting: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of :data:`LINKS` of the sets that meet.

    ``first`` has sig, sig2, doc_id, line and size of each distinct set. The
    sets are read again from their documents and sent to the cells of their
    leaders.
    """
    spark = docs.sparkSession
    known = meeting.join(first.select("sig", "sig2", "doc_id", "line", "size"), "sig")
    # only leaders of more than CELL_BYTES, so one row for as many bytes at most: small enough to broadcast
    total = known.groupBy("leader").agg(F.sum(F.lit(6) * F.col("size").cast("long")).alias("bytes"))
    wide = total.where(F.col("bytes") > CELL_BYTES).select("leader", F.ceil(F.col("bytes") / F.lit(CELL_BYTES)).cast("int").alias("_grid"))
    cells = known.join(F.broadcast(wide), "leader", "left").groupBy("sig", "sig2", "doc_id", "line", "size").agg(F.collect_list(F.struct("leader", F.coalesce("_grid", F.lit(1)).alias("grid"))).alias("cells"))
    wanted = stored(cells.groupBy("doc_id").agg(F.collect_list(F.struct("sig", "sig2", "doc_id", "line", "cells")).alias("wanted"), F.sum(F.expr("aggregate(cells, 0L, (n, c) -> n + c.grid * (100L + 6L * size))")).alias("bytes"), F.sum(F.size("cells")).alias("many")))
    rows, moved, many = wanted.agg(F.count("*"), F.sum("bytes"), F.sum("many")).first()
    parts = max(partitions(spark), math.ceil((moved or 0) / (8 * CELL_BYTES)))
    wanted = wanted.select("doc_id", "wanted")
    if 120 * rows + 60 * (many or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    again = docs.join(wanted, "doc_id").select("text", "wanted").mapInArrow(released(lambda x: sent(x, spec, parts)), "part int, sets int, data binary")
    return again.repartitionById(parts, F.col("part")).mapInArrow(released(lambda x: checked(x, spec)), LINKS)


@dataclass(frozen=True)
class Similar:
    """Stored tables: all sets (sig, sig2, doc_id, line, size), and for each set and cell in which it has similar ones a row of :data:`LINKS`."""

    units: DataFrame
    links: DataFrame

    def classes(self) -> DataFrame:
        """Of the sets that are equal: sig, sig2, the least position at, size and copies."""
        return self.units.groupBy("sig", "sig2").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.max("size").alias("size"), F.count("*").alias("copies"))

    def best(self) -> DataFrame:
        """Of each set that has similar ones: sig, sig2, links (how many), and match, the least position of those with its jaccard."""
        match = F.struct(F.struct(F.col("match_doc").alias("doc_id"), F.col("match_line").alias("line")).alias("at"), "jaccard")
        return self.links.groupBy("sig", "sig2").agg(F.sum("links").alias("links"), F.min(match).alias("match"))


def similar(docs: DataFrame, spec: Spec) -> Similar:
    """All sets of the documents and the links between those that are similar but not equal."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    scan = stored(scanned(docs, spec))
    classes, every = rarity(scan)
    units = scan.where("slice is null").select("sig", "sig2", "doc_id", "line", "size")
    found = stored(met(docs, spec, classes, every))
    meeting = stored(members(found, spec))
    dropped(found)
    first = Similar(units, units).classes().select("sig", "sig2", "at.doc_id", "at.line", "size")
    links = stored(verified(docs, spec, meeting, first))
    dropped(meeting)
    return Similar(units, links)
