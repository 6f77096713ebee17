"""Headings that are variants of each other, and greedy batches: what built-in operators can't express."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

Char = tuple[str, bool, bool]  # character, sorted, escaped
CHARS = "array<struct<chr:string,sorted:boolean,escaped:boolean>>"
Parts = tuple[list[Char], list[Char], list[Char]]
#: Headings that are sent back at once.
OUT = 2048


def marked(text: Column) -> Column:
    """A heading whose unsorted characters are in braces."""
    pieces = F.regexp_extract_all(text, F.lit(r"\{[^}]*\}|[^{]+"), F.lit(0))
    chars = F.transform(pieces, lambda p: F.transform(F.filter(F.split(F.regexp_replace(p, r"[{}]", ""), ""), lambda c: c != ""), lambda c: F.struct(c.alias("chr"), (~p.startswith("{")).alias("sorted"), F.lit(False).alias("escaped"))))
    return F.flatten(chars)


def _cut(chars: list[Char], opening: list[Char], closing: list[Char], at_end: bool) -> Parts | None:
    """What is before, between and after two marks."""
    spot = lambda what, start: next((i for i in range(start, len(chars) - len(what) + 1) if chars[i : i + len(what)] == what), -1)
    a = spot(opening, 0)
    b = spot(closing, a) if a >= 0 else -1
    if b < 0 or at_end and b + len(closing) != len(chars):
        return None
    return chars[:a], chars[a + len(opening) : b], chars[b + len(closing) :]


_OPEN, _CLOSE = ("(", False, False), (")", False, False)
_FREE, _SORTED = (" ", False, False), (" ", True, False)
#: Marks of the form whose middle doesn't sort, of the form whose middle may, what the merged heading has around it, and whether it ends there.
_FORMS: tuple[tuple[list[Char], list[Char], list[Char], list[Char], str, str, bool], ...] = (
    ([_OPEN], [_CLOSE], [_OPEN], [_CLOSE], "(", ")", False),
    ([_FREE, _OPEN], [_CLOSE], [_SORTED, _OPEN], [_CLOSE], " (", ")", True),
    ([_SORTED, _OPEN], [_CLOSE, _FREE], [_SORTED, _OPEN], [_CLOSE, _SORTED], " (", ") ", False),
)


def _keys(heading: list[Char]) -> list[tuple[tuple | None, tuple | None, Parts | None]]:
    """For each form what has to be equal, as the heading whose middle doesn't sort and as the one whose middle may; and its parts."""
    out = []
    for open_a, close_a, open_b, close_b, _, _, at_end in _FORMS:
        a, b = _cut(heading, open_a, close_a, at_end), _cut(heading, open_b, close_b, at_end)
        key = lambda p: (tuple(p[0]), tuple((c, e) for c, _, e in p[1]), tuple(p[2]))
        out.append((key(a) if a and not any(s for _, s, _ in a[1]) else None, key(b) if b else None, b))
    return out


def _joined(x: list, y: list) -> list[Char] | None:
    """One heading for two, given by their keys, that differ only in whether their bracket sorts; None for any others."""
    for (a1, b1, p1), (a2, b2, p2), (_, _, _, _, before, after, _) in zip(x, y, _FORMS):
        a, b, p = (a1, b2, p2) if a1 is not None else (a2, b1, p1)
        if a is not None and a == b:
            return p[0] + [(c, True, False) for c in before] + p[1] + [(c, True, False) for c in after] + p[2]
    return None


def merged(x: list[Char], y: list[Char]) -> list[Char] | None:
    return _joined(_keys(x), _keys(y))


class _Places:
    """Growing numbers, of which mostly the first goes: removing that moves nothing."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.head = 0

    def add(self, i: int) -> None:
        if not self.at or i > self.at[-1]:
            self.at.append(i)
        else:
            insort(self.at, i, self.head)

    def drop(self, i: int) -> None:
        k = bisect_left(self.at, i, self.head)
        if k > self.head:
            self.at.pop(k)
            return
        self.head += 1
        if self.head == len(self.at):
            self.at, self.head = [], 0

    def after(self, i: int) -> int | None:
        k = bisect_right(self.at, i, self.head)
        return self.at[k] if k < len(self.at) else None

    def before(self, i: int) -> int | None:
        return self.at[self.head] if self.head < len(self.at) and self.at[self.head] < i else None


class _Partners:
    """Headings by what has to be equal for a merge, so that the first partner of one is looked up instead of met in turn."""

    def __init__(self, keys: list) -> None:
        self.places: defaultdict[tuple, _Places] = defaultdict(_Places)
        for i, x in enumerate(keys):
            self.add(i, x)

    @staticmethod
    def _of(x: list) -> Iterator[tuple]:
        for form, (a, b, _) in enumerate(x):
            if a is not None:
                yield form, "a", a
            if b is not None:
                yield form, "b", b
                if a is None:
                    yield form, "only b", b

    def add(self, i: int, x: list) -> None:
        for key in self._of(x):
            self.places[key].add(i)

    def drop(self, i: int, x: list) -> None:
        for key in self._of(x):
            self.places[key].drop(i)

    def _spots(self, form: int, kind: str, key: tuple | None) -> list[_Places]:
        found = self.places.get((form, kind, key)) if key is not None else None
        return [found] if found else []

    def after(self, i: int, x: list) -> int | None:
        """The first heading after ``i``, whose keys are ``x``, that merges into it."""
        spots = [p for form, (a, b, _) in enumerate(x) for p in (self._spots(form, "b", a) if a is not None else self._spots(form, "a", b))]
        return min((j for p in spots if (j := p.after(i)) is not None), default=None)

    def before(self, i: int, x: list) -> int | None:
        """The first heading of all before ``i`` into which that merges."""
        spots = [p for form, (a, b, _) in enumerate(x) for p in (*self._spots(form, "a", b), *self._spots(form, "only b", a))]
        return min((k for p in spots if (k := p.before(i)) is not None), default=None)


def collapse(headings: list[list[Char]], strict: bool = False) -> list[tuple[int, list[Char]]]:
    """Numbers and characters of the headings that are left.

    The first pair in order that merges does so, until none does. As in the
    format's first implementation, a heading that was merged into another stays
    a partner for later ones, which then go as well; ``strict`` takes it out at
    once. After a merge only pairs with the new heading are looked at again.
    Partners are looked up by their keys: time grows with the headings, not
    with their pairs.
    """
    known: dict[tuple, list] = {}

    def keys_of(h: list[Char]) -> list:
        return known[t] if (t := tuple(h)) in known else known.setdefault(t, _keys(list(h)))

    now, keys, gone = list(headings), [keys_of(h) for h in headings], set()
    partners = _Partners(keys)

    def merge(i: int, j: int) -> None:
        m = _joined(keys[i], keys[j])
        partners.drop(i, keys[i])
        now[i], keys[i] = m, keys_of(m)
        partners.add(i, keys[i])
        if strict:
            partners.drop(j, keys[j])
        gone.add(j)

    i = 0
    while i < len(now):
        if not (strict and i in gone) and (j := partners.after(i, keys[i])) is not None:
            merge(i, j)
            # earlier headings have met all but this new one
            while (back := partners.before(i, keys[i])) is not None:
                merge(back, i)
                i = back
        else:
            i += 1
    return [(i, h) for i, h in enumerate(now) if i not in gone]


def _same(x, y) -> bool:
    """Equal as keys of a group are: NaN is NaN."""
    return x == y or x != x and y != y


def collapsed(df: DataFrame, reference: str, order: str, chars: str, strict: bool = False) -> DataFrame:
    """The headings of each reference with variants merged.

    Variants, and what they are merged into, have the same characters apart
    from their flags. So headings are spread and sorted by reference and text,
    and of a task's headings only those of one text are held at once.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    c = F.coalesce(F.col(chars), F.array().cast(CHARS))
    odd = F.exists(c, lambda x: ~F.coalesce(F.length(x["chr"]) == 1, F.lit(False)))
    flags = F.transform(c, lambda x: F.when(x["sorted"], F.when(x["escaped"], "3").otherwise("1")).otherwise(F.when(x["escaped"], "2").otherwise("0")))
    rows = df.select(
        F.col(reference).alias("_reference"), F.array_join(F.transform(c, lambda x: F.coalesce(x["chr"], F.lit(""))), "").alias("_text"), F.col(order).alias("_order"),
        F.array_join(flags, "").alias("_flags"), F.when(odd, F.transform(c, lambda x: F.coalesce(F.length(x["chr"]), F.lit(-1)))).alias("_sizes"),
    )
    spread = rows.repartition("_reference", "_text").sortWithinPartitions("_reference", "_text", F.col("_order").asc_nulls_last())
    schema = StructType().add(reference, kinds[reference]).add(order, kinds[order]).add(chars, ArrayType(StructType().add("chr", "string").add("sorted", "boolean").add("escaped", "boolean")))
    shape = pa.list_(pa.struct([("chr", pa.string()), ("sorted", pa.bool_()), ("escaped", pa.bool_())]))

    def heading(text: str, flags: str, sizes: list[int] | None) -> list[Char]:
        if sizes is None:
            signs = text
        else:
            ends = list(accumulate(max(n, 0) for n in sizes))
            signs = [None if n < 0 else text[end - n : end] for n, end in zip(sizes, ends)]
        return [(s, f in "13", f in "23") for s, f in zip(signs, flags)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {}
        out: list[tuple] = []
        held: list[list[Char]] = []
        orders: list = []
        read: dict[tuple, list[Char]] = {}
        own = None

        def end() -> None:
            out.extend((own[0], orders[i], h) for i, h in (collapse(held, strict) if len(held) > 1 else enumerate(held)))
            held.clear(), orders.clear(), read.clear()

        def batch() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out), (kind["_reference"], kind["_order"], shape))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [reference, order, chars])

        for b in batches:
            kind = {f.name: f.type for f in b.schema}
            for ref, text, at, flags, sizes in zip(*(b.column(k).to_pylist() for k in ("_reference", "_text", "_order", "_flags", "_sizes"))):
                if own is None or text != own[1] or not _same(ref, own[0]):
                    if own is not None:
                        end()
                        if len(out) >= OUT:
                            yield batch()
                    own = ref, text
                form = (flags, None if sizes is None else tuple(sizes))
                held.append(read[form] if form in read else read.setdefault(form, heading(text, *form)))
                orders.append(at)
        if own is not None:
            end()
        if out:
            yield batch()

    return spread.mapInArrow(run, schema)


def fill(sizes: list[int], limit: int) -> list[int | None]:
    """Bin of each item: a bin is closed as soon as it holds more than ``limit``; a rest of no rows has none."""
    bins: list[int | None] = []
    n, total, begin = 0, 0, 0
    for k, size in enumerate(sizes):
        total += size
        bins.append(n)
        if total > limit:
            n, total, begin = n + 1, 0, k + 1
    return bins if total else bins[:begin] + [None] * (len(bins) - begin)


def greedy_batches(df: DataFrame, group: str, order: str, rows: str, limit: int) -> DataFrame:
    """Batches of consecutive tables of each group; see :func:`fill`."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, order, rows)}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        return g.assign(batch=pd.array(fill([int(x) for x in g[rows]], limit), "Int32"))

    return df.select(group, order, rows).groupBy(group).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", batch int")
