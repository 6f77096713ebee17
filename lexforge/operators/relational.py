"""Relational steps of a lexicon: every one works on any table that has the columns it is given."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..session import cut
from .ordering import following, numbered, running_total

#: Width of the buckets over which range lookups are joined.
BUCKET = 64
#: Bytes of a decoded block.
BLOCK = 8192


# filters and dispatch
def by_language(df: DataFrame, source: int = -1, target: int = -1, source_column: str = "source_lang", target_column: str = "target_lang") -> DataFrame:
    """Rows of a language pair; -1 stands for any."""
    return df.where(((F.lit(source) == -1) | (F.col(source_column) == source)) & ((F.lit(target) == -1) | (F.col(target_column) == target)))


def language_names(df: DataFrame, code: str, name: str = "language") -> DataFrame:
    """The language's name, ``unknown`` for other codes."""
    known = df.sparkSession.createDataFrame(list(T.LANGUAGES.items()), "_code int, _name string")
    return df.join(F.broadcast(known), F.col(code) == F.col("_code"), "left").withColumn(name, F.coalesce("_name", F.lit("unknown"))).drop("_code", "_name")


def supported(df: DataFrame, version: str) -> DataFrame:
    return df.withColumn("decoder", T.decoder_of(F.col(version))).withColumn("supported", F.col("decoder") != "unsupported")


def parsed_headings(df: DataFrame, heading: str, offset: str, kind: str | None = None) -> DataFrame:
    """Name and offset of raw index headings.

    ``name $$$$ a b c``: b - 1 is the offset; a fourth number drops the row, as does the kind 10.
    """
    tail = r" \$\$\$\$\s+-?[0-9]+\s([0-9]+)\s-?[0-9]+$"
    drop = r" \$\$\$\$\s+-?[0-9]+\s[0-9]+\s-?[0-9]+\s-?[0-9]+$"
    h = F.col(heading)
    out = df.where(~h.rlike(drop))
    if kind:
        out = out.where(F.col(kind) != 10)
    return out.withColumn("offset", F.when(h.rlike(tail), F.regexp_extract(h, tail, 1).cast("long") - 1).otherwise(F.col(offset).cast("long"))).withColumn("name", F.regexp_replace(h, tail, ""))


# aggregation
def grouped_headings(df: DataFrame, reference: str, order: str, heading: str) -> DataFrame:
    """Headings of each reference in their order, and where the reference first appears."""
    return df.groupBy(reference).agg(F.min(order).alias("first_ord"), F.transform(F.sort_array(F.collect_list(F.struct(order, heading))), lambda x: x[heading]).alias("headings"))


def grouped_entries(df: DataFrame, offset: str, name: str) -> DataFrame:
    """Sorted names of each offset, and the bytes up to the next offset (-1 in the last row)."""
    groups = df.groupBy(offset).agg(F.array_sort(F.collect_list(name)).alias("headings"))
    return following(groups, offset, "_next").withColumn("article_size", F.coalesce(F.col("_next") - F.col(offset), F.lit(-1))).drop("_next")


def progress(df: DataFrame, order: list[str], total: int | None = None) -> DataFrame:
    """Rows at which the percentage that is done goes up."""
    rows = numbered(df, order, "i")
    total = rows.count() if total is None else total
    now, before = F.floor(100 * F.col("i") / total), F.floor(100 * (F.col("i") - 1) / total)
    return rows.withColumn("percent", now.cast("int")).where((now > before) | (F.col("i") == 1))


def report_status(errors: Column, failed: Column) -> Column:
    return F.when(failed | (errors > 20), 1).when(errors > 0, 2).otherwise(0)


def checked_count(df: DataFrame, expected: int) -> DataFrame:
    """The table; an error when it is read if it has another number of rows."""
    n = df.agg(F.count("*").alias("_n"))
    test = n.select(F.assert_true(F.col("_n") == expected, F.lit(f"the header tells of {expected} headings")).alias("_ok"), F.lit(1).alias("_one"))
    return df.join(F.broadcast(test), (F.col("_one") == 1) & F.col("_ok").isNull()).drop("_ok", "_one")


# distinct
def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first, by a partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def content_names(df: DataFrame, content: str, order: str, template: str = "rendered_table_%04d.png") -> DataFrame:
    """A sequential name for each distinct content, by first appearance."""
    keyed = df.withColumn("_key", F.sha2(F.col(content).cast("binary"), 256))
    firsts = numbered(keyed.groupBy("_key").agg(F.min(order).alias("_first")), ["_first"], "_n")
    return keyed.join(firsts, "_key").withColumn("name", F.format_string(template, "_n")).drop("_key", "_first", "_n")


def without_used(files: DataFrame, used: DataFrame, name: str) -> DataFrame:
    """Files that no manifest has claimed, whatever the case."""
    return files.join(used.select(F.lower(name).alias("_used")).distinct(), F.lower(name) == F.col("_used"), "left_anti")


# lookups
def range_lookup(rows: DataFrame, ranges: DataFrame, offset: str, first: str, last: str, order: str, bucket: int = BUCKET) -> DataFrame:
    """The first range (by ``order``) with first <= offset < last for every row, and the offset within it; null without one.

    Ranges are cut at multiples of ``bucket``; of those with the same part of a
    bucket the first stays, so a bucket has few however many ranges there are.
    Each distinct offset meets its bucket's list once: no row for each pair of
    an offset and a range that holds it.
    """
    parts = ranges.where(F.col(first) < F.col(last)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor((F.col(last) - 1) / bucket))))
    low, high = F.greatest(F.col(first), F.col("_bucket") * bucket).alias("_low"), F.least(F.col(last), (F.col("_bucket") + 1) * bucket).alias("_high")
    parts = parts.select("_bucket", low, high, F.col(order).alias("_order"), F.struct(*ranges.columns).alias("_range")).repartition("_bucket")
    firsts = parts.groupBy("_bucket", "_low", "_high").agg(F.min_by(F.struct("_order", "_range"), "_order").alias("_first"))
    lists = firsts.groupBy("_bucket").agg(F.collect_list(F.struct("_low", "_high", F.col("_first._order").alias("_order"), F.col("_first._range").alias("_range"))).alias("_parts"))
    asked = rows.select(F.col(offset).alias("_offset")).where("_offset is not null").distinct().withColumn("_bucket", F.floor(F.col("_offset") / bucket))
    holds = F.filter("_parts", lambda x: (x["_low"] <= F.col("_offset")) & (F.col("_offset") < x["_high"]))
    # a null order counts for nothing, as in min_by
    earliest = F.reduce(
        F.filter(holds, lambda x: x["_order"].isNotNull()), F.lit(None).cast(lists.schema["_parts"].dataType.elementType),
        lambda acc, x: F.when(acc.isNull() | (x["_order"] < acc["_order"]), x).otherwise(acc),
    )
    best = asked.join(lists, "_bucket").select("_offset", earliest["_range"].alias("range")).where("range is not null")
    return rows.join(best, F.col(offset) == F.col("_offset"), "left").withColumn("within", F.col(offset) - F.col(f"range.{first}")).drop("_offset")


def resolved(references: DataFrame, groups: DataFrame, key: str, hint: str, headings: str = "headings") -> DataFrame:
    """The heading a reference shows: its trimmed hint if the article has that, else the article's first, else ``unknown``."""
    wanted = T.display_name(F.col(hint))
    out = references.join(groups.select(key, headings), key, "left")
    return out.withColumn("resolved", F.coalesce(F.when(F.array_contains(headings, wanted), wanted), F.try_element_at(headings, F.lit(1)), F.lit("unknown"))).drop(headings)


def case_repaired(wanted: DataFrame, files: DataFrame, name: str, file_name: str) -> DataFrame:
    """The spelling that the file has, for names written in any case; the given one without such a file."""
    known = first_of(files.select(F.lower(file_name).alias("_lower"), F.col(file_name).alias("_file")), ["_lower"], ["_file"])
    return wanted.join(known, F.lower(name) == F.col("_lower"), "left").withColumn("file", F.coalesce("_file", F.col(name))).drop("_lower", "_file")


def tree_paths(edges: DataFrame, parent: str, child: str, position: str, levels: int = 1000) -> DataFrame:
    """Every node with its depth and path of positions; ordered by path, it is a pre-order walk.

    One join a level; each level is written, so neither lineage nor work
    grows with the depth. More than ``levels`` is taken for a cycle.
    """
    edges = edges.select(F.col(parent).alias("_p"), F.col(child).alias("node"), F.format_string("%010d", F.col(position).cast("long")).alias("_at"))
    roots = edges.where("_p is null").select("node", F.lit(0).alias("depth"), F.col("_at").alias("path"))
    found, level = [roots], cut(roots)
    while not level.isEmpty():
        if len(found) > levels:
            raise ValueError("the tree has a cycle")
        below = edges.alias("e").join(level.withColumnRenamed("node", "_p"), "_p").select("node", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "_at").alias("path"))
        level = cut(below)
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def located(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Offset of each row in the archive of all rows in order, with its first and last block."""
    out = running_total(df, order, size, "offset")
    end = F.col("offset") + F.greatest(F.col(size) - 1, F.lit(0))
    return out.select(*out.columns, F.floor(F.col("offset") / BLOCK).alias("first_block"), F.floor(end / BLOCK).alias("last_block"), (F.col("offset") % BLOCK).alias("skip"))


def blocks_of(df: DataFrame, key: str, content: str) -> DataFrame:
    """A content's blocks, numbered from 0."""
    n = F.ceil(F.length(content) / BLOCK).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(key, content, F.explode(numbers).alias("block_no")).select(key, "block_no", F.substring(F.col(content), F.col("block_no") * BLOCK + 1, F.lit(BLOCK)).alias("data"))


def read_ranges(requests: DataFrame, blocks: DataFrame, key: str, offset: str, size: str) -> DataFrame:
    """What lies at offset, size bytes long (-1: up to the end), put together from the blocks it reaches over.

    At the end of the archive a content is as long as there is something; one
    that begins beyond it is null, as is that of an unknown archive.
    """
    last = blocks.groupBy(key).agg(F.max("block_no").alias("_last"))
    asked = requests.select(key, offset, size).distinct().join(last, key)
    b0 = F.floor(F.col(offset) / BLOCK).cast("int")
    b1 = F.when(F.col(size) < 0, F.col("_last")).otherwise(F.least(F.floor((F.col(offset) + F.greatest(F.col(size), F.lit(1)) - 1) / BLOCK).cast("int"), F.col("_last")))
    wanted = asked.where((F.col(offset) >= 0) & (b0 <= b1)).select(key, offset, size, F.explode(F.sequence(b0, b1)).alias("block_no"))
    whole = wanted.join(blocks, [key, "block_no"]).groupBy(key, offset, size).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "data"))), lambda x: x["data"]), "").alias("_all"))
    skip = (F.col(offset) % BLOCK).cast("int")
    rest = F.when(F.col(size) < 0, F.length("_all")).otherwise(F.col(size)).cast("int")
    found = whole.where(F.length("_all") >= skip).select(key, offset, size, F.substring(F.col("_all"), skip + 1, rest).alias("content"))
    return requests.join(found, [key, offset, size], "left")


# checks
def articles_of(leaves: DataFrame, kind: str = "type") -> DataFrame:
    """Leaves of an index that stand for articles: plain ones and variants."""
    return leaves.where(F.col(kind).isin(1, 10))


def within_archive(rows: DataFrame, offset: str, size: str | int) -> tuple[DataFrame, DataFrame]:
    """Rows whose offset lies in an archive of so many decoded bytes, and those that are to be reported and left out; a null or negative offset is out."""
    inside = F.coalesce((F.col(offset) >= 0) & (F.col(offset) < (F.col(size) if isinstance(size, str) else F.lit(size))), F.lit(False))
    return rows.where(inside), rows.where(~inside)


def with_files(references: DataFrame, files: DataFrame, name: str, file_name: str, content: str) -> DataFrame:
    """Each reference with the content of its file, found in any case; without one it is empty, and ``missing`` is set."""
    known = first_of(files.select(F.lower(file_name).alias("_lower"), F.col(file_name).alias("_file"), F.col(content).alias("_content")), ["_lower"], ["_file"])
    out = references.join(known, F.lower(name) == F.col("_lower"), "left")
    return out.withColumn("missing", F.col("_lower").isNull()).withColumn("content", F.coalesce("_content", F.lit(b""))).drop("_lower", "_file", "_content")


def total_samples(entries: DataFrame, size: str = "sample_size") -> DataFrame:
    """Samples of an audio archive in all, as a 64-bit sum; none is 0."""
    return entries.agg(F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("total_samples"))


def stacked(images: DataFrame, group: str, width: str, height: str) -> DataFrame:
    """Size of the images of a group put one below the other: the greatest width, the sum of the heights."""
    return images.groupBy(group).agg(F.max(width).alias("width"), F.sum(height).alias("height"))


def first_mark(text: str, mark: str = "@", within: int = 0x200):
    """Where the mark is first found in the first characters, from 0; -1 if it isn't there."""
    return F.instr(F.substring(F.col(text), 1, within), mark) - 1


# sequences
def table_spans(cells: DataFrame, row: str, column: str, merged: str) -> DataFrame:
    """Spans along a row: each merged cell widens the last cell before it that isn't merged, or the first of the row."""
    upto = Window.partitionBy(row).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.coalesce(F.last(F.when(~F.col(merged), F.col(column)), ignorenulls=True).over(upto), F.min(column).over(Window.partitionBy(row)))
    out = cells.withColumn("_owner", owner)
    widened = F.sum(F.col(merged).cast("int")).over(Window.partitionBy(row, "_owner"))
    return out.withColumn("span", F.when(F.col(column) == F.col("_owner"), 1 + widened).otherwise(1).cast("int")).drop("_owner")


def front_coded(df: DataFrame, page: str, order: list[str], text: str) -> DataFrame:
    """Each text as the length of what it shares with the one before it on its page, and the rest."""
    before = F.coalesce(F.lag(text).over(Window.partitionBy(page).orderBy(*order)), F.lit(""))
    out = df.withColumn("_before", before)
    shorter = F.least(F.length(text), F.length("_before"))
    same = F.when(shorter > 0, F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: F.substring(F.col(text), F.lit(1), i) == F.substring(F.col("_before"), F.lit(1), i)))).otherwise(0)
    return out.withColumn("prefix_len", same).withColumn("suffix", F.substring(F.col(text), F.col("prefix_len") + 1, F.length(text))).drop("_before")


def front_decoded(df: DataFrame, page: str, order: list[str], keep: list[str]) -> DataFrame:
    """The texts again: each page is sorted and read through once, and of a page only the text before is held."""
    kept = list(dict.fromkeys([*order, *keep]))
    rows = df.select(F.col(page).alias("_page"), *kept, F.col("prefix_len").alias("_prefix"), F.col("suffix").alias("_suffix"))
    first = ~F.coalesce(F.lag(F.lit(True)).over(Window.partitionBy("_page").orderBy(*kept, "_prefix", "_suffix")), F.lit(False))
    rows = rows.withColumn("_first", first)
    schema = StructType([StructField(page, rows.schema["_page"].dataType), *(rows.schema[c] for c in kept), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = ""
        for b in batches:
            texts = []
            for new, n, rest in zip(*(b.column(c).to_pylist() for c in ("_first", "_prefix", "_suffix"))):
                text = None if n is None or rest is None else ("" if new else before)[: max(n, 0)] + rest
                texts.append(text)
                before = text or ""
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_page", *kept)), pa.array(texts, pa.string())], [page, *kept, "text"])

    return rows.mapInArrow(run, schema)
