"""DataFrames of dictionary files: one task for a file or for a range of its pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

#: Pages of a dictionary that one task decodes.
PAGES = 256


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(df: DataFrame, schema: str, rows: Callable[..., Iterator[dict]]) -> DataFrame:
    """Rows of each input row; an input that can't be read gives one row with its error."""
    names = [f.name for f in df.schema.fields]
    kinds = df.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = {n: batch.column(n)[k].as_py() for n in names}
                try:
                    out = [{"path": values["path"], "error": None} | r for r in rows(**values)]
                except (ValueError, EOFError, LookupError, StopIteration, ArithmeticError, struct.error, zlib.error) as e:
                    out = [{"path": values["path"], "error": f"{type(e).__name__}: {e}"}]
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    return df.mapInArrow(run, schema)


def dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """Headers alone; articles stay undecoded."""

    def rows(path: str, content: bytes):
        d = formats.dictionary(content)
        note = formats.Decoder(content, d).annotation() if d.decoder != "unsupported" and d.annotation_at else None
        yield {"version": d.version, "decoder": d.decoder, "name": d.name, "source_lang": d.source, "target_lang": d.target, "entries_count": d.entries, "annotation": note, "icon": d.icon}

    return _rows(_files(spark, path), "path string, version int, decoder string, name string, source_lang int, target_lang int, entries_count long, annotation string, icon binary, error string", rows)


def headings(spark: SparkSession, path: str) -> DataFrame:
    """Headings of all leaf pages, in page ranges that are spread over the cluster."""

    def ranges(path: str, content: bytes):
        d = formats.dictionary(content)
        for first, last, data, at in formats.page_ranges(content, d, PAGES):
            yield {"version": d.version, "first": first, "last": last, "data": data, "pages_at": at}

    # a range has its own pages and the tables, not the whole file
    cut = _rows(_files(spark, path), "path string, version int, first int, last int, data binary, pages_at int, error string", ranges)
    spread = cut.repartition(F.col("path"), F.col("first")).drop("error").where("data is not null")

    def rows(path: str, version: int, first: int, last: int, data: bytes, pages_at: int):
        decoder = formats.page_decoder(data, version, first, pages_at)
        for page in range(first, last):
            for k, (chars, reference) in enumerate(decoder.page(page)):
                yield {"page": page, "pos": k, "ordinal": page << 16 | k, "reference": reference, "chars": [{"chr": c, "sorted": s, "escaped": e} for c, s, e in chars]}

    return _rows(spread, "path string, page int, pos int, ordinal long, reference long, chars array<struct<chr:string,sorted:boolean,escaped:boolean>>, error string", rows)


def articles(spark: SparkSession, path: str, references: DataFrame) -> DataFrame:
    """The distinct articles that headings refer to; each file's tables are read once for all of them."""
    wanted = references.select("path", "reference").distinct().groupBy("path").agg(F.sort_array(F.collect_list("reference")).alias("wanted"))

    def rows(path: str, content: bytes, wanted: list[int]):
        decoder = formats.Decoder(content, formats.dictionary(content))
        for r in wanted:
            yield {"reference": r, "body": decoder.article(r)}

    return _rows(_files(spark, path).join(wanted, "path"), "path string, reference long, body string, error string", rows)


def overlays(spark: SparkSession, path: str) -> DataFrame:
    def rows(path: str, content: bytes):
        for name, at, size, data in formats.overlay(content, formats.dictionary(content)):
            yield {"name": name, "offset": at, "size": size, "content": data}

    return _rows(_files(spark, path), "path string, name string, offset long, size long, content binary, error string", rows)


def audio(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, name string, sample_offset long, sample_size long, read_size long, error string"
    return _rows(_files(spark, path), schema, lambda path, content: iter(formats.audio_entries(content)))


def hierarchies(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, page_offset long, pos int, kind string, heading string, type int, text_offset long, child_offset long, count int, delta int, error string"
    return _rows(_files(spark, path), schema, lambda path, content: iter(formats.hierarchy(content)[2]))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Decoded blocks of archives, each beside the index of the same name."""
    stem = F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", stem.alias("stem"))
    index = every.where(F.lower("path").endswith(".idx")).select("stem", F.col("content").alias("index"))
    content = every.where(F.lower("path").endswith(".bof")).join(index, "stem").select("path", "content", "index")

    def rows(path: str, content: bytes, index: bytes):
        for k, data in formats.blocks(content, formats.block_index(index)):
            yield {"block_no": k, "data": data}

    return _rows(content, "path string, block_no int, data binary, error string", rows)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The dictionaries of each manifest, with what their descriptors say and the archives they use.

    A manifest is read beside its own folder: files are found in any case and
    named as they are on disk. Only names are listed there, and only
    descriptors opened.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(folder.alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).groupBy("folder").agg(F.collect_list("file").alias("files"))
    small = every.where(F.lower("path").rlike(r"\.ld$")).select(folder.alias("folder"), F.struct(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content").alias("x")).groupBy("folder").agg(F.collect_list("x").alias("descriptors"))
    wanted = every.where(F.lower("path").endswith(".inf")).select("path", "content", folder.alias("folder")).join(names, "folder").join(small, "folder", "left").select("path", "content", "files", "descriptors")

    def rows(path: str, content: bytes, files: list[str], descriptors: list[dict] | None):
        disk = dict.fromkeys(files, b"") | {x["file"]: bytes(x["content"]) for x in descriptors or ()}
        for x in formats.manifest(content, disk):
            d = formats.descriptor(disk[x["ld"]])
            yield x | {
                "base": d.base, "name": d.name, "language": d.language, "ranges": [dict(zip(("file", "first", "last"), r)) for r in d.ranges], "references": [dict(zip(("type", "name", "code"), r)) for r in d.references],
            }

    schema = "path string, version int, ld string, hic string, idx string, bof string, resources array<struct<fsi:string,bof:string,idx:string,fsd:string>>, base string, name string, language string, ranges array<struct<file:string,first:long,last:long>>, references array<struct<type:string,name:string,code:string>>, error string"
    return _rows(wanted, schema, rows)


def blobs(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """Contents of the entries (path of a blob file, name, offset, size): what lies there, filled up with zeros to its size."""
    wanted = entries.groupBy("path").agg(F.collect_list(F.struct("name", "offset", "size")).alias("wanted"))

    def rows(path: str, content: bytes, wanted: list[dict]):
        for w in wanted:
            yield {"name": w["name"], "content": content[w["offset"] : w["offset"] + w["size"]].ljust(w["size"], b"\0")}

    return _rows(_files(spark, path).join(wanted, "path"), "path string, name string, content binary, error string", rows)


def resources(spark: SparkSession, path: str) -> DataFrame:
    def rows(path: str, content: bytes):
        for name, offset, size in formats.resource_entries(content):
            yield {"name": name, "offset": offset, "size": size}

    return _rows(_files(spark, path), "path string, name string, offset long, size long, error string", rows)
