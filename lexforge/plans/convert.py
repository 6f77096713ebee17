"""From dictionary files to text dictionaries."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational, variants
from ..session import cut
from ..sinks import writers
from ..sources import readers


def text_dictionaries(spark: SparkSession, path: str, folder: str, source: int = -1, target: int = -1, dumb: bool = False) -> DataFrame:
    """Writes every dictionary of a language pair as text, with its annotation, icon and archive of embedded files.

    Variants of a heading are merged and headings of one article put together,
    unless ``dumb``: then every heading has the article to itself, in the order
    of the file. Returns path, status (``written``, ``unsupported``,
    ``decoding error`` where the number of headings isn't that of the header,
    or what is wrong with the file), headings, articles and files.
    """
    heads = cut(relational.language_names(relational.language_names(readers.dictionaries(spark, path), "source_lang", "source"), "target_lang", "target"))
    heads = heads.where("error is not null").unionByName(relational.by_language(heads.where("error is null"), source, target))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem")
    readable = heads.where("error is null and decoder <> 'unsupported'").select("path", stem, "name", "source", "target", "annotation", "icon", "entries_count")
    names = cut(readers.headings(spark, path).join(readable.select("path"), "path", "left_semi"))
    counted = names.groupBy("path").agg(F.count("reference").alias("headings"), F.max("error").alias("wrong"))
    state = readable.join(counted, "path", "left").withColumn("good", F.col("wrong").isNull() & (F.coalesce("headings", F.lit(0)) == F.col("entries_count")))
    good = state.where("good").select("path", "stem", "name", "source", "target", "annotation", "icon")
    rows = names.where("reference is not null").join(good.select("path"), "path", "left_semi")
    rows = rows.withColumn("key", F.concat_ws("\0", "path", F.col("reference").cast("string")))
    left = rows.select("key", "ordinal", "chars") if dumb else variants.collapsed(rows, "key", "ordinal", "chars")
    left = left.select(F.concat_ws("\0", "key", F.col("ordinal").cast("string")).alias("own") if dumb else F.col("key").alias("own"), "key", "ordinal", T.dsl_text(F.col("chars")).alias("heading"))
    groups = relational.grouped_headings(left, "own", "ordinal", "heading").join(left.select("own", F.split("key", "\0")[0].alias("path"), F.split("key", "\0")[1].cast("long").alias("reference")).distinct(), "own")
    bodies = readers.articles(spark, path, rows).where("error is null").select("path", "reference", "body")
    articles = groups.join(bodies, ["path", "reference"]).join(good, "path").select("stem", "name", "source", "target", "annotation", "icon", "first_ord", "headings", "body")
    written = cut(writers.write_dictionaries(articles, folder, "stem", title="name"))
    files = cut(_archives(readers.overlays(spark, path).where("error is null").join(good.select("path", "stem"), "path"), folder))
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("decoder") == "unsupported", F.col("decoder")).when(F.col("good"), "written").otherwise(F.coalesce("wrong", F.lit("decoding error")))
    out = heads.select("path", "error", "decoder").join(state.select("path", "stem", "good", "wrong", "headings"), "path", "left").join(written.select("stem", "articles"), "stem", "left").join(files, "stem", "left")
    return out.select("path", status.alias("status"), F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("files", F.lit(0)).alias("files"))


def _archives(embedded: DataFrame, folder: str) -> DataFrame:
    """An archive ``stem.dsl.files.zip`` for each dictionary with embedded files (stem, name, content); stem and how many."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("offset")
        n = writers.write_zip(os.path.join(folder, f"{g.iloc[0]['stem']}.dsl.files.zip"), ((r.name_, bytes(r.content)) for r in g.rename(columns={"name": "name_"}).itertuples()))
        return pd.DataFrame({"stem": [g.iloc[0]["stem"]], "files": [n]})

    return embedded.select("stem", "name", "offset", "content").groupBy("stem").applyInPandas(run, "stem string, files long")
