"""Line de-duplication across documents by an exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._setjoin import Spec, similar
from ._text import fresh

#: Lines count as the same from this Jaccard similarity of their sets of words on.
THRESHOLD = 0.8


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Lines for which an earlier line of the corpus is similar.

    Lines are the parts of ``text`` between line feeds, ordered by ``doc_id``
    and number; words are as in :mod:`._text`. Returns doc_id, line (from 0),
    and of the earliest similar line match_doc_id, match_line, jaccard. The
    earlier line need not itself be kept.

    Lines without a word are never repeated, so neither are empty texts; nor
    are lines of documents with a null ``doc_id`` or ``text``. Rows that share
    a ``doc_id`` are one document, whose equal lines of equal number are one
    line. An empty table gives an empty result; other columns are ignored.
    """
    found = similar(docs, Spec(True, 1, threshold))
    here = F.struct("doc_id", "line")
    # the least position wins; a set is its own match with similarity 1
    own = F.struct("at", F.lit(1.0).alias("jaccard"))
    classes = found.classes().where("copies > 1").select("sig", "sig2", own.alias("m"))
    best = classes.unionByName(found.best().select("sig", "sig2", F.col("match").alias("m"))).groupBy("sig", "sig2").agg(F.min("m").alias("m"))
    lines = found.units.select("sig", "sig2", "doc_id", "line").join(best, ["sig", "sig2"]).where(F.col("m.at") < here)
    lines = lines.select("doc_id", "line", F.col("m.at.doc_id").alias("match_doc_id"), F.col("m.at.line").alias("match_line"), F.col("m.jaccard").alias("jaccard"))
    return lines.distinct()


def without_lines(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The documents without these lines; ``n_chars`` (where there is one) is counted anew.

    A document that had words and of which nothing but white space is left is
    dropped. Rows with a null ``doc_id`` or ``text`` stay as they are.
    """
    key, lost = fresh(docs, "__id"), fresh(docs, "__gone")
    # a bit a line, 64 in a word, so that each line of a document is looked up in constant time
    bits = repeated.groupBy(F.col("doc_id").alias(key), F.expr("line div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, line % 64))").alias("bits"))
    gone = bits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"), F.max("word").alias("top"))
    gone = gone.select(key, F.expr("transform(sequence(0L, top), w -> coalesce(bits[w], 0L))").alias(lost))
    is_gone = lambda i: F.getbit(F.get(F.col(lost), F.floor(i / 64).cast("int")), i % 64) == 1
    text = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(is_gone(i), F.lit(False))), "\n")
    columns = [c for c in docs.columns]
    out = docs.join(gone, F.col("doc_id") == F.col(key), "left").withColumn("text", F.when(F.col(lost).isNull() | F.col("text").isNull(), F.col("text")).otherwise(text))
    out = out.where(F.col(lost).isNull() | F.col("text").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(f"`{c}`" for c in columns))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with each line removed that is similar to an earlier one; see :func:`repeated_lines` and :func:`without_lines`."""
    return without_lines(docs, repeated_lines(docs, threshold))
