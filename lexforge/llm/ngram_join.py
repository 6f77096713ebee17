"""Near-duplicate documents by an exact n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._setjoin import Similar, Spec, similar
from ._text import dropped, fresh, stored

#: Words of an n-gram, and the least Jaccard similarity of near duplicates.
N, THRESHOLD = 2, 0.6


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Every document that has a copy or a near duplicate, with its class and its links.

    Documents are compared by their sets of n-grams of words (of fewer than n
    words: the whole text). Those with equal sets are a class. Returns doc_id,
    class_id (the least ``doc_id`` of the class), copies (documents of the
    class), links (the other classes that are similar to it, each counted once
    and none left out), match_doc_id (the least ``class_id`` of these, null if
    there are none) and jaccard (with that, else 1.0). So a passage with
    thousands of exact copies gives thousands of rows, not millions.

    Documents with no word have no near duplicates, nor those with a null
    ``doc_id`` or ``text``. Rows that share a ``doc_id`` are never linked with
    each other; where their texts differ the document has a row for each. An
    empty table gives an empty result; other columns are ignored.
    """
    found = similar(docs, Spec(False, n, threshold))
    units = found.units.select("sig", "sig2", "doc_id").distinct()
    classes = units.groupBy("sig", "sig2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).join(found.best(), ["sig", "sig2"], "left").where("copies > 1 or links is not null")
    return units.join(classes, ["sig", "sig2"]).select(
        "doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("match.at.doc_id").alias("match_doc_id"), F.coalesce("match.jaccard", F.lit(1.0)).alias("jaccard")
    )


def groups(edges: DataFrame) -> DataFrame:
    """Connected components of edges u, v: doc_id, first (the least ``doc_id`` of its group) of every document but the first itself.

    Alternates between linking each document's larger and its smaller
    neighbours to the least of them, until nothing changes; the number of
    rounds grows with the logarithm of the longest chain. Every round is
    written to the shared folder, and deleted when the next one is there.
    """
    edges = stored(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small)
        dropped(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("first"))
        before = now


def _edges(found: Similar) -> DataFrame:
    """Each document to the first of its class, and each class to the first of its part of a cell: as connected as all links, in as many rows as documents and sets in cells."""
    units = found.units.select("sig", "sig2", "doc_id")
    first = units.groupBy("sig", "sig2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    copies = units.join(first.where("copies > 1"), ["sig", "sig2"]).select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    near = found.links.join(first, ["sig", "sig2"]).select(F.col("first").alias("u"), F.col("root_doc").alias("v"))
    return copies.union(near)


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of a group of near duplicates that aren't its first.

    A group is what links connect. Rows with a null ``doc_id`` or ``text`` stay,
    as do texts without a word and all rows of the ``doc_id`` that is the first.
    An empty table stays empty; all columns are kept as they are.
    """
    key = fresh(docs, "__id")
    gone = groups(_edges(similar(docs, Spec(False, n, threshold)))).select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
