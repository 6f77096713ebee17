"""Balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed

#: Shards, and about how many groups are differenced together.
SHARDS, GROUPS = 32, 20_000
#: So many partial partitions are differenced together, by the driver when no more are left.
FAN = 1024


def difference(items: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """Lays partial partitions onto each other: for each item, the shard of each of its parts.

    An item is one size, or the k sums of a partial partition. The two with the
    largest spread are combined again and again, the largest parts of one with
    the smallest of the other, until one is left.
    """
    if not items:
        return []
    heap = []
    for n, sums in enumerate(items):
        parts = sorted(((int(x), j) for j, x in enumerate(sums)), reverse=True)
        parts += [(0, -1)] * (k - len(parts))
        # a slot is a tree of (item, part)
        heap.append((-(parts[0][0] - parts[-1][0]), n, [x for x, _ in parts], [(n, j) if j >= 0 else None for _, j in parts]))
    heapq.heapify(heap)
    fresh = len(items)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        both = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))), reverse=True)
        slots = [(left[i], right[k - 1 - i], None) if left[i] is not None and right[k - 1 - i] is not None else left[i] or right[k - 1 - i] for _, i in both]
        heapq.heappush(heap, (-(both[0][0] - both[-1][0]), fresh, [x for x, _ in both], slots))
        fresh += 1
    out = [[0] * len(x) for x in items]
    for shard, slot in enumerate(heap[0][3]):
        todo = [slot] if slot is not None else []
        while todo:
            slot = todo.pop()
            if len(slot) == 3:
                todo.extend(slot[:2])
            else:
                out[slot[0]][slot[1]] = shard
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, groups: int = GROUPS) -> DataFrame:
    """Shard of every document: doc_id, group_id, n_bytes (UTF-8) and shard (from 0).

    Documents of equal text are one group and are never parted, so copies
    don't end up on both sides of a split. Groups are hashed into buckets, as
    many as the number of documents asks for, and each bucket is differenced
    into a partial partition in parallel. The partial partitions, with their
    sums alone, are differenced in the same way, ``FAN`` at a time, until one
    is left. Ties go by ``group_id``; the session's settings don't matter.

    Null texts are one group of 0 bytes, as are empty ones; a null ``doc_id``
    is kept; repeated rows each count and stay together. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("group_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    buckets = max(1, math.ceil(docs.count() / groups))
    sizes = docs.groupBy("group_id").agg(F.sum("n_bytes").alias("size")).withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("group_id", "ascending")])
        part = [x[0] for x in difference([(s,) for s in table.column("size").to_pylist()], shards)]
        return pa.table({"bucket": table.column("bucket"), "group_id": table.column("group_id"), "size": table.column("size"), "part": pa.array(part, pa.int32())})

    parted = checkpointed(sizes.groupBy("bucket").applyInArrow(local, "bucket long, group_id long, size long, part int"))
    sums = parted.groupBy("bucket", "part").agg(F.sum("size").alias("size"))
    while buckets > FAN:
        above = checkpointed(sums.groupBy((F.floor(F.col("bucket") / FAN)).alias("top")).applyInArrow(lambda key, table: _placed(table, shards, key[0].as_py()), "top long, bucket long, part int, size long, place int"))
        parted = parted.join(above.select("top", "bucket", "part", "place"), ["bucket", "part"]).select(F.col("top").alias("bucket"), "group_id", F.col("place").alias("part"))
        sums = above.groupBy(F.col("top").alias("bucket"), F.col("place").alias("part")).agg(F.sum("size").alias("size"))
        buckets = math.ceil(buckets / FAN)
    # at most FAN times shards rows
    table = spark.createDataFrame(_placed(sums.toArrow(), shards, 0).select(["bucket", "part", "place"]), "bucket long, part int, place int")
    where = parted.join(F.broadcast(table), ["bucket", "part"]).select("group_id", F.col("place").alias("shard"))
    return docs.join(where, "group_id").select("doc_id", "group_id", "n_bytes", "shard")


def _placed(table: pa.Table, shards: int, top: int) -> pa.Table:
    """Rows of partial partitions (bucket, part, size), with the place of each part when they are laid onto each other."""
    sums: dict[int, list[int]] = {}
    for bucket, part, size in zip(*(table.column(c).to_pylist() for c in ("bucket", "part", "size"))):
        sums.setdefault(bucket, [0] * shards)[part] = size
    order = sorted(sums)
    rows = [(b, p, sums[b][p], s) for b, x in zip(order, difference([sums[b] for b in order], shards)) for p, s in enumerate(x)]
    bucket, part, size, place = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"top": pa.array([top] * len(rows), pa.int64()), "bucket": pa.array(bucket, pa.int64()), "part": pa.array(part, pa.int32()), "size": pa.array(size, pa.int64()), "place": pa.array(place, pa.int32())})
