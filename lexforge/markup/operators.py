"""Markup on columns: nodes as rows, and printed forms; a text that can't be parsed gives its error, not a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from . import tree

NODE = StructType()
for _name in ("node_id", "parent_id", "pos", "depth"):
    NODE = NODE.add(_name, IntegerType())
NODE = NODE.add("kind", StringType()).add("text", StringType()).add("attrs", MapType(StringType(), StringType()))


#: Bytes of text that are parsed before what came of them is sent on, and nodes that are sent at once.
TEXTS, NODES = 1 << 18, 4096
_ATTRS = pa.map_(pa.string(), pa.string())
_NODE = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), _ATTRS)
_PRINTED = pa.struct([("out", pa.string()), ("error", pa.string())])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Where they begin, and slices of about ``TEXTS`` bytes; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TEXTS, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def parsed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each node of each text; a bad text has one row with ``error``. Rows are sent on as they come: of a task's texts the nodes of one are held."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    names = [*rows.columns[:-1], "error", *NODE.names]

    def of(t: str | None) -> tuple[list[tuple], str | None]:
        if t is None:
            return [], None
        try:
            return list(tree.parse(t).walk()), None
        except (tree.MarkupError, RecursionError) as e:
            return [], str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            errors: list[str | None] = []
            nodes: list[tuple] = []

            def batch() -> pa.RecordBatch:
                kept = [b.column(k).take(pa.array(at, pa.int32())) for k in range(b.num_columns - 1)]
                made = [pa.array(x, kind) for x, kind in zip(zip(*nodes), _NODE)]
                out = pa.RecordBatch.from_arrays([*kept, pa.array(errors, pa.string()), *made], names)
                at.clear(), errors.clear(), nodes.clear()
                return out

            for start, texts in _pieces(b.column(b.num_columns - 1)):
                for row, t in enumerate(texts.to_pylist(), start):
                    found, error = of(t)
                    for i, p, k, d, n in found or [(None, None, None, None, None)]:
                        at.append(row)
                        errors.append(error)
                        nodes.append((i, p, k, d, None, None, None) if n is None else (i, p, k, d, n.kind, n.text, [(a, str(v)) for a, v in n.attrs.items() if a != "grid"]))
                        if len(nodes) >= NODES:
                            yield batch()
            if nodes:
                yield batch()

    schema = StructType([*rows.schema.fields[:-1], StructField("error", StringType()), *NODE.fields])
    return rows.mapInArrow(run, schema)


def printed(text: Column, form: Callable[[tree.Node], str]) -> Column:
    """``tree.dsl``, ``tree.dsl_heading``, ``tree.html`` or ``tree.outline`` of each text, with its error; sent on in pieces."""

    def one(t: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if t is None else form(tree.parse(t))), None
        except (tree.MarkupError, RecursionError) as e:
            return None, str(e)

    @F.arrow_udf(StructType().add("out", StringType()).add("error", StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for _, texts in _pieces(b):
                yield pa.array([one(t) for t in texts.to_pylist()], _PRINTED)

    return run(text)
