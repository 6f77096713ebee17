"""Dictionary files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of new files with the version and decoder of their header; other files have none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    raw = F.hex(F.substring("content", 9, 4))
    little = F.concat(*(F.substring(raw, k, 2) for k in (7, 5, 3, 1)))
    is_one = F.substring(F.hex("content"), 1, 14) == "4C696E67566F00"
    version = F.when(is_one, F.conv(little, 16, 10).cast("int"))
    return files.select("path", "modificationTime", "length", version.alias("version"), F.when(is_one, T.decoder_of(version)).alias("decoder"))
