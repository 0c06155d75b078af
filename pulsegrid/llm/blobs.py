"""One copy of each distinct text, and an append-only table of what was found out about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import broadcast_if_small

#: Unseen keys up to this number are broadcast to spare cached texts the shuffle; 64 characters each.
BROADCAST_KEYS = 200_000


def open_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, created empty where it is missing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        return spark.read.schema(schema).parquet(path)


def unseen(keyed: DataFrame, key: str, text: str, seen: DataFrame) -> DataFrame:
    """One (key, text) for each key that ``seen`` lacks.

    The texts move once: copies meet within each map task first, so a text that a third of all rows share sends
    one row a task, and the anti-join reuses that partitioning.  Keys are content digests, so any copy will do.
    """
    fresh = keyed
    known = bool(seen.take(1))
    if known:
        new = keyed.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")
        small = broadcast_if_small(new, BROADCAST_KEYS)
        if small is not new:
            return keyed.join(small, key, "left_semi").groupBy(key).agg(F.first(text).alias(text))
    once = fresh.groupBy(key).agg(F.first(text).alias(text))
    return once.join(seen.select(key).distinct(), key, "left_anti") if known else once


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(text, 256)
