"""What the corpus operators share: text normalisation, checked broadcasts, tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of text in an Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS = 1000
#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 64 << 20
#: Workers serve task after task: freed arrays go back to the system instead of staying in each worker.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package by the driver's path, and keep them and their Arrow batches small.

    On a cluster whose nodes lack that path, ship the package with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session; a cluster's nodes would each have their own, so
    there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that outlive executors.

    Texts are worth zstd; it holds memory outside the heap for each open column, so small tables stay with snappy.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more; those of a store that Arrow can't open stay."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        try:
            where, path = pafs.FileSystem.from_uri(folder)
            where.delete_dir(path)
        except (OSError, ValueError):
            continue


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores after it, such that ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` is that for pure ASCII, and much faster than ``translate``."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, UPPER.lower())
    )


def is_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, and those at most ``max_bytes`` bytes as JSON."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return seen["n"] <= max_rows and seen["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if it is small in rows and bytes; else Spark's shuffled join is used."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
