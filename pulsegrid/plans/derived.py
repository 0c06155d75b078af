"""Derived tables that follow their source: only partitions that a change reaches are made again.

Tables are cut by keys (a person, say) and by a unit of time (a day).  Beside a derived table stands the state of the
source it was made from: a hash of the rows of each partition, and the version of what made it.  The next update
hashes the source again, finds the partitions that differ, spreads each to the later units whose rows look back at it,
reads what those need, and replaces them.  Nothing but hashes is compared, and all of it is joins on partition keys.

``reach`` is how many units a row looks back: 0 for its own unit alone, None where there is no bound (carried values,
recursive filters); then all later units of the key are made again, from all of its rows.

Defined cases: a missing table or another version makes everything; partitions that are gone from the source go from
the table, and a unit that is empty now still reaches later ones; a source without changes starts no writing.  The
state is written last, so an update that is broken off is made again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import windows
from pulsegrid.sources import tables


@dataclass(frozen=True)
class Change:
    """What an update has to do with one source: its partitions now, those that differ from the state, and whether there was one."""

    now: DataFrame  # keys, unit, rows, hash, version
    differing: DataFrame  # keys, unit, rows_a (before), rows_b (now)
    keys: list[str]
    unit: str
    known: bool


def _step(c: Column, by: int, kind: str) -> Column:
    return F.date_add(c, by) if kind == "date" else c + F.lit(by)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def find_changes(source: DataFrame, state: str, keys: list[str], unit: str, version: str = "") -> Change:
    """Partitions of ``source`` by ``keys`` and ``unit`` (a date or a whole number) that differ from those in ``state``."""
    spark, parts = source.sparkSession, [*keys, unit]
    now = windows.written(tables.partition_hashes(source, parts, source.columns).withColumn("version", F.lit(version)))
    before = _stored(spark, state)
    if before is not None and not before.filter(F.col("version") != version).isEmpty():
        before = None
    differing = tables.differing_hashes(before if before is not None else now.limit(0), now, parts)
    return Change(now, windows.written(differing), keys, unit, before is not None)


def reached(change: Change, reach: int | None) -> DataFrame:
    """(keys, unit): partitions to make again, there now or gone."""
    keys, unit = change.keys, change.unit
    kind = change.now.schema[unit].dataType.typeName()
    every = change.now.select(*keys, unit).unionByName(change.differing.select(*keys, unit)).distinct()
    if reach is None:
        first = change.differing.groupBy(*keys).agg(F.min(unit).alias("_first"))
        return windows.back(every, first, keys).filter(F.col(unit) >= F.col("_first")).drop("_first")
    steps = F.explode(F.sequence(F.lit(0), F.lit(reach)))
    spread = change.differing.select(*keys, unit, steps.alias("_k")).select(*keys, _step(F.col(unit), F.col("_k"), kind).alias(unit)).distinct()
    return windows.back(every, spread, [*keys, unit])


def needed(change: Change, remade: DataFrame, reach: int | None) -> DataFrame:
    """(keys, unit): partitions of the source that the rows of ``remade`` look at."""
    keys, unit = change.keys, change.unit
    kind = change.now.schema[unit].dataType.typeName()
    if reach is None:
        last = remade.groupBy(*keys).agg(F.max(unit).alias("_last"))
        return windows.back(change.now.select(*keys, unit), last, keys).filter(F.col(unit) <= F.col("_last")).drop("_last")
    steps = F.explode(F.sequence(F.lit(0), F.lit(reach)))
    return remade.select(*keys, unit, steps.alias("_k")).select(*keys, _step(F.col(unit), -F.col("_k"), kind).alias(unit)).distinct()


def only(df: DataFrame, parts: DataFrame, names: list[str], max_rows: int = 100_000) -> DataFrame:
    """Rows of ``df`` in the partitions ``parts``; a small list is broadcast, by which Spark prunes folders."""
    return windows.back(df, tables.broadcast_if_small(parts.select(*names), max_rows), names, "left_semi")


def remove(spark: SparkSession, files: DataFrame) -> None:
    """Delete the files named by the column ``file``, one at a time, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in files.select("file").distinct().toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"]))
        path.getFileSystem(conf).delete(path, False)


def remake(source: DataFrame, change: Change, make: Callable[[DataFrame], DataFrame], reach: int | None, write: Callable[[DataFrame], object], path: str) -> DataFrame:
    """Bring the table at ``path`` up to ``source``; returns the partitions (keys, unit) that were made again.

    ``make`` derives rows with the same keys and unit; ``write`` replaces the partitions of the rows it gets, and no
    others.
    """
    spark, names = source.sparkSession, [*change.keys, change.unit]
    stored = _stored(spark, path)
    if stored is None or not change.known:
        remade = windows.written(change.now.select(*names).unionByName(change.differing.select(*names)).distinct())
        rows = make(source)
    else:
        remade = windows.written(reached(change, reach))
        if remade.isEmpty():
            return remade
        rows = only(make(only(source, needed(change, remade, reach), names)), remade, names)
    made = windows.written(rows)  # read twice: to be written, and to tell what is gone
    left = None
    if stored is not None:
        old = stored.select(*names, F.col("_metadata.file_path").alias("file"))
        if change.known:
            old = only(old, remade, names)
        # listed before anything is written, after which these files may not be there any more
        left = windows.written(windows.back(old, made.select(*names).distinct(), names, "left_anti").select("file").distinct())
    if not made.isEmpty():
        write(made)
    if left is not None:
        remove(spark, left)
    return remade


def commit(change: Change, state: str) -> None:
    """Remember the source's partitions; to be called when all tables made from it are written."""
    change.now.write.mode("overwrite").parquet(state)


def update(source: DataFrame, make: Callable[[DataFrame], DataFrame], home: str, name: str, keys: list[str], unit: str, reach: int | None, version: str = "") -> DataFrame:
    """One derived table under ``home`` with its state beside it; returns the partitions that were made again."""
    state, path = f"{home}/_state/{name}", f"{home}/{name}"
    change = find_changes(source, state, keys, unit, version)

    def write(df: DataFrame) -> None:
        df.repartition(*keys, unit).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, unit).parquet(path)

    remade = remake(source, change, make, reach, write, path)
    commit(change, state)
    return remade
