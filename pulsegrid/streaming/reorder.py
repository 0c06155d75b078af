"""Packets put back in order of their device's time, as a stateful streaming query.

A device's packets wait in state until the watermark has passed their time, and leave in order, each with its place
among all of the device's.  Devices are dealt to shards by a hash of their name, and a shard is a group of the state: a
batch costs a few state calls and one timer for each shard, and not for each device or packet; within a shard packets
are sorted and counted as columns.  State is bounded by what devices send within the watermark's delay and a batch, and
a row for each device.  Packets later than the watermark are dropped by Spark and counted (``run``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.operators.windows import written

#: Timers are set at multiples of so many milliseconds.
STEP_MS = 600_000
#: Groups that devices are dealt to; fixed for the life of a checkpoint.
SHARDS = 512
#: Packets, about, of a batch that callers who choose the stretches should aim at: one task writes and reads a batch.
BATCH_ROWS = 2_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(1 << 62)


def _packed(df: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


class Reorder(StatefulProcessor):
    """Waits for earlier packets of a shard's devices; ``overtaken`` says whether one of a later time had arrived before."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packets binary")  # each an Arrow batch (key, packet_id, time_ns, overtaken)
        self.told = handle.getValueState("told", "devices binary")  # an Arrow batch (key, place, latest_ns)

    def _told(self, packets: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        """Which row of the table of devices each packet belongs to, and that table, new devices added."""
        told = _unpacked(self.told.get()[0]) if self.told.exists() else pd.DataFrame({self.key: [], "place": np.array([], np.int64), "latest_ns": np.array([], np.int64)})
        names = np.concatenate([told[self.key].to_numpy(object), packets[self.key].to_numpy(object)])
        code, devices = pd.factorize(names, use_na_sentinel=False)
        new = len(devices) - len(told)
        of = lambda c, missing: np.concatenate([told[c].to_numpy(np.int64), np.full(new, missing, np.int64)])
        return code[len(told) :], pd.DataFrame({self.key: np.where(pd.isna(devices), None, devices), "place": of("place", 0), "latest_ns": of("latest_ns", NEVER)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["arrival_ns", "packet_id"], ignore_index=True)
        device, told = self._told(new)
        latest = told["latest_ns"].to_numpy()[device]
        before = new["time_ns"].groupby(device).cummax().groupby(device).shift(1, fill_value=NEVER).to_numpy(np.int64)
        self.waiting.appendValue((_packed(new[[self.key, "packet_id", "time_ns"]].assign(overtaken=np.maximum(before, latest) > new["time_ns"])),))
        np.maximum.at(latest := told["latest_ns"].to_numpy().copy(), device, new["time_ns"].to_numpy())
        self.told.update((_packed(told.assign(latest_ns=latest)),))
        self.handle.registerTimer((int(new["time_ns"].max()) // 1_000_000 // STEP_MS + 1) * STEP_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000
        held = [_unpacked(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        held = pd.concat(held, ignore_index=True) if held else None
        if held is None or not (held["time_ns"] < until).any():
            return
        ready, rest = held[held["time_ns"] < until].sort_values(["time_ns", "packet_id"], ignore_index=True), held[held["time_ns"] >= until]
        self.waiting.put([(_packed(rest),)]) if len(rest) else self.waiting.clear()
        device, told = self._told(ready)
        place = told["place"].to_numpy()[device] + ready.groupby(device).cumcount().to_numpy() + 1
        self.told.update((_packed(told.assign(place=told["place"] + np.bincount(device, minlength=len(told)))),))
        yield ready.assign(place=place)[[self.key, "packet_id", "time_ns", "place", "overtaken"]]

    def close(self) -> None:
        pass


def reordered(packets: DataFrame, key: str, late: str, shards: int = SHARDS) -> DataFrame:
    """(key, packet_id, time_ns, place, overtaken) of a stream (key, packet_id, time_ns, arrival_ns), in order by key."""
    kind = packets.schema[key].dataType.simpleString()
    timed = packets.withColumn("_at", F.timestamp_micros(F.expr("time_ns div 1000"))).withWatermark("_at", late)
    named = timed.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("_shard"), F.col(key).cast("string").alias(key), "packet_id", "time_ns", "arrival_ns", "_at")  # whole numbers with nulls would be floats in pandas
    out = named.groupBy("_shard").transformWithStateInPandas(
        Reorder(key), outputStructType=f"{key} string, packet_id long, time_ns long, place long, overtaken boolean", outputMode="Append", timeMode="EventTime",
    )
    return out.withColumn(key, F.col(key).cast(kind))


def in_order(packets: DataFrame, key: str) -> DataFrame:
    """The same rows from a table."""
    order = Window.partitionBy(key).orderBy("time_ns", "packet_id")
    arrived = Window.partitionBy(key).orderBy("arrival_ns", "packet_id").rowsBetween(Window.unboundedPreceding, -1)
    overtaken = F.coalesce(F.max("time_ns").over(arrived) > F.col("time_ns"), F.lit(False))
    return packets.select(key, "packet_id", "time_ns", F.row_number().over(order).cast("long").alias("place"), overtaken.alias("overtaken"))


def run(spark: SparkSession, source: str, schema, out: str, key: str, late: str) -> int:
    """Read the files of ``source`` as they came, write packets in order to ``out``; returns how many came too late."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        packets = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = reordered(packets, key, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}_state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def arrive(packets: DataFrame, path: str, key: str, batches: int, end: bool = True) -> None:
    """Write a table's packets as they arrive, a file for each stretch of arrival time; ``packets`` is worked out once.

    With ``end`` a last packet without a key follows, far behind all, so that the watermark passes every other.
    """
    packets = written(packets)
    low, high, last = packets.agg(F.min("arrival_ns"), F.max("arrival_ns"), F.max("time_ns")).first()
    if low is None:
        return
    width = (high - low) // batches + 1
    for k in range(batches):
        packets.filter(F.col("arrival_ns").between(low + k * width, low + (k + 1) * width - 1)).repartition(1).write.mode("append").parquet(path)
    for k in range(2 if end else 0):
        at = last + (k + 1) * 30 * 86_400 * 10**9
        packets.sparkSession.range(1).select(F.lit(None).cast(packets.schema[key].dataType).alias(key), F.lit(-1 - k).cast("long").alias("packet_id"), F.lit(at).alias("time_ns"), F.lit(at).alias("arrival_ns")).select(*packets.columns).write.mode("append").parquet(path)
