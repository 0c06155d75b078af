"""The reordering stream against its batch form, with and without late packets."""

import numpy as np

from pulsegrid.streaming import reorder

HOUR = 3600 * 10**9


def packets(spark, n=200, most=2 * HOUR):
    rng = np.random.default_rng(5)
    times = np.sort(rng.integers(0, 48 * HOUR, n))
    rows = [(f"d{k % 3}" if k % 2 else "hot", k, int(t), int(t + rng.integers(0, most))) for k, t in enumerate(times)]
    rows += [("hot", n, rows[0][2], rows[0][3] + 5)]  # a tie in time
    return spark.createDataFrame(rows, "device string, packet_id long, time_ns long, arrival_ns long")


def test_stream_equals_batch(spark, tmp_path):
    p = packets(spark)
    reorder.arrive(p, f"{tmp_path}/in", "device", 4)
    assert reorder.run(spark, f"{tmp_path}/in", p.schema, f"{tmp_path}/out", "device", "3 hours") == 0
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("packet_id >= 0").collect())
    expected = sorted(tuple(r) for r in reorder.in_order(p, "device").collect())
    assert got == expected and any(r[4] for r in got)


def test_late_packets_are_counted(spark, tmp_path):
    p = packets(spark, most=1)
    late = spark.createDataFrame([("hot", 900, 5, 60 * HOUR)], p.schema)
    reorder.arrive(p.union(late), f"{tmp_path}/in", "device", 5)
    n = reorder.run(spark, f"{tmp_path}/in", p.schema, f"{tmp_path}/out", "device", "1 hour")
    rows = spark.read.parquet(f"{tmp_path}/out").filter("packet_id >= 0")
    assert n == 1 and rows.count() == 201 and rows.filter("packet_id = 900").isEmpty()


def test_state_is_by_shard(spark, tmp_path):
    """Many devices share a group of the state: a batch costs rows of state by shards, not by devices."""
    rows = [(None if k == 7 else k % 300 + (1 << 60), k, HOUR + k * 10**9, HOUR + (k + k * 7919 % 100) * 10**9) for k in range(900)]
    p = spark.createDataFrame(rows, "device long, packet_id long, time_ns long, arrival_ns long")
    reorder.arrive(p, f"{tmp_path}/in", "device", 3)
    stream = reorder.reordered(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "device", "1 hour", shards=4)
    spark.conf.set(reorder.STORE, reorder.ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        most = max(s["numRowsTotal"] for x in query.recentProgress for s in x["stateOperators"])
    finally:
        spark.conf.unset(reorder.STORE)
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").filter("packet_id >= 0").collect()))
    assert got == sorted(map(str, reorder.in_order(p, "device").collect())) and most < 100
