"""Connected components by minimum labels with shortcuts, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round takes the least label among the neighbours and then the label of that label, so labels travel
    twice as far each time.  Minima are taken before the shuffle, and joins are plain equi-joins whose large keys
    adaptive execution splits, so a node of very many edges needs no task of its own.  Every round is written to
    the shared folder, and the one before it deleted; whether any label changed is all that reaches the driver.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = materialise(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        step = labels.join(near, "a").select("a", "l", F.least("l", "nl").alias("m"))
        jump = step.join(labels.select(F.col("a").alias("m"), F.col("l").alias("ml")), "m", "left")
        new = materialise(jump.select("a", F.least("m", F.coalesce("ml", "m")).alias("l"), (F.least("m", F.coalesce("ml", "m")) < F.col("l")).alias("moved")), "labels")
        discard(labels)
        if new.filter("moved").isEmpty():
            discard(both)
            return new.select(F.col("a").alias("node"), F.col("l").alias("component"))
        labels = new.select("a", "l")
