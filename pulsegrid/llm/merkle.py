"""Merkle manifest of a dataset: a tree of fan-out 16 over each source's rows, and one over the sources.

1. Leaves: a row's digest is made where its text lies; texts are never moved, only digests are.
2. Index: digests are range-sorted by (source, id), each partition counts its rows by source, and running totals of
   these counts (a row for each partition and source) give every leaf its place in its source.
3. Stacks: a task walks its rows in order with one mountain range a source: a stack of pending nodes by level, in which
   every sixteen aligned nodes carry into their parent, and a source's last, shorter run closes without padding.
   Whole runs are emitted as node records; nodes whose run starts or ends in another partition are emitted as edges.
4. Merging: edges meet by (source, level, run), at most 16 a group, and carry upward level by level.
5. Proofs: from the root downward each run gets its path (the siblings of its parent and of all above it); a row joins
   its lowest run and folds its own digest up the path inside the JVM.

A source with a third of all rows is many partitions, since ranges and runs are cut by place and not by source.  All
levels are written tables, so a lost executor costs its tasks only.

Defined cases: null fields are ``-`` in a leaf; null ids come first, and rows of one id are ordered by their leaf, so the
manifest depends on the rows alone; equal rows are leaves of their own, and since they are alike so may their places
be swapped; a null source is a source of its own and comes first; an empty table has no rows and no root; columns that
aren't part of a leaf are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, broadcast_if_small, materialise, prepare

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a range partition, about: some ten MB.
PARTITION_LEAVES = 100_000
#: Counts by partition and source up to this number are broadcast.
BROADCAST_COUNTS = 200_000


def digest_of_row(fields: dict[str, Column]) -> Column:
    """SHA-256 (32 bytes) of the row's fields, each ``-`` or its UTF-8 size, a colon and its value."""
    parts = []
    for c in fields.values():
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hash(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


class Range:
    """Mountain range of one source within a task: pending nodes by level, from ``start`` on."""

    def __init__(self, group: bytes, total: int, fan_out: int, emit: Callable[[bytes, int, int, list[bytes]], None]):
        self.group, self.fan_out, self.emit = group, fan_out, emit
        self.sizes = [total]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fan_out))
        self.pending: list[tuple[int, list[bytes]]] = [(0, []) for _ in self.sizes]

    def add(self, level: int, place: int, node: bytes) -> None:
        """Put a node behind the pending ones of its level; a run that is whole becomes its parent, on the level above."""
        while True:
            first, nodes = self.pending[level]
            if not nodes:
                first, nodes = place, []
                self.pending[level] = (first, nodes)
            nodes.append(node)
            last = place == self.sizes[level] - 1
            if len(self.sizes) - 1 == level or not (last or place % self.fan_out == self.fan_out - 1):
                return
            if first % self.fan_out:  # the run began in another partition
                self.edges(level)
                return
            self.emit(self.group, level, first // self.fan_out, nodes)
            self.pending[level] = (0, [])
            level, place, node = level + 1, place // self.fan_out, _hash(nodes)

    def edges(self, level: int) -> None:
        """Hand out what is pending on a level as it is, a piece of one run."""
        first, nodes = self.pending[level]
        if nodes:
            self.emit(self.group, level, -1 - first, nodes)
            self.pending[level] = (0, [])

    def close(self) -> None:
        for level in range(len(self.sizes)):
            self.edges(level)


#: Node records: a whole run of children, or (``whole`` false) a piece of one that begins at place ``first``.
RECORDS = "grp binary, level int, first long, whole boolean, nodes binary, total long"


def _stacked(rows: DataFrame, fan_out: int) -> DataFrame:
    """Node records of each task's rows (grp, place, total, leaf), which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: Range | None = None
        expected, total = -1, 0

        def emit(group: bytes, level: int, run_: int, nodes: list[bytes]) -> None:
            whole = run_ >= 0
            out.append((group, level, run_ * fan_out if whole else -1 - run_, whole, b"".join(nodes), total))

        def batch() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["grp", "level", "first", "whole", "nodes", "total"])
            out.clear()
            return made

        for b in batches:
            for group, place, n, leaf in zip(*(b.column(c).to_pylist() for c in ("grp", "place", "total", "leaf")), strict=True):
                if state is None or state.group != group or place != expected:
                    if state is not None:
                        state.close()
                    total = n
                    state = Range(group, n, fan_out, emit)
                state.add(0, place, leaf)
                expected = place + 1
            if len(out) >= 1000:
                yield batch()
        if state is not None:
            state.close()
        if out:
            yield batch()

    # files come back in order of their rows but several to a task: sorted, their rows follow each other
    return rows.select("grp", "place", "total", "leaf").sortWithinPartitions("grp", "place").mapInArrow(run, RECORDS)


def _whole_nodes(pieces: Column) -> Column:
    """The nodes of a run, from its pieces in order of place."""
    ordered = F.array_sort(F.collect_list(F.struct("first", pieces.alias("nodes"))))
    return F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["nodes"]))


def hash_nodes(nodes: Column) -> Column:
    return F.unhex(F.sha2(F.lower(F.hex(nodes)), 256))


def indexed(leaves: DataFrame, order: list[str], label: str, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """Add ``place`` (from 0 within ``grp``, by ``order``) and ``total``; the result is written in order."""
    n = leaves.count()
    parts = max(1, -(-n // partition_leaves))
    names = leaves.columns
    ranged = leaves.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *ids], names=[*b.schema.names, "part", "at"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields)
    numbered = materialise(ranged.mapInArrow(run, f"{schema}, part int, at long"), f"{label}_sorted")
    counts = numbered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("start"))
    over = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a source
    before = counts.select("grp", "part", "rows", (F.coalesce(F.sum("rows").over(over), F.lit(0)) - F.col("start")).alias("shift"))
    totals = before.groupBy("grp").agg(F.sum("rows").alias("total"))
    known = materialise(before.join(totals, "grp").select("grp", "part", "shift", "total"), f"{label}_offsets")
    placed = numbered.join(broadcast_if_small(known, BROADCAST_COUNTS), ["grp", "part"])
    return placed.select(*names, (F.col("at") + F.col("shift")).alias("place"), "total")


def tree(placed: DataFrame, label: str, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame, int]:
    """(runs, tops, levels) of leaves with their places.

    ``runs`` (grp, level, run, nodes): the children of every node, 32 bytes each; ``tops`` (grp, node): what remains of
    each group; ``levels``: the most levels of runs in any group.
    """
    made = materialise(_stacked(placed, fan_out), f"{label}_nodes")
    edges = made.filter(~F.col("whole"))
    runs = made.filter("whole").select("grp", "level", (F.col("first") / fan_out).cast("long").alias("run"), "nodes", F.col("total"))
    most = made.agg(F.max("total")).first()[0] or 0
    levels, size = 0, most
    while size > 1:
        levels, size = levels + 1, -(-size // fan_out)
    tops = edges.filter(f"level = {_height('total', fan_out)}").select("grp", F.col("nodes").alias("node"))
    carried = None
    for level in range(levels):
        here = edges.filter((F.col("level") == level) & (F.lit(level) < F.expr(_height("total", fan_out)))).select("grp", "first", "nodes", "total")
        if carried is not None:
            here = here.unionByName(carried.filter(F.lit(level) < F.expr(_height("total", fan_out))))
        group = here.groupBy("grp", (F.col("first") / fan_out).cast("long").alias("run")).agg(_whole_nodes(F.col("nodes")).alias("nodes"), F.max("total").alias("total"))
        merged = materialise(group, f"{label}_merged")
        runs = runs.unionByName(merged.select("grp", F.lit(level).alias("level"), "run", "nodes", "total"))
        carried = merged.select("grp", F.col("run").alias("first"), hash_nodes(F.col("nodes")).alias("nodes"), "total")
        tops = tops.unionByName(carried.filter(F.lit(level + 1) == F.expr(_height("total", fan_out))).select("grp", F.col("nodes").alias("node")))
    return runs, tops, levels


def _height(total: str, fan_out: int) -> str:
    """Levels of runs above ``total`` leaves, as SQL of whole numbers."""
    steps, size = [], fan_out
    while size < 1 << 62:
        steps.append(size)
        size *= fan_out
    return f"CASE WHEN {total} <= 1 THEN 0 " + " ".join(f"WHEN {total} <= {s} THEN {k + 1}" for k, s in enumerate(steps)) + f" ELSE {len(steps) + 1} END"


STEP = "struct<before:binary,after:binary>"


def _step(nodes: Column, k: Column) -> Column:
    """The siblings before and after child ``k`` of a run."""
    return F.struct(F.substring(nodes, F.lit(1), (k * 32).cast("int")).alias("before"), F.substring(nodes, (k * 32 + 33).cast("int"), F.lit(1 << 30)).alias("after"))


def paths(runs: DataFrame, above: DataFrame, levels: int, label: str, fan_out: int = FAN_OUT) -> DataFrame:
    """(grp, run, nodes, path) of the lowest runs: ``path`` are the steps of their parent and of all above it.

    ``above`` (grp, path): the steps of each group's top, which its own top run starts from.
    """
    nothing = F.array().cast(f"array<{STEP}>")
    known = None
    for level in reversed(range(levels)):
        here = runs.filter(F.col("level") == level)
        top = F.expr(_height("total", fan_out)) == level + 1
        first = here.filter(top).join(above, "grp").select("grp", "run", "nodes", "path")
        if known is None:
            made = first
        else:
            parent = known.withColumnsRenamed({"run": "up", "nodes": "siblings", "path": "rest"})
            below = here.filter(~top).withColumn("up", (F.col("run") / fan_out).cast("long")).join(parent, ["grp", "up"])
            own = F.array(_step(F.col("siblings"), F.col("run") % fan_out))
            made = first.unionByName(below.select("grp", "run", "nodes", F.concat(own, F.coalesce("rest", nothing)).alias("path")))
        known = materialise(made, f"{label}_paths") if level else made
    return known


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None,
             fan_out: int = FAN_OUT, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """A row for each row: its id, ``leaf``, ``subroot`` of its source, ``root``, ``path`` and what it proves.

    ``proof_sha256`` hashes the siblings, and ``folded_root`` is the root as it follows from the row's fields with
    ``tampered`` put in place of some of them; ``verified`` says whether it equals ``root``.  Digests are hex.
    """
    spark = rows.sparkSession
    prepare(spark)
    columns = {c: F.col(c) for c in fields}
    group = F.when(F.col(source).isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), F.encode(F.col(source), "UTF-8")))
    leaf, other = digest_of_row(columns), digest_of_row(columns | (tampered or {}))
    leaves = materialise(rows.select(F.col(order).alias("id"), group.alias("grp"), leaf.alias("leaf"), F.nullif(other, leaf).alias("other")), "leaves")
    placed = materialise(indexed(leaves, ["id", "leaf"], "leaves", partition_leaves), "placed")
    runs, tops, levels = tree(placed, "rows", fan_out)
    tops = materialise(tops, "tops")
    crowns = materialise(indexed(tops.select(F.lit(b"").cast("binary").alias("grp"), F.col("grp").alias("name"), F.col("node").alias("leaf")), ["name"], "sources", partition_leaves), "crowns")
    upper, root, height = tree(crowns, "sources", fan_out)
    found = root.first()
    if found is None:
        return spark.createDataFrame([], f"id {rows.schema[order].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    nothing = F.array().cast(f"array<{STEP}>")
    start = spark.range(1).select(F.lit(b"").cast("binary").alias("grp"), nothing.alias("path"))
    named = crowns.select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "place")
    if height:
        ends = paths(upper, start, height, "sources", fan_out).select("run", F.col("nodes").alias("siblings"), F.col("path").alias("rest"))
        joined = named.withColumn("run", (F.col("place") / fan_out).cast("long")).join(ends, "run")
        above = joined.select("grp", "subroot", F.concat(F.array(_step(F.col("siblings"), F.col("place") % fan_out)), "rest").alias("path"))
    else:
        above = named.select("grp", "subroot", nothing.alias("path"))
    above = materialise(above, "above")
    subroots = broadcast_if_small(above.select("grp", "subroot"), BROADCAST_COUNTS)
    lone = placed.filter("total = 1").join(above.select("grp", "path"), "grp").select("grp", "id", "leaf", "other", "path")
    low = placed.filter("total > 1").withColumn("run", (F.col("place") / fan_out).cast("long"))
    if levels:
        tails = paths(runs, broadcast_if_small(above.select("grp", "path"), 50_000), levels, "rows", fan_out)
        whole = low.join(tails, ["grp", "run"]).select("grp", "id", "leaf", "other", F.concat(F.array(_step(F.col("nodes"), F.col("place") % fan_out)), "path").alias("path"))
        lone = lone.unionByName(whole)
    hexed = lambda b: F.lower(F.hex(b))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "")
    fold = F.aggregate("path", hexed(F.coalesce("other", "leaf")), lambda a, s: F.sha2(F.concat(hexed(s["before"]), a, hexed(s["after"])), 256))
    proved = lone.select("grp", "id", hexed(F.col("leaf")).alias("leaf"), F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root"))
    with_top = proved.join(subroots, "grp")
    top = found["node"].hex()
    return with_top.select("id", "leaf", hexed(F.col("subroot")).alias("subroot"), F.lit(top).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(top)).alias("verified"))


def lowered_text(sample: Column, text: str = "text") -> dict[str, Column]:
    """The tampering of the manifest's check: where ``sample`` holds, A-Z of the text are lower-cased; nulls stay."""
    return {text: F.when(F.coalesce(sample, F.lit(False)), ascii_lower(F.col(text))).otherwise(F.col(text))}


def differing_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """(subroot): roots of sources that only one of two manifests has; rows of other sources need not be compared."""
    one, two = (m.select("subroot").distinct() for m in (a, b))
    return one.join(two, "subroot", "left_anti").unionByName(two.join(one, "subroot", "left_anti"))
