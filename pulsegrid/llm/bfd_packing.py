"""Best-fit-decreasing packing into id matrices.

Within a block of documents, pieces go by falling length into the open sequence with the least room that still
holds them; a segment tree over the amounts of free room finds it in a few steps.  Documents longer than a sequence
are split without loss: whole sequences first, the rest as a piece of its own.  A block is what one task has read,
up to ``BLOCK_TOKENS``: the table is packed without a shuffle, and a lost task packs the same block again.

Each sequence comes with its padded row of the id matrix, the cumulative lengths of its segments, and position ids
that begin again at 0 with each segment.

Defined cases: null text counts as empty, which is the separator alone; repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import prepare, text_of
from pulsegrid.llm.tokenization import encoder

CAPACITY = 4096
SEPARATOR_ID = 2
PAD_ID = 0
#: Tokens packed together: 8 million, 16 MB of 2-byte ids.
BLOCK_TOKENS = 8 << 20


class RoomTree:
    """Counts of open sequences by free room; finds the least room that is at least some length."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._bump(room, 1)

    def take(self, room: int) -> int:
        self._bump(room, -1)
        return self.open[room].pop()

    def _bump(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def best(self, length: int) -> int | None:
        """Least room of an open sequence that is at least ``length``."""
        count, at = self.count, length + self.leaves
        if not count[at]:
            while at & 1 or not count[at + 1]:  # up until a sibling to the right has any
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indices into ``lengths`` (none above ``capacity``)."""
    tree, bins = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.best(lengths[i])
        if room is None:
            room, at = capacity, len(bins)
            bins.append([])
        else:
            at = tree.take(room)
        bins[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return bins


def pack_best_fit(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator_id: int = SEPARATOR_ID, pad_id: int = PAD_ID,
    block_tokens: int = BLOCK_TOKENS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """A row for each sequence.

    sequence_id, n_tokens, doc_ids, starts (of each segment in its document), cu_seqlens, input_ids (the padded
    matrix row, little-endian, 2 bytes an id where the vocabulary allows, else 4), position_ids (2 bytes each up to
    a capacity of 65,536, else 4), ids_crc32 (of the unpadded ids as unsigned 32-bit).
    """
    prepare(docs.sparkSession)
    light = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(light.schema["doc_id"].dataType)), T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("input_ids", T.BinaryType()),
        T.StructField("position_ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def emit(held: list[tuple], dtype: np.dtype, kind: pa.DataType, first: int) -> pa.RecordBatch:
        pieces = [(i, at, min(capacity, len(ids) - at)) for i, (_, ids) in enumerate(held) for at in range(0, len(ids), capacity)]
        bins = best_fit_decreasing([p[2] for p in pieces], capacity)
        place = np.dtype("<u2" if capacity <= 1 << 16 else "<u4")
        out: list[list] = [[] for _ in schema]
        for at, members in enumerate(bins):
            parts = [pieces[m] for m in members]
            ids = np.concatenate([held[i][1][s : s + n] for i, s, n in parts])
            row = np.full(capacity, pad_id, dtype)
            row[: len(ids)] = ids
            spots = np.zeros(capacity, place)
            spots[: len(ids)] = np.concatenate([np.arange(n, dtype=place) for _, _, n in parts])
            cumulative = np.cumsum([0, *(n for _, _, n in parts)]).tolist()
            values = (first + at, len(ids), [held[i][0] for i, _, _ in parts], [s for _, s, _ in parts], cumulative, row.tobytes(), spots.tobytes(), zlib.crc32(ids.astype("<u4").tobytes()))
            for column, v in zip(out, values, strict=True):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([separator_id], enc.dtype).tobytes()
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        held, n, kind = [], 0, pa.int64()
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                whole = np.frombuffer(ids + end, enc.dtype)
                held.append((doc, whole))
                n += len(whole)
            if n >= block_tokens:
                out = emit(held, enc.dtype, kind, first)
                first += out.num_rows
                held, n = [], 0
                yield out
        if held:
            yield emit(held, enc.dtype, kind, first)

    return light.mapInArrow(run, schema)


def write_matrices(packed: DataFrame, path: str) -> DataFrame:
    """Write the sequences as raw matrices, and return the manifest, which names the files of finished tasks only.

    For each task: ``*.ids`` (rows of input ids), ``*.positions`` (rows of position ids), and ``*.lengths``
    (cumulative segment lengths as int32, the segments of one row after another).  ``path`` is shared by all nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        name = os.path.join(root, f"matrix-{uuid.uuid4().hex}")
        rows = segments = 0
        with where.open_output_stream(f"{name}.ids") as ids, where.open_output_stream(f"{name}.positions") as spots, where.open_output_stream(f"{name}.lengths") as lengths:
            for b in batches:
                for row, places, cumulative in zip(*(b.column(c).to_pylist() for c in ("input_ids", "position_ids", "cu_seqlens")), strict=True):
                    ids.write(row)
                    spots.write(places)
                    lengths.write(np.array(cumulative, "<i4").tobytes())
                    rows, segments = rows + 1, segments + len(cumulative)
        if rows:
            yield pa.RecordBatch.from_pydict({"file": [name], "n_rows": pa.array([rows], pa.int64()), "n_lengths": pa.array([segments], pa.int64())})

    return packed.select("input_ids", "position_ids", "cu_seqlens").mapInArrow(run, "file string, n_rows long, n_lengths long")
