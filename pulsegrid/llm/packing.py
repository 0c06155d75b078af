"""Packing along a space-filling curve.

Token ids of a document are hashed into a count vector, projected to a few dimensions and placed on a Hilbert
curve; documents are range-sorted by that key and laid end to end, so neighbours on the curve share sequences.  The
stream is cut every ``capacity`` tokens: all sequences are full but the last one of all.

Ids are encoded once and stored; only (key, length) are sorted, and positions come from sums within the sorted
partitions and over their totals.  The stored ids then move once, to be cut.

Defined cases: null text counts as empty, which is the separator alone; ties on the curve go by id and then by row,
so copies of one text spread over partitions; repeated rows are documents of their own; an empty table gives an
empty result; other columns are ignored, whatever their names; long documents are cut without loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import materialise, prepare, text_of
from pulsegrid.llm.tokenization import encoder

CAPACITY = 4096
SEPARATOR_ID = 2
#: Hash buckets of the vector, dimensions and bits of the curve.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 10


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (integers below 2 ** bits), after Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (x[i] >> b & 1)
    return key


def curve_points(ids: list[np.ndarray], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hashed count vectors of unit length under a fixed random projection, squashed to the grid."""
    projection = np.random.default_rng(20_240_229).standard_normal((BUCKETS, dimensions))
    hashed = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    out = np.zeros((len(ids), dimensions))
    for row, x in enumerate(ids):
        if len(x):
            v = np.bincount(hashed[x & 0xFFFF].astype(np.int64), minlength=BUCKETS).astype(float)
            out[row] = v @ projection / np.sqrt(v @ v)
    return np.minimum((1 << bits) / (1 + np.exp(-1.702 * out)), (1 << bits) - 1).astype(np.int64)


def encode_documents(docs: DataFrame, tokenizer_path: str, separator_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, key, n_tokens, ids): ids are zstd-compressed little-endian, with the separator at the end."""
    prepare(docs.sparkSession)
    light = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    schema = T.StructType([light.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shrink = encoder(tokenizer_path), zstandard.ZstdCompressor(1)
        end = np.array([separator_id], enc.dtype).tobytes()
        for b in batches:
            found = enc.ids(b.column("text").to_pylist())
            keys = hilbert_keys(curve_points([np.frombuffer(x, enc.dtype) for x in found]), BITS)
            n = [len(x) // enc.dtype.itemsize + 1 for x in found]
            ids = pa.array([shrink.compress(x + end) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(n, pa.int64()), ids], names=schema.names)

    return light.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def positions(encoded: DataFrame) -> DataFrame:
    """(row, begin): where each document begins in the stream along the curve."""
    order = ["key", "doc_id", "row"]
    ranged = encoded.select(*order, "n_tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "curve")
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("base"))
    within = ranged.select("row", "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("local"))
    return within.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("local")).alias("begin"))


def pack_along_curve(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator_id: int = SEPARATOR_ID, with_ids: bool = True,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key.

    ``ids_crc32`` is taken over little-endian unsigned 32-bit ids; ``with_ids`` adds those bytes as ``ids``.
    """
    encoded = materialise(encode_documents(docs, tokenizer_path, separator_id, id_column, text_column), "encoded")
    placed = materialise(positions(encoded), "positions")
    schema = T.StructType(
        [encoded.schema["doc_id"]]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key")]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, grow = encoder(tokenizer_path).dtype, zstandard.ZstdDecompressor()
        for b in batches:
            source, rows, blobs = [], [], []
            cols = (b.column(n).to_pylist() for n in ("begin", "key", "n_tokens", "ids"))
            for i, (begin, key, n, ids) in enumerate(zip(*cols, strict=True)):
                wide = np.frombuffer(grow.decompress(ids), dtype).astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, capacity)
                    stop = min(n, at + capacity - offset)
                    piece = wide[at:stop].tobytes()
                    source.append(i)
                    rows.append((at, stop - at, zlib.crc32(piece), n, sequence, offset, key))
                    if with_ids:
                        blobs.append(piece)
                    at = stop
            numbers = np.array(rows, np.int64).reshape(-1, 7)
            columns = [b.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(numbers[:, k]) for k in range(7))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, names=schema.names)

    moved = encoded.select("row", "doc_id", "key", "n_tokens", "ids").join(placed, "row")
    return moved.select("doc_id", "begin", "key", "n_tokens", "ids").mapInArrow(cut, schema)
