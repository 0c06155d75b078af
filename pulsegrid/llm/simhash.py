"""Near-duplicates by SimHash fingerprints, compared bit-sliced.

Fingerprints that differ in at most ``radius`` bits agree on at least ``bands - radius`` of ``bands`` bands; rows
meet under every such choice of bands, so no link is lost.  Within a bucket the candidates' bits lie vertically:
one 64-bit word holds one bit of 64 fingerprints.  A query's differences are added up in carry-save counters, 64
distances at a time, and a block of 64 is left as soon as all of its distances exceed the radius.  From each bucket
only a spanning forest of its links leaves; components follow from those.

Equal fingerprints are one node, so copies meet before any comparison.  Buckets beyond ``TILE`` rows are dealt into
tiles by hash and compared tile by tile in separate tasks.

Defined cases: null text counts as empty; texts without words have fingerprint 0 and link like any other; repeated
rows give a row each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, prepare, text_of
from pulsegrid.llm.graph import connected_components

WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a bucket that are compared in one task.
TILE = 4096
#: Cells (query x 64 candidates) that are compared at once; bounds memory to some 50 MB.
CELLS = 400_000
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """64 bits, each set if set in over half of the XXH64 values of the word shingles."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= width:
        hashes = digest(whole, seed)
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begin = np.concatenate(([0], stops[: n - width])).tolist()
        end = (stops[width - 1 :] - 1).tolist()
        hashes = b"".join([digest(whole[i:j], seed) for i, j in zip(begin, end, strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)  # big-endian
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), BLOCK):
        ones += np.unpackbits(rows[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
    """(row, doc_id, fp): fp is the fingerprint as a signed 64-bit integer, row ``row_column`` or a number given here."""
    spark = docs.sparkSession
    prepare(spark)
    row = F.col(row_column) if row_column else F.monotonically_increasing_id()
    light = docs.select(row.alias("row"), F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    schema = light.select("row", "doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fps.view(np.int64))], names=schema.names)

    return light.mapInArrow(run, schema)


def band_choices(n: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bands as (shift, bits), and the choices of bands under which rows meet.

    More rows take more bands, so that buckets stay near a thousand rows; every choice finds every link.
    """
    spare = 1
    while spare < 4 and n >> (64 * spare // (radius + spare)) > 1024:
        spare += 1
    bands = radius + spare
    edges = [64 * i // bands for i in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)], list(combinations(range(bands), spare))


def bucket_keys(fp: Column, bands: list[tuple[int, int]], choices: list[tuple[int, ...]]) -> Column:
    """The keys under which a fingerprint meets others: the number of the choice, and the bits that it keeps."""
    masks = [sum(((1 << bits) - 1) << shift for shift, bits in (bands[i] for i in choice)) for choice in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose 3-bit counters exceed the radius."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in (2, 1, 0):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def sliced_matches(queries: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For cells (query, word of 64 candidates): the cells with matches, and the matching lanes as bits.

    ``planes[j, w]`` has bit j of the 64 candidates of word w; ``lanes[w]`` marks its candidates that are there.
    """
    cell = np.arange(len(query))
    c = [np.zeros(len(query), np.uint64) for _ in range(3)]
    past = np.zeros(len(query), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = queries[query]
    for j in range(0, 64, 2):
        x = planes[j][word] ^ ((value >> np.uint64(63 - j) & np.uint64(1)) * full)
        y = planes[j + 1][word] ^ ((value >> np.uint64(62 - j) & np.uint64(1)) * full)
        half = x ^ y  # full adder of two planes and the lowest counter
        carry = (x & y) | (c[0] & half)
        c[0] ^= half
        carry2 = c[1] & carry
        c[1] ^= carry
        past |= c[2] & carry2
        c[2] ^= carry2
        if j % 8 == 6 or j == 62:
            alive = ~(past | _over(c, radius)) & lanes[word]
            kept = np.flatnonzero(alive)
            if len(kept) < 0.7 * len(alive) or j == 62:  # blocks that all exceed the radius are left
                cell, word, value, past = cell[kept], word[kept], value[kept], past[kept]
                c = [x[kept] for x in c]
                if not len(kept):
                    break
    alive = ~(past | _over(c, radius)) & lanes[word] if len(cell) else np.zeros(0, np.uint64)
    return cell, word, alive


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of ``label`` along the pairs (a, b); roots are the least members."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def block_forest(fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each group (rows come sorted by group).

    side 0: the group is compared with itself; else sides 1 and 2 are compared with each other only.
    """
    n = len(fp)
    label = np.arange(n)
    asks, answers = side != 2, side != 1
    cand = np.flatnonzero(answers)
    g = group[cand]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(g)))
    words = (sizes + 63) // 64
    base = np.concatenate(([0], np.cumsum(words)))[:-1]
    slot = np.repeat(base * 64, sizes) + np.arange(len(g)) - np.repeat(first, sizes)
    total = int(words.sum())
    row_of = np.full(total * 64, -1)
    row_of[slot] = cand
    packed = np.zeros(total * 64, np.uint64)
    packed[slot] = fp[cand]
    bits = np.unpackbits(packed.byteswap().view(np.uint8).reshape(total, 64, 8), axis=2)  # word, lane, bit from the top
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    lanes = np.packbits((row_of >= 0).reshape(total, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    ask = np.flatnonzero(asks)
    if not total or not len(ask):
        return fp[:0], fp[:0]
    where = np.searchsorted(group[cand][first], group[ask])
    there = (where < len(first)) & (group[cand][first][np.minimum(where, len(first) - 1)] == group[ask])
    ask, where = ask[there], where[there]
    n_cells = words[where]
    stops = np.cumsum(n_cells)
    at = 0
    while at < len(ask):
        upto = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + CELLS, "right")))
        rows, k = ask[at:upto], n_cells[at:upto]
        query = np.repeat(np.arange(len(rows)), k)
        word = np.repeat(base[where[at:upto]], k) + np.arange(len(query)) - np.repeat(np.cumsum(k) - k, k)
        cell, met, alive = sliced_matches(fp[rows], planes, query, word, lanes, radius)
        for part in range(0, len(cell), 1 << 15):  # dense blocks have up to 64 pairs a cell
            sl = slice(part, part + (1 << 15))
            pairs = np.unpackbits(alive[sl].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(pairs)
            a, b = rows[query[cell[sl][i]]], row_of[met[sl][i] * 64 + lane]
            label = hook(label, a, b)
        at = upto
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) from which all links' components follow."""
    bands, choices = band_choices(distinct.count(), radius)
    met = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), bands, choices)).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = met.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = materialise(sizes.select("choice", "bits", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "buckets")
    dealt = met.join(many, ["choice", "bits"]).withColumn("own", F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = dealt.select("fp", "choice", "bits", "own", other).select(
        "fp", "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    key = ["choice", "bits", "i", "j"]
    tasks = pairs.repartition(*key).sortWithinPartitions(*key).select("fp", "side", F.xxhash64(*key).alias("bucket"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, side, bucket in _whole_groups(batches):
            group = np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]).astype(np.int64))))
            x, y = block_forest(fp.view(np.uint64), group, side, radius)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return tasks.mapInArrow(compare, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gather batches until ``rows`` rows are there, and pass on whole buckets only."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        n += b.num_rows
        if n >= rows:
            fp, side, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[-1])
            if cut:
                yield fp[:cut], side[:cut], bucket[:cut]
            held, n = [[fp[cut:], side[cut:], bucket[cut:]]], n - cut
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, radius: int = RADIUS, tile: int = TILE, id_column: str = "doc_id", text_column: str = "text",
    row_column: str | None = None,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, row), one row for each row of ``docs``.

    component_id is the least id reachable (null if all are null); component names the same group by one of its
    fingerprints, so that groups of null ids stay apart.
    """
    rows = materialise(fingerprints(docs, width, seed, id_column, text_column, row_column), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = connected_components(materialise(links(nodes.select("fp"), radius, tile), "links"))
    named = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = materialise(named.join(ids, "component").select("fp", "component_id", "component"), "components")
    word = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return rows.join(of_fp, "fp").select("doc_id", word("fp").alias("fingerprint"), "component_id", word("component").alias("component"), "row")
