"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted arrays, mapped by workers.

Words are named by XXH64 and then by their rank among the sorted hashes.  An n-gram is named by one 64-bit key: the
rank of its context (the n-gram of one word less before it) and the rank of its last word.  So orders are counted
one after another, each by the sorted keys of the one before.  Tasks count a bounded stretch of text, sort the keys
and send them as compressed blocks to the shard that owns the context, where blocks are merged; so what moves is
pre-aggregated, and a frequent word or n-gram sends one entry a block.  Shards hold about ``SHARD_BYTES`` of text
each, whatever the size of the corpus; the longest row of followers that one context can have is the vocabulary.
They write sorted arrays to the shared folder; the driver sees one manifest row a shard and the counts of counts.
Workers map the files into memory and look keys up by binary search.

The highest order uses counts, lower ones numbers of distinct left neighbours, each with three discounts from its
counts of counts; the last is interpolated with a uniform share for unseen words.  A text is preceded by as many
start symbols as a context has words; they are context only.

Words whose XXH64 are equal would be one.  Their XXH32 is stored beside each: where two words of the training
texts clash, the model is counted anew under another seed, and a word outside them that meets a stored hash is
known only if the second one agrees.

Defined cases: null text counts as empty, which is the end token alone; without training tokens the model is the
uniform share (score of each token log10(1 / (V + 1)), V = 0); repeated rows give a row each; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh_path, materialise, prepare, text_of

#: The end token; no word holds white space.
END = b"\n"
#: Distinct words, and bigrams, that a task counts before it sends them on; words kept by a worker's memo.
FLUSH_WORDS, FLUSH_PAIRS, MEMO_WORDS = 400_000, 3_000_000, 500_000
ADD = 0.1
#: Words of an n-gram, and bytes of text for each shard.
ORDER, SHARD_BYTES = 3, 32 << 20
#: Seeds under which words are hashed, in the order in which they are tried.
SEEDS = range(8)
BLOCK_SCHEMA = "shard int, keys binary, counts binary"
WORD_SCHEMA = "shard int, keys binary, counts binary, second binary"
NOTE_SCHEMA = "kind string, shard int, n long, total long, n1 long, n2 long, n3 long, n4 long, path string, keys binary, counts binary"


def squeeze(a: np.ndarray) -> bytes:
    """Sorted unsigned integers: differences, bytes of equal weight together, then zstd."""
    step = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype)[:, 0], dtype=dtype)


def squeeze_counts(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(len(a), 8).T).tobytes())


def unsqueeze_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8")[:, 0].astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash: shards one after another are sorted as a whole."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def context_shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return hash_shard(ids * np.uint64(0x9E3779B97F4A7C15), shards)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """One file of arrays, each behind a line with its kind and length; its unique name makes repeats harmless."""
    where, root = _store(folder)
    where.create_dir(root, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(os.path.join(root, path)) as out:
        for a in arrays:
            out.write(f"{a.dtype.str:<8}{len(a):<56}".encode())
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    return path


def map_arrays(folder: str, path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory.  A file of a remote store is copied to an unlinked local file first."""
    where, root = _store(folder)
    local = os.path.join(root, path)
    if not isinstance(where, pafs.LocalFileSystem):
        with where.open_input_stream(local) as source, tempfile.NamedTemporaryFile() as copy:
            while block := source.read(1 << 24):
                copy.write(block)
            copy.flush()
            whole = np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)
    else:
        whole = np.memmap(local, np.uint8, "r")
    out, at = [], 0
    while at < len(whole):
        kind, n = bytes(whole[at : at + 64]).decode().split()
        size = int(n) * np.dtype(kind).itemsize
        out.append(whole[at + 64 : at + 64 + size].view(kind))
        at += 64 + size + -size % 64
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``table``, and whether they are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class WordClash(ValueError):
    """Two words of the training texts have one hash."""


@dataclass(frozen=True)
class WordTable:
    """Where the sorted word hashes, their counts and second hashes are; one entry a shard."""

    folder: str
    shards: int
    files: tuple[tuple[int, str, int], ...]  # shard, file, words
    tokens: int
    seed: int = 0

    @property
    def size(self) -> int:
        return sum(n for *_, n in self.files)

    @property
    def bits(self) -> int:
        """Bits of a word's rank; the start symbol has the rank after the last word, and the last number is no word's."""
        return (self.size + 1).bit_length()


@dataclass(frozen=True)
class Level:
    """One order from two words up: where its sorted keys and what belongs to them are, by shard; and counts of counts."""

    order: int
    keys: tuple[tuple[int, str, int], ...]  # shard, file, n-grams
    values: tuple[tuple[int, str], ...]
    ones: tuple[int, ...]  # how many n-grams count 1, 2, 3 and 4


@dataclass(frozen=True)
class NgramModel:
    words: WordTable
    order: int
    levels: tuple[Level, ...]
    left: tuple[tuple[int, str], ...]  # numbers of left neighbours of words, by shard
    left_ones: tuple[int, ...]
    left_totals: tuple[int, int, int, int]  # their sum; words with 1, 2, 3 and more

    @property
    def folder(self) -> str:
        return self.words.folder


#: Discounts where counts of counts can't give them (a very small corpus): half of each count, 3 for the last.
FALLBACK = (0.5, 1.0, 1.5)


def discounts(n: tuple[int, ...]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from counts of counts.

    One that is undefined, or not above 0 and at most its count, is replaced by its fallback, so that unseen words
    always keep some share.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [k - (k + 1) * y * b / a if a and b else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(d if 0 < d <= k else f for k, d, f in zip((1, 2, 3), raw, FALLBACK, strict=True))])


class Lookup:
    """A worker's view of the word table: ids and counts of words, with a bounded memo."""

    def __init__(self, table: WordTable) -> None:
        import xxhash

        self.digest, self.second_digest, self.table, self.memo = xxhash.xxh64_intdigest, xxhash.xxh32_intdigest, table, {}
        self.base, self.keys, self.counts, self.second = {}, {}, {}, {}
        n = 0
        for shard, path, size in table.files:
            self.base[shard] = n
            self.keys[shard], self.counts[shard], self.second[shard] = map_arrays(table.folder, path)
            n += size

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ranks of words, -1 for unknown ones."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        new = list({w for w in words if w not in memo})
        if new:
            hashes = np.fromiter((self.digest(w, self.table.seed) for w in new), np.uint64, len(new))
            second = np.fromiter(map(self.second_digest, new), np.uint32, len(new))
            memo.update(zip(new, self.ranks(hashes, second).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def ranks(self, hashes: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        shard = hash_shard(hashes[order], self.table.shards)
        for s in np.unique(shard):
            if s in self.keys:
                rows = order[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")]
                at, there = find(self.keys[s], hashes[rows])
                there[there] = self.second[s][at[there]] == second[rows[there]]
                out[rows[there]] = at[there] + self.base[s]
        return out

    def by_rank(self, arrays: dict[int, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Values of arrays that lie by word rank; 0 for unknown words."""
        out = np.zeros(len(ids), np.int64)
        shards = sorted(self.base, key=self.base.get)
        owner = np.searchsorted([self.base[s] for s in shards], ids, "right") - 1
        for k in np.unique(owner[ids >= 0]):
            rows = np.flatnonzero((owner == k) & (ids >= 0))
            out[rows] = arrays[shards[k]][ids[rows] - self.base[shards[k]]]
        return out


_OPEN: dict[str, object] = {}


def opened(kind: type, source, *more):
    """The worker's open tables; one of a kind at a time stays open."""
    key = f"{kind.__name__} {source} {more}"
    if key not in _OPEN:
        for k in [k for k in _OPEN if k.startswith(f"{kind.__name__} ")]:
            del _OPEN[k]
        _OPEN[key] = kind(source, *more)
    return _OPEN[key]


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, then the end."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def _blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block for each shard, of keys in order."""
    order = np.lexsort((keys, shard))
    keys, counts, shard = keys[order], counts[order], shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[a]], pa.int32()), "keys": pa.array([squeeze(keys[a:b])], pa.binary()), "counts": pa.array([squeeze_counts(counts[a:b])], pa.binary())})


def _merged(batches: Iterator[pa.RecordBatch], kind: type = np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard by shard (rows come sorted by shard): distinct keys and summed counts.  Folded as they come in."""
    shard, keys, counts, held = None, [], [], 0

    def fold():
        return summed(np.concatenate(keys), np.concatenate(counts))

    for b in batches:
        for s, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if s != shard and shard is not None:
                yield shard, *fold()
                keys, counts, held = [], [], 0
            shard = s
            keys.append(unsqueeze(k, kind))
            counts.append(unsqueeze_counts(c))
            held += len(keys[-1])
            if held > 2 * FLUSH_PAIRS:
                k0, c0 = fold()
                keys, counts, held = [k0], [c0], 0
    if shard is not None:
        yield shard, *fold()


def _note(kind: str, shard: int, path: str = "", n: int = 0, total: int = 0, of: np.ndarray | None = None, keys: bytes | None = None, counts: bytes | None = None) -> pa.RecordBatch:
    some = [int((of == k).sum()) for k in (1, 2, 3, 4)] if of is not None else [0] * 4
    values = [kind, shard, n, total, *some, path, keys, counts]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["kind", "shard", "n", "total", "n1", "n2", "n3", "n4", "path", "keys", "counts"])


def by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard")


def same_words(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where each distinct word begins among sorted hashes; ``WordClash`` where second hashes of one hash differ."""
    same = keys[1:] == keys[:-1]
    if (second[1:][same] != second[:-1][same]).any():
        raise WordClash("two words have one hash")
    return np.flatnonzero(np.concatenate(([True], ~same)))


def count_words(train: DataFrame, shards: int, folder: str, seed: int) -> WordTable:
    """The sorted table of all training words (with the end) of rows (text); ``WordClash`` where two have one hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def flush() -> Iterator[pa.RecordBatch]:
            keys, second = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in seen), np.uint64, len(seen)), np.fromiter(map(xxhash.xxh32_intdigest, seen), "<u4", len(seen))
            order = np.argsort(keys)  # equal ranges of the hash are shards, so this sorts by shard as well
            keys, second, counts = keys[order], second[order], np.fromiter(seen.values(), np.int64, len(seen))[order]
            seen.clear()
            shard = hash_shard(keys, shards)
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[a]], pa.int32()), "keys": pa.array([squeeze(keys[a:b])], pa.binary()), "counts": pa.array([squeeze_counts(counts[a:b])], pa.binary()),
                                                  "second": pa.array([second[a:b].tobytes()], pa.binary())})

        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(tokens(t))
            if len(seen) > FLUSH_WORDS:
                yield from flush()
        if seen:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def fold() -> list[np.ndarray]:
            keys, counts, second = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts, second = keys[order], counts[order], second[order]
            first = same_words(keys, second)
            return [keys[first], np.add.reduceat(counts, first), second[first]]

        def note() -> pa.RecordBatch:
            keys, counts, second = fold()
            return _note("words", shard, write_arrays(folder, f"words-{shard}", [keys, counts, second]), len(keys), int(counts.sum()))

        for b in batches:
            for s, k, c, d in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if s != shard and shard is not None:
                    yield note()
                    held = []
                shard = s
                held.append([unsqueeze(k, np.uint64), unsqueeze_counts(c), np.frombuffer(d, "<u4")])
                if sum(len(h[0]) for h in held) > 2 * FLUSH_PAIRS:
                    held = [fold()]
        if shard is not None:
            yield note()

    notes = by_shard(train.mapInArrow(count, WORD_SCHEMA), shards).mapInArrow(merge, NOTE_SCHEMA)
    rows = sorted(notes.select("shard", "path", "n", "total").collect())  # a row for each shard
    return WordTable(folder, shards, tuple((r["shard"], r["path"], r["n"]) for r in rows), sum(r["total"] for r in rows), seed)


class Ngrams:
    """A worker's view of the sorted keys of one order: ranks of n-grams, and the keys that ranks stand for."""

    def __init__(self, level: Level, words: WordTable) -> None:
        self.shards, self.bits = words.shards, words.bits
        self.keys = {s: map_arrays(words.folder, path)[0] for s, path, _ in level.keys}
        self.order = [s for s, *_ in level.keys]
        self.base = dict(zip(self.order, np.cumsum([0, *(n for *_, n in level.keys)])[:-1].tolist(), strict=True)) if self.order else {}
        self.starts = np.array([self.base[s] for s in self.order], np.int64)

    def places(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Shard by shard: which of ``keys`` (sorted) it owns, their places in it, and whether they are there."""
        shard = context_shard(keys >> np.uint64(self.bits), self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0, [True]))) if len(order) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            if (s := int(shard[rows[0]])) in self.keys:
                yield s, rows, *find(self.keys[s], keys[rows])

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key, -1 where it isn't there.  Each distinct key is looked up once."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        for s, rows, at, there in self.places(distinct):
            out[rows[there]] = at[there] + self.base[s]
        return out[back]

    def of_ranks(self, ranks: np.ndarray) -> np.ndarray:
        """The keys of ranks."""
        out = np.zeros(len(ranks), np.uint64)
        owner = np.searchsorted(self.starts, ranks, "right") - 1
        for k in np.unique(owner):
            rows = np.flatnonzero(owner == k)
            out[rows] = self.keys[self.order[k]][ranks[rows] - self.starts[k]]
        return out


class Chain:
    """A worker's view of the keys of all lower orders: from word ranks to the key of the n-gram that ends at each token."""

    def __init__(self, levels: tuple[Level, ...], words: WordTable) -> None:
        self.look, self.tables = opened(Lookup, words), [Ngrams(level, words) for level in levels]
        self.start, self.bits = words.size, np.uint64(words.bits)

    def joined(self, left: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << self.bits | ids.astype(np.uint64)

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For contexts of 1, 2 and more words: the rank of that before each token, -1 where it was never seen.

        ``first`` are the places where texts begin.  Ranks of unknown words are -1.
        """
        def before(x: np.ndarray, at_first: int) -> np.ndarray:
            out = np.concatenate(([at_first], x[:-1]))
            out[first] = at_first
            return out

        out, start = [before(ids, self.start)], self.start
        for table in self.tables:
            # the n-gram that ends at each token, and then the one that ends before it
            known = (out[-1] >= 0) & (ids >= 0)
            ending = np.full(len(ids), -1, np.int64)
            ending[known] = table.ranks(self.joined(out[-1][known], ids[known]))
            start = int(table.ranks(self.joined(np.array([start]), np.array([self.start])))[0])
            out.append(before(ending, start))
        return out


def count_order(train: DataFrame, words: WordTable, levels: tuple[Level, ...], n_starts: int, last: bool) -> tuple[DataFrame, Level]:
    """Sorted keys of the n-grams of the next order over rows (text); notes with numbers of left neighbours of the order below.

    ``last``: counts are kept, and what belongs to them is written at once.  Lower orders keep the n-grams of start
    symbols alone as well, as contexts.
    """
    shards, bits, folder, order = words.shards, np.uint64(words.bits), words.folder, len(levels) + 2
    room = 1 << (64 - words.bits)
    if (sum(n for *_, n in levels[-1].keys) if levels else words.size + 1) >= room:
        raise ValueError(f"more contexts of {order - 1} words than fit {64 - words.bits} bits beside a word's rank")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = opened(Chain, levels, words)
        held, n = [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return summed(np.concatenate([keys, k]), np.concatenate([counts, c])) if len(keys) else (k, c)

        for b in batches:
            split = [tokens(t) for t in b.column("text").to_pylist()]
            if not split:
                continue
            ids = chain.look.ids([w for ws in split for w in ws])
            first = np.cumsum([0, *map(len, split)])[:-1]
            context = chain.contexts(ids, first)[-1]
            held.append(chain.joined(context, ids))
            if not last:  # a start symbol after the start symbols
                held.append(chain.joined(context[first[:1]], np.array([words.size])))
            n += len(ids)
            if n > FLUSH_PAIRS:
                keys, counts = fold()
                held, n = [], 0
                if len(keys) > FLUSH_PAIRS:
                    yield from _blocks(keys, counts, context_shard(keys >> bits, shards))
                    keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = fold()
        if len(keys):
            yield from _blocks(keys, counts, context_shard(keys >> bits, shards))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = opened(Chain, levels, words)
        for shard, keys, counts in _merged(batches):
            real = (keys & np.uint64((1 << words.bits) - 1)) != np.uint64(words.size)
            if last:
                keys, counts, real = keys[real], counts[real], real[real]
                path = write_arrays(folder, f"order{order}-{shard}", [keys])
                yield _note("values", shard, write_arrays(folder, f"values{order}-{shard}", context_arrays(keys, counts, words)), of=counts)
            else:
                path = write_arrays(folder, f"order{order}-{shard}", [keys])
            yield _note("keys", shard, path, len(keys), int(counts.sum()))
            # each distinct n-gram is one left neighbour of what follows its first word
            lower = np.sort(without_first(keys[real], below))
            if len(lower):
                at = np.flatnonzero(np.concatenate(([True], lower[1:] != lower[:-1])))
                found, lefts = lower[at], np.diff(np.append(at, len(lower)))
                owner = context_shard(found >> bits, shards) if levels else owners(found, words)
                for block in _blocks(found, lefts, owner):
                    s, k, c = (block.column(i)[0].as_py() for i in range(3))
                    yield _note("left", s, keys=k, counts=c)

    blocks = by_shard(train.mapInArrow(count, BLOCK_SCHEMA), shards)
    notes = materialise(blocks.mapInArrow(merge, NOTE_SCHEMA), "ngram_notes")
    some = ("n1", "n2", "n3", "n4")
    rows = sorted(notes.filter("kind = 'keys'").select("shard", "path", "n").collect())  # a row for each shard
    values = sorted(notes.filter("kind = 'values'").select("shard", "path", *some).collect())
    level = Level(order, tuple((r["shard"], r["path"], r["n"]) for r in rows), tuple((r["shard"], r["path"]) for r in values), tuple(sum(r[k] for r in values) for k in some))
    return notes.filter("kind = 'left'"), level


def without_first(keys: np.ndarray, chain: Chain) -> np.ndarray:
    """The keys of n-grams less their first word: for pairs the word's rank, else the key one order below."""
    bits, mask = chain.bits, np.uint64((1 << int(chain.bits)) - 1)
    if not chain.tables:
        return keys & mask
    shorter = without_first(chain.tables[-1].of_ranks((keys >> bits).astype(np.int64)), Shorter(chain))  # of the context
    context = shorter if len(chain.tables) == 1 else chain.tables[-2].ranks(shorter).astype(np.uint64)
    return context << bits | keys & mask


class Shorter:
    """A chain less its highest order."""

    def __init__(self, chain: Chain) -> None:
        self.bits, self.tables = chain.bits, chain.tables[:-1]


def owners(ranks: np.ndarray, words: WordTable) -> np.ndarray:
    """Shards of words by rank."""
    stops = np.cumsum([n for *_, n in words.files])
    return np.array([s for s, *_ in words.files])[np.searchsorted(stops, ranks.astype(np.int64), "right")]


def context_arrays(keys: np.ndarray, counts: np.ndarray, words: WordTable) -> list[np.ndarray]:
    """Counts of sorted keys; their contexts, with sums of counts and how many of them are 1, 2, and 3 or more."""
    context = keys >> np.uint64(words.bits)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
    narrow = lambda x: x.astype("<u4") if not len(x) or x.max() < 1 << 32 else x.astype("<u8")
    per = lambda x: narrow(np.add.reduceat(x.astype(np.int64), first)) if len(first) else np.zeros(0, "<u4")
    return [narrow(counts), narrow(context[first]), per(counts), per(counts == 1), per(counts == 2), per(counts > 2)]


def gather_left(notes: DataFrame, words: WordTable, level: Level | None) -> list:
    """Numbers of left neighbours beside the sorted keys of ``level`` (of the words where that is None); a row for each shard."""
    sizes = {s: (int(b), n) for (s, _, n), b in zip(words.files, np.cumsum([0, *(n for *_, n in words.files)]), strict=False)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, found, lefts in _merged(batches):
            if level is None:
                base, n = sizes[shard]
                dense = np.zeros(n, np.int64)
                dense[found.astype(np.int64) - base] = lefts
                yield _note("left", shard, write_arrays(words.folder, f"left-{shard}", [dense.astype("<u4")]), int((dense > 2).sum()), int(dense.sum()), dense)
            else:
                keys = opened(Ngrams, level, words).keys[shard]
                dense = np.zeros(len(keys), np.int64)
                dense[find(keys, found)[0]] = lefts
                yield _note("left", shard, write_arrays(words.folder, f"values{level.order}-{shard}", context_arrays(keys, dense, words)), of=dense)

    left = by_shard(notes.select("shard", "keys", "counts"), words.shards).mapInArrow(gather, NOTE_SCHEMA)
    return sorted(left.select("shard", "path", "n1", "n2", "n3", "n4", "n", "total").collect())


def count_ngrams(train: DataFrame, words: WordTable, order: int) -> NgramModel:
    """All orders of the model over rows (text)."""
    some = ("n1", "n2", "n3", "n4")
    sums = lambda rows: tuple(sum(r[k] for r in rows) for k in some)
    levels: tuple[Level, ...] = ()
    for k in range(2, order + 1):
        notes, level = count_order(train, words, levels, k - 1, k == order)
        rows = gather_left(notes, words, levels[-1] if levels else None)
        if k == 2:
            left, left_ones = tuple((r["shard"], r["path"]) for r in rows), sums(rows)
            totals = (sum(r["total"] for r in rows), sum(r["n1"] for r in rows), sum(r["n2"] for r in rows), sum(r["n"] for r in rows))
        else:
            levels = (*levels[:-1], replace(levels[-1], values=tuple((r["shard"], r["path"]) for r in rows), ones=sums(rows)))
        levels = (*levels, level)
    return NgramModel(words, order, levels, left, left_ones, totals)


class Scorer:
    """A worker's view of the whole model."""

    def __init__(self, model: NgramModel) -> None:
        self.model = model
        self.chain = Chain(model.levels[:-1], model.words)
        self.look, self.top = self.chain.look, Ngrams(model.levels[-1], model.words)
        self.values = [{s: map_arrays(model.folder, p) for s, p in level.values} for level in model.levels]
        self.left = {s: map_arrays(model.folder, p)[0] for s, p in model.left}
        self.rates, self.left_rates = [discounts(level.ones) for level in model.levels], discounts(model.left_ones)

    def word_share(self, ids: np.ndarray) -> np.ndarray:
        """Lowest order: share by left neighbours, and the uniform share of what is discounted."""
        total, one, two, more = self.model.left_totals
        size, d = self.model.words.size, self.left_rates
        if not total:
            return np.full(len(ids), 1 / (size + 1))
        c = self.look.by_rank(self.left, ids)
        rest = (d[1] * one + d[2] * two + d[3] * more) / total
        return (c - d[np.minimum(c, 3)]) / total + rest / (size + 1)

    def share(self, contexts: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """P(word | context) for ranks of words and of their contexts of 1, 2 and more words (-1: unknown)."""
        out = self.word_share(ids)
        for table, values, d, context in zip([*self.chain.tables, self.top], self.values, self.rates, contexts, strict=True):
            rows = np.flatnonzero(context >= 0)  # a context that was never seen leaves the share below
            key = self.chain.joined(context[rows], np.where(ids[rows] < 0, (1 << int(self.chain.bits)) - 1, ids[rows]))
            keys, back = np.unique(key, return_inverse=True)
            count, total, weight = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
            for s, own, at, there in table.places(keys):
                counts, contexts_, sums, one, two, more = values[s]
                count[own[there]] = counts[at[there]]
                wanted = keys[own] >> self.chain.bits
                at, there = find(contexts_, wanted.astype(contexts_.dtype))
                there &= wanted <= np.uint64(np.iinfo(contexts_.dtype).max)
                total[own[there]] = sums[at[there]]
                weight[own[there]] = d[1] * one[at[there]] + d[2] * two[at[there]] + d[3] * more[at[there]]
            count, total, weight = count[back], total[back], weight[back]
            seen = total > 0
            rows, count, total, weight = rows[seen], count[seen], total[seen], weight[seen]
            out[rows] = (count - d[np.minimum(count, 3)] + weight * out[rows]) / total
        return out


def fit(train: DataFrame, text_column: str = "text", shards: int | None = None, order: int = ORDER) -> NgramModel:
    """Count the model of ``order`` words (2 at least) over all rows of ``train``."""
    if order < 2:
        raise ValueError("the order must be at least 2")
    spark = train.sparkSession
    prepare(spark)
    texts = train.select(text_of(text_column).alias("text"))
    if shards is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = fresh_path(spark, "ngram_model")
    for seed in SEEDS:
        try:
            return count_ngrams(texts, count_words(texts, shards, folder, seed), order)
        except PythonException as e:
            if WordClash.__name__ not in str(e):
                raise
    raise WordClash("two words have one hash under every seed")


def score(docs: DataFrame, model: NgramModel, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of every row with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    prepare(docs.sparkSession)
    light = docs.select(*columns, text_of(text_column).alias("_text"))
    added = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    schema = light.drop("_text").schema
    for part in added.split(", "):
        name, kind = part.split()
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, size, n_train = opened(Scorer, model), model.words.size, model.words.tokens
        for b in batches:
            if not b.num_rows:
                continue
            split = [tokens(t) for t in b.column("_text").to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            first = np.cumsum(n) - n
            ids = scorer.look.ids([w for ws in split for w in ws])
            count = scorer.look.by_rank(scorer.look.counts, ids)
            base = np.log10((count + ADD) / (n_train + ADD * (size + 1)))
            whole = np.log10(scorer.share(scorer.chain.contexts(ids, first), ids))
            per = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            score_ = per(whole)
            out = [n, per((count > 0).astype(np.int64)), np.full(len(n), n_train), per(base), score_, 10 ** (-score_ / n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, out)], names=schema.names)

    return light.mapInArrow(run, schema)


def score_documents(docs: DataFrame, train_condition, columns: list[str], text_column: str = "text", order: int = ORDER) -> DataFrame:
    """Fit on the rows that meet ``train_condition`` and score them all."""
    return score(docs, fit(docs.filter(train_condition), text_column, order=order), columns, text_column)
