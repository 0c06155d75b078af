"""Whole blocks of time out of a sorted stream of Arrow batches, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def block_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each block of a series begins; rows are in order."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in (*keys, "_block"):
        code = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole blocks with at most ``rows`` rows, or of one block; batches may be larger."""

    def cut(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ends, k = np.append(starts[1:], table.num_rows), 0
        while k < len(starts):
            upto = max(int(np.searchsorted(ends, starts[k] + rows, "right")), k + 1)
            yield table.slice(int(starts[k]), int(ends[upto - 1] - starts[k]))
            k = upto

    held: list[pa.RecordBatch] = []
    n, wait = 0, rows
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= wait:
            table = pa.Table.from_batches(held)
            starts = block_starts(table, keys)
            whole = int(starts[-1])  # the last block may go on
            yield from cut(table.slice(0, whole), starts[:-1])
            held, n = table.slice(whole).to_batches(), n - whole
            wait = max(rows, 2 * n)  # a block of many batches is looked through a few times, not with each of them
    if n:
        table = pa.Table.from_batches(held)
        yield from cut(table, block_starts(table, keys))
