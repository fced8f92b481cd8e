"""Whole groups in Arrow batches: rows that Spark has dealt by key and sorted, taken up group by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def new_group(t: pa.Table, keys: list[str]) -> np.ndarray:
    """True on every row whose keys differ from the row before; null keys are equal to each other."""
    first = np.zeros(t.num_rows, bool)
    first[:1] = True
    for key in keys:
        c = t[key].combine_chunks()
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        unlike = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
        first[1:] |= unlike.to_numpy(zero_copy_only=False).astype(bool)
    return first


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], known: str | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the marks of each group's first row; rows without ``known`` are left out.

    The last group of a batch is held until the next one, so a task holds a batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if known and batch.column(known).null_count:
            batch = batch.filter(pc.is_valid(batch.column(known)))
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        first = new_group(t, keys)
        cut = int(np.flatnonzero(first)[-1])
        if cut:
            yield t.slice(0, cut), first[:cut]
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, new_group(t, keys)


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)
