"""Bounded groups of rows handed to Python one at a time.

A unit is named by a few key columns and is small by construction (large groups
are cut into tiles before they get here). Rows are dealt by the keys, sorted
within each partition and streamed, so a worker holds one Arrow batch and the
unit in hand, however many units its partition has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopweave.llm._bytes import trimmed


def over_units(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] = ()) -> DataFrame:
    """Call fn once for each combination of the (long) keys, with its rows sorted by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                out = fn(pa.Table.from_batches(held))
                held.clear()
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in keys], 1)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            for a, b in zip([0, *cut], [*cut, len(k)]):
                if last is not None and tuple(k[a]) != last:
                    yield from done()
                last = tuple(k[a])
                held.append(batch.slice(a, b - a))
        yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


def over_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] = ()) -> DataFrame:
    """As over_units, but fn gets many whole units at once, one after the other: for work that is vectorised over units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                out = fn(pa.Table.from_batches(held).combine_chunks())
                held.clear()
                if out is not None and out.num_rows:
                    yield out

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in keys], 1)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if last is not None and tuple(k[0]) != last:
                yield from done()
            if len(cut):  # all but the batch's last unit are whole
                held.append(batch.slice(0, int(cut[-1])))
                yield from done()
                batch = batch.slice(int(cut[-1]))
            held.append(batch)
            last = tuple(k[-1])
        yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


def bounds(k: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, np.int64)
