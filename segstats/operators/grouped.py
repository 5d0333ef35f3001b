"""Whole groups through Arrow, many groups per call.

Spark shuffles and sorts; a task then sees its groups one after another and hands
the helper a table of *complete* groups. Small groups are batched together, so a
billion tiny images cost no per-group Python call, and a group is never larger than
what its key allows (a tile, an image row, one object's rows).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row starts a new group of the sorted ``table``."""
    n = table.num_rows
    flag = np.zeros(n, bool)
    if n:
        flag[0] = True
    for key in keys:
        column = table[key].combine_chunks()
        if n > 1:
            flag[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return flag


def ints(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64, copy=False)


def stream_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pa.Table], pa.Table],
    schema: str,
    chunk_rows: int = 131_072,
) -> DataFrame:
    """Apply ``fn`` to tables of complete groups, sorted by ``keys`` then ``order``."""

    def run(batches):
        held, rows, limit = [], 0, chunk_rows
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(table, keys))[-1])
            if cut:
                yield from fn(table.slice(0, cut)).to_batches()
            held = table.slice(cut).to_batches()
            rows -= cut
            limit = max(chunk_rows, 2 * rows)
        if rows:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
