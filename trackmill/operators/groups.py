"""Whole groups of rows as numpy columns, streamed through sorted partitions.

A task sorts its rows once and holds one group, or an Arrow batch of them, at a time; nothing is
collected or copied per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, np.ndarray]


def bounds(columns: Columns, keys: list[str]) -> list[int]:
    """Where groups of equal keys begin, and the end of the last one."""
    n = len(columns[keys[0]])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= columns[k][1:] != columns[k][:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else [0]


def over_groups(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[Columns], tuple | None], schema: str, by: list[str] | None = None) -> DataFrame:
    """``solve`` over each group of rows with equal keys, in the given order: arrays of equal length, one
    for each column of the schema, or None. Groups come by the keys; ``by`` names the first of them, by
    which rows are dealt to tasks, so that state kept by ``solve`` can run over their groups."""
    names = df.columns
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def solved(columns: Columns, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        found = [solve({c: v[a:b] for c, v in columns.items()}) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [f for f in found if f is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def joined(pieces: list[Columns]) -> Columns:
        return pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []  # pieces of the group that the last batch ended in, joined once it is whole
        for batch in batches:
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            cuts = bounds(columns, keys)
            if len(cuts) < 2:
                continue
            if held and all(held[-1][k][-1] == columns[k][0] for k in keys):
                held.append({c: v[: cuts[1]] for c, v in columns.items()})
                cuts = cuts[1:]
            if len(cuts) > 1:
                if held:
                    whole = joined(held)
                    yield from solved(whole, [0, len(whole[names[0]])])
                yield from solved(columns, cuts[:-1])
                held = [{c: v[cuts[-2] :] for c, v in columns.items()}]
        if held:
            whole = joined(held)
            yield from solved(whole, [0, len(whole[names[0]])])

    return df.repartition(*(by or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def corners(columns: Columns) -> np.ndarray:
    return np.stack([columns[c] for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
