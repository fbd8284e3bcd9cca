"""Groups met in sorted order inside each task, many small ones without a call per group from Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(df: DataFrame, function: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to the rows of each value of the long column ``g``, one group in memory at a time.

    Groups must be bounded by the caller. Rows of a group come in no fixed order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            if held and held[0].column("g")[0].as_py() != g[0]:
                cuts = np.concatenate([[0], cuts])
            last = 0
            for c in cuts.tolist():
                held.append(batch.slice(last, c - last))
                last = c
                if (out := function(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            held.append(batch.slice(last))
        if held and (out := function(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)
