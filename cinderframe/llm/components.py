"""Connected components of a table of links, by joins and grouping alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Links that a task ties together at a time.
HELD = 500_000


def tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node but the smallest of its component to that one: no more than there were, same components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, low):
            break
        low = new
    rest = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[rest]], nodes[rest]


def contracted(links: DataFrame) -> DataFrame:
    """The same components by at most as many links: each task ties what it holds, ``HELD`` links at a time."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def tie():
            a, b = tied(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return a, b

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
            if n >= HELD:
                a, b = tie()
                if len(a) > HELD // 2:  # little to tie: let go of it
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    n = 0
                else:
                    held.append((a, b))
                    n = len(a)
        if held:
            a, b = tie()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; the root is the smallest node reachable.

    ``links`` has long columns a and b. Each task first ties the links it holds. Then, round by round, every node
    points to its smallest neighbour or itself, pointers are followed to their ends by repeated doubling, and links
    are carried over to the ends; links within one end are gone. Local minima at least halve, so rounds are
    logarithmic. A node with very many links only meets partial minima and joins of stored tables, which adaptive
    execution splits; nothing is collected. Null ends and links to oneself are left out; an empty table has no nodes.
    """
    left = cut(contracted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")), "links")
    whole = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        points = cut(both.select("node", F.least("node", "low").alias("root")), "points")
        while True:
            on = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(points.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "points")
            moved = not jumped.where("moved").isEmpty()
            forget(points)
            points = jumped.select("node", "root")
            if not moved:
                break
        if whole is None:
            joined = points
        else:
            on = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            joined = cut(whole.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            forget(whole)
        ends = left.join(points.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(points.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        rest = cut(contracted(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "links")
        forget(left)
        if whole is not None:
            forget(points)
        left, whole = rest, joined
    return whole if whole is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
