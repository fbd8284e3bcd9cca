"""Operator 9, embedding near-dedup: Euclidean p-stable hashing.

Each table quantises ``width``-wide cells of ``projections`` random Gaussian projections of the
normalised vector; rows that share all cells of a table (and the label) are compared by exact cosine in
double precision. Equal vectors of a label are one row with a weight first. A linked pair counts in the
first table that brings it together, so no pair list is kept: tasks give each row's count and links
that span what they found. Buckets beyond ``block`` rows are compared block by block, whole.

There are as many tables as it takes for two vectors right at the threshold to meet in none with a probability of
at most ``miss``: 77 at the defaults; at cosine 0.95 it is 2e-05. Unrelated vectors of 64 dimensions meet in one of
them with a probability of 0.0013; for more rows, more projections make more and smaller buckets. Vectors that are
null, empty, zero or hold null or non-finite components, and rows without label, link with nothing: 0 links and their own id. Rows of one vec_id and vector count as copies.
An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, tune
from .components import components
from .streams import by_group
from .vectors import as_bytes, element_type, matrix, unit, usable_vector


def cells(units: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit key of the cells for every row and table: equal cells have equal keys."""
    rng = np.random.default_rng([seed, units.shape[1]])
    keys = np.empty((len(units), tables), np.int32)
    with np.errstate(over="ignore"):
        for t in range(tables):
            a, b = rng.standard_normal((units.shape[1], projections)), rng.uniform(0, width, projections)
            cell = np.floor((units @ a + b) / width).astype(np.int64)
            odd = rng.integers(-(2**62), 2**62, projections) * 2 + 1
            keys[:, t] = (cell * odd).sum(1) >> 32
    return keys


def meeting(cosine: float, width: float) -> float:
    """The probability that two unit vectors share a cell of one projection (Datar and others 2004)."""
    r = width / math.sqrt(2.0 - 2.0 * cosine)
    return math.erf(r / math.sqrt(2.0)) - math.sqrt(2.0 / math.pi) / r * (1.0 - math.exp(-r * r / 2.0))


def tables_for(threshold: float, projections: int, width: float, miss: float) -> int:
    """Tables in which two vectors at the threshold meet at least once, but for a probability of ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-meeting(threshold, width) ** projections)))


def takes_part():
    return F.coalesce(usable_vector() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, miss: float = 1e-3, projections: int = 16, width: float = 2.1, block: int = 512, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = embeddings.sparkSession
    tune(spark)
    tables = tables_for(threshold, projections, width, miss)
    dtype = element_type(embeddings)
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")

    def to_bytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), as_bytes(batch.column("embedding"), dtype)], ["vec_id", "label", "vec"])

    good = every.where(takes_part()).mapInArrow(to_bytes, "vec_id long, label string, vec binary")
    once = good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))

    def keyed(batches):
        for batch in batches:
            raw = batch.column("vec")
            sizes = pa.compute.binary_length(raw).to_numpy()
            keys = np.zeros((len(sizes), tables), np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                keys[own] = cells(unit(matrix(raw.take(pa.array(own)), dtype)), tables, projections, width, seed + int(size))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    reps = cut(once.mapInArrow(keyed, "label string, vec binary, rep long, weight long, keys array<int>"), "vectors")
    # buckets with more than one row; the rest meets nobody
    slots = reps.select("rep", "label", F.posexplode("keys").alias("tab", "key")).withColumn("slot", F.xxhash64("label", "tab", "key")).select("rep", "tab", "slot")
    full = cut(slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot", F.ceil(F.col("n") / block).alias("blocks")), "buckets")
    met = slots.join(full, "slot").join(reps, "rep")
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("g", F.xxhash64("slot", F.least("own", "other"), F.greatest("own", "other")))

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        """Rows of one block, or of two: then only pairs across count."""
        if group.num_rows < 2:
            return None
        group = group.combine_chunks()
        rep, tab, own = (group.column(c).to_numpy() for c in ("rep", "tab", "own"))
        sizes = pa.compute.binary_length(group.column("vec")).combine_chunks().to_numpy()
        label = np.unique(np.array(group.column("label").to_pylist()), return_inverse=True)[1]
        keys = np.array(group.column("keys").combine_chunks().flatten()).reshape(len(rep), -1)
        linked = np.zeros((len(rep),) * 2, bool)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            v = unit(matrix(group.column("vec").take(pa.array(at)), dtype))
            cos = v @ v.T
            i, j = np.nonzero(np.abs(cos - threshold) < 1e-9)  # near the threshold by one fixed order of sums
            cos[i, j] = (v[i] * v[j]).sum(1)
            linked[np.ix_(at, at)] = cos >= threshold
        linked &= label[:, None] == label[None]
        across = group.column("cross")[0].as_py()
        linked &= (own[:, None] != own[None]) if across else (own[:, None] == own[None])
        i, j = np.nonzero(np.triu(linked, 1))
        if not len(i):
            return None
        first = (keys[i] == keys[j]).argmax(1) == tab[i]
        i, j = i[first], j[first]
        if not len(i):
            return None
        weight, n = group.column("weight").to_numpy(), np.zeros(len(rep), np.int64)
        np.add.at(n, i, weight[j])
        np.add.at(n, j, weight[i])
        root = np.arange(len(rep))
        while True:  # the smallest row reachable within the block
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        counted, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[counted], rep[tied]])), pa.array(np.concatenate([n[counted], np.full(len(tied), -1)])), pa.array(np.concatenate([rep[counted], rep[root[tied]]]))], ["rep", "links", "to"])

    met = met.withColumn("cross", F.col("own") != F.col("other")).select("g", "rep", "tab", "own", "cross", "label", "weight", "vec", "keys")
    found = cut(by_group(met, compare, "rep long, links long, to long"), "vector-links")
    counts = found.where("links >= 0").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("links < 0").select(F.col("rep").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("rep"), "root")
    known = cut(reps.select("rep", "label", "vec", "weight").join(counts, "rep", "left").join(roots, "rep", "left").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "vector-classes")
    linked = good.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = every.where(~takes_part()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    forget(reps, full, found)
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
