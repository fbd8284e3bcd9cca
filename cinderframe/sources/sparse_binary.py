"""Sparse big-endian matrices: count, x and y of every positive cell, then one value array for each matrix.

x counts columns from 1, y rows from the bottom, from 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode(x: np.ndarray, y: np.ndarray, values: list[np.ndarray]) -> bytes:
    head = [np.array([len(x)], ">i4"), x.astype(">i4"), y.astype(">i4")]
    return b"".join(a.tobytes() for a in [*head, *(v.astype(">i4" if v.dtype.kind == "i" else ">f4") for v in values)])


def decode(data: bytes, kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n = int(np.frombuffer(data, ">i4", 1)[0])
    parts = [np.frombuffer(data, kind, n, 4 + 4 * n * k) for k, kind in enumerate([">i4", ">i4", *(">i4" if t == "int" else ">f4" for t in kinds)])]
    return parts[0], parts[1], parts[2:]


def encoded(sim_cells: DataFrame, n_rows: int, values: list[str]) -> DataFrame:
    """(sim, content): a file's bytes for every simulation; a simulation's burned cells are bounded by its grid."""

    def run(key, rows):
        rows = rows.sort_values(["i", "j"])
        data = encode(rows["j"].to_numpy() + 1, n_rows - rows["i"].to_numpy(), [rows[v].to_numpy() for v in values])
        return pd.DataFrame({"sim": [key[0]], "content": [data]})

    return sim_cells.where(F.col(values[0]) > 0).select("sim", "i", "j", *values).groupBy("sim").applyInPandas(run, "sim int, content binary")


def read(spark: SparkSession, path: str, n_rows: int, values: dict[str, str]) -> DataFrame:
    """Cells of sparse files: path, i, j and the values (name: int or float)."""
    schema = "path string, i int, j int, " + ", ".join(f"{n} {k}" for n, k in values.items())

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                x, y, data = decode(content, list(values.values()))
                yield pd.DataFrame({"path": p, "i": n_rows - y.astype(np.int32), "j": x.astype(np.int32) - 1, **{n: d.astype(d.dtype.newbyteorder("=")) for n, d in zip(values, data)}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
