"""ENVI band-sequential rasters as rows (layer, b, i, j, v), through Spark's file readers on any store."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ENVI data type codes.
TYPES = {2: "i2", 3: "i4", 4: "f4", 5: "f8"}
NEEDED = ("samples", "lines", "bands", "data type", "interleave")


def parse_header(text: str) -> dict[str, str]:
    """Fields of a .hdr text: names in lower case, braces joined over lines."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "ENVI":
        raise ValueError("no ENVI header")
    out, name = {}, None
    for line in lines[1:]:
        if name is not None:
            out[name] += " " + line.strip()
        elif "=" in line:
            name, value = (x.strip() for x in line.split("=", 1))
            name = name.lower()
            out[name] = value
        if name is not None and out[name].count("{") == out[name].count("}"):
            name = None
    missing = [k for k in NEEDED if k not in out]
    if missing:
        raise ValueError(f"header lacks {', '.join(missing)}")
    if out["interleave"].lower() != "bsq":
        raise ValueError(f"interleave {out['interleave']} is not band sequential")
    if int(out["data type"]) not in TYPES:
        raise ValueError(f"data type {out['data type']} is not supported")
    return out


def read_bsq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells of band-sequential files, each beside its .hdr. A file is one task's memory; tile larger rasters.

    Files meet their headers by path, so equal names in several folders stay apart; nothing comes to the driver.
    """
    files = spark.read.format("binaryFile")
    stem = F.regexp_replace("path", r"\.(bsq|hdr)$", "")
    headers = files.load([p.removesuffix(".bsq") + ".hdr" for p in paths]).select(stem.alias("stem"), F.col("content").alias("header"))

    def run(batches):
        for batch in batches:
            for path, layer, content, header in zip(*(c.to_pylist() for c in batch.columns)):
                if header is None:
                    raise ValueError(f"{path} has no header beside it")
                h = parse_header(header.decode())
                bands, rows, cols = (int(h[k]) for k in ("bands", "lines", "samples"))
                kind = (">" if h.get("byte order", "0") == "1" else "<") + TYPES[int(h["data type"])]
                data = np.frombuffer(content, kind, offset=int(h.get("header offset", 0)))
                if len(data) != bands * rows * cols:
                    raise ValueError(f"{path} holds {len(data)} values, its header declares {bands * rows * cols}")
                for b, band in enumerate(data.reshape(bands, rows, cols)):
                    i, j = np.divmod(np.arange(rows * cols, dtype=np.int32), np.int32(cols))
                    n = len(i)
                    yield pa.RecordBatch.from_arrays([pa.array([layer] * n), pa.array(np.full(n, b, np.int32)), pa.array(i), pa.array(j), pa.array(band.ravel().astype(np.float64))], ["layer", "b", "i", "j", "v"])

    data = files.load(paths).select("path", stem.alias("stem"), F.regexp_extract("path", r"([^/]*)\.bsq$", 1).alias("layer"), "content")
    return data.join(headers, "stem", "left").select("path", "layer", "content", "header").mapInArrow(run, "layer string, b int, i int, j int, v double")


def header_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """name, value of ``name = value`` lines, in SQL functions alone."""
    parts = F.split(F.col(column), "=", 2)
    return texts.where(F.contains(F.col(column), F.lit("="))).select(F.lower(F.trim(parts[0])).alias("name"), F.trim(parts[1]).alias("value"))
