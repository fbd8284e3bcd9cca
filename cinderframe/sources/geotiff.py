"""GeoTIFF rasters as rows (layer, b, i, j, v) and back, through Spark's file readers and writers' own tasks.

Reads classic TIFF files of either byte order: strips or tiles, one or more bands (together or apart), integers and
floats of 8 to 64 bits, plain or deflate-packed, with or without a horizontal predictor. Values equal to the file's
no-data value come back as null. A file is one task's memory; tile larger rasters.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values (TIFF 6.0): sizes of field types, and tags by name.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
SCHEMA = "layer string, b int, i int, j int, v double"


def fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = SIZES.get(kind, 1) * n
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = data[place : place + size]
        if kind == 2:
            out[tag] = (raw.rstrip(b"\0").decode("latin-1"),)
        elif kind in CODES:
            out[tag] = struct.unpack(f"{order}{n}{CODES[kind]}", raw)
    return order, out


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(bands, rows, cols) of values and what places them: scale, left, top, nodata."""
    order, tag = fields(data)
    one = lambda t, default: tag.get(t, (default,))[0]
    wide, high, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, form, packed = one(BITS, 1), one(FORMAT, 1), one(COMPRESSION, 1)
    if bits not in (8, 16, 32, 64) or packed not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{bits} bits, compression {packed}, predictor {one(PREDICTOR, 1)} are not supported")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    tiled = TILES in tag
    part_w, part_h = (one(TILE_WIDTH, wide), one(TILE_HEIGHT, high)) if tiled else (wide, min(one(ROWS, high), high))
    starts, sizes = (tag[TILES], tag[TILE_BYTES]) if tiled else (tag[STRIPS], tag[STRIP_BYTES])
    apart = one(PLANAR, 1) == 2 and bands > 1
    depth = 1 if apart else bands
    across, down = -(-wide // part_w), -(-high // part_h)
    if len(starts) != across * down * (bands if apart else 1):
        raise ValueError(f"{len(starts)} parts do not make {high} by {wide} cells")
    out = np.zeros((bands, high, wide), kind.newbyteorder("="))
    for n, (start, size) in enumerate(zip(starts, sizes)):
        band, rest = divmod(n, across * down) if apart else (0, n)
        r, c = rest // across * part_h, rest % across * part_w
        rows = part_h if tiled else min(part_h, high - r)
        raw = data[start : start + size]
        part = np.frombuffer(zlib.decompress(raw) if packed != 1 else raw, kind, rows * part_w * depth).reshape(rows, part_w, depth)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, 1, dtype=part.dtype.newbyteorder("="))
        h, w = min(rows, high - r), min(part_w, wide - c)
        out[band : band + depth, r : r + h, c : c + w] = np.moveaxis(part[:h, :w], 2, 0)
    scale, tie = tag.get(SCALE, (1.0, 1.0, 0.0)), tag.get(TIEPOINT, (0.0,) * 6)
    nodata = float(tag[NODATA][0]) if NODATA in tag else None
    return out, {"scale": scale[0], "left": tie[3] - tie[0] * scale[0], "top": tie[4] + tie[1] * scale[1], "nodata": nodata}


def encode(values: np.ndarray, scale: float = 1.0, left: float = 0.0, top: float = 0.0, nodata: float | None = None, rows: int = 64) -> bytes:
    """A little-endian, deflate-packed file of (bands, rows, cols), each band in strips of its own."""
    bands, high, wide = values.shape
    form = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    little = values.astype(values.dtype.newbyteorder("<"))
    strips = [zlib.compress(little[b, r : r + rows].tobytes()) for b in range(bands) for r in range(0, high, rows)]
    starts = np.concatenate([[8], 8 + np.cumsum([len(x) for x in strips])]).astype(int).tolist()
    tags = [
        (WIDTH, 4, [wide]), (HEIGHT, 4, [high]), (BITS, 3, [values.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8]), (262, 3, [1]), (STRIPS, 4, starts[:-1]), (SAMPLES, 3, [bands]),
        (ROWS, 4, [rows]), (STRIP_BYTES, 4, [len(x) for x in strips]), (PLANAR, 3, [2 if bands > 1 else 1]), (FORMAT, 3, [form] * bands), (SCALE, 12, [scale, scale, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]),
    ]
    entries, more, at = [], b"", starts[-1] + starts[-1] % 2
    packed = [(t, k, struct.pack(f"<{len(v)}{CODES[k]}", *v), len(v)) for t, k, v in tags]
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        packed.append((NODATA, 2, text, len(text)))
    end = at + 2 + 12 * len(packed) + 4
    for t, k, raw, n in packed:
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", t, k, n, end + len(more)))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", t, k, n) + raw.ljust(4, b"\0"))
    body = b"".join(strips)
    return b"II" + struct.pack("<HI", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(packed)) + b"".join(entries) + struct.pack("<I", 0) + more


def decoded(files: DataFrame) -> DataFrame:
    """Cells of GeoTIFF contents (path, content); ``layer`` is the path."""

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                values, place = decode(content)
                i, j = np.divmod(np.arange(values[0].size, dtype=np.int32), np.int32(values.shape[2]))
                for b, band in enumerate(values):
                    v = band.ravel().astype(np.float64)
                    gone = v == place["nodata"] if place["nodata"] is not None else np.zeros(len(v), bool)
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, b, np.int32)), pa.array(i), pa.array(j), pa.array(v, mask=gone)], ["layer", "b", "i", "j", "v"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_geotiff(spark: SparkSession, *paths: str) -> DataFrame:
    """Cells of GeoTIFF files on any store that Spark reads."""
    return decoded(spark.read.format("binaryFile").load(list(paths)))


def envelopes(spark: SparkSession, *paths: str) -> DataFrame:
    """(layer, bands, height, width, scale, x, y) of GeoTIFF files: upper-left corners, for placing tiles."""

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                values, place = decode(content)
                yield pa.RecordBatch.from_pylist([{"layer": path, "bands": values.shape[0], "height": values.shape[1], "width": values.shape[2], "scale": place["scale"], "x": place["left"], "y": place["top"]}])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "layer string, bands long, height long, width long, scale double, x double, y double")


def encoded(cells: DataFrame, n_rows: int, n_cols: int, scale: float = 1.0, left: float = 0.0, top: float = 0.0, nodata: float = -9999.0) -> DataFrame:
    """(layer, content): a file's bytes for each layer of cells (layer, b, i, j, v), 32-bit floats, missing cells no data.

    A layer is bounded by its grid of ``n_rows`` by ``n_cols``; tile larger ones before.
    """

    def run(table: pa.Table) -> pa.Table:
        b, i, j = (table.column(c).to_numpy() for c in ("b", "i", "j"))
        values = np.full((int(b.max()) + 1, n_rows, n_cols), nodata, np.float32)
        v = table.column("v").to_numpy()
        values[b, i, j] = np.where(np.isnan(v), nodata, v)
        return pa.table({"layer": table.column("layer").slice(0, 1), "content": pa.array([encode(values, scale, left, top, nodata)], pa.binary())})

    inside = cells.where(F.col("i").between(0, n_rows - 1) & F.col("j").between(0, n_cols - 1))
    return inside.select("layer", "b", "i", "j", "v").groupBy("layer").applyInArrow(run, "layer string, content binary")
