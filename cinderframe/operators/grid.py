"""Operators on rasters kept as rows (b, i, j, value): alignment, neighbours, stencils, tiles and burned sets.

Layers meet by equi-joins on computed coordinates, never by range or cross joins: neighbours come from
exploding the fixed eight offsets on one side, coarse layers from scaled indices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSETS = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]


def align(fine: DataFrame, coarse: DataFrame, multiplier: float, keys: tuple[str, ...] = ("i", "j"), how: str = "left") -> DataFrame:
    """Join a layer of another resolution: its cell is the fine cell's index times ``multiplier``, cut off."""
    scaled = {k: (F.col(k) * F.lit(multiplier)).cast("int").alias(f"_{k}") for k in keys if k != "b"}
    left = fine.select("*", *scaled.values())
    right = coarse.select(*(F.col(k).alias(f"_{k}") if k != "b" else F.col(k) for k in keys), *(c for c in coarse.columns if c not in keys))
    on = [f"_{k}" if k != "b" else k for k in keys]
    return left.join(right, on, how).drop(*(f"_{k}" for k in keys if k != "b"))


def hour_band(minute: Column) -> Column:
    """The weather band of a simulation minute."""
    return F.floor(minute / 60.0)


def default_value(df: DataFrame, layer: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """Look a layer up by coordinates, with a default outside it."""
    return df.join(layer.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def neighbours(cells: DataFrame, of: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each cell with every existing neighbour's columns (renamed): di, dj tell where it lies."""
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in OFFSETS)))
    wide = cells.withColumn("_o", at).select(*cells.columns, F.col("_o.di").alias("di"), F.col("_o.dj").alias("dj"))
    wide = wide.withColumns({"_i": F.col("i") + F.col("di"), "_j": F.col("j") + F.col("dj")})
    right = of.select(F.col("i").alias("_i"), F.col("j").alias("_j"), *(F.col(c).alias(n) for c, n in columns.items()))
    return wide.join(right, ["_i", "_j"]).drop("_i", "_j")


def terrain_distances(cells: DataFrame, cell_size: float) -> DataFrame:
    """Distance over the terrain to each neighbour."""
    pairs = neighbours(cells.select("i", "j", "elevation"), cells, {"elevation": "elevation_to"})
    flat = F.lit(cell_size) * F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"))
    rise = F.col("elevation_to") - F.col("elevation")
    return pairs.withColumn("distance", F.sqrt(flat * flat + rise * rise))


def near_matching(cells: DataFrame, of: DataFrame) -> DataFrame:
    """Cells with at least one neighbour among ``of``."""
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in OFFSETS)))
    around = of.select("i", "j", at.alias("o")).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"))
    return cells.join(around, ["i", "j"], "left_semi")


def blocked_diagonals(cells: DataFrame, open_cell: Column) -> DataFrame:
    """Diagonal moves between open cells whose two shared corners are both closed.

    Every cell takes its part in the four blocks of two by two cells that it lies in: one shuffle, no join. Blocks over
    the edge or a missing cell have none of them.
    """
    corner = F.explode(F.array(*map(F.lit, range(4))))
    parts = cells.select("i", "j", open_cell.alias("open"), corner.alias("at"))
    di, dj = F.floor(F.col("at") / 2).cast("int"), F.col("at") % 2
    blocks = parts.groupBy((F.col("i") - di).alias("bi"), (F.col("j") - dj).alias("bj")).agg(*(F.bool_and(F.when(F.col("at") == k, F.col("open"))).alias(f"o{k}") for k in range(4)))

    def moves(a: int, b: int, condition: str) -> DataFrame:
        step = lambda x, y: F.struct((F.col("bi") + x // 2).alias("i"), (F.col("bj") + x % 2).alias("j"), F.lit(y // 2 - x // 2).alias("di"), F.lit(y % 2 - x % 2).alias("dj"))
        return F.when(F.expr(condition), F.array(step(a, b), step(b, a))).otherwise(F.array())

    both = F.concat(moves(0, 3, "o0 AND o3 AND NOT o1 AND NOT o2"), moves(1, 2, "o1 AND o2 AND NOT o0 AND NOT o3"))
    return blocks.select(F.inline(both))


def gradient(cells: DataFrame, value: str, missing: float | None = None) -> DataFrame:
    """Central differences along rows and columns, one-sided at edges or beside missing values, null alone."""
    v = F.col(value) if missing is None else F.when(F.col(value) != missing, F.col(value))

    def slope(across: str, along: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        before = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(v).over(w))
        after = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(v).over(w))
        return F.when(v.isNotNull(), F.coalesce((after - before) / 2.0, after - v, v - before))

    return cells.withColumns({"d_di": slope("j", "i"), "d_dj": slope("i", "j")})


def data_rows(cells: DataFrame, value: str) -> DataFrame:
    """First and one past the last row that hold data (value >= 0); 0, 0 if none does."""
    hit = F.when(F.col(value) >= 0, F.col("i"))
    return cells.agg(F.coalesce(F.min(hit), F.lit(0)).alias("first_row"), F.coalesce(F.max(hit) + 1, F.lit(0)).alias("end_row"))


def bounding_box(cells: DataFrame, inside: Column) -> DataFrame:
    hit = cells.where(inside)
    return hit.agg(*(f(c).alias(f"{n}_{c}") for c in ("i", "j") for f, n in ((F.min, "min"), (F.max, "max"))))


def clipped(cells: DataFrame, box: DataFrame) -> DataFrame:
    """Cells within a box (min_i, max_i, min_j, max_j), counted from its corner. The box is one row."""
    inside = cells.join(F.broadcast(box), F.col("i").between(F.col("min_i"), F.col("max_i")) & F.col("j").between(F.col("min_j"), F.col("max_j")))
    moved = {"i": F.col("i") - F.col("min_i"), "j": F.col("j") - F.col("min_j")}
    return inside.select(*(moved.get(c, F.col(c)).alias(c) for c in cells.columns))


def difference(before: Column, here: Column, after: Column) -> Column:
    """Central difference, one-sided beside a missing value, 0 if two of three are missing."""
    return F.coalesce((after - before) * 0.5, after - here, here - before, F.lit(0.0))


def incidence_cosine(vectors: DataFrame, arrivals: DataFrame, keys: list[str], fallback: float = 1.0) -> DataFrame:
    """Cosine between a front's normal, guessed from arrival times around a cell, and each vector's direction.

    ``vectors``: keys, i, j, direction (degrees from north), at_cell (whether its own cell has ignited, else the one it
    comes from counts), di, dj (its step). ``arrivals``: keys, i, j, burn_time, -1 where nothing burned.
    """
    at = vectors.withColumns({"_i": F.when(F.col("at_cell"), F.col("i")).otherwise(F.col("i") - F.col("di")), "_j": F.when(F.col("at_cell"), F.col("j")).otherwise(F.col("j") - F.col("dj"))})
    places = at.select(*keys, "_i", "_j").distinct()
    burned = arrivals.where("burn_time != -1")
    steps = {"c": (0, 0), "u": (-1, 0), "d": (1, 0), "l": (0, -1), "r": (0, 1)}
    at_steps = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in steps.items()))
    near = burned.select(*keys, "i", "j", "burn_time", F.explode(at_steps).alias("s")).select(*keys, (F.col("i") - F.col("s.a")).alias("_i"), (F.col("j") - F.col("s.b")).alias("_j"), F.col("s.n").alias("n"), "burn_time")
    wide = near.join(places, [*keys, "_i", "_j"], "left_semi").groupBy(*keys, "_i", "_j").agg(*(F.max(F.when(F.col("n") == n, F.col("burn_time"))).alias(f"_{n}") for n in steps))
    out = at.join(wide, [*keys, "_i", "_j"], "left")
    gi, gj = difference(F.col("_u"), F.col("_c"), F.col("_d")), difference(F.col("_l"), F.col("_c"), F.col("_r"))
    out = out.withColumns({"_gi": gi, "_gj": gj})
    size = F.sqrt(F.col("_gi") * F.col("_gi") + F.col("_gj") * F.col("_gj"))
    turn = F.radians("direction")
    cosine = (F.col("_gi") * -F.cos(turn) + F.col("_gj") * F.sin(turn)) / F.nullif(size, F.lit(0.0))
    return out.withColumn("cosine", F.coalesce(cosine, F.lit(fallback))).select(*vectors.columns, "cosine")


def venn_class(observed: Column, simulated: Column, ignited: Column) -> Column:
    """4: ignited, 2.5: burned in both, 1: only observed, 5: only simulated, 0: neither."""
    return F.when(ignited, 4.0).when(observed & simulated, 2.5).when(observed, 1.0).when(simulated, 5.0).otherwise(0.0)


def rescaled(cells: DataFrame, value: str, factor: int, keys: list[str] | None = None) -> DataFrame:
    """A coarser layer: the mean of each block of ``factor`` by ``factor`` cells, those without value left out; each of ``keys`` by itself."""
    coarse = cells.groupBy(*(keys or []), F.floor(F.col("i") / factor).cast("int").alias("i"), F.floor(F.col("j") / factor).cast("int").alias("j"))
    return coarse.agg(F.avg(value).alias(value))


def tile_offsets(tiles: DataFrame) -> DataFrame:
    """Place tiles (tile_row, tile_col, height, width) in one raster by running sums of heights and widths.

    The windows hold a row for each row or column of tiles: the sides of one raster's grid, not its tiles.
    """
    rows = tiles.groupBy("tile_row").agg(F.max("height").alias("h"))
    cols = tiles.groupBy("tile_col").agg(F.max("width").alias("w"))
    up, left = Window.partitionBy(F.lit(0)).orderBy("tile_row"), Window.partitionBy(F.lit(0)).orderBy("tile_col")
    rows = rows.withColumn("row0", F.sum("h").over(up) - F.col("h")).drop("h")
    cols = cols.withColumn("col0", F.sum("w").over(left) - F.col("w")).drop("w")
    return tiles.join(rows, "tile_row").join(cols, "tile_col")


def stitched(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells of tiles (tile_row, tile_col, i, j, ...) at their places in the whole raster."""
    placed = cells.join(tile_offsets(tiles).select("tile_row", "tile_col", "row0", "col0"), ["tile_row", "tile_col"])
    moved = {"i": (F.col("i") + F.col("row0")).cast("int"), "j": (F.col("j") + F.col("col0")).cast("int")}
    return placed.select(*(moved.get(c, F.col(c)).alias(c) for c in cells.columns if c not in ("tile_row", "tile_col")))


def tile_faults(tiles: DataFrame, near: float = 1e-6) -> DataFrame:
    """(tile_row, tile_col, fault) of tiles that do not make one raster: heights that differ in a row, widths in a column,
    scales in the whole grid, or corners that do not meet the neighbour's (x, y of the upper left, in map units, y going
    up). A missing tile is a fault too. Needs tile_row, tile_col, height, width, scale, x, y."""
    one = tiles.agg(F.min("scale").alias("s0"), F.countDistinct("tile_col").alias("n"))
    row, col = Window.partitionBy("tile_row"), Window.partitionBy("tile_col")
    marked = tiles.join(F.broadcast(one)).withColumns({
        "h0": F.min("height").over(row), "w0": F.min("width").over(col), "have": F.count("*").over(row),
        "next_x": F.lead("x").over(row.orderBy("tile_col")), "next_y": F.lead("y").over(col.orderBy("tile_row")),
    })
    apart = lambda a, b: F.coalesce(F.abs(a - b) > near, F.lit(False))
    faults = {
        "height": F.col("height") != F.col("h0"), "width": F.col("width") != F.col("w0"), "scale": apart(F.col("scale"), F.col("s0")), "missing": F.col("have") != F.col("n"),
        "right": apart(F.col("x") + F.col("width") * F.col("scale"), F.col("next_x")), "below": apart(F.col("y") - F.col("height") * F.col("scale"), F.col("next_y")),
    }
    found = F.array_compact(F.array(*(F.when(c, n) for n, c in faults.items())))
    return marked.select("tile_row", "tile_col", F.explode(found).alias("fault"))


def union_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j").union(b.select("i", "j")).distinct()


def common_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j").intersect(b.select("i", "j"))


def except_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j").subtract(b.select("i", "j"))


def sparse(cells: DataFrame, value: str, n_cols: int) -> DataFrame:
    """Positive cells as flat index and value."""
    return cells.where(F.col(value) > 0).select((F.col("i").cast("long") * n_cols + F.col("j")).alias("cell"), value)
