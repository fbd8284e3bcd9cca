"""Unit conversion as affine Column arithmetic, and the angle and recoding projections of raster layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name: (factor, offset); value * factor + offset. Constants as fire models publish them, not exact SI.
AFFINE = {
    "f_to_k": (5 / 9, 459.67 * 5 / 9),
    "k_to_f": (1.8, -459.67),
    "f_to_c": (5 / 9, -32 * 5 / 9),
    "c_to_f": (1.8, 32.0),
    "m_to_ft": (3.281, 0.0),
    "ft_to_m": (0.30478512648582745, 0.0),
    "mph_to_mps": (0.44701818551254696, 0.0),
    "mps_to_mph": (2.237045454545455, 0.0),
    "mph_to_kmh": (1.609344, 0.0),
    "kmh_to_mph": (0.621371192237334, 0.0),
    "mps_to_fpm": (196.86, 0.0),
    "fpm_to_mps": (1 / 196.86, 0.0),
    "mph_to_fpm": (88.0, 0.0),
    "fpm_to_mph": (1 / 88.0, 0.0),
    "wind_20ft_to_10m": (1 / 0.87, 0.0),
    "wind_10m_to_20ft": (0.87, 0.0),
    "btu_ft_s_to_kw_m": (3.46165186, 0.0),
    "kw_m_to_btu_ft_s": (0.28887942532730604, 0.0),
    "btu_lb_to_kj_kg": (2.3259999996185, 0.0),
    "kj_kg_to_btu_lb": (1 / 2.3259999996185, 0.0),
    "kg_m3_to_lb_ft3": (0.0624, 0.0),
    "lb_ft3_to_kg_m3": (16.025641025641026, 0.0),
    "percent_to_dec": (0.01, 0.0),
    "dec_to_percent": (100.0, 0.0),
    "sec_to_min": (0.016666666666666666, 0.0),
    "min_to_sec": (60.0, 0.0),
    "ms_to_min": (0.000016667, 0.0),
    "hour_to_min": (60.0, 0.0),
    "min_to_day": (0.000694444, 0.0),
}
ACRE_SQUARE_FEET = 43560.0

#: Converters of layers in metric and other units to the internal imperial ones.
LAYER_UNITS = {
    ("elevation", "metric"): "m_to_ft",
    ("slope", None): "deg_to_ratio",
    ("canopy_height", "metric"): "m_to_ft",
    ("canopy_base_height", "metric"): "m_to_ft",
    ("crown_bulk_density", "metric"): "kg_m3_to_lb_ft3",
    ("wind_speed_20ft", "metric"): "mps_to_mph",
    ("temperature", "metric"): "c_to_f",
    ("temperature", "absolute"): "k_to_f",
    ("canopy_cover", "ratio"): "dec_to_percent",
    ("relative_humidity", "ratio"): "dec_to_percent",
    ("fuel_moisture", "percent"): "percent_to_dec",
    ("foliar_moisture", "percent"): "percent_to_dec",
}


def convert(value: Column, name: str) -> Column:
    """Apply a named converter; null stays null."""
    if name in AFFINE:
        factor, offset = AFFINE[name]
        return value * F.lit(factor) + F.lit(offset) if offset else value * F.lit(factor)
    special = {
        "deg_to_rad": F.radians,
        "rad_to_deg": F.degrees,
        "deg_to_ratio": lambda x: F.tan(F.radians(x)),
        "ratio_to_deg": lambda x: F.degrees(F.atan(x)),
        "min_to_ms": lambda x: (x * 60000.0).cast("bigint"),
        "min_to_hour": lambda x: (x / 60.0).cast("bigint"),
    }
    return special[name](value)


def cells_to_acres(cells: Column, cell_size: float) -> Column:
    return cells * F.lit(cell_size * cell_size / ACRE_SQUARE_FEET)


def rotate_angle(degrees: Column, by: float) -> Column:
    return F.pmod(degrees + F.lit(by), F.lit(360.0))


def layer_value(value: Column, layer: str, units: str | None, multiplier: float = 1.0, rotate: float | None = None) -> Column:
    """A stored layer value in internal units: pre-multiplier, converter of the layer's units, then rotation."""
    out = value if multiplier == 1 else value * F.lit(multiplier)
    name = LAYER_UNITS.get((layer, units))
    out = convert(out, name) if name else out
    return out if rotate is None else rotate_angle(out, rotate)


def layer_envelope(left: Column, top: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """Bounds of a raster from its upper-left corner; rows grow to the south (negative scale_y)."""
    return F.struct(left.alias("xmin"), (top + scale_y * height).alias("ymin"), (left + scale_x * width).alias("xmax"), top.alias("ymax"))


def burn_history_class(burn_time: Column, clock: Column, burning_neighbour: Column) -> Column:
    """201: unburned beside fire, 200: unburned, 1 to 4: hours since ignition, 5: longer, 0: none of these."""
    hours = F.floor((clock - burn_time) / 60.0)
    return (
        F.when((burn_time == -1.0) & burning_neighbour, 201)
        .when(burn_time == -1.0, 200)
        .when((hours >= 0) & (hours < 4), (hours + 1).cast("int"))
        .when(hours >= 4, 5)
        .otherwise(0)
    )
