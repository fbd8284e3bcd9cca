"""Crown fire initiation, spread and intensity as Columns, in imperial units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import convert


def critical_intensity(base_height_m: Column, foliar_percent: Column) -> Column:
    """Van Wagner's critical fireline intensity (kW/m)."""
    return F.pow((foliar_percent * 26.0 + 460.0) * 0.01 * base_height_m, F.lit(1.5))


def initiates(cover: Column, base_height: Column, foliar: Column, intensity: Column) -> Column:
    """Whether a surface fire reaches the crowns: cover (%), base height (ft), foliar moisture (ratio), intensity (Btu/ft/s)."""
    metric = convert(intensity, "btu_ft_s_to_kw_m")
    needed = critical_intensity(convert(base_height, "ft_to_m"), foliar * 100.0)
    return (cover > 40.0) & (metric > 0.0) & (base_height > 0.0) & (metric >= needed)


def spread(wind_20ft: Column, bulk_density: Column, fine_moisture: Column) -> Column:
    """Cruz crown spread rate (ft/min): positive if active, negative if passive."""
    wind = convert(convert(wind_20ft, "mph_to_kmh"), "wind_20ft_to_10m")
    density = convert(bulk_density, "lb_ft3_to_kg_m3")
    active = 11.02 * F.pow(wind, F.lit(0.9)) * F.pow(density, F.lit(0.19)) * F.exp(fine_moisture * 100.0 * -0.17)
    ratio = active * density / 3.0  # the critical rate is 3 m/min over density
    return convert(F.when(ratio > 1.0, active).otherwise(-active * F.exp(-ratio)), "m_to_ft")


def intensity(rate: Column, bulk_density: Column, crown_length: Column, heat: Column) -> Column:
    return rate * bulk_density * crown_length * heat / 60.0


def length_to_width(wind_20ft: Column, adjustment: Column) -> Column:
    return 1.0 + 0.125 * wind_20ft * adjustment


def eccentricity(wind_20ft: Column, adjustment: Column) -> Column:
    lw = length_to_width(wind_20ft, adjustment)
    return F.sqrt(lw * lw - 1.0) / lw
