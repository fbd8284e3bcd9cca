"""Suppression scalars as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import cells_to_acres


def bearing(row: Column, column: Column, row0: Column, column0: Column) -> Column:
    """Degrees clockwise from east, rows growing to the south."""
    theta = F.degrees(F.atan2(row - row0, column - column0))
    return F.when(row < row0, theta + 360.0).otherwise(theta)


def slice_of(theta: Column, size: float) -> Column:
    return F.floor(theta / size)


def joined_average(a: Column, n: Column, b: Column, m: Column) -> Column:
    return F.try_divide(a * n + b * m, n + m)


def parted_average(a: Column, n: Column, b: Column, m: Column) -> Column:
    return F.coalesce(F.try_divide(a * n - b * m, n - m), F.lit(0.0))


def contained_by_curve(runtime_fraction: Column, coefficient: Column) -> Column:
    return F.pow(2.0 * runtime_fraction / (1.0 + runtime_fraction * runtime_fraction), coefficient)


def growth_acres_per_day(cells: Column, cell_size: float, minutes: float) -> Column:
    return cells_to_acres(cells, cell_size) / (minutes / 1440.0)


def difficulty_factor(sensitivity: Column, multiplier: Column, mean_index: Column) -> Column:
    """Difficulty slows containment down and speeds up its loss: only the multiplier's sign counts."""
    return F.exp(F.when(multiplier >= 0.0, -1.0).otherwise(1.0) * sensitivity * mean_index)


def contained_by_index(previous: Column, percent_a_day: Column, multiplier: Column, difficulty: Column, minutes: float) -> Column:
    """The fraction contained after ``minutes`` more, never below 0."""
    change = percent_a_day * multiplier * difficulty * 0.01 * (minutes * 0.000694444)
    return F.greatest(F.lit(0.0), previous + change)


def growth_multiplier(area_reference: Column, area_rate: Column) -> Column:
    return 1.0 - F.try_divide(F.ln(area_rate), F.ln(area_reference))
