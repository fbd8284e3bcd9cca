"""Firebrand ignition, travel and landing as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (Albini 1979): maximum firebrand height for 3 mm (m), constants of its flight time.
BRAND_HEIGHT, FLIGHT_A, FLIGHT_B, STEADY_MINUTES = 117.0, 5.963, 4.563, 20.0
FEET_A_METRE = 3.281


def preignition_heat(celsius: Column, moisture: Column) -> Column:
    """Heat needed to ignite fine fuel (Schroeder 1969)."""
    dry = 144.512 - 0.266 * celsius - 0.00058 * celsius * celsius
    return dry - celsius * moisture + 18.54 * (1.0 - F.exp(-15.1 * moisture)) + 640.0 * moisture


def ignition_probability(celsius: Column, moisture: Column) -> Column:
    x = F.greatest((400.0 - preignition_heat(celsius, moisture)) / 10.0, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(x, F.lit(4.3)) * 0.000048 / 50.0))


def spot_probability(probability: Column, decay: Column, metres: Column) -> Column:
    return probability * F.exp(-decay * metres)


def maximum_height(diameter: Column) -> Column:
    return diameter * 0.39e5


def flight_minutes(flame_metres: Column) -> Column:
    rise = 1.2 + FLIGHT_A / 3.0 * (F.pow((FLIGHT_B + BRAND_HEIGHT / flame_metres) / FLIGHT_A, F.lit(1.5)) - 1.0)
    return 2.0 * F.sqrt(flame_metres) / 2.3 / 60.0 * rise


def spot_time(burn_time: Column, flame_metres: Column) -> Column:
    return burn_time + 2.0 * flight_minutes(flame_metres) + STEADY_MINUTES


def mean_distance(intensity: Column, wind: Column, mean: float, intensity_power: float, wind_power: float) -> Column:
    return mean * F.pow(intensity, F.lit(intensity_power)) * F.pow(wind, F.lit(wind_power))


def lognormal(mean: Column, variance: Column) -> tuple[Column, Column]:
    """mu and sigma of a lognormal distribution of the given mean and variance."""
    return F.log(mean * mean / F.sqrt(mean * mean + variance)), F.sqrt(F.log(1.0 + variance / (mean * mean)))


def lognormal_mean_feet(mu: Column, sigma: Column) -> Column:
    return F.exp(mu + sigma * sigma / 2.0) * FEET_A_METRE


def lognormal_variation(sigma: Column) -> Column:
    return F.sqrt(F.exp(sigma * sigma) - 1.0)


def crosswind_sigma(mu: Column, sigma: Column) -> Column:
    """Himoto's default spread across the wind."""
    h = F.exp(sigma * sigma / 2.0)
    return FEET_A_METRE * 0.92 * 0.47 / (0.88 * 0.88) * F.exp(mu) * h * (h + 1.0) * (h - 1.0)


def landing(wind_to: Column, along: Column, across: Column, cell: float) -> tuple[Column, Column]:
    """Rows and columns from the source to where a firebrand lands; half cells round up."""
    w = F.radians(wind_to)
    dx, dy = along * F.sin(w) + across * F.cos(w), -along * F.cos(w) + across * F.sin(w)
    return F.floor(dy / cell + 0.5), F.floor(dx / cell + 0.5)


def distance_variance(normalized: Column, mean_metres: Column) -> Column:
    """Variance of the downwind distance (m2) from its mean."""
    return normalized * mean_metres


def sardoy(intensity: Column, wind: Column, a: float, p: float, q: float, b: float) -> Column:
    """Sardoy's form for mu and sigma of the lognormal distance: intensity in kW/m, wind in m/s."""
    return a * (F.pow(intensity * 0.001, F.lit(p)) * F.pow(wind, F.lit(q))) + b


def spots_at_all(crowns: Column, crown_share: Column, intensity: Column, critical: Column, surface_share: Column, draw: Column) -> Column:
    """Whether a burning cell throws firebrands: by a share of crown fires, else of surface fires over a critical intensity."""
    return F.when(crowns, crown_share >= draw).otherwise((intensity > F.coalesce(critical, F.lit(0.0))) & (F.coalesce(surface_share, F.lit(0.0)) >= draw))
