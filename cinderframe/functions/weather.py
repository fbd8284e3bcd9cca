"""Fuel moisture from weather, and sunrise, sunset and burn periods, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def equilibrium_moisture(humidity: Column, temperature: Column) -> Column:
    """Equilibrium moisture content (ratio) from relative humidity (%) and temperature (F), in three humidity ranges."""
    dry = 0.03229 + 0.281073 * humidity - 0.000578 * humidity * temperature
    mid = 2.22749 + 0.160107 * humidity - 0.01478 * temperature
    wet = 21.0606 + 0.005565 * humidity * humidity - 0.00035 * humidity * temperature - 0.483199 * humidity
    return F.when(humidity < 10, dry).when(humidity < 50, mid).otherwise(wet) / 30.0


def fuel_moistures(humidity: Column, temperature: Column) -> dict[str, Column]:
    """Moisture by size class from the equilibrium content."""
    emc = equilibrium_moisture(humidity, temperature)
    return {"fm_1h": emc + 0.002, "fm_10h": emc + 0.015, "fm_100h": emc + 0.025, "fm_herb": emc * 2.0, "fm_woody": emc * 0.5}


#: Fixed values (NOAA solar equations): cosine and sine coefficients by harmonic.
EQUATION_OF_TIME = [(0.000075, 0.0), (0.001868, -0.032077), (-0.014615, -0.040849)]
DECLINATION = [(0.006918, 0.0), (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148)]
EQUATION_MINUTES, HORIZON_DEGREES = 229.18, 90.833


def harmonics(coefficients: list[tuple[float, float]], angle: Column) -> Column:
    total = F.lit(0.0)
    for k, (c, s) in enumerate(coefficients):
        total = total + F.lit(c) * F.cos(angle * k) + F.lit(s) * F.sin(angle * k)
    return total


def year_angle(ts: Column) -> Column:
    """The share of its UTC year that a timestamp has passed, as an angle."""
    ts = ts.cast("timestamp")
    first, after = F.date_trunc("year", ts), F.add_months(F.date_trunc("year", ts).cast("date"), 12).cast("timestamp")
    return (F.unix_micros(ts) - F.unix_micros(first)) / (F.unix_micros(after) - F.unix_micros(first)) * (2 * math.pi)


def sun_hours(lat: Column, lon: Column, angle: Column) -> tuple[Column, Column]:
    """UTC hours of sunrise and sunset at latitude and longitude in degrees."""
    decl, phi = harmonics(DECLINATION, angle), F.radians(lat)
    half = F.acos(math.cos(math.radians(HORIZON_DEGREES)) / (F.cos(phi) * F.cos(decl)) - F.tan(phi) * F.tan(decl))
    noon = 12.0 - harmonics(EQUATION_OF_TIME, angle) * EQUATION_MINUTES / 60.0 - lon / 15.0
    return noon - F.degrees(half) / 15.0, noon + F.degrees(half) / 15.0


def clock(hour: Column) -> Column:
    """HH:MM of an hour, wrapped to a day; minutes are rounded half up, so the last half minute of an hour shows as :60, which
    readers of burn periods take as the next hour."""
    minutes = F.floor((hour - F.when(hour < 0, F.ceil(hour)).otherwise(F.floor(hour))) * 60.0 + 0.5)
    return F.format_string("%02d:%02d", F.pmod(F.floor(hour), F.lit(24)).cast("int"), minutes.cast("int"))


def burn_period(lat: Column, lon: Column, ts: Column, length: Column | None = None, fraction: float = 0.5) -> tuple[Column, Column]:
    """Start and end of the daily burn period: from sunrise to sunset, or ``length`` hours around a centre between them."""
    rise, fall = sun_hours(lat, lon, year_angle(ts))
    if length is None:
        return clock(rise), clock(fall)
    centre = rise * (1 - fraction) + fall * fraction
    return clock(centre - length * 0.5), clock(centre + length * 0.5)
