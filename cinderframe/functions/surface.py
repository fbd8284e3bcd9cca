"""Surface fire spread (Rothermel 1972, Albini 1976) as staged projections.

Each stage adds columns that the next one uses: the six size classes are scalar columns, not arrays under lambdas.
The optimiser merges stages into one, which repeats a shared intermediate wherever it is used. ``bound`` keeps a few
seams apart that would otherwise multiply it, by passing their columns through a one-element generator, which stays in
generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fuels import burnable, dynamic, dynamic_grass

#: Size classes: four dead ones (the fourth is cured herbaceous), two live ones.
CLASSES = ("1h", "10h", "100h", "cured", "herb", "woody")
DEAD, LIVE = CLASSES[:4], CLASSES[4:]
#: Lower bounds of surface-to-volume ratio classes; particle density, mineral contents.
SAV_BOUNDS = (1200.0, 192.0, 96.0, 48.0, 16.0)
DENSITY, MINERAL_TOTAL, MINERAL_EFFECTIVE = 32.0, 0.0555, 0.01


def col(name: str) -> Column:
    return F.col(name)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def bound(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns that are worked out once, here, whatever uses them later. ``keep``: the other columns to go on with."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(c for c in (df.columns if keep is None else keep) if c not in columns), made)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def moisturized(cells: DataFrame) -> DataFrame:
    """Add each class's load, ratio, moisture and weights. ``cells``: fuel columns and fm_1h .. fm_woody (ratios)."""
    cures = dynamic(col("base")) & (col("load_herb") > 0)
    green = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col("fm_herb") / 0.9 - 1 / 3))
    out = cells.withColumns({"_cures": cures, "_green": F.when(cures, green).otherwise(1.0)})
    first = {
        "_w_cured": F.when(col("_cures"), col("load_herb") * (1.0 - col("_green"))).otherwise(0.0),
        "_w_herb": col("load_herb") * col("_green"),
        "_s_cured": F.when(col("_cures"), col("sav_herb")).otherwise(0.0),
        "_m_cured": F.when(col("_cures"), col("fm_1h")).otherwise(0.0),
    }
    first |= {f"_w_{c}": col(f"load_{c}") for c in ("1h", "10h", "100h", "woody")}
    first |= {f"_s_{c}": col(f"sav_{c}") for c in CLASSES if c != "cured"}
    first |= {f"_m_{c}": col(f"fm_{c}") for c in CLASSES if c != "cured"}
    out = out.withColumns(first)

    def bin_of(sav: Column) -> Column:
        return total((sav < b).cast("int") for b in SAV_BOUNDS)

    out = out.withColumns({f"_a_{c}": col(f"_s_{c}") * col(f"_w_{c}") / DENSITY for c in CLASSES} | {f"_bin_{c}": bin_of(col(f"_s_{c}")) for c in CLASSES})
    out = out.withColumns({"_a_dead": total(col(f"_a_{c}") for c in DEAD), "_a_live": total(col(f"_a_{c}") for c in LIVE)})
    out = out.withColumns(
        {f"_f_{c}": share(col(f"_a_{c}"), col("_a_dead" if c in DEAD else "_a_live")) for c in CLASSES}
        | {f"_f_{k}": share(col(f"_a_{k}"), col("_a_dead") + col("_a_live")) for k in ("dead", "live")}
    )
    weights = {}
    for group in (DEAD, LIVE):
        for c in group:
            weights[f"_g_{c}"] = total(F.when(col(f"_bin_{c}") == col(f"_bin_{o}"), col(f"_f_{o}")).otherwise(0.0) for o in group)
    for group, rate in ((DEAD, -138.0), (LIVE, -500.0)):
        for c in group:
            weights[f"_l_{c}"] = F.when(col(f"_s_{c}") > 0, col(f"_w_{c}") * F.exp(rate / F.nullif(col(f"_s_{c}"), F.lit(0.0)))).otherwise(0.0)
    out = out.withColumns(weights)
    out = out.withColumns({"_l_dead": total(col(f"_l_{c}") for c in DEAD), "_l_live": total(col(f"_l_{c}") for c in LIVE), "_lm_dead": total(col(f"_l_{c}") * col(f"_m_{c}") for c in DEAD)})
    drying = 1.0 - share(col("_lm_dead"), col("_l_dead")) / F.nullif(col("mx_dead"), F.lit(0.0))
    live = F.greatest(col("mx_dead"), 2.9 * (col("_l_dead") / F.nullif(col("_l_live"), F.lit(0.0))) * drying - 0.226)
    return out.withColumn("_mx_live", F.when(col("_l_live") > 0, live).otherwise(col("mx_dead")))


def with_minimum_spread(cells: DataFrame, grass_suppression: bool = False) -> DataFrame:
    """Add base_rate (ft/min), reaction_intensity (Btu/ft2/min), residence_time (min) and the wind and slope
    coefficients of the no-wind, no-slope fire; 0 for fuels that don't burn."""
    out = moisturized(cells)
    made = [c for c in out.columns if c.startswith("_")]
    out = bound(out, {c: col(c) for c in made})
    stage = {
        "_sigma": total(col(f"_f_{k}") * total(col(f"_f_{c}") * col(f"_s_{c}") for c in group) for k, group in (("dead", DEAD), ("live", LIVE))),
        "_beta": share(total(col(f"_w_{c}") for c in CLASSES) / DENSITY, col("depth")),
        "_rho": share(total(col(f"_w_{c}") for c in CLASSES), col("depth")),
    }
    for k, group, mx in (("dead", DEAD, col("mx_dead")), ("live", LIVE, col("_mx_live"))):
        held, least = total(col(f"_f_{c}") * col(f"_m_{c}") for c in group), total(col(f"_f_{c}") for c in group) * mx
        stage[f"_r_{k}"] = F.when(least > 0, F.least(F.lit(1.0), held / F.nullif(least, F.lit(0.0)))).otherwise(1.0)
        stage[f"_net_{k}"] = total(col(f"_g_{c}") * col(f"_w_{c}") for c in group) * (1.0 - MINERAL_TOTAL)
        stage[f"_heat_{k}"] = total(col(f"_f_{c}") for c in group) * col("heat")
        mineral = total(col(f"_f_{c}") for c in group) * MINERAL_EFFECTIVE
        stage[f"_min_{k}"] = F.when(mineral > 0, 0.174 / F.pow(F.nullif(mineral, F.lit(0.0)), F.lit(0.19))).otherwise(1.0)
        stage[f"_eps_{k}"] = total(
            F.when(col(f"_s_{c}") > 0, col(f"_f_{c}") * F.exp(-138.0 / F.nullif(col(f"_s_{c}"), F.lit(0.0))) * (250.0 + 1116.0 * col(f"_m_{c}"))).otherwise(0.0) for c in group
        )
    out = bound(out, stage, [*cells.columns, *made])
    burns = burnable(col("model")) & (col("_sigma") > 0) & (col("_beta") > 0)
    damp = {k: 1.0 - 2.59 * col(f"_r_{k}") + 5.11 * F.pow(col(f"_r_{k}"), F.lit(2.0)) - 3.52 * F.pow(col(f"_r_{k}"), F.lit(3.0)) for k in ("dead", "live")}
    out = out.withColumns({
        "_burns": burns,
        "_btus": total(col(f"_net_{k}") * col(f"_heat_{k}") * damp[k] * col(f"_min_{k}") for k in ("dead", "live")),
        "_opt": col("_beta") / (3.348 / F.pow(F.greatest(col("_sigma"), F.lit(1.0)), F.lit(0.8189))),
        "_eps": col("_f_dead") * col("_eps_dead") + col("_f_live") * col("_eps_live"),
    })
    sigma = F.greatest(col("_sigma"), F.lit(1.0))
    peak = F.pow(sigma, F.lit(1.5)) / (495.0 + 0.0594 * F.pow(sigma, F.lit(1.5)))
    bend = 133.0 / F.pow(sigma, F.lit(0.7913))
    flux = F.exp((0.792 + 0.681 * F.sqrt(sigma)) * (col("_beta") + 0.1)) / (192.0 + 0.2595 * sigma)
    out = bound(out, {c: col(c) for c in ("_burns", "_btus", "_opt", "_eps", "_sigma", "_beta", "_rho")}, cells.columns)
    out = bound(out, {
        "_gamma": peak * F.pow(col("_opt"), bend) * F.exp(bend * (1.0 - col("_opt"))),
        "_xi": flux,
        "wind_b": F.when(col("_burns"), 0.02526 * F.pow(sigma, F.lit(0.54))),
        "wind_c": F.when(col("_burns"), 7.47 * F.exp(-0.133 * F.pow(sigma, F.lit(0.55)))),
        "wind_f": F.when(col("_burns"), F.pow(col("_opt"), 0.715 * F.exp(-3.59 * sigma / 10000.0))),
        "slope_k": F.when(col("_burns"), 5.275 * F.pow(col("_beta"), F.lit(-0.3))),
    })
    rate = F.when(col("_burns") & (col("_rho") * col("_eps") > 0), col("_gamma") * col("_btus") * col("_xi") / F.nullif(col("_rho") * col("_eps"), F.lit(0.0))).otherwise(0.0)
    if grass_suppression:
        rate = rate * F.when(dynamic_grass(col("base")), 0.5).otherwise(1.0)
    out = out.withColumns({
        "base_rate": rate,
        "reaction_intensity": F.when(col("_burns"), col("_gamma") * col("_btus")).otherwise(0.0),
        "residence_time": F.when(col("_burns"), 384.0 / sigma).otherwise(0.0),
    })
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def wind_adjustment(depth: Column, canopy_height: Column, canopy_cover: Column) -> Column:
    """Midflame over 20-ft wind speed (Andrews 2012): sheltered, unsheltered, 0 without fuel."""
    def log_profile(h: Column) -> Column:
        return F.log((20.0 + 0.36 * h) / (0.13 * F.nullif(h, F.lit(0.0))))

    sheltered = 0.555 / (F.sqrt(canopy_cover / 300.0 * canopy_height) * log_profile(canopy_height))
    return F.when((canopy_cover > 0) & (canopy_height > 0), sheltered).when(depth > 0, 1.83 / log_profile(depth)).otherwise(0.0)


def wind_adjustment_metric(depth: Column, canopy_height: Column, canopy_cover: Column) -> Column:
    """The same factor as another fire model works it out: canopy height in metres, cover a ratio."""
    h = canopy_height / 0.3048
    sheltered = 1.0 / F.log((20.0 + 0.36 * h) / (0.13 * F.nullif(h, F.lit(0.0)))) * (0.555 / F.sqrt(canopy_cover / 3.0 * h))
    bare = 1.36 * F.log((20.0 + 0.36 * depth) / (0.13 * F.nullif(depth, F.lit(0.0)))) * (F.log(F.lit(1.36 / 0.13)) - 1.0)
    return F.when((canopy_cover > 0) & (canopy_height > 0), sheltered).when(depth > 0, bare).otherwise(0.0)


def angle_between(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def nearly_zero(x: Column) -> Column:
    return F.abs(x) < 0.000001


def with_maximum_spread(cells: DataFrame, wind: Column, wind_from: Column, slope: Column, aspect: Column, ellipse: Column, adjustment: Column) -> DataFrame:
    """Add max_rate (ft/min), max_direction (degrees), effective_wind (ft/min) and eccentricity.

    ``wind``: midflame, ft/min. ``slope``: rise over run. Needs the columns of with_minimum_spread. The combined
    wind and slope effect is a vector sum; the effective wind is capped at 0.9 times the reaction intensity.
    """
    wind_to, upslope = F.pmod(wind_from + 180.0, F.lit(360.0)), F.pmod(aspect + 180.0, F.lit(360.0))

    def phi_wind(speed: Column) -> Column:
        return F.when(speed > 0, F.pow(speed, col("wind_b")) * (col("wind_c") / F.nullif(col("wind_f"), F.lit(0.0)))).otherwise(0.0)

    def wind_of(phi: Column) -> Column:
        return F.when(phi > 0, F.pow(phi * (col("wind_f") / F.nullif(col("wind_c"), F.lit(0.0))), 1.0 / col("wind_b"))).otherwise(0.0)

    out = bound(cells, {
        "_r": col("base_rate") * adjustment, "_u": wind, "_to": wind_to, "_up": upslope, "_cap": 0.9 * col("reaction_intensity"), "_e": ellipse,
        "_flat": nearly_zero(slope), "_calm": nearly_zero(wind), "_ps": F.when(slope > 0, col("slope_k") * slope * slope).otherwise(0.0), "_pw": phi_wind(wind),
    })
    turn = F.radians(F.pmod(col("_to") - col("_up"), F.lit(360.0)))
    out = bound(out, {"_x": col("_r") * (col("_ps") + col("_pw") * F.cos(turn)), "_y": col("_r") * col("_pw") * F.sin(turn)})
    out = out.withColumns({"_v": F.sqrt(col("_x") * col("_x") + col("_y") * col("_y")), "_with": angle_between(col("_to"), col("_up")) < 15.0})
    across = ~col("_flat") & ~col("_calm") & ~col("_with")
    still = across & nearly_zero(col("_v"))
    bearing = F.degrees(F.atan2(col("_y"), col("_x")))
    phi = (
        F.when(col("_flat") & col("_calm"), 0.0).when(col("_flat"), col("_pw")).when(col("_calm"), col("_ps"))
        .when(col("_with"), col("_pw") + col("_ps")).when(still, 0.0).otherwise(col("_v") / F.nullif(col("_r"), F.lit(0.0)))
    )
    direction = (
        F.when(col("_flat") & col("_calm"), 0.0).when(col("_flat"), col("_to")).when(col("_calm") | col("_with"), col("_up"))
        .when(still, 0.0).otherwise(F.pmod(col("_up") + bearing, F.lit(360.0)))
    )
    out = bound(out, {"_phi": phi, "max_direction": direction})
    out = bound(out, {"_eff": F.when(col("_flat") & ~col("_calm"), col("_u")).otherwise(wind_of(col("_phi")))})
    over = col("_eff") > col("_cap")
    out = out.withColumns({"max_rate": col("_r") * (1.0 + F.when(over, phi_wind(col("_cap"))).otherwise(col("_phi"))), "effective_wind": F.when(over, col("_cap")).otherwise(col("_eff"))})
    lw = 1.0 + 0.002840909 * col("effective_wind") * col("_e")
    out = out.withColumn("eccentricity", F.sqrt(lw * lw - 1.0) / lw)
    out = out.withColumns({"max_rate": F.coalesce("max_rate", F.lit(0.0)), "effective_wind": F.coalesce("effective_wind", F.lit(0.0)), "eccentricity": F.coalesce("eccentricity", F.lit(0.0)), "max_direction": F.coalesce("max_direction", F.lit(0.0))})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def rate_towards(max_rate: Column, max_direction: Column, eccentricity: Column, direction: Column) -> Column:
    """Spread rate in a direction, from the ellipse with the ignition at its rear focus."""
    theta = angle_between(max_direction, direction)
    shape = (1.0 - eccentricity) / (1.0 - eccentricity * F.cos(F.radians(theta)))
    return F.when(nearly_zero(eccentricity) | nearly_zero(theta), max_rate).otherwise(max_rate * shape)


def normal_rate(eccentricity: Column, cos_angle: Column) -> Column:
    """Rate of the front's normal motion over the maximum rate, by the cosine of its angle to the maximum."""
    ec = eccentricity * cos_angle
    return (ec + F.sqrt(1.0 - eccentricity * eccentricity + ec * ec)) / (1.0 + eccentricity)


def fireline_intensity(reaction: Column, rate: Column, residence: Column) -> Column:
    """Byram's intensity (Btu/ft/s) from Anderson's flame depth."""
    return reaction * (rate * residence) / 60.0


def flame_length(intensity: Column) -> Column:
    return 0.45 * F.pow(intensity, F.lit(0.46))
