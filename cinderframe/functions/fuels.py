"""The fuel dimension: standard surface fuel models and predicates on their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values (Anderson 1982, Scott and Burgan 2005): number, name, depth (ft), dead extinction moisture (%),
#: heat (1000 Btu/lb), loads (lb/ft2) and surface-to-volume ratios (1/ft) of dead 1h, 10h, 100h, live herb, woody.
#: 98 and 99 bear the names that fire models with consecutive ones give them; Scott and Burgan call them NB8 and NB9.
MODELS = """
1 R01 1.0 12 8 0.0340 0 0 0 0 3500 0 0 0 0
2 R02 1.0 15 8 0.0920 0.0460 0.0230 0.0230 0 3000 109 30 1500 0
3 R03 2.5 25 8 0.1380 0 0 0 0 1500 0 0 0 0
4 R04 6.0 20 8 0.2300 0.1840 0.0920 0.2300 0 2000 109 30 1500 0
5 R05 2.0 20 8 0.0460 0.0230 0 0.0920 0 2000 109 0 1500 0
6 R06 2.5 25 8 0.0690 0.1150 0.0920 0 0 1750 109 30 0 0
7 R07 2.5 40 8 0.0520 0.0860 0.0690 0.0170 0 1750 109 30 1550 0
8 R08 0.2 30 8 0.0690 0.0460 0.1150 0 0 2000 109 30 0 0
9 R09 0.2 25 8 0.1340 0.0190 0.0070 0 0 2500 109 30 0 0
10 R10 1.0 25 8 0.1380 0.0920 0.2300 0.0920 0 2000 109 30 1500 0
11 R11 1.0 15 8 0.0690 0.2070 0.2530 0 0 1500 109 30 0 0
12 R12 2.3 20 8 0.1840 0.6440 0.7590 0 0 1500 109 30 0 0
13 R13 3.0 25 8 0.3220 1.0580 1.2880 0 0 1500 109 30 0 0
91 NB1 0 0 0 0 0 0 0 0 0 0 0 0 0
92 NB2 0 0 0 0 0 0 0 0 0 0 0 0 0
93 NB3 0 0 0 0 0 0 0 0 0 0 0 0 0
98 NB4 0 0 0 0 0 0 0 0 0 0 0 0 0
99 NB5 0 0 0 0 0 0 0 0 0 0 0 0 0
101 GR1 0.4 15 8 0.0046 0 0 0.0138 0 2200 109 30 2000 0
102 GR2 1.0 15 8 0.0046 0 0 0.0459 0 2000 109 30 1800 0
103 GR3 2.0 30 8 0.0046 0.0184 0 0.0689 0 1500 109 30 1300 0
104 GR4 2.0 15 8 0.0115 0 0 0.0872 0 2000 109 30 1800 0
105 GR5 1.5 40 8 0.0184 0 0 0.1148 0 1800 109 30 1600 0
106 GR6 1.5 40 9 0.0046 0 0 0.1561 0 2200 109 30 2000 0
107 GR7 3.0 15 8 0.0459 0 0 0.2479 0 2000 109 30 1800 0
108 GR8 4.0 30 8 0.0230 0.0459 0 0.3352 0 1500 109 30 1300 0
109 GR9 5.0 40 8 0.0459 0.0459 0 0.4132 0 1800 109 30 1600 0
121 GS1 0.9 15 8 0.0092 0 0 0.0230 0.0298 2000 109 30 1800 1800
122 GS2 1.5 15 8 0.0230 0.0230 0 0.0275 0.0459 2000 109 30 1800 1800
123 GS3 1.8 40 8 0.0138 0.0115 0 0.0666 0.0574 1800 109 30 1600 1600
124 GS4 2.1 40 8 0.0872 0.0138 0.0046 0.1561 0.3260 1800 109 30 1600 1600
141 SH1 1.0 15 8 0.0115 0.0115 0 0.0069 0.0597 2000 109 30 1800 1600
142 SH2 1.0 15 8 0.0620 0.1102 0.0344 0 0.1768 2000 109 30 0 1600
143 SH3 2.4 40 8 0.0207 0.1377 0 0 0.2847 1600 109 30 0 1400
144 SH4 3.0 30 8 0.0390 0.0528 0.0092 0 0.1171 2000 109 30 1800 1600
145 SH5 6.0 15 8 0.1653 0.0964 0 0 0.1331 750 109 30 0 1600
146 SH6 2.0 30 8 0.1331 0.0666 0 0 0.0643 750 109 30 0 1600
147 SH7 6.0 15 8 0.1607 0.2433 0.1010 0 0.1561 750 109 30 0 1600
148 SH8 3.0 40 8 0.0941 0.1561 0.0390 0 0.1997 750 109 30 0 1600
149 SH9 4.4 40 8 0.2066 0.1125 0 0.0712 0.3214 750 109 30 1800 1500
161 TU1 0.6 20 8 0.0092 0.0413 0.0689 0.0092 0.0413 2000 109 30 1800 1600
162 TU2 1.0 30 8 0.0436 0.0826 0.0574 0 0.0092 2000 109 30 0 1600
163 TU3 1.3 30 8 0.0505 0.0069 0.0115 0.0298 0.0505 1800 109 30 1600 1400
164 TU4 0.5 12 8 0.2066 0 0 0 0.0918 2300 109 30 0 2000
165 TU5 1.0 25 8 0.1837 0.1837 0.1377 0 0.1377 1500 109 30 0 750
181 TL1 0.2 30 8 0.0459 0.1010 0.1653 0 0 2000 109 30 0 0
182 TL2 0.2 25 8 0.0643 0.1056 0.1010 0 0 2000 109 30 0 0
183 TL3 0.3 20 8 0.0230 0.1010 0.1286 0 0 2000 109 30 0 0
184 TL4 0.4 25 8 0.0230 0.0689 0.1928 0 0 2000 109 30 0 0
185 TL5 0.6 25 8 0.0528 0.1148 0.2020 0 0 2000 109 30 0 1600
186 TL6 0.3 25 8 0.1102 0.0551 0.0551 0 0 2000 109 30 0 0
187 TL7 0.4 25 8 0.0138 0.0643 0.3719 0 0 2000 109 30 0 0
188 TL8 0.3 35 8 0.2663 0.0643 0.0505 0 0 1800 109 30 0 0
189 TL9 0.6 35 8 0.3053 0.1515 0.1905 0 0 1800 109 30 0 1600
201 SB1 1.0 25 8 0.0689 0.1377 0.5051 0 0 2000 109 30 0 0
202 SB2 1.0 25 8 0.2066 0.1951 0.1837 0 0 2000 109 30 0 0
203 SB3 1.2 25 8 0.2525 0.1263 0.1377 0 0 2000 109 30 0 0
204 SB4 2.7 25 8 0.2410 0.1607 0.2410 0 0 2000 109 30 0 0
"""
#: Variants for the wildland-urban interface by family: first variant, last variant, first original.
WUI_FAMILIES = [(211, 218, 101), (221, 224, 121), (241, 249, 141), (261, 263, 161), (265, 265, 165), (281, 289, 181), (301, 303, 201)]

COLUMNS = ["model", "name", "depth", "mx_dead", "heat", *(f"{k}_{c}" for k in ("load", "sav") for c in ("1h", "10h", "100h", "herb", "woody"))]


def model_rows() -> list[tuple]:
    """Every model in the fixed table: extinction moisture as a ratio, heat in Btu/lb."""
    out = []
    for line in MODELS.split("\n"):
        if line:
            number, name, *values = line.split()
            depth, mx, heat, *rest = map(float, values)
            out.append((int(number), name, depth, mx * 0.01, heat * 1000.0, *rest))
    return out


def wui_synonyms() -> dict[int, int]:
    return {v: o + v - a for a, b, o in WUI_FAMILIES for v in range(a, b + 1)}


def fuel_models(spark: SparkSession, synonyms: bool = True) -> DataFrame:
    """The dimension table, one row a model; variants carry their original's values, and its number in ``base``.

    Its size is fixed (58 models and 37 variants), so joining it by broadcast is safe at any scale.
    """
    rows = {r[0]: r for r in model_rows()}
    found = [(*r, r[0]) for r in rows.values()]
    if synonyms:
        found += [(v, *rows[o][1:], o) for v, o in wui_synonyms().items()]
    kinds = ["int", "string", *["double"] * 13, "int"]
    return spark.createDataFrame(found, ", ".join(f"{c} {k}" for c, k in zip([*COLUMNS, "base"], kinds)))


def burnable(model: Column) -> Column:
    return (model > 0) & ((model < 91) | (model > 99))


def dynamic(model: Column) -> Column:
    """Models whose live herbaceous load cures with its moisture."""
    return model > 100


def dynamic_grass(model: Column) -> Column:
    return model.between(101, 109) | model.between(211, 219)
