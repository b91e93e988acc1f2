"""Rain, terrain and alert rules as column expressions. Unknown is never safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terrain bands (inclusive upper bound in metres, label, flood rate, lift).
TERRAIN_BANDS = (
    (2.0, "VERY_HIGH", 0.355, 5.5),
    (5.0, "HIGH", 0.148, 2.3),
    (10.0, "MODERATE", 0.052, 0.8),
    (20.0, "LOW", 0.004, 0.1),
    (float("inf"), "VERY_LOW", 0.000, 0.0),
)
RISK_ORDER = ("VERY_LOW", "LOW", "MODERATE", "HIGH", "VERY_HIGH")
TRIGGERS = {"VERY_HIGH": "ADVISORY", "HIGH": "ADVISORY", "MODERATE": "WARNING", "LOW": "EXTREME", "VERY_LOW": "EXTREME"}
SEVERITY = {"NONE": 0, "ADVISORY": 1, "WARNING": 2, "EXTREME": 3}
ALERTS = ("WATCH", "PREPARE", "EVACUATE")
NEAR_FLOOD_M = 500


def rain_rate(dbz: Column, no_echo: float = -250.0) -> Column:
    """mm/h of radar reflectivity (Z = 200 R^1.6); 0 at or below the no-echo code."""
    clipped = F.greatest(F.lit(-30.0), F.least(F.lit(80.0), dbz))
    return F.when(dbz.isNull(), None).when(dbz <= no_echo, 0.0).otherwise(F.pow(F.pow(F.lit(10.0), clipped / 10) / 200, F.lit(1 / 1.6)))


def twi(area: Column, slope_deg: Column, floor_deg: float = 0.05) -> Column:
    """Topographic wetness index ln(a / tan slope) with a floor on the slope."""
    return F.log(area / F.tan(F.radians(F.greatest(slope_deg, F.lit(floor_deg)))))


def spi(area: Column, slope_deg: Column, floor_deg: float = 0.05) -> Column:
    """Stream power index ln(1 + a tan slope)."""
    return F.log(1 + area * F.tan(F.radians(F.greatest(slope_deg, F.lit(floor_deg)))))


def catchment_m(cells: Column, cell_m: float, squared: bool = False) -> Column:
    """Contributing area: max(cells, 1) * cell, or cells * cell^2."""
    return cells * cell_m**2 if squared else F.greatest(cells, F.lit(1)) * cell_m


def calibrate(p: Column, weight: float) -> Column:
    """A probability with class weighting undone, by its odds."""
    odds = p / F.greatest(1 - p, F.lit(1e-9)) / weight
    return odds / (1 + odds)


def scenario(df: DataFrame, levels: Sequence[float], cap: float = 40.0, hour_share: float = 0.20) -> DataFrame:
    """Rows for each rain level, with rain_6h = min(level, cap) and rain_1h a share of it.

    The levels are a literal array, exploded in place: no join.
    """
    out = df.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    out = out.withColumn("rain_6h", F.least("level", F.lit(cap)))
    return out.withColumn("rain_1h", F.col("rain_6h") * hour_share)


def terrain_band(rel: Column, inclusive: bool = True) -> Column:
    """struct(band, rate, lift) of a height above the local minimum; NULL is UNKNOWN."""
    out = F.when(rel.isNull() | F.isnan(rel), F.struct(F.lit("UNKNOWN").alias("band"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("lift")))
    for upper, band, rate, lift in TERRAIN_BANDS:
        fits = F.lit(True) if upper == float("inf") else (rel <= upper) if inclusive else (rel < upper)
        out = out.when(fits, F.struct(F.lit(band).alias("band"), F.lit(rate).alias("rate"), F.lit(lift).alias("lift")))
    return out


def static_risk(band: Column, flood_m: Column) -> Column:
    """The band, raised one step if a past flood is within 500 m; UNKNOWN stays."""
    order = F.array(*map(F.lit, RISK_ORDER))
    at = F.array_position(order, band)
    raised = F.when(F.coalesce(flood_m <= NEAR_FLOOD_M, F.lit(False)), F.least(at + 1, F.lit(len(RISK_ORDER)))).otherwise(at)
    return F.when(at == 0, "UNKNOWN").otherwise(F.try_element_at(order, raised.cast("int")))


def rain_trigger(band: Column) -> Column:
    """Rain level at which a band acts; bands without one use the middle level."""
    table = F.create_map(*[F.lit(x) for kv in TRIGGERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, band), F.lit("WARNING"))


def warning_level(mm1h: Column, mm3h: Column, mm12h: Column) -> Column:
    """Official rain level, most severe first; a missing total counts as 0."""
    r1, r3, r12 = (F.coalesce(c, F.lit(0.0)) for c in (mm1h, mm3h, mm12h))
    return (
        F.when((r1 >= 72) | ((r1 >= 50) & (r3 >= 90)), "EXTREME")
        .when((r3 >= 90) | (r12 >= 180), "WARNING")
        .when((r3 >= 60) | (r12 >= 110), "ADVISORY")
        .otherwise("NONE")
    )


def _severity(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), level)


def alert(risk: Column, available: Column, level: Column, trigger: Column) -> Column:
    """UNKNOWN terrain, then unavailable rain, give UNKNOWN; no warning is CALM; else by the gap."""
    gap = F.greatest(F.lit(0), F.least(F.lit(2), _severity(level) - _severity(trigger)))
    return (
        F.when(risk == "UNKNOWN", "UNKNOWN")
        .when(~F.coalesce(available, F.lit(False)), "UNKNOWN")
        .when(level == "NONE", "CALM")
        .otherwise(F.element_at(F.array(*map(F.lit, ALERTS)), (gap + 1).cast("int")))
    )


def reasons(rel_m: Column, river_m: Column, flood_m: Column, available: Column, level: Column) -> Column:
    """The reasons for which there is evidence, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(rel_m.isNotNull(), F.format_string("%.1f m above the lowest ground nearby", rel_m)),
            F.when(river_m.isNotNull(), F.format_string("%.1f m above the nearest river", river_m)),
            F.when(flood_m.isNotNull(), F.format_string("past flood %d m away", flood_m.cast("long"))),
            F.when(F.coalesce(available, F.lit(False)) & (level != "NONE"), F.concat(F.lit("rain level "), level)),
            F.when(~F.coalesce(available, F.lit(False)), "rain unavailable"),
        )
    )


def risk_view(risk: Column, available: Column, mm6h: Column, mm3h: Column, mm1h: Column, station_km: Column) -> Column:
    """struct(badge, word, rain): what a card shows. UNKNOWN never reads as safe."""
    badge = F.when(risk.isin("VERY_HIGH", "HIGH", "UNKNOWN"), "warning").otherwise("safe")
    words = F.create_map(*[F.lit(x) for kv in {"VERY_LOW": "Very low", "LOW": "Low", "MODERATE": "Moderate", "HIGH": "High", "VERY_HIGH": "Very high"}.items() for x in kv])
    said = lambda hours, c: F.when(c.isNotNull(), F.format_string(f"{hours} h: %.1f mm", c))
    far = F.when(station_km >= 3, F.format_string(" (gauge %.1f km away)", station_km)).otherwise("")
    rain = F.concat(F.coalesce(said(6, mm6h), said(3, mm3h), said(1, mm1h), F.lit("unavailable")), far)
    return F.struct(
        badge.alias("badge"),
        F.coalesce(F.try_element_at(words, risk), F.lit("Unknown")).alias("word"),
        F.when(F.coalesce(available, F.lit(False)), rain).otherwise("unavailable").alias("rain"),
    )


def band_of(score: Column, cutoffs: Sequence[tuple[str, float]], default: str | None = None) -> Column:
    """First band, from the highest cut-off, with score >= its least score."""
    out = F.when(score.isNull(), None)
    for name, least in sorted(cutoffs, key=lambda x: -x[1]):
        out = out.when(score >= least, name)
    return out.otherwise(default)
