"""Distances on the WGS-84 ellipsoid, Web-Mercator coordinates and grid keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS-84 semi-major axis (m) and squared eccentricity.
EARTH_A = 6378137.0
EARTH_E2 = 0.0066943799901413165

# Lower bounds of one degree in metres: latitude at the equator, longitude times cos(lat).
_LAT_DEG_M = 110574.0
_LON_DEG_M = 111319.0
_KEY = 1 << 32


def wrap_degrees(delta: Column) -> Column:
    """A longitude difference brought into [-180, 180]."""
    return F.when(delta > 180.0, delta - 360.0).when(delta < -180.0, delta + 360.0).otherwise(delta)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Short-range ellipsoidal distance, with both radii taken at the mean latitude."""
    mid = F.radians((lat1 + lat2) / 2.0)
    s = F.sin(mid)
    t = 1.0 - EARTH_E2 * s * s
    meridian = EARTH_A * (1.0 - EARTH_E2) / (t * F.sqrt(t))
    normal = EARTH_A / F.sqrt(t)
    north = meridian * F.radians(lat1 - lat2)
    east = normal * F.cos(mid) * F.radians(wrap_degrees(lon1 - lon2))
    return F.sqrt(north * north + east * east)


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """``distance_m`` as SQL text for the twins."""
    d = f"({lon1} - {lon2})"
    wrapped = f"(CASE WHEN {d} > 180 THEN {d} - 360 WHEN {d} < -180 THEN {d} + 360 ELSE {d} END)"
    mid = f"radians(({lat1} + {lat2}) / cast(2 as double))"
    e2, a = f"cast({EARTH_E2!r} as double)", f"cast({EARTH_A!r} as double)"
    t = f"(1 - {e2} * sin({mid}) * sin({mid}))"
    north = f"({a} * (1 - {e2}) / ({t} * sqrt({t})) * radians({lat1} - {lat2}))"
    east = f"({a} / sqrt({t}) * cos({mid}) * radians({wrapped}))"
    return f"sqrt({north} * {north} + {east} * {east})"


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_A


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4.0 + F.radians(lat) / 2.0)) * EARTH_A


def mercator_eps(eps_m: float, mean_lat: float) -> float:
    """Planar radius that covers ``eps_m`` ground metres at ``mean_lat``."""
    return eps_m / max(math.cos(math.radians(mean_lat)), 1e-6)


# ── geographic grid ────────────────────────────────────────────────────────────
# Latitude bands twice the search radius high; every band is cut into equal columns at least
# as wide as twice the radius at its widest |lat|. A point within the radius of another lies
# in one of the few cells the other one's search box touches (usually 1-4).


def _band_height(radius_m: float) -> float:
    return 2.0 * radius_m / _LAT_DEG_M


def _band_cos(band: Column, height: float, *lats: Column) -> Column:
    south, north = band * height - 90.0, (band + 1) * height - 90.0
    edge = F.least(F.greatest(F.abs(south), F.abs(north), *[F.abs(v) for v in lats]), F.lit(90.0))
    return F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))


def _band_columns(band: Column, height: float, radius_m: float) -> Column:
    width = 2.0 * radius_m / (_LON_DEG_M * _band_cos(band, height))
    return F.greatest(F.floor(360.0 / width), F.lit(1).cast("long"))


def _column_of(lon: Column, columns: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * columns)


def grid_cell(lat: Column, lon: Column, radius_m: float) -> Column:
    """The one cell (a long) that holds a point."""
    height = _band_height(radius_m)
    band = F.floor((lat + 90.0) / height)
    columns = _band_columns(band, height, radius_m)
    return band * _KEY + F.least(_column_of(lon, columns), columns - 1)


def explode_cells(df: DataFrame, lat: str, lon: str, radius_m: float, name: str) -> DataFrame:
    """One row per cell that may hold a point within ``radius_m``, as ``name``.

    Wraps at the antimeridian; near the poles all columns of a band are taken. Bands and
    columns are exploded one after the other, which keeps the arithmetic in generated code.
    """
    height = _band_height(radius_m)
    reach = radius_m / _LAT_DEG_M
    y, x = F.col(lat), F.col(lon)
    bands = F.sequence(F.floor((y - reach + 90.0) / height), F.floor((y + reach + 90.0) / height))
    out = df.withColumn("_band", F.explode(bands))
    dlon = radius_m / (_LON_DEG_M * _band_cos(F.col("_band"), height, y))
    out = out.withColumns({"_columns": _band_columns(F.col("_band"), height, radius_m), "_dlon": dlon})
    out = out.withColumns(
        {
            "_first": _column_of(x - F.col("_dlon"), F.col("_columns")),
            "_last": _column_of(x + F.col("_dlon"), F.col("_columns")),
        }
    )
    whole = F.col("_last") - F.col("_first") >= F.col("_columns") - 1
    span = F.when(whole, F.sequence(F.lit(0).cast("long"), F.col("_columns") - 1)).otherwise(
        F.sequence("_first", "_last")
    )
    return (
        out.withColumn("_column", F.explode(span))
        .withColumn(name, F.col("_band") * _KEY + F.pmod("_column", "_columns"))
        .drop("_band", "_columns", "_dlon", "_first", "_last", "_column")
    )
