"""Distance of points to the nearest line segment on the sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.functions.calendar import bearing, haversine_km

EARTH_KM = 6371.0

#: Degrees of a grid cell, and kilometres of a degree of latitude (a little low, to be safe).
CELL, KM_DEGREE = 1.0, 110.0


def segment_km(lat="lat", lon="lon", lat1="lat1", lon1="lon1", lat2="lat2", lon2="lon2"):
    """Great-circle distance from a point to a segment: across the track if its foot lies on the
    segment, else to the nearer end."""
    to_point = haversine_km(lat1, lon1, lat, lon) / EARTH_KM
    turn = bearing(lat1, lon1, lat, lon) - bearing(lat1, lon1, lat2, lon2)
    across = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(to_point) * F.sin(turn))))
    along = F.atan2(F.sin(to_point) * F.cos(turn), F.cos(to_point))
    length = haversine_km(lat1, lon1, lat2, lon2) / EARTH_KM
    ends = F.least(haversine_km(lat1, lon1, lat, lon), haversine_km(lat2, lon2, lat, lon))
    return F.when((along >= 0) & (along <= length) & (length > 0), F.abs(across) * EARTH_KM).otherwise(ends)


def nearest_segment(points: DataFrame, segments: DataFrame, max_km: float = 25.0, key: str = "station") -> DataFrame:
    """``points`` (key, lat, lon) with ``km`` to the nearest segment within ``max_km`` (else null) and ``near``.

    A segment is listed under every grid cell that its box touches, widened by ``max_km``; a
    point meets the segments of its own cell alone. Longitudes are wrapped into [-180, 180);
    near the poles, where a degree of longitude is short, cells are widened accordingly.
    """
    pad = max_km / KM_DEGREE
    low_lat, high_lat = F.least("lat1", "lat2") - pad, F.greatest("lat1", "lat2") + pad
    widest = F.greatest(F.abs(low_lat), F.abs(high_lat))
    pad_lon = F.least(F.lit(180.0), pad / F.greatest(F.cos(F.radians(F.least(widest, F.lit(89.9)))), F.lit(0.002)))
    low_lon, high_lon = F.least("lon1", "lon2") - pad_lon, F.greatest("lon1", "lon2") + pad_lon
    cells = segments.withColumn("cell_lat", F.explode(F.sequence(F.floor(low_lat / CELL), F.floor(high_lat / CELL))))
    cells = cells.withColumn("cell_lon", F.explode(F.sequence(F.floor(low_lon / CELL), F.floor(high_lon / CELL))))
    n_lon = int(360 / CELL)
    cells = cells.withColumn("cell_lon", F.pmod(F.col("cell_lon"), F.lit(n_lon)))
    at = points.withColumn("cell_lat", F.floor(F.col("lat") / CELL)).withColumn("cell_lon", F.pmod(F.floor(F.col("lon") / CELL), F.lit(n_lon)))
    met = at.join(cells.select("cell_lat", "cell_lon", "lat1", "lon1", "lat2", "lon2"), ["cell_lat", "cell_lon"])
    best = met.groupBy(key).agg(F.min(segment_km()).alias("km")).where(F.col("km") <= max_km)
    return points.join(best, key, "left").withColumn("near", F.col("km").isNotNull())
