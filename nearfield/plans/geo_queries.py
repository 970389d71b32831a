"""Queries of the geographic functions, over customers placed on the map by their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import geo as G
from nearfield.operators.filters import Condition, compile_filter
from nearfield.plans.registry import query

#: (lat, lon) from a key.
PLACES = "(SELECT c_custkey AS id, (c_custkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 AS lon FROM customer)"
HOME = (40.7128, -74.006)
POLYGON = [(10.0, -30.0), (55.0, -20.0), (45.0, 60.0), (5.0, 40.0)]
HOLE = [(20.0, 0.0), (30.0, 0.0), (30.0, 20.0), (20.0, 20.0)]


def places(spark, sf_dir):
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("id"), ((key * 37 % 1800) / 10.0 - 90).alias("lat"), ((key * 91 % 3600) / 10.0 - 180).alias("lon"))


def km(lat: float, lon: float) -> str:
    h = f"(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))"
    return f"2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h})))"


@query("geo_distance", f"SELECT id, round({km(*HOME)}, 4) AS km, round({km(*HOME)} * 1000, 1) AS m, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid FROM {PLACES}")
def geo_distance(spark, sf_dir):
    p = places(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    return p.select("id", F.round(G.haversine_km(lat, lon, *HOME), 4).alias("km"), F.round(G.haversine_m(lat, lon, *HOME), 1).alias("m"), G.valid(lat, lon).alias("valid"))


@query("geo_radius", f"SELECT id, round({km(*HOME)}, 4) AS km FROM {PLACES} WHERE {km(*HOME)} <= 2500 ORDER BY {km(*HOME)}, id LIMIT 20")
def geo_radius(spark, sf_dir):
    """The box of the circle first, then exact distances; nearest first."""
    p = places(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    found = p.filter(G.in_box(lat, lon, *G.radius_box(*HOME, 2500))).withColumn("d", G.haversine_km(lat, lon, *HOME)).filter("d <= 2500")
    return found.orderBy("d", "id").limit(20).select("id", F.round("d", 4).alias("km"))


@query("geo_box", f"SELECT id FROM {PLACES} WHERE lat BETWEEN 10 AND 60 AND lon BETWEEN -30 AND 40")
def geo_box(spark, sf_dir):
    return places(spark, sf_dir).filter(G.in_box(F.col("lat"), F.col("lon"), 60, -30, 10, 40)).select("id")


@query("geo_box_date_line", f"SELECT id FROM {PLACES} WHERE lat BETWEEN -40 AND 40 AND (lon >= 160 OR lon <= -150)")
def geo_box_date_line(spark, sf_dir):
    return places(spark, sf_dir).filter(G.in_box(F.col("lat"), F.col("lon"), 40, 160, -40, -150)).select("id")


def _ring(ring) -> str:
    edges = zip(ring, [*ring[1:], ring[0]], strict=True)
    rows = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in edges)
    return f"(SELECT count(*) % 2 = 1 FROM (VALUES {rows}) t(la, lo, lb, lp) WHERE (la > p.lat) <> (lb > p.lat) AND p.lon < (lp - lo) * (p.lat - la) / (lb - la) + lo)"


@query("geo_polygon", f"SELECT id FROM {PLACES} p WHERE {_ring(POLYGON)} AND NOT {_ring(HOLE)}")
def geo_polygon(spark, sf_dir):
    """A polygon with a hole."""
    return places(spark, sf_dir).filter(G.in_polygon(F.col("lat"), F.col("lon"), POLYGON, [HOLE])).select("id")


@query("geo_filter", f"SELECT id FROM {PLACES} WHERE {km(0.0, 0.0)} <= 3000")
def geo_filter(spark, sf_dir):
    """A radius as a payload filter on a field with lat and lon."""
    p = places(spark, sf_dir).select("id", F.struct("lat", "lon").alias("at"))
    return p.filter(compile_filter(p, Condition("at", "geo_radius", {"lat": 0.0, "lon": 0.0, "km": 3000}))).select("id")


@query("geo_grid", f"SELECT ((floor(lat * 10) + 900) * 3600 + floor(lon * 10) + 1800)::BIGINT AS cell, count(*) AS n FROM {PLACES} GROUP BY 1")
def geo_grid(spark, sf_dir):
    return places(spark, sf_dir).groupBy(G.grid_cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "geohash",
    f"""
SELECT id, list_aggregate(list_transform(range(0, 8), lambda d: substr('0123456789bcdefghjkmnpqrstuvwxyz', list_sum(list_transform(range(0, 5), lambda b:
  CASE WHEN (5 * d + b) % 2 = 0 THEN (x >> (19 - (5 * d + b) // 2)) & 1 ELSE (y >> (19 - (5 * d + b) // 2)) & 1 END * (16 >> b)))::BIGINT + 1, 1)), 'string_agg', '') AS hash
FROM (SELECT id, least(1048575, floor((lon + 180) / 360 * 1048576))::BIGINT AS x, least(1048575, floor((lat + 90) / 180 * 1048576))::BIGINT AS y FROM {PLACES})
""",
)
def geohash(spark, sf_dir):
    return places(spark, sf_dir).select("id", G.geohash(F.col("lat"), F.col("lon"), 8).alias("hash"))


@query("geo_parse", f"SELECT id, lat, lon FROM {PLACES}")
def geo_parse(spark, sf_dir):
    """Points from JSON."""
    p = places(spark, sf_dir).select("id", F.to_json(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("lng"))).alias("j"))
    return p.select("id", G.parse_point(F.col("j")).alias("p")).select("id", "p.lat", "p.lon")
