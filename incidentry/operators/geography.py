"""Coordinates, density and map figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.common import beside, count_if, title_case
from incidentry.functions.grades import map_severity, map_severity_rank
from incidentry.functions.places import jitter, looks_like_address, looks_like_street, steady_uniform, suburb
from incidentry.operators.joins import fixed_table, lookup_join, top_values
from incidentry.operators.ordered import exact_percentiles
from incidentry.session import settle


def centroids(spark) -> DataFrame:
    return fixed_table(spark, fixed.SUBURB_CENTROIDS, "suburb string, suburb_lat double, suburb_lon double")


def keyword_point(location: str) -> tuple[Column, Column]:
    """Centroid of the first suburb named in a location."""
    place = F.lower(F.coalesce(location, F.lit("")))
    lat = lon = None
    for name, latitude, longitude in fixed.SUBURB_CENTROIDS:
        hit = place.contains(name.lower())
        lat = F.when(hit, latitude) if lat is None else lat.when(hit, latitude)
        lon = F.when(hit, longitude) if lon is None else lon.when(hit, longitude)
    return lat, lon


def with_coordinates(df: DataFrame, metres: float = fixed.JITTER_METRES) -> DataFrame:
    """Per row: given coordinates, else the address's suburb with a small steady offset, else a suburb named in the location."""
    placed = df.withColumn("suburb", suburb("address")).join(F.broadcast(centroids(df.sparkSession)), "suburb", "left")
    given = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    shift_lat, shift_lon = jitter("address", F.col("suburb_lat"), metres)
    word_lat, word_lon = keyword_point("location")
    known = F.col("suburb_lat").isNotNull()
    return placed.withColumns(
        {
            "latitude": F.when(given, F.col("latitude")).when(known, F.col("suburb_lat") + shift_lat).otherwise(word_lat),
            "longitude": F.when(given, F.col("longitude")).when(known, F.col("suburb_lon") + shift_lon).otherwise(word_lon),
        }
    ).drop("suburb_lat", "suburb_lon")


def with_place_points(df: DataFrame) -> DataFrame:
    """``lat``/``lon`` from the fixed places; an address gets a steady point in the Sydney box; others null."""
    places = fixed_table(df.sparkSession, fixed.NAMED_PLACES, "location string, _lat double, _lon double")
    south, north, west, east = fixed.SYDNEY_BOX
    street = looks_like_street("location")
    text = F.col("location")
    return (
        df.join(F.broadcast(places), "location", "left")
        .withColumn("lat", F.coalesce("_lat", F.when(street, south + steady_uniform(text, 0) * (north - south))))
        .withColumn("lon", F.coalesce("_lon", F.when(street, west + steady_uniform(text, 1) * (east - west))))
        .drop("_lat", "_lon")
    )


def map_points(df: DataFrame) -> DataFrame:
    """Rows with coordinates, severity named as on the map, and their weight."""
    placed = with_coordinates(df).where("latitude is not null and longitude is not null")
    return placed.withColumn("severity", map_severity("severity")).withColumn(
        "severity_weight", map_severity_rank("severity")
    )


def density(points: DataFrame, cell_degrees: float = 0.01) -> DataFrame:
    """Severity weight and incidents per grid cell."""
    return points.groupBy(
        F.floor(F.col("latitude") / cell_degrees).alias("cell_lat"), F.floor(F.col("longitude") / cell_degrees).alias("cell_lon")
    ).agg(F.sum("severity_weight").alias("weight"), F.count(F.lit(1)).alias("incidents"))


def hotspots(cells: DataFrame, k: int = 10) -> DataFrame:
    return cells.orderBy(F.desc("weight"), F.desc("incidents"), "cell_lat", "cell_lon").limit(k)


def map_kpis(points: DataFrame) -> DataFrame:
    """Incidents shown, critical ones, most frequent suburb, and the centre of the map. The points are placed once."""
    points = settle(points.select("severity", "suburb", "latitude", "longitude"))
    figures = points.agg(
        F.count(F.lit(1)).alias("incidents_shown"), count_if(F.col("severity") == "Critical").alias("critical_incidents")
    )
    top = top_values(points, "suburb", 1).select(title_case("suburb").alias("top_suburb"))
    center = exact_percentiles(points, {"center_lat": ("latitude", 0.5), "center_lon": ("longitude", 0.5)})
    default_lat, default_lon = fixed.DEFAULT_CENTER
    return (
        beside(beside(figures, top), center)
        .withColumns(
            {
                "center_lat": F.coalesce("center_lat", F.lit(default_lat)),
                "center_lon": F.coalesce("center_lon", F.lit(default_lon)),
            }
        )
    )


def geocode_requests(df: DataFrame, column: str = "location") -> DataFrame:
    """Distinct address-like texts to be sent to a geocoder."""
    return df.where(looks_like_address(column)).select(column).distinct()


def with_geocoded(df: DataFrame, answers: DataFrame, column: str = "location", spread: str = "incident_id") -> DataFrame:
    """Geocoder answers joined back; several answers for one text are reduced to the smallest first."""
    single = (
        answers.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(F.struct("lat", "lon")).alias("_point"))
        .select(column, "_point.lat", "_point.lon")
    )
    return lookup_join(df, single, column, spread)
