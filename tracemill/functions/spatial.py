"""Distances and grids as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lon1: Column | float, lat1: Column | float, lon2: Column | float, lat2: Column | float) -> Column:
    """Great-circle distance in km."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    rise, run = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(rise / 2.0), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(run / 2.0), 2.0)
    return 2.0 * EARTH_KM * F.asin(F.sqrt(a))


@dataclass(frozen=True)
class Box:
    """An open box of coordinates and the length in km of its grid's cells. Bounds may be numbers or columns."""

    min_lon: Column | float
    max_lon: Column | float
    min_lat: Column | float
    max_lat: Column | float
    cell_km: float = 1.6

    def contains(self, lon: Column, lat: Column) -> Column:
        return (lon > self.min_lon) & (lon < self.max_lon) & (lat > self.min_lat) & (lat < self.max_lat)

    def width(self) -> Column:
        """Of the lower edge, in km."""
        return haversine(self.min_lon, self.min_lat, self.max_lon, self.min_lat)

    def height(self) -> Column:
        return haversine(self.min_lon, self.min_lat, self.min_lon, self.max_lat)

    def area(self) -> Column:
        return self.width() * self.height()

    def n_cells(self) -> Column:
        return (F.floor(self.area() / (self.cell_km * self.cell_km)) + 1).cast("long")

    def n_columns(self) -> Column:
        return F.floor(self.width() / self.cell_km).cast("long")

    def cell(self, lon: Column, lat: Column) -> Column:
        """Number of the point's cell, from 1, row by row. A partial last column runs into the next row."""
        i = F.floor(haversine(self.min_lon, self.min_lat, lon, self.min_lat) / self.cell_km)
        j = F.floor(haversine(self.min_lon, self.min_lat, self.min_lon, lat) / self.cell_km)
        return (self.n_columns() * j + i + 1).cast("long")

    def centroids(self, spark: SparkSession, n: int, epsilon: float = 1e-10, row_order: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
        """(roi, lon, lat) of cells 1..n, kept inside the box."""
        cells = spark.range(1, n + 1).select(F.col("id").cast("int").alias("roi"))
        index = F.col("roi").cast("long") - 1
        i, j = row_order(F.col("roi"), self.n_columns()) if row_order else (index % self.n_columns(), F.floor(index / self.n_columns()))
        lon_km = haversine(self.min_lon, self.min_lat, _col(self.min_lon) + 1.0, self.min_lat)
        lat_km = haversine(self.min_lon, self.min_lat, self.min_lon, _col(self.min_lat) + 1.0)
        lon = _col(self.min_lon) + (i + 0.5) * self.cell_km / lon_km
        lat = _col(self.min_lat) + (j + 0.5) * self.cell_km / lat_km
        return cells.select(
            "roi",
            F.greatest(_col(self.min_lon) + epsilon, F.least(lon, _col(self.max_lon) - epsilon)).alias("lon"),
            F.greatest(_col(self.min_lat) + epsilon, F.least(lat, _col(self.max_lat) - epsilon)).alias("lat"),
        )
