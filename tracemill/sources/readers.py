"""Sources: raw points, events as visits, sites, and the engine's own Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import collections

FEATURE = "user string, timestamp long, `geomPoint.geom` struct<type:string,coordinates:array<double>>"


def geojson(spark: SparkSession, path: str, lines: bool = False, cut: bool = True) -> DataFrame:
    """Point features as (user_id, ts, lon, lat); other geometries and those with fewer than two coordinates are left out.

    `lines`: one feature per line; else whole collections, each of which is cut between tasks too (see `collections`). Without
    `cut` a task reads a whole collection, which is cheaper for many small files and needs memory for the largest.
    """
    if lines:
        features = spark.read.schema(FEATURE).json(path)
    elif cut:
        features = collections.features(spark, path, FEATURE).select("feature.*")
    else:
        whole = spark.read.schema(StructType().add("features", ArrayType(StructType.fromDDL(FEATURE)))).option("multiLine", True).json(path)
        features = whole.select(F.explode("features").alias("f")).select("f.*")
    place = F.col("`geomPoint.geom`")
    kept = features.where((place["type"] == "Point") & (F.size(place["coordinates"]) >= 2))
    return kept.select(F.col("user").alias("user_id"), F.col("timestamp").alias("ts"), F.get(place["coordinates"], 0).alias("lon"), F.get(place["coordinates"], 1).alias("lat"))


def event_points(events: DataFrame) -> DataFrame:
    """The events table as points: (event_id, user_id from 1, ts, k, lon, lat), the place made from the event's property."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    value = F.col("value")
    return events.select(
        "event_id", (F.col("user_id") + 1).alias("user_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"), k.alias("k"),
        (F.lit(9.08) + F.lit(0.002) * k + F.lit(0.00001) * value).alias("lon"), (F.lit(45.39) + F.lit(0.0015) * k + F.lit(0.00001) * value).alias("lat"),
    )


def sites(spark: SparkSession, path: str, n_rois: int | None = None) -> DataFrame:
    """Sites from CSV with a header (site_id, arr_id, lon, lat), up to site n_rois."""
    df = spark.read.csv(path, header=True, schema="site_id int, arr_id int, lon double, lat double")
    return df.where(F.col("site_id") <= n_rois) if n_rois is not None else df


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table that `sinks.table` wrote: traces, adjacency, aggregates, statistics, mappings."""
    return spark.read.parquet(path)


def runs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """`scores`, `predictions` or `settings` of all runs that `sinks.results` completed; each row has its run_id."""
    return spark.read.parquet(f"{path}/[!_]*/{name}")


def dims(traces: DataFrame) -> DataFrame:
    """One row: n_rois, n_epochs (from the largest indexes), n_users."""
    return traces.agg((F.max("roi") + 1).cast("long").alias("n_rois"), (F.max("epoch") + 1).cast("long").alias("n_epochs"), F.count_distinct("user_id").alias("n_users"))


def bundle_meta(aggregates: DataFrame) -> DataFrame:
    """What a bundle of aggregates holds: splits, labels and numbers of aggregates by target."""
    return aggregates.groupBy("target", "split", "label").agg(F.count_distinct("agg_id").alias("n_aggregates"))
