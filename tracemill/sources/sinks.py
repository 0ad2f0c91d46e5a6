"""Sinks: Parquet tables for what a run makes and finds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AuditConfig


def table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Write a table, in folders by the given columns: aggregates by ("split", "target") are pruned when one target is read."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def bundle(aggregates: DataFrame, path: str) -> None:
    """A bundle of aggregates, by split and target; a file has the rows of few targets."""
    table(aggregates.repartition("split", "target"), path, by=("split", "target"))


def collections(features: DataFrame, path: str) -> None:
    """Features as JSON (column value) as GeoJSON collections, one file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"type": "FeatureCollection", "features": ['
        for b in batches:
            lines = []
            for value in b.column(0).to_pylist():
                lines.append(before + value)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if before == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    features.select("value").mapInArrow(run, "value string").write.text(path)


def run_meta(spark: SparkSession, config: AuditConfig, run_id: str | None = None) -> DataFrame:
    """One row: run_id, tag and the settings of a run."""
    row = {"run_id": run_id or uuid.uuid4().hex, "tag": config.tag()} | config.row()
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def results(scores: DataFrame, predictions: DataFrame, meta: DataFrame, path: str) -> str:
    """A run's scores, predictions and settings below path/<run_id>, all at once or not at all; returns the run's id.

    They are written beside it and moved there by one renaming when all three are complete, so readers never see a part of a run and
    a failed one leaves nothing in sight. A run_id that is there already raises, and stays as it is.
    """
    spark, run = meta.sparkSession, meta.first()["run_id"]
    files = spark._jvm.org.apache.hadoop.fs
    there, unfinished = files.Path(f"{path}/{run}"), files.Path(f"{path}/_unfinished/{uuid.uuid4().hex}")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(there):
        raise FileExistsError(f"{path} has a run {run}")
    try:
        for name, df in (("scores", scores), ("predictions", predictions), ("settings", meta)):
            table(df.withColumn("run_id", F.lit(run)), f"{unfinished.toString()}/{name}")
        if fs.exists(there) or not fs.rename(unfinished, there):
            raise FileExistsError(f"{path} has a run {run}")
    finally:
        fs.delete(unfinished, True)
    return run


def summary(scores: DataFrame) -> DataFrame:
    """Mean accuracy and AUC over targets."""
    return scores.agg(F.avg("acc").alias("mean_acc"), F.avg("auc").alias("mean_auc"), F.count("*").alias("n_targets"))
