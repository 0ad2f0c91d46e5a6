"""Long-form tables of the engine and their validators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = "user_id string, ts long, lon double, lat double"
VISITS = "user_id long, ts long, roi int, epoch int"
TRACES = "user_id long, roi int, epoch int"
ROI_MAP = "roi int, lon double, lat double"
ROI_ADJ = "roi int, nbr int"
MEMBERSHIP = "target long, split string, agg_id string, pair_id string, label int, user_id long"
AGGREGATES = "target long, split string, agg_id string, pair_id string, label int, roi int, epoch int, cnt long"


class FormatError(ValueError):
    """A table is not in the format that the engine works with."""


def problems(visits: DataFrame, roi_map: DataFrame) -> list[str]:
    """What is wrong with a pair of visit and ROI tables: columns, types, index bases, ROIs without a place."""
    found = []
    for name, df, wanted in (("visits", visits, {"user_id", "ts", "roi"}), ("roi_map", roi_map, {"roi", "lon", "lat"})):
        if missing := wanted - set(df.columns):
            found.append(f"{name} lacks {sorted(missing)}")
    if found:
        return found
    types = dict(visits.dtypes)
    found += [f"visits.{c} is {types[c]}, not an integer" for c in ("user_id", "ts") if types[c] not in ("int", "bigint")]
    found += [f"roi_map.{c} is {t}, not a double" for c, t in roi_map.dtypes if c in ("lon", "lat") and t != "double"]
    first = visits.agg(F.min("user_id"), F.count_if(F.expr("ts is null or roi is null or user_id is null"))).first()
    if first[0] is not None and first[0] != 1:
        found.append(f"user ids start at {first[0]}, not 1")
    if first[1]:
        found.append(f"{first[1]} visits have nulls")
    low = roi_map.agg(F.min("roi")).first()[0]
    if low is not None and low != 0:
        found.append(f"ROIs start at {low}, not 0")
    if lost := visits.join(roi_map, "roi", "left_anti").count():
        found.append(f"{lost} visits are in ROIs that the map lacks")
    return found


def check(visits: DataFrame, roi_map: DataFrame) -> None:
    if found := problems(visits, roi_map):
        raise FormatError("; ".join(found))
