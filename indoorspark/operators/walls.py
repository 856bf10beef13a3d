"""Rooms and openings of a level for the raised-wall job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_floors(shapes: DataFrame) -> DataFrame:
    """(building_id, level_id, floors, doorways): rooms' rings and openings' lines of each level that has a room.

    A level is one drawing, so its arrays are small; order is by seq.
    """
    rows = shapes.where("level_id is not null and kind in ('unit', 'opening')")
    of = lambda kind, col: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "shape_id", col))))
    got = rows.groupBy("building_id", "level_id").agg(of("unit", "rings").alias("floors"), of("opening", "line").alias("doorways"))
    return got.where(F.size("floors") > 0)
