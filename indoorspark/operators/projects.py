"""Saved projects: latest version, catalog, checks of ids and plan files, levels, deletions, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indoorspark.functions.scalars import text_or

# Plan files that are taken, and their largest size.
PLAN_TYPES, PLAN_BYTES = ("image/png", "image/jpeg", "image/jpg", "application/pdf"), 50 * 1024 * 1024


def latest_projects(saves: DataFrame, key: str = "project_id", at: str = "updated_at", tie: str = "event_id") -> DataFrame:
    """The last save of each project. Only one row of each task and project is shuffled, so a hot project is no burden."""
    rest = [c for c in saves.columns if c != key]
    last = saves.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_last"))
    return last.select(key, "_last.*").select(*saves.columns)


def catalog(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", "project_name", "created_at", "updated_at")


def plan_verdict(mimetype: Column, size: Column) -> Column:
    """null for a plan file that is taken, else the reason why not."""
    kind = F.coalesce(mimetype.isin(*PLAN_TYPES), F.lit(False))
    return F.when(~kind, "type").when(F.coalesce(size, F.lit(0)) > PLAN_BYTES, "size")


def id_verdict(id_: Column) -> Column:
    """null for a usable project id, else the reason."""
    return F.when(id_.isNull() | (id_ == ""), "missing").when(~id_.rlike(r"^[a-zA-Z0-9-]+$"), "characters").when(F.length(id_) > 50, "length")


def level_defaults(levels: DataFrame) -> DataFrame:
    """ordinal, name and short_name with what stands in for missing ones; a short name of 0 is kept as text."""
    short = F.col("short_name") if "short_name" in levels.columns else F.lit(None).cast("string")
    stated = F.col("ordinal").cast("string")
    return levels.withColumns({
        "name": text_or(F.col("name"), F.concat(F.lit("Level "), F.coalesce(stated, F.lit("undefined")))),
        "short_name": text_or(short, stated, "0"),
        "ordinal": F.coalesce("ordinal", F.lit(0)),
    })


def is_section(kind: Column) -> Column:
    return F.coalesce(kind == "section", F.lit(False))


def is_desk(category: Column, place_id: Column) -> Column:
    """A fixture is a desk by its category, or by being tied to the directory."""
    return (text_or(category, "furniture") == "desk") | (text_or(place_id, "") != "")


def on_level(df: DataFrame, level_id: str | None) -> DataFrame:
    """Features of the level, and those of none; without a level all of them."""
    return df if not level_id else df.where(F.col("level_id").isNull() | (F.col("level_id") == "") | (F.col("level_id") == level_id))


def cascade_delete(shapes: DataFrame, levels: DataFrame) -> DataFrame:
    """Shapes that stay when these levels go."""
    return shapes.join(levels.select("level_id").distinct(), "level_id", "left_anti")


def delete_by_id(shapes: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """Shapes that stay when these go, told by `key` (shape_id alone, unless named)."""
    key = list(key or ("shape_id",))
    return shapes.join(ids.select(*key).distinct(), key, "left_anti")


def shape_counts(levels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Levels and shapes of each kind by building; buildings known by either table."""
    kinds = {"unit": "units", "section": "sections", "amenity": "amenities", "fixture": "fixtures", "opening": "openings"}
    n = shapes.groupBy("building_id").agg(*[F.count_if(F.col("kind") == k).alias(v) for k, v in kinds.items()])
    both = levels.groupBy("building_id").agg(F.count(F.lit(1)).alias("levels")).join(n, "building_id", "full")
    return both.select("building_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("levels", *kinds.values())])


def attach_place_ids(features: DataFrame, sources: list[DataFrame], id_col: str = "feature_id") -> DataFrame:
    """features with place_id; each source has (id, place_id, seq), and a later source or seq wins over an earlier one."""
    some = [s.where(text_or(F.col("place_id"), "") != "").select("id", "place_id", F.struct(F.lit(i).alias("source"), F.col("seq").cast("long").alias("seq")).alias("at")) for i, s in enumerate(sources)]
    every = some[0]
    for s in some[1:]:
        every = every.unionByName(s)
    known = every.groupBy("id").agg(F.max_by("place_id", "at").alias("place_id"))
    return features.join(known.withColumnRenamed("id", id_col), id_col, "left")


def numbered(df: DataFrame, label: str, by: str, order: list[str], start: Column | None = None, out: str = "name") -> DataFrame:
    """`{label} {n}`, counting within `by` on from `start`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(out, F.concat(F.lit(label + " "), ((start if start is not None else F.lit(0)) + place).cast("string")))
