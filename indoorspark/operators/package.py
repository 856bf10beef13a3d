"""Grid work on ring columns, the map package, its validation and the directory correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indoorspark.functions import rings as R
from indoorspark.functions.scalars import csv_field, text_or


def grid_cells(df: DataFrame, key: str) -> DataFrame:
    """(key, i, j, x0, x1, y0, y1, filled): cells of the grid that all points of `rings` span, filled by the test of their centres."""
    values = lambda axis: R.grid_lines(F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[axis]))))
    lined = df.select(key, "rings", values("x").alias("xs"), values("y").alias("ys"))
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda u, v: F.struct(u.alias("a"), v.alias("b")))
    across = lined.select(key, "rings", pairs(F.col("ys")).alias("yy"), F.posexplode(pairs(F.col("xs"))).alias("i", "x"))
    cells = across.select(key, "rings", "i", "x", F.posexplode("yy").alias("j", "y"))
    inside = R.point_in_rings((F.col("x.a") + F.col("x.b")) / 2, (F.col("y.a") + F.col("y.b")) / 2, F.col("rings"))
    return cells.select(key, "i", "j", F.col("x.a").alias("x0"), F.col("x.b").alias("x1"), F.col("y.a").alias("y0"), F.col("y.b").alias("y1"), inside.alias("filled"))


def hatch(df: DataFrame, key: str, spacing: Column, thickness: Column) -> DataFrame:
    """(key, y, x0, x1): slivers at multiples of `spacing` over the filled cells of each row of the grid of `rings`, runs of cells as one."""
    cells = grid_cells(df, key).where("filled")
    run = F.col("i") - F.row_number().over(Window.partitionBy(key, "j").orderBy("i"))
    runs = cells.withColumn("_run", run).groupBy(key, "j", "_run", "y0", "y1").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    k = F.explode(F.sequence(F.ceil(F.col("y0") / spacing), F.ceil(F.col("y1") / spacing)))
    lines = runs.select(key, "y0", "y1", "x0", "x1", k.alias("k")).withColumn("y", F.col("k") * spacing)
    return lines.where((F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1") - thickness)).select(key, "y", "x0", "x1")


# Files of a package and the properties that each kind of feature may have.
FILES = ("building.geojson", "footprint.geojson", "level.geojson", "unit.geojson", "section.geojson", "fixture.geojson")
PROPERTIES = {
    "building": ["category", "restriction", "name", "alt_name", "display_point"],
    "footprint": ["category", "name", "building_ids"],
    "level": ["ordinal", "category", "restriction", "outdoor", "name", "short_name", "building_ids"],
    "unit": ["category", "restriction", "name", "alt_name", "display_point", "level_id"],
    "section": ["category", "restriction", "name", "alt_name", "display_point", "level_id"],
    "fixture": ["category", "name", "level_id", "rotation"],
}
LABELS = ("name", "alt_name", "short_name")
# Fixed value: what a correlated feature is called in the directory.
DIRECTORY = {"building": "Building", "level": "Floor", "unit": "Room", "section": "Section", "fixture": "Desk"}


def validate(features: DataFrame) -> DataFrame:
    """(building_id, file, feature_id, problem, detail), one row a problem.

    features: building_id, file, feature_id, feature_type, n_rings (null: no geometry) and properties, a map of JSON text.
    A file that isn't known is reported once and its features are left alone.
    """
    known = F.col("file").isin(*FILES)
    files = features.where(~known).select("building_id", "file").distinct().select("building_id", "file", F.lit(None).cast("string").alias("feature_id"), F.lit("file").alias("problem"), F.lit(None).cast("string").alias("detail"))
    kind, p = F.col("feature_type"), F.col("properties")
    get = lambda k: F.try_element_at(p, F.lit(k))
    missing = lambda k: get(k).isNull() | get(k).isin("null", '""', "false", "0")
    allowed = F.lit(None).cast("array<string>")
    for k, names in PROPERTIES.items():
        allowed = F.when(kind == k, F.array(*map(F.lit, names))).otherwise(allowed)
    odd = F.transform(F.array_except(F.map_keys(p), F.coalesce(allowed, F.array().cast("array<string>"))), lambda k: F.struct(F.lit("property").alias("problem"), k.alias("detail")))
    one = lambda when, name, detail=None: F.when(when, F.struct(F.lit(name).alias("problem"), F.lit(detail).cast("string").alias("detail")))
    plain = [one(get(k).isNotNull() & ~get(k).rlike(r"^(null|\{.*\}|\[.*\])$"), "label", k) for k in LABELS]
    level = kind == "level"
    rest = [
        one((kind == "building") & F.col("n_rings").isNotNull(), "geometry"),
        one(level & ~F.coalesce(get("ordinal").rlike(r"^-?\d+$"), F.lit(False)), "ordinal"),
        one(level & ~F.coalesce(get("outdoor") == "false", F.lit(False)), "outdoor"),
        one(level & ~F.coalesce(get("building_ids").rlike(r"^\[.+\]$"), F.lit(False)), "building_ids"),
        one((kind == "unit") & missing("level_id"), "level_id"),
        one(F.col("n_rings") > 1, "holes"),
    ]
    found = features.where(known).select("building_id", "file", "feature_id", F.explode(F.concat(odd, F.array_compact(F.array(*plain, *rest)))).alias("q"))
    return found.select("building_id", "file", "feature_id", "q.problem", "q.detail").unionByName(files)


def report(packages: DataFrame, problems: DataFrame) -> DataFrame:
    """(building_id, valid, n) of every package, n its number of problems, counted in tasks; `report_lines` has their text."""
    got = problems.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"))
    both = packages.select("building_id").distinct().join(got, "building_id", "left")
    return both.select("building_id", F.col("n").isNull().alias("valid"), F.coalesce("n", F.lit(0)).alias("n"))


def report_lines(problems: DataFrame) -> DataFrame:
    """(building_id, at, value): a line for each problem; `at` sorts a building's lines. Rows, however many a building has."""
    line = F.concat_ws(" ", "file", F.col("feature_id"), "problem", F.col("detail"))
    return problems.select("building_id", F.concat_ws(" ", "file", F.coalesce("feature_id", F.lit("")), "problem").alias("at"), line.alias("value"))


def package_files(features: DataFrame, buildings: DataFrame) -> DataFrame:
    """(building_id, file, n): four files always, sections and fixtures only if there are any."""
    counts = features.groupBy("building_id", F.concat("feature_type", F.lit(".geojson")).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    always = buildings.select("building_id", F.explode(F.array(*map(F.lit, FILES[:4]))).alias("file"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(always).groupBy("building_id", "file").agg(F.sum("n").alias("n"))


def correlations(features: DataFrame) -> DataFrame:
    """Rows of the directory table, with file_rank and, if features have it, paint: features(building_id, feature_type, feature_id, label, category,
    place_id), footprints left out."""
    place, name = text_or(F.col("place_id"), ""), F.coalesce("label", F.lit(""))
    tied = place != ""
    kinds = [k for k in DIRECTORY]
    called = F.create_map(*[F.lit(x) for pair in DIRECTORY.items() for x in pair])[F.col("feature_type")]
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("feature_type"))
    return features.where(F.col("feature_type").isin(*kinds)).select(
        "building_id", rank.cast("int").alias("file_rank"), *[c for c in ("paint",) if c in features.columns], place.alias("PlaceId"), F.when(tied, name).otherwise("").alias("Name"), F.when(tied, called).otherwise("").alias("Type"),
        F.initcap("feature_type").alias("FeatureType"), F.col("feature_id").alias("FeatureId"), name.alias("FeatureName"), text_or(F.col("category"), "unspecified").alias("FeatureCategory"),
    )


COLUMNS = ("PlaceId", "Name", "Type", "FeatureType", "FeatureId", "FeatureName", "FeatureCategory")


def csv_lines(rows: DataFrame) -> DataFrame:
    """rows with `line`, as in the file (without its end)."""
    return rows.withColumn("line", F.concat_ws(",", *[csv_field(F.col(c)) for c in COLUMNS]))
