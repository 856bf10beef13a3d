"""Extent, scale and projection of buildings; features of the map package."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indoorspark.functions import rings as R
from indoorspark.functions.scalars import category, labels, parse_lat_lon, text_or, twin_id, venue_origin
from indoorspark.operators.projects import is_desk

# Metres of a degree at the equator and along a meridian; width of a building of unknown width.
LON_METRES, LAT_METRES, WIDTH = 111320.0, 110540.0, 50.0
# Fixed values, in metres: band of a section's frame and its cut; reach of a doorway; in pixels: half width of a line, of a point.
FRAME, CUT, DOOR, HALF_LINE, HALF_POINT = 0.15, 0.02, 0.45, 0.75, 1.0


SIDES = ("min_x", "min_y", "max_x", "max_y")


def building_extent(buildings: DataFrame, shapes: DataFrame) -> DataFrame:
    """min_x, min_y, max_x, max_y of each building over unit and section rings (holes too) and its `outline` (open ring).

    Bounds are taken row by row and combined before the shuffle. A building without any has the square 0 to 100 pixels.
    """
    every = F.flatten("rings")
    own = shapes.where(F.col("kind").isin("unit", "section")).select("building_id", R.bounds(every).alias("b"))
    outline = buildings.where("outline is not null").select("building_id", R.bounds(F.col("outline")).alias("b"))
    got = own.unionByName(outline).groupBy("building_id").agg(*[f(f"b.{c}").alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))])
    both = buildings.select("building_id").join(got, "building_id", "left")
    return both.select("building_id", *[F.coalesce(c, F.lit(0.0 if c[:3] == "min" else 100.0)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def building_scale(buildings: DataFrame, extent: DataFrame) -> DataFrame:
    """Extent with width_m, mpu (metres a pixel), cx, cy, lon, lat (null without an origin), deg_lon, deg_lat, and the bounds
    clip_* of the building itself: of its outline, or else its extent."""
    origin = venue_origin(parse_lat_lon(F.col("venue_text")))
    width = F.when(F.col("width_meters") > 0, F.col("width_meters")).otherwise(WIDTH)
    own = R.bounds(F.col("outline"))
    got = extent.join(buildings.select("building_id", width.alias("width_m"), origin.lon.alias("lon"), origin.lat.alias("lat"), *[own[c].alias(f"clip_{c}") for c in SIDES]), "building_id")
    got = got.withColumns({f"clip_{c}": F.coalesce(f"clip_{c}", c) for c in SIDES})
    mpu = F.col("width_m") / F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1e-9))
    cos = F.cos(F.coalesce("lat", F.lit(0.0)) * math.pi / 180)
    return got.withColumns({"mpu": mpu, "cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2}).withColumns({"deg_lon": F.col("mpu") / (LON_METRES * cos), "deg_lat": F.col("mpu") / LAT_METRES})


SCALE = (*SIDES, *(f"clip_{c}" for c in SIDES), "mpu", "cx", "cy", "lon", "lat", "deg_lon", "deg_lat")


def join_extent(df: DataFrame, scale: DataFrame) -> DataFrame:
    """df with its building's scale; Spark broadcasts the scale table only if it is small."""
    return df.join(scale.select("building_id", *SCALE), "building_id")


def project_x(x: Column) -> Column:
    return F.when(F.col("lon").isNull(), x / 100000.0).otherwise(F.col("lon") + (x - F.col("cx")) * F.col("deg_lon"))


def project_y(y: Column) -> Column:
    return F.when(F.col("lat").isNull(), y / 100000.0).otherwise(F.col("lat") - (y - F.col("cy")) * F.col("deg_lat"))


def project_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: R.point(project_x(p.x), project_y(p.y)))


def project_polygon(rings: Column) -> Column:
    """All rings projected; the outer one runs counter-clockwise, holes stay as they are."""
    return F.transform(rings, lambda r, i: F.when(i == 0, R.ensure_ccw(project_ring(r))).otherwise(project_ring(r)))


def footprint_ring(outline: Column) -> Column:
    """Closed ring in pixels: the traced outline if it has three points, else the extent padded by a tenth (5 pixels at least)."""
    pad_x, pad_y = (F.greatest((F.col(f"max_{a}") - F.col(f"min_{a}")) * 0.1, F.lit(5.0)) for a in "xy")
    padded = R.box(F.col("min_x") - pad_x, F.col("min_y") - pad_y, F.col("max_x") + pad_x, F.col("max_y") + pad_y)
    return F.when(F.size(outline) >= 3, R.closed(outline)).otherwise(padded)


#: Columns of a feature; seq and piece: its place in a level. extra: properties that only its type has, as JSON text.
FEATURE = ("building_id", "feature_id", "feature_type", "level_id", "seq", "piece", "category", "restriction", "label", "rings", "point", "extra")


def _feature(df: DataFrame, id_, type_: str, label, **columns) -> DataFrame:
    piece = F.col("piece") if "piece" in df.columns else F.lit(0)
    given = {"level_id": F.lit(None).cast("string"), "seq": F.lit(0), "piece": piece, "category": F.lit("unspecified"), "restriction": F.lit(None).cast("string"), "extra": F.create_map().cast("map<string,string>")} | columns
    return df.withColumns({"feature_id": id_, "feature_type": F.lit(type_), "label": label, **given}).select(*FEATURE)


def json_text(value: Column) -> Column:
    """A string as JSON; null is null."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def json_labels(value: Column) -> Column:
    return F.when(text_or(value, "") == "", "null").otherwise(F.concat(F.lit('{"en":'), json_text(value), F.lit("}")))


def no_rings() -> Column:
    return F.lit(None).cast(f"array<{R.RING}>")


def no_point() -> Column:
    return F.lit(None).cast("struct<x:double,y:double>")


def building_features(buildings: DataFrame, scale: DataFrame) -> DataFrame:
    df = join_extent(buildings, scale)
    return _feature(df, F.col("building_id"), "building", text_or(F.col("name"), "Building"), restriction=F.lit("restricted"), rings=no_rings(), point=R.point(project_x(F.col("cx")), project_y(F.col("cy"))))


def footprint_features(buildings: DataFrame, scale: DataFrame) -> DataFrame:
    rings = project_polygon(F.array(footprint_ring(F.col("outline"))))
    return _feature(join_extent(buildings, scale), F.col("footprint_id"), "footprint", F.lit(None).cast("string"), category=F.lit("ground"), rings=rings, point=no_point(), extra=F.create_map(F.lit("building_ids"), F.to_json(F.array("building_id"))))


def level_features(levels: DataFrame, footprints: DataFrame) -> DataFrame:
    df = levels.join(footprints.select("building_id", "rings"), "building_id")
    own = {"ordinal": F.col("ordinal").cast("string"), "outdoor": F.lit("false"), "short_name": json_labels(F.col("short_name")), "building_ids": F.to_json(F.array("building_id"))}
    extra = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    return _feature(df, F.col("level_id"), "level", F.col("name"), level_id=F.col("level_id"), seq=F.col("ordinal"), restriction=F.lit("restricted"), rings=F.col("rings"), point=no_point(), extra=extra)


def centre(rings: Column) -> Column:
    """Where the label of an area in pixels stands, projected."""
    middle = R.display_point(F.element_at(rings, 1))
    return R.point(project_x(middle.x), project_y(middle.y))


def drawn_features(shapes: DataFrame, scale: DataFrame, type_: str, default: str = "Unit", drawn: bool = True) -> DataFrame:
    """Units or sections of one ring or more as features; their labels stand at the area's centre. Without `drawn`, here and
    below: no rings and no points."""
    df = join_extent(shapes, scale)
    rings, point = (project_polygon(F.col("rings")), centre(F.col("rings"))) if drawn else (no_rings(), no_point())
    return _feature(df, F.col("shape_id"), type_, text_or(F.col("name"), default), level_id=F.col("level_id"), seq=F.col("seq"), category=category(F.col("category")), rings=rings, point=point)


def section_frame(ring: Column, mpu: Column) -> Column:
    """Closed ring of a clean closed ring's frame, cut by a hair so that it has no hole; null if it is too small for one."""
    width = F.lit(FRAME) / mpu
    both = lambda o: F.struct(o.alias("outer"), R.offset_polygon(o, -width).alias("inner"))
    return R.let(R.let(R.opened(ring), both), lambda t: _frame(t["outer"], t["inner"], width, mpu))


def _frame(outer: Column, inner: Column, width: Column, mpu: Column) -> Column:
    a, b = R.bounds(outer), R.bounds(inner)
    fits = (F.size(outer) >= 3) & (F.size(inner) == F.size(outer)) & (b.max_x - b.min_x >= width) & (b.max_y - b.min_y >= width) & (b.min_x >= a.min_x) & (b.max_x <= a.max_x)
    o1, o2, i1 = F.element_at(outer, 1), F.element_at(outer, 2), F.element_at(inner, 1)
    length = F.sqrt((o2.x - o1.x) * (o2.x - o1.x) + (o2.y - o1.y) * (o2.y - o1.y))
    gap = F.least(width * 0.3, F.lit(CUT) / mpu) / F.when(length == 0, 1.0).otherwise(length)
    dx, dy = (o2.x - o1.x) * gap, (o2.y - o1.y) * gap
    start, rest = R.point(o1.x + dx, o1.y + dy), F.size(outer) - 1
    path = F.concat(F.array(start), F.slice(outer, F.lit(2), rest), F.array(o1, i1), F.reverse(F.slice(inner, F.lit(2), rest)), F.array(R.point(i1.x + dx, i1.y + dy), start))
    return F.when(fits, path)


def framed(sections: DataFrame, scale: DataFrame) -> DataFrame:
    """sections with `frame` (closed ring, null for a solid one) and `solid`. Sections are solid by choice or if too small."""
    df = sections.join(scale.select("building_id", F.col("mpu").alias("_mpu")), "building_id")
    frame = F.when(F.coalesce("outline_only", F.lit(True)), section_frame(F.element_at("rings", 1), F.col("_mpu")))
    return df.withColumn("frame", frame).withColumn("solid", F.col("frame").isNull()).drop("_mpu")


def section_features(sections: DataFrame, scale: DataFrame, drawn: bool = True) -> DataFrame:
    """Frames or solid sections; the label stays at the whole section's centre."""
    df = join_extent(framed(sections, scale) if drawn else sections, scale)
    rings, point = (project_polygon(F.when(F.col("solid"), F.col("rings")).otherwise(F.array(F.col("frame")))), centre(F.col("rings"))) if drawn else (no_rings(), no_point())
    return _feature(df, F.col("shape_id"), "section", text_or(F.col("name"), "Unit"), level_id=F.col("level_id"), seq=F.col("seq"), category=category(F.col("category")), rings=rings, point=point)


def twin_units(sections: DataFrame, scale: DataFrame, drawn: bool = True) -> DataFrame:
    """A unit for each solid section, under an id derived from the section's."""
    solid = framed(sections, scale).where("solid").withColumn("shape_id", twin_id(F.col("shape_id"))).drop("frame", "solid")
    return drawn_features(solid, scale, "unit", drawn=drawn)


def strip(line: Column) -> Column:
    """Closed ring of a line's first and last point, HALF_LINE to either side."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    length = F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))
    by = F.lit(HALF_LINE) / F.when(length == 0, 1.0).otherwise(length)
    ox, oy = -(b.y - a.y) * by, (b.x - a.x) * by
    first = R.point(a.x + ox, a.y + oy)
    return F.array(first, R.point(b.x + ox, b.y + oy), R.point(b.x - ox, b.y - oy), R.point(a.x - ox, a.y - oy), first)


def fixture_rings(rings: Column, line: Column, at: Column) -> Column:
    """Rings in pixels of a fixture: its polygon, or its line as a strip, or a small square at its point (or the building's centre)."""
    x, y = F.coalesce(at.x, F.col("cx")), F.coalesce(at.y, F.col("cy"))
    r = HALF_POINT
    square = F.array(R.point(x - r, y - r), R.point(x + r, y - r), R.point(x + r, y + r), R.point(x - r, y + r), R.point(x - r, y - r))
    return F.when(F.size(line) >= 2, F.array(strip(line))).when(rings.isNotNull(), rings).otherwise(F.array(square))


def fixture_features(fixtures: DataFrame, scale: DataFrame, desks: bool, drawn: bool = True) -> DataFrame:
    """Desks as fixtures, or all others as units named Furniture."""
    df = join_extent(fixtures.where(is_desk(F.col("category"), F.col("place_id")) == F.lit(desks)), scale)
    rings = project_polygon(fixture_rings(F.col("rings"), F.col("line"), no_point())) if drawn else no_rings()
    df = df.withColumn("rings", rings)
    point = R.centroid(F.element_at("rings", 1)) if drawn and not desks else no_point()
    label = F.col("name") if desks else text_or(F.col("name"), "Furniture")
    none = F.create_map().cast("map<string,string>")
    turned = F.when(desk_rotation(F.col("rotation")).isNotNull(), F.create_map(F.lit("rotation"), F.col("rotation").cast("string"))).otherwise(none)
    return _feature(df, F.col("shape_id"), "fixture" if desks else "unit", label, level_id=F.col("level_id"), seq=F.col("seq"), category=F.lit("desk" if desks else "unspecified"), rings=F.col("rings"), point=point, extra=turned if desks else none)


def desk_rotation(rotation: Column) -> Column:
    return F.when(F.coalesce(rotation, F.lit(0)) != 0, rotation)


def doorway_boxes(openings: DataFrame, scale: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of each opening: along its line, DOOR metres to either side, inside the building's own bounds; empty ones go."""
    df = join_extent(openings, scale)
    a, b, reach = F.element_at("line", 1), F.element_at("line", -1), F.lit(DOOR) / F.col("mpu")
    along = F.abs(b.x - a.x) >= F.abs(b.y - a.y)
    mx, my = (a.x + b.x) / 2, (a.y + b.y) / 2
    pick = lambda yes, no: F.when(along, yes).otherwise(no)
    got = df.withColumns({
        "x0": F.greatest(pick(F.least(a.x, b.x), mx - reach), F.col("clip_min_x")), "x1": F.least(pick(F.greatest(a.x, b.x), mx + reach), F.col("clip_max_x")),
        "y0": F.greatest(pick(my - reach, F.least(a.y, b.y)), F.col("clip_min_y")), "y1": F.least(pick(my + reach, F.greatest(a.y, b.y)), F.col("clip_max_y")),
    })
    return got.where("x1 > x0 and y1 > y0").select("building_id", "level_id", "shape_id", "seq", "x0", "y0", "x1", "y1")


# Fixed value: tiers of the unit file, painted in this order.
TIERS = ("doorway", "walkway", "room", "twin", "furniture", "wall")


def tiered(units: dict[str, DataFrame]) -> DataFrame:
    """All units in one table with `tier`; keys as in TIERS. Walkways among "room" get their own tier."""
    every = None
    for name, df in units.items():
        tier = F.lit(TIERS.index(name))
        if name == "room":
            tier = F.when(F.col("category") == "walkway", TIERS.index("walkway")).otherwise(tier)
        df = df.withColumn("tier", tier)
        every = df if every is None else every.unionByName(df)
    return every


def paint_order(features: DataFrame, levels: DataFrame, *by: str) -> DataFrame:
    """features with `paint`, from 1 in each building (and `by`): tier, then file order (level, then seq and piece; without level
    last, by id).

    A building's levels are numbered apart and their counts added up, so that no task sorts a whole building.
    """
    level = levels.select("level_id", F.col("ordinal").alias("_ordinal"))
    df = features.join(level, "level_id", "left").withColumn("_last", F.when(F.col("_ordinal").isNull(), 1).otherwise(0)).withColumn("_group", F.coalesce("_ordinal", F.lit(-1)))
    whole = ["building_id", *by]
    key = [*whole, "tier", "_last", "_group"]
    placed = F.col("_last") == 0
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(F.when(placed, F.col("seq")), F.when(placed, F.col("piece")), "feature_id"))
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*whole).orderBy("tier", "_last", "_group").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_in", inside).join(counts.withColumn("_before", F.coalesce(before, F.lit(0))), key).withColumn("paint", (F.col("_in") + F.col("_before")).cast("int")).drop("_in", "_before", "_n", "_last", "_group", "_ordinal")
