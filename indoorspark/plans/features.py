"""Queries of the portfolio export: extent, projection, features, paint order, validation, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.fixtures import view
from indoorspark.functions import rings as R
from indoorspark.functions import scalars as S
from indoorspark.operators import export as E
from indoorspark.operators import geo as G
from indoorspark.operators import package as K
from indoorspark.operators import projects as P
from indoorspark.operators import ring_jobs as J
from indoorspark.operators.shapes import by_id, category_style, pixel_box, polygon_transform, scaled, shape_kind, shapes
from indoorspark.plans.basics import ORIGIN
from indoorspark.plans.registry import query
from indoorspark.sources.scratch import kept

ALL = ("fx_building", "fx_level", "fx_shape", "fx_vertex", "fx_line")


def buildings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("outline_size")
    outline = F.array(R.point(0, 0), R.point(F.lit(0), n), R.point(n, n), R.point(n, F.lit(0)))
    return view(spark, d, "fx_building").withColumn("outline", F.when(F.col("has_outline"), outline))


def scale_of(spark, d, b=None):
    b = buildings(spark, d) if b is None else b
    return G.building_scale(b, G.building_extent(b, shapes(spark, d)))


def rounded(*names: str, to: int = 9):
    return [F.round(n, to).alias(n) for n in names]


def corners(df: DataFrame, *keep: str, to: int = 9) -> DataFrame:
    """One row a point of `rings`."""
    df = df.select(*keep, F.posexplode("rings").alias("ring", "_r"))
    return df.select(*keep, "ring", F.posexplode("_r").alias("pt", "_p")).select(*keep, "ring", "pt", F.round("_p.x", to).alias("x"), F.round("_p.y", to).alias("y"))


EXTENT = ORIGIN.strip() + """,
v AS (SELECT building_id, x, y FROM fx_vertex WHERE kind IN ('unit', 'section')
  UNION ALL SELECT building_id, t.x * outline_size, t.y * outline_size FROM fx_building, (VALUES (0, 0), (0, 1), (1, 1), (1, 0)) t(x, y) WHERE has_outline),
m AS (SELECT building_id, MIN(x) AS x0, MIN(y) AS y0, MAX(x) AS x1, MAX(y) AS y1 FROM v GROUP BY 1),
e AS (SELECT b.building_id, COALESCE(x0, 0.0::DOUBLE) AS min_x, COALESCE(y0, 0.0::DOUBLE) AS min_y, COALESCE(x1, 100.0::DOUBLE) AS max_x, COALESCE(y1, 100.0::DOUBLE) AS max_y,
  CASE WHEN width_meters > 0 THEN width_meters ELSE 50 END AS width_m, b.name, b.footprint_id, b.has_outline, b.outline_size, b.place_id, b.effect3d FROM fx_building b LEFT JOIN m ON b.building_id = m.building_id),
s AS (SELECT e.*, width_m / GREATEST(max_x - min_x, 1e-9) AS mpu, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, lon, lat,
  width_m / GREATEST(max_x - min_x, 1e-9) / (111320 * cos(COALESCE(lat, 0) * pi() / 180)) AS deg_lon, width_m / GREATEST(max_x - min_x, 1e-9) / 110540 AS deg_lat
  FROM e JOIN o ON e.building_id = o.building_id)
"""
NUMBERED = "v0 AS (SELECT shape_id, building_id, kind, ring, x, y, CAST(row_number() OVER (PARTITION BY shape_id, ring ORDER BY pt) - 1 AS INT) AS pt FROM fx_vertex)"
PX = "CASE WHEN lon IS NULL THEN {0} / 100000.0 ELSE lon + ({0} - cx) * deg_lon END"
PY = "CASE WHEN lat IS NULL THEN {0} / 100000.0 ELSE lat - ({0} - cy) * deg_lat END"
EX = ("fx_building", "fx_shape", "fx_vertex")


@query("A1_building_extent", EXTENT + "SELECT building_id, min_x, min_y, max_x, max_y FROM e", *EX)
def extent(spark, d):
    return G.building_extent(buildings(spark, d), shapes(spark, d))


@query("A2_building_scale", EXTENT + "SELECT building_id, width_m, ROUND(mpu, 9) AS mpu, cx, cy, ROUND(deg_lon, 12) AS deg_lon, ROUND(deg_lat, 12) AS deg_lat FROM s", *EX)
def scale(spark, d):
    return scale_of(spark, d).select("building_id", "width_m", *rounded("mpu"), "cx", "cy", *rounded("deg_lon", "deg_lat", to=12))


@query("J3_join_extent", EXTENT + "SELECT shape_id, ROUND(mpu, 9) AS mpu, lon, lat FROM fx_shape JOIN s ON fx_shape.building_id = s.building_id", *EX)
def joined(spark, d):
    return G.join_extent(shapes(spark, d), scale_of(spark, d)).select("shape_id", *rounded("mpu"), "lon", "lat")


@query("P20_project_point", EXTENT + f"SELECT shape_id, ROUND({PX.format('x0')}, 9) AS x, ROUND({PY.format('y0')}, 9) AS y FROM fx_shape JOIN s ON fx_shape.building_id = s.building_id WHERE kind = 'amenity'", *EX)
def project_point(spark, d):
    df = G.join_extent(shapes(spark, d).where("kind = 'amenity'"), scale_of(spark, d))
    return df.select("shape_id", F.round(G.project_x(F.col("x0")), 9).alias("x"), F.round(G.project_y(F.col("y0")), 9).alias("y"))


# Rings run top left, bottom left, bottom right on screen: turned upside down by an origin they run clockwise.
POLYGON = NUMBERED + f""", g AS (SELECT v0.*, MAX(pt) OVER (PARTITION BY v0.shape_id, ring) AS last, lon IS NOT NULL AS turned,
  {PX.format('x')} AS gx, {PY.format('y')} AS gy FROM v0 JOIN s ON v0.building_id = s.building_id)"""
# on the plan y grows down, so these rings have a negative shoelace area; with an origin y is turned and the area is positive
CCW = "CASE WHEN ring = 0 AND NOT turned THEN last - pt ELSE pt END"


@query("P21_project_polygon", EXTENT.rstrip() + ", " + POLYGON + f" SELECT shape_id, ring, {CCW} AS pt, ROUND(gx, 9) AS x, ROUND(gy, 9) AS y FROM g WHERE kind = 'unit'", *EX)
def project_polygon(spark, d):
    df = G.join_extent(shapes(spark, d).where("kind = 'unit'"), scale_of(spark, d))
    return corners(df.withColumn("rings", G.project_polygon(F.col("rings"))), "shape_id")


@query("P11_shape_kind", "SELECT shape_id, CASE form WHEN 'holed' THEN 'holed' WHEN 'ell' THEN 'polygon' ELSE 'box' END AS shape FROM fx_shape WHERE kind IN ('unit', 'section', 'fixture')", "fx_shape")
def kinds(spark, d):
    return shapes(spark, d).where("rings is not null").select("shape_id", shape_kind(F.col("rings")).alias("shape"))


@query("P12_pixel_box", "SELECT shape_id, CAST(x0 AS DOUBLE) AS left_, CAST(y0 AS DOUBLE) AS top_, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height FROM fx_shape WHERE kind IN ('unit', 'section', 'fixture') UNION ALL SELECT shape_id, 100, 100, 100, 100 FROM fx_shape WHERE kind NOT IN ('unit', 'section', 'fixture')", "fx_shape")
def boxes(spark, d):
    b = pixel_box(scaled(F.col("rings"), 1 / S.PIXELS))
    return shapes(spark, d).select("shape_id", *[F.round(b[k], 6).alias(v) for k, v in (("left", "left_"), ("top", "top_"), ("width", "width"), ("height", "height"))])


def outlines(spark, d):
    """Rings by id: fx_vertex, too, takes what shares an id (orders of more than 16 lines reach into the next one's ids) as one shape."""
    return by_id(shapes(spark, d).where("rings is not null"))


CENTRE = """a AS (SELECT shape_id, x, y, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny FROM fx_vertex WHERE ring = 0 WINDOW w AS (PARTITION BY shape_id ORDER BY pt)),
k AS (SELECT shape_id, SUM(x * ny - nx * y) AS a2, SUM((x + nx) * (x * ny - nx * y)) AS mx, SUM((y + ny) * (x * ny - nx * y)) AS my FROM a WHERE nx IS NOT NULL GROUP BY 1)"""


@query("P14_display_point", f"WITH {CENTRE} SELECT shape_id, ROUND(mx / (3.0 * a2), 6) AS x, ROUND(my / (3.0 * a2), 6) AS y FROM k", "fx_shape", "fx_vertex")
def display_point(spark, d):
    p = R.display_point(F.element_at("rings", 1))
    return outlines(spark, d).select("shape_id", F.round(p.x, 6).alias("x"), F.round(p.y, 6).alias("y"))


@query("P16_close_open_ring", """SELECT shape_id, COUNT(*) AS n_closed, COUNT(*) - 1 AS n_open, COUNT(*) AS n_again FROM fx_vertex WHERE ring = 0 GROUP BY 1""", "fx_shape", "fx_vertex")
def close_open(spark, d):
    ring = F.element_at("rings", 1)
    return outlines(spark, d).select("shape_id", F.size(R.closed(ring)).cast("long").alias("n_closed"), F.size(R.opened(ring)).cast("long").alias("n_open"), F.size(R.closed(R.opened(ring))).cast("long").alias("n_again"))


@query("P18_polygon_transform", f"""
WITH {NUMBERED} SELECT shape_id, pt, ROUND((0.5 * (x - 10) + 0.25 * (y - 20) + 7) / 100000.0, 9) AS x, ROUND((2.0 * (y - 20) - 0.125 * (x - 10) + 3) / 100000.0, 9) AS y FROM v0 WHERE ring = 0 AND kind = 'unit'""", "fx_shape", "fx_vertex")
def transform(spark, d):
    ring = polygon_transform(R.opened(F.element_at("rings", 1)), [0.5, -0.125, 0.25, 2.0, 7.0, 3.0], 10, 20)
    return corners(shapes(spark, d).where("kind = 'unit'").withColumn("rings", F.array(ring)), "shape_id").drop("ring")


@query("P19_category_style", """
SELECT shape_id, CASE WHEN kind = 'section' THEN '#ff8c00' ELSE CASE category WHEN 'walkway' THEN '#c4c4bc' WHEN 'conference' THEN '#907fc0' WHEN 'room' THEN '#7ba7cc' WHEN 'wall' THEN '#5d6878' ELSE '#0078d4' END END AS stroke FROM fx_shape WHERE kind <> 'amenity'""", "fx_shape")
def styles(spark, d):
    return category_style(shapes(spark, d).where("kind <> 'amenity'")).select("shape_id", "stroke")


@query("G1_ring_area", f"WITH {CENTRE} SELECT shape_id, a2 / 2.0 AS area FROM k", "fx_shape", "fx_vertex")
def ring_area(spark, d):
    return outlines(spark, d).select("shape_id", R.area(R.opened(F.element_at("rings", 1))).alias("area"))


@query("G2_ring_bounds", "SELECT shape_id, ring, CAST(MIN(x) AS DOUBLE) AS min_x, CAST(MIN(y) AS DOUBLE) AS min_y, CAST(MAX(x) AS DOUBLE) AS max_x, CAST(MAX(y) AS DOUBLE) AS max_y FROM fx_vertex GROUP BY 1, 2", "fx_shape", "fx_vertex")
def ring_bounds(spark, d):
    return outlines(spark, d).select("shape_id", F.posexplode("rings").alias("ring", "r")).select("shape_id", "ring", R.bounds(F.col("r")).alias("b")).select("shape_id", "ring", "b.*")


@query("G3_ensure_ccw", f"WITH {NUMBERED} SELECT shape_id, MAX(pt) OVER (PARTITION BY shape_id) - pt AS pt, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v0 WHERE ring = 0", "fx_shape", "fx_vertex")
def ccw(spark, d):
    df = shapes(spark, d).where("rings is not null").withColumn("rings", F.array(R.ensure_ccw(F.element_at("rings", 1))))
    return corners(df, "shape_id").drop("ring")


@query("G4_ring_centroid", f"WITH {CENTRE} SELECT shape_id, ROUND(mx / (3.0 * a2), 6) AS x, ROUND(my / (3.0 * a2), 6) AS y FROM k", "fx_shape", "fx_vertex")
def centroid(spark, d):
    p = R.centroid(F.element_at("rings", 1))
    return outlines(spark, d).select("shape_id", F.round(p.x, 6).alias("x"), F.round(p.y, 6).alias("y"))


@query("G6_is_rectilinear", "SELECT shape_id, form <> 'box' OR w % 2 = 0 AS straight FROM fx_shape WHERE kind = 'unit'", "fx_shape")
def rectilinear(spark, d):
    ring = R.opened(F.element_at("rings", 1))
    skew = F.transform(ring, lambda p, i: R.point(p.x + F.when((i == 1) & (F.col("form") == "box") & (F.col("w") % 2 == 1), 3).otherwise(0), p.y))
    return shapes(spark, d).where("kind = 'unit'").select("shape_id", R.is_rectilinear(skew).alias("straight"))


# Every corner of a room's outer ring moved by 5 out; the one that turns in moves the same way as its neighbours' edges.
OFFSET = """SELECT shape_id, CAST(t.pt AS INT) AS pt, CAST(CASE WHEN form = 'ell' AND t.pt IN (2, 3) THEN x0 + FLOOR(w / 2.0) + 5 WHEN t.pt IN (0, 1) THEN x0 - 5 ELSE x0 + w + 5 END AS DOUBLE) AS x,
  CAST(CASE WHEN form = 'ell' AND t.pt IN (3, 4) THEN y0 + FLOOR(h / 2.0) + 5 WHEN t.pt IN (1, 2) THEN y0 + h + 5 ELSE y0 - 5 END AS DOUBLE) AS y FROM fx_shape, range(0, 6) t(pt) WHERE kind = 'unit' AND (t.pt < 4 OR form = 'ell')"""


def ring_offsets(spark, d, f):
    df = shapes(spark, d).where("kind = 'unit'")
    return corners(df.withColumn("rings", F.array(f(R.opened(F.element_at("rings", 1)), 5.0))), "shape_id", to=6).drop("ring")


@query("G8_offset_rectilinear", OFFSET, "fx_shape")
def offset_rectilinear(spark, d):
    return ring_offsets(spark, d, R.offset_rectilinear)


@query("G13_offset_polygon", OFFSET, "fx_shape")
def offset_polygon(spark, d):
    return ring_offsets(spark, d, R.offset_polygon)


@query("G11_chaikin", f"""
WITH {NUMBERED}, e AS (SELECT shape_id, pt, x, y, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny FROM v0 WHERE ring = 0 AND kind = 'unit' WINDOW w AS (PARTITION BY shape_id ORDER BY pt)),
c AS (SELECT *, LEAST(0.25, 20.0 / sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS t FROM e WHERE nx IS NOT NULL)
SELECT shape_id, 2 * pt AS pt, ROUND(x + (nx - x) * t, 6) AS x, ROUND(y + (ny - y) * t, 6) AS y FROM c
UNION ALL SELECT shape_id, 2 * pt + 1, ROUND(nx + (x - nx) * t, 6), ROUND(ny + (y - ny) * t, 6) FROM c""", "fx_shape", "fx_vertex")
def chaikin(spark, d):
    df = shapes(spark, d).where("kind = 'unit'").withColumn("rings", F.array(R.chaikin(R.opened(F.element_at("rings", 1)), 1, 20.0)))
    return corners(df, "shape_id", to=6).drop("ring")


@query("G14_point_in_rings", """
SELECT shape_id, CASE WHEN form = 'holed' THEN false WHEN form = 'ell' THEN w * 0.75 < FLOOR(w / 2.0) OR h * 0.75 < FLOOR(h / 2.0) ELSE true END AS middle,
  true AS corner, false AS beyond FROM fx_shape WHERE kind = 'unit'""", "fx_shape")
def inside(spark, d):
    x0, y0, w, h = map(F.col, ("x0", "y0", "w", "h"))
    at = lambda fx, fy: R.point_in_rings(x0 + fx, y0 + fy, F.col("rings"))
    return shapes(spark, d).where("kind = 'unit'").select("shape_id", F.when(F.col("form") == "holed", at(w * 0.5, h * 0.5)).otherwise(at(w * 0.75, h * 0.75)).alias("middle"), at(F.lit(5.5), F.lit(5.5)).alias("corner"), at(w + 1, F.lit(5.0)).alias("beyond"))


@query("G16_grid_lines", """
WITH v AS (SELECT DISTINCT shape_id, x FROM fx_vertex WHERE kind = 'unit')
SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY x) - 1 AS i, CAST(x AS DOUBLE) AS x FROM v""", "fx_shape", "fx_vertex")
def lines(spark, d):
    xs = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p.x)))
    return shapes(spark, d).where("kind = 'unit'").select("shape_id", F.posexplode(R.grid_lines(xs)).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("G17_grid_from_rings", """
SELECT shape_id, CASE form WHEN 'box' THEN 1 WHEN 'ell' THEN 4 ELSE 9 END AS cells, CASE form WHEN 'box' THEN 1 WHEN 'ell' THEN 3 ELSE 8 END AS filled FROM fx_shape WHERE kind = 'unit'""", "fx_shape")
def grid(spark, d):
    cells = K.grid_cells(shapes(spark, d).where("kind = 'unit'"), "shape_id")
    return cells.groupBy("shape_id").agg(F.count(F.lit(1)).cast("int").alias("cells"), F.count_if("filled").cast("int").alias("filled"))


@query("G20_ring_to_spans", """
WITH r AS (SELECT s.*, t.y AS y FROM fx_shape s, range(0, 3000) t(y) WHERE kind = 'unit' AND t.y >= y0 AND t.y < y0 + h),
p AS (SELECT shape_id, y, x0 AS a, CASE WHEN form = 'ell' AND y + 0.5 > y0 + FLOOR(h / 2.0) THEN x0 + FLOOR(w / 2.0) WHEN form = 'holed' AND y + 0.5 > y0 + 20 AND y + 0.5 < y0 + h - 20 THEN x0 + 20 ELSE x0 + w END AS b FROM r
  UNION ALL SELECT shape_id, y, x0 + w - 20, x0 + w FROM r WHERE form = 'holed' AND y + 0.5 > y0 + 20 AND y + 0.5 < y0 + h - 20)
SELECT shape_id, COUNT(*) AS spans, CAST(SUM(b - a) AS BIGINT) AS pixels FROM p GROUP BY 1""", "fx_shape")
def spans(spark, d):
    got = J.ring_spans(shapes(spark, d).where("kind = 'unit'"), "shape_id")
    return got.groupBy("shape_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("to") - F.col("from") + 1).alias("pixels"))


@query("G21_rounded_rect", """
WITH r AS (SELECT shape_id, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, LEAST(10.0, LEAST(w, h) / 2.0) AS r FROM fx_shape WHERE kind = 'unit')
SELECT shape_id, 3 + 8 + 1 AS points, ROUND(r * cos(pi() + pi() / 16) + r, 6) AS x1, ROUND(r * sin(pi() + pi() / 16) + r, 6) AS y1 FROM r""", "fx_shape")
def rounded_rect(spark, d):
    zero = F.lit(0.0)
    ring = R.rounded_rect(zero, zero, F.col("w").cast("double"), F.col("h").cast("double"), [F.lit(10.0), zero, F.lit(0.2), zero])
    p = F.element_at(ring, 2)
    return shapes(spark, d).where("kind = 'unit'").select("shape_id", F.size(ring).alias("points"), F.round(p.x, 6).alias("x1"), F.round(p.y, 6).alias("y1"))


# Rows of the grid that a room's points span, with the filled stretches of each: one line for each multiple of 7 well inside a row.
@query("G23_hatch_ring", """
WITH u AS (SELECT *, CAST(FLOOR(w / 2.0) AS INT) AS wm, CAST(FLOOR(h / 2.0) AS INT) AS hm FROM fx_shape WHERE kind = 'unit'),
r AS (SELECT shape_id, y0 AS a, y0 + h AS b, x0 AS l, x0 + w AS r FROM u WHERE form = 'box'
  UNION ALL SELECT shape_id, y0, y0 + hm, x0, x0 + w FROM u WHERE form = 'ell' UNION ALL SELECT shape_id, y0 + hm, y0 + h, x0, x0 + wm FROM u WHERE form = 'ell'
  UNION ALL SELECT shape_id, y0, y0 + 20, x0, x0 + w FROM u WHERE form = 'holed' UNION ALL SELECT shape_id, y0 + h - 20, y0 + h, x0, x0 + w FROM u WHERE form = 'holed'
  UNION ALL SELECT shape_id, y0 + 20, y0 + h - 20, x0, x0 + 20 FROM u WHERE form = 'holed' UNION ALL SELECT shape_id, y0 + 20, y0 + h - 20, x0 + w - 20, x0 + w FROM u WHERE form = 'holed')
SELECT shape_id, k * 7.0::DOUBLE AS y, CAST(l AS DOUBLE) AS x0, CAST(r AS DOUBLE) AS x1 FROM r, range(0, 2000) t(k) WHERE k * 7 > a AND k * 7 < b - 2""", "fx_shape")
def hatch(spark, d):
    return K.hatch(shapes(spark, d).where("kind = 'unit'"), "shape_id", F.lit(7.0), F.lit(2.0)).select("shape_id", *rounded("y", "x0", "x1", to=6))


@query("A6_vertex_mean", "SELECT shape_id, ROUND(SUM(x) / COUNT(*), 6) AS x, ROUND(SUM(y) / COUNT(*), 6) AS y FROM fx_vertex WHERE ring = 0 AND kind = 'fixture' GROUP BY 1", "fx_shape", "fx_vertex")
def mean(spark, d):
    p = R.vertex_mean(F.element_at("rings", 1))
    return shapes(spark, d).where("kind = 'fixture'").select("shape_id", F.round(p.x, 6).alias("x"), F.round(p.y, 6).alias("y"))


@query("E1_building_features", EXTENT + f"SELECT building_id, COALESCE(name, 'Building') AS label, ROUND({PX.format('cx')}, 9) AS x, ROUND({PY.format('cy')}, 9) AS y, 'restricted' AS restriction FROM s", *EX)
def e1(spark, d):
    b = buildings(spark, d)
    return G.building_features(b, scale_of(spark, d, b)).select("building_id", "label", F.round("point.x", 9).alias("x"), F.round("point.y", 9).alias("y"), "restriction")


FOOT = f""", q AS (SELECT *, CASE WHEN has_outline THEN 0 ELSE min_x - GREATEST((max_x - min_x) * 0.1, 5) END AS l, CASE WHEN has_outline THEN outline_size ELSE max_x + GREATEST((max_x - min_x) * 0.1, 5) END AS r,
  CASE WHEN has_outline THEN 0 ELSE min_y - GREATEST((max_y - min_y) * 0.1, 5) END AS t, CASE WHEN has_outline THEN outline_size ELSE max_y + GREATEST((max_y - min_y) * 0.1, 5) END AS b FROM s),
f AS (SELECT building_id, footprint_id, CASE WHEN lon IS NULL THEN 4 - p.pt ELSE p.pt END AS pt, ROUND({PX.format("(CASE WHEN p.pt IN (0, 1, 4) THEN l ELSE r END)")}, 9) AS x,
  ROUND({PY.format("(CASE WHEN p.pt IN (1, 2) THEN b ELSE t END)")}, 9) AS y FROM q, (VALUES (0), (1), (2), (3), (4)) p(pt)) """


@query("E2_footprint_features", EXTENT.rstrip() + FOOT + "SELECT footprint_id AS feature_id, pt, x, y FROM f", *EX)
def e2(spark, d):
    b = buildings(spark, d)
    return corners(G.footprint_features(b, scale_of(spark, d, b)), "feature_id").drop("ring")


@query("E3_level_features", EXTENT.rstrip() + FOOT + ", l AS (SELECT level_id, building_id, ordinal, COALESCE(name, 'Level ' || ordinal) AS label FROM fx_level) SELECT l.level_id AS feature_id, label, ordinal AS seq, pt, x, y FROM l JOIN f ON l.building_id = f.building_id", "fx_building", "fx_level", "fx_shape", "fx_vertex")
def e3(spark, d):
    b = buildings(spark, d)
    got = G.level_features(P.level_defaults(view(spark, d, "fx_level")), G.footprint_features(b, scale_of(spark, d, b)))
    return corners(got, "feature_id", "label", "seq").drop("ring")


# Every drawn shape, rooms and furniture in pieces: a hole's left edge cuts off a strip of 20 pixels. px, py: centroid of the piece.
LINED = "(kind = 'fixture' AND w % 3 = 0)"
SPLIT = f"(form = 'holed' AND kind IN ('unit', 'fixture') AND NOT {LINED})"
PIECE_ID = "CASE WHEN i = 0 THEN {0} ELSE substr({0}, 1, length({0}) - 3) || printf('%03x', i) END"
DRAWN = EXTENT.rstrip() + ", " + CENTRE + f""", u AS (SELECT h.*, CAST(t.i AS INT) AS piece, {PIECE_ID.format('h.shape_id')} AS id, CASE WHEN category = 'conference' THEN 'conferenceroom' ELSE COALESCE(category, 'unspecified') END AS cat,
  CASE WHEN {LINED} THEN CASE WHEN w % 2 = 0 THEN x0 + 15 ELSE x0 END WHEN NOT {SPLIT} THEN mx / (3.0 * a2) WHEN t.i = 0 THEN x0 + 10 ELSE ((w - 20) * h * (x0 + 10 + w / 2.0) - (w - 40) * (h - 40) * (x0 + w / 2.0)) / ((w - 20) * h - (w - 40) * (h - 40)) END::DOUBLE AS px,
  CASE WHEN {LINED} THEN CASE WHEN w % 2 = 0 THEN y0 ELSE y0 + 15 END WHEN NOT {SPLIT} THEN my / (3.0 * a2) ELSE y0 + h / 2.0 END::DOUBLE AS py, lon, lat, cx, cy, deg_lon, deg_lat, mpu
  FROM fx_shape h JOIN s ON h.building_id = s.building_id JOIN k ON h.shape_id = k.shape_id, range(0, 2) t(i) WHERE t.i = 0 OR {SPLIT}) """


def tiers(spark, d, walls=False):
    b, rows = buildings(spark, d), kept(shapes(spark, d), "tiers-shapes")
    return E.unit_tiers(b, rows, kept(G.building_scale(b, G.building_extent(b, rows)), "tiers-scale"), walls)


@query("E4_unit_features", DRAWN + f"SELECT id AS feature_id, cat AS category, COALESCE(name, 'Unit') AS label, level_id, piece, ROUND({PX.format('px')}, 9) AS x, ROUND({PY.format('py')}, 9) AS y FROM u WHERE kind = 'unit'", *EX)
def e4(spark, d):
    df = tiers(spark, d)["room"]
    return df.select("feature_id", "category", "label", "level_id", "piece", F.round("point.x", 9).alias("x"), F.round("point.y", 9).alias("y"))


# Corners of a frame: outer ring from a hair after its first corner, back along the inner one. Boxes turn left, so the inner ring is 0.15 m inside.
@query("E5_section_features", EXTENT.rstrip() + """, fr AS (SELECT h.*, 0.15 / mpu AS fw, 0.15 / mpu * CASE WHEN form = 'ell' THEN 2 ELSE 1 END AS least FROM fx_shape h JOIN s ON h.building_id = s.building_id WHERE kind = 'section'),
q AS (SELECT *, NOT outline_only AS solid FROM fr)
SELECT shape_id, solid, CASE WHEN solid THEN CASE WHEN form = 'holed' THEN 2 ELSE 1 END ELSE 1 END AS rings, CASE WHEN form = 'ell' THEN CASE WHEN solid THEN 7 ELSE 15 END ELSE CASE WHEN solid THEN 5 ELSE 11 END END AS points,
  ROUND(CASE WHEN solid THEN CASE WHEN form = 'ell' THEN w * h - (w - FLOOR(w / 2.0)) * (h - FLOOR(h / 2.0)) ELSE w * h END
    ELSE 2 * fw * (w + h) - 4 * fw * fw - LEAST(fw * 0.3, 0.02 / mpu_) * fw END, 3) AS area
FROM (SELECT q.*, s.mpu AS mpu_ FROM q JOIN s ON q.building_id = s.building_id)""", *EX)
def e5(spark, d):
    df = G.framed(shapes(spark, d).where("kind = 'section'"), scale_of(spark, d))
    rings = F.when(F.col("solid"), F.col("rings")).otherwise(F.array("frame"))
    ring = F.element_at("r", 1)
    return df.withColumn("r", rings).select("shape_id", "solid", F.size("r").alias("rings"), F.size(ring).alias("points"), F.round(F.abs(R.area(ring)), 3).alias("area"))


@query("E6_twin_units", DRAWN + f"SELECT substr(shape_id, 1, 24) || translate(substr(shape_id, 25), '0123456789abcdef', 'fedcba9876543210') AS feature_id, COALESCE(name, 'Unit') AS label, ROUND({PX.format('px')}, 9) AS x FROM u WHERE kind = 'section' AND NOT outline_only", *EX)
def e6(spark, d):
    return tiers(spark, d)["twin"].select("feature_id", "label", F.round("point.x", 9).alias("x"))


@query("E7_fixture_polygon", """
SELECT h.shape_id, CASE WHEN w % 3 = 0 THEN 5 WHEN form = 'ell' THEN 7 ELSE 5 END AS points, CASE WHEN w % 3 = 0 THEN CASE WHEN w % 2 = 0 THEN y0 - 0.75 ELSE y0 END ELSE y0 END::DOUBLE AS min_y,
  CASE WHEN w % 3 = 0 THEN CASE WHEN w % 2 = 0 THEN x0 ELSE x0 - 0.75 END ELSE x0 END::DOUBLE AS min_x FROM fx_shape h WHERE kind = 'fixture'""", "fx_shape")
def e7(spark, d):
    none = F.lit(None).cast("struct<x:double,y:double>")
    df = G.join_extent(shapes(spark, d).where("kind = 'fixture'"), scale_of(spark, d)).withColumn("rings", G.fixture_rings(F.col("rings"), F.col("line"), none))
    ring = F.element_at("rings", 1)
    b = R.bounds(ring)
    return df.select("shape_id", F.size(ring).alias("points"), F.round(b.min_y, 6).alias("min_y"), F.round(b.min_x, 6).alias("min_x"))


@query("E8_furniture_units", DRAWN + f"SELECT id AS feature_id, COALESCE(name, 'Furniture') AS label, ROUND({PX.format('px')}, 8) AS x, ROUND({PY.format('py')}, 8) AS y FROM u WHERE kind = 'fixture' AND COALESCE(category, 'furniture') <> 'desk' AND place_id IS NULL", *EX)
def e8(spark, d):
    return tiers(spark, d)["furniture"].select("feature_id", "label", F.round("point.x", 8).alias("x"), F.round("point.y", 8).alias("y"))


@query("E9_desk_fixtures", "SELECT shape_id, name AS label, CASE WHEN rotation <> 0 THEN rotation END AS rotation FROM fx_shape WHERE kind = 'fixture' AND (category = 'desk' OR place_id IS NOT NULL)", "fx_shape")
def e9(spark, d):
    rows = shapes(spark, d).where("kind = 'fixture'")
    got = G.fixture_features(rows, scale_of(spark, d), desks=True).select(F.col("feature_id").alias("shape_id"), "label")
    return got.join(rows.select("shape_id", G.desk_rotation(F.col("rotation")).alias("rotation")), "shape_id")


@query("E10_doorway_boxes", EXTENT.rstrip() + """, l AS (SELECT f.shape_id, f.x1 AS a, f.y1 AS b, f.x2 AS c, f.y2 AS d, 0.45 / mpu AS r, s.* FROM fx_line f JOIN s ON f.building_id = s.building_id WHERE kind = 'opening'),
g AS (SELECT shape_id, GREATEST(CASE WHEN a <> c THEN a ELSE a - r END, CASE WHEN has_outline THEN 0 ELSE min_x END) AS x0, LEAST(CASE WHEN a <> c THEN c ELSE a + r END, CASE WHEN has_outline THEN outline_size ELSE max_x END) AS x1,
  GREATEST(CASE WHEN a <> c THEN b - r ELSE b END, CASE WHEN has_outline THEN 0 ELSE min_y END) AS y0, LEAST(CASE WHEN a <> c THEN b + r ELSE d END, CASE WHEN has_outline THEN outline_size ELSE max_y END) AS y1 FROM l)
SELECT shape_id, ROUND(x0, 6) AS x0, ROUND(y0, 6) AS y0, ROUND(x1, 6) AS x1, ROUND(y1, 6) AS y1 FROM g WHERE x1 > x0 AND y1 > y0""", "fx_building", "fx_shape", "fx_vertex", "fx_line")
def e10(spark, d):
    return G.doorway_boxes(shapes(spark, d).where("kind = 'opening'"), scale_of(spark, d)).select("shape_id", *rounded("x0", "y0", "x1", "y1", to=6))


# Units of the first five tiers; raised walls come after them and are checked without SQL.
UNITS = f"""bx AS (SELECT f.shape_id, f.building_id, f.level_id, f.x1 AS a, f.y1 AS b, f.x2 AS c, f.y2 AS d, 0.45 / mpu AS r, s.* EXCLUDE (building_id, name) FROM fx_line f JOIN s ON f.building_id = s.building_id WHERE kind = 'opening' AND effect3d AND f.level_id IN (SELECT level_id FROM fx_shape WHERE kind = 'unit')),
bc AS (SELECT *, GREATEST(CASE WHEN a <> c THEN a ELSE a - r END, CASE WHEN has_outline THEN 0 ELSE min_x END) AS x0, LEAST(CASE WHEN a <> c THEN c ELSE a + r END, CASE WHEN has_outline THEN outline_size ELSE max_x END) AS x1,
  GREATEST(CASE WHEN a <> c THEN b - r ELSE b END, CASE WHEN has_outline THEN 0 ELSE min_y END) AS y0, LEAST(CASE WHEN a <> c THEN b + r ELSE d END, CASE WHEN has_outline THEN outline_size ELSE max_y END) AS y1 FROM bx),
dw AS (SELECT bc.*, h.seq, row_number() OVER (PARTITION BY bc.level_id ORDER BY h.seq, bc.shape_id) - 1 AS i FROM bc JOIN fx_shape h ON bc.shape_id = h.shape_id WHERE bc.x1 > bc.x0 AND bc.y1 > bc.y0),
dx AS (SELECT *, sha1(building_id || '|' || level_id || '|doorway|' || i) AS hx FROM dw),
un AS (SELECT substr(hx, 1, 8) || '-' || substr(hx, 9, 4) || '-4' || substr(hx, 14, 3) || '-a' || substr(hx, 18, 3) || '-' || substr(hx, 21, 12) AS feature_id, building_id, level_id, seq, 0 AS piece, 0 AS tier, 'Doorway' AS label, 'walkway' AS cat FROM dx
  UNION ALL SELECT {PIECE_ID.format('shape_id')}, building_id, level_id, seq, i, CASE WHEN category = 'walkway' THEN 1 ELSE 2 END, COALESCE(name, 'Unit'), CASE WHEN category = 'conference' THEN 'conferenceroom' ELSE COALESCE(category, 'unspecified') END
    FROM fx_shape, range(0, 2) t(i) WHERE kind = 'unit' AND (i = 0 OR {SPLIT})
  UNION ALL SELECT substr(shape_id, 1, 24) || translate(substr(shape_id, 25), '0123456789abcdef', 'fedcba9876543210'), building_id, level_id, seq, 0, 3, COALESCE(name, 'Unit'), CASE WHEN category = 'conference' THEN 'conferenceroom' ELSE COALESCE(category, 'unspecified') END FROM fx_shape WHERE kind = 'section' AND NOT outline_only
  UNION ALL SELECT {PIECE_ID.format('shape_id')}, building_id, level_id, seq, i, 4, COALESCE(name, 'Furniture'), 'unspecified' FROM fx_shape, range(0, 2) t(i) WHERE kind = 'fixture' AND COALESCE(category, 'furniture') <> 'desk' AND place_id IS NULL AND (i = 0 OR {SPLIT})),
pt AS (SELECT un.*, CAST(row_number() OVER (PARTITION BY un.building_id ORDER BY tier, ordinal NULLS LAST, CASE WHEN ordinal IS NOT NULL THEN seq END, CASE WHEN ordinal IS NOT NULL THEN piece END, feature_id) AS INT) AS paint FROM un LEFT JOIN fx_level l ON un.level_id = l.level_id)"""


@query("W1_paint_order", EXTENT.rstrip() + f", {UNITS} SELECT feature_id, tier, paint FROM pt", *ALL)
def w1(spark, d):
    units = G.tiered(tiers(spark, d)).select("building_id", "level_id", "feature_id", "tier", "seq", "piece")
    return G.paint_order(kept(units, "tiers-units"), view(spark, d, "fx_level")).select("feature_id", "tier", "paint")


@query("U1_unit_file_union", EXTENT.rstrip() + f", {UNITS} SELECT building_id, tier, COUNT(*) AS n FROM pt GROUP BY 1, 2", *ALL)
def u1(spark, d):
    return G.tiered(tiers(spark, d)).groupBy("building_id", "tier").agg(F.count(F.lit(1)).alias("n"))
