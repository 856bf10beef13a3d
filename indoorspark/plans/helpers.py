"""Queries through the ring helpers; what SQL can't express is checked by tests against hand-made rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from indoorspark.fixtures import view
from indoorspark.functions import rings as R
from indoorspark.operators import export as E
from indoorspark.operators import geo as G
from indoorspark.operators import package as K
from indoorspark.operators import raster as X
from indoorspark.operators import ring_jobs as J
from indoorspark.operators.shapes import shapes
from indoorspark.plans.features import buildings
from indoorspark.plans.rasters import KINDS, PX, SPACES, cc, halves, ink, plan_table, spaces
from indoorspark.plans.registry import query
from indoorspark.sources.scratch import kept


# Free pixels that hang together by sides or corners, on a plan with a free edge around it: those not joined to the edge are holes.
FREE8 = """fe AS (SELECT p.plan_id, p.x, p.y FROM px p LEFT JOIN ink USING (plan_id, x, y) WHERE ink.plan_id IS NULL),
f8 AS (SELECT plan_id, x, y, x AS tx, y AS ty FROM fe UNION SELECT r.plan_id, r.x, r.y, i.x, i.y FROM f8 r JOIN fe i ON r.plan_id = i.plan_id AND abs(i.x - r.tx) <= 1 AND abs(i.y - r.ty) <= 1),
h8 AS (SELECT f8.plan_id, x, y, MIN(ty * 65536 + tx) AS label, MAX(CASE WHEN tx IN (0, width - 1) OR ty IN (0, height - 1) THEN 1 ELSE 0 END) AS out FROM f8 JOIN fx_plan z ON f8.plan_id = z.plan_id GROUP BY 1, 2, 3),
hole AS (SELECT DISTINCT plan_id, label FROM h8 WHERE out = 0)"""


def outers(spark, d):
    return shapes(spark, d).where("kind = 'unit'").select("shape_id", R.opened(F.element_at("rings", 1)).alias("ring"))


def summed(df, ring="ring"):
    """Points and area of a ring."""
    return df.select("shape_id", F.size(ring).alias("points"), F.round(R.area(F.col(ring)), 6).alias("area"))


@query("G5_clean_ring", "SELECT shape_id, CASE WHEN form = 'ell' THEN 6 ELSE 4 END AS points, CASE WHEN form = 'ell' THEN -(w * h - (w - FLOOR(w / 2.0)) * (h - FLOOR(h / 2.0))) ELSE -w * h END::DOUBLE AS area FROM fx_shape WHERE kind = 'unit'", "fx_shape")
def g5(spark, d):
    half = lambda r: F.flatten(F.zip_with(r, R.rotated(r), lambda a, b: F.array(a, R.point((a.x + b.x) / 2, (a.y + b.y) / 2))))
    return summed(outers(spark, d).withColumn("ring", J.clean_ring(R.let(F.col("ring"), half), F.lit(0.0))))


@query("G7_rectilinear_simplify")
def g7(spark, d):
    return summed(outers(spark, d).withColumn("ring", J.rectilinear_simplify(F.col("ring"), F.lit(60.0))))


@query("G9_simplify_path")
def g9(spark, d):
    return summed(outers(spark, d).withColumn("ring", J.simplify_path(R.chaikin(F.col("ring"), 2), F.lit(4.0))))


@query("G10_simplify_ring")
def g10(spark, d):
    return summed(outers(spark, d).withColumn("ring", J.simplify_ring(R.chaikin(F.col("ring"), 2), F.lit(4.0))))


@query("G12_snap_axes", "SELECT shape_id, CASE WHEN form = 'ell' THEN 6 ELSE 4 END AS points FROM fx_shape WHERE kind = 'unit'", "fx_shape")
def g12(spark, d):
    bent = F.transform("ring", lambda p, i: R.point(p.x + F.when(i % 2 == 0, 2.0).otherwise(-2.0), p.y + F.when(i % 3 == 0, 2.0).otherwise(-1.0)))
    return summed(outers(spark, d).withColumn("ring", J.snap_axes(bent, F.lit(0.0)))).drop("area")


PIECES = "SELECT shape_id, 2 AS pieces, CAST(w * h - (w - 40) * (h - 40) AS DOUBLE) AS area FROM fx_shape WHERE kind = 'unit' AND form = 'holed'"


@query("G19_split_holes", PIECES, "fx_shape")
def g19(spark, d):
    rows = shapes(spark, d).where("kind = 'unit' and form = 'holed'").select("shape_id", J.split_holes(F.col("rings")).alias("p"))
    return rows.select("shape_id", F.size("p").alias("pieces"), F.round(R.total(F.transform("p", lambda r: F.abs(R.area(r)))), 6).alias("area"))


@query("E4_unit_pieces", "SELECT CASE WHEN i = 0 THEN shape_id ELSE substr(shape_id, 1, length(shape_id) - 3) || printf('%03x', i) END AS shape_id, CAST(i AS INT) AS piece FROM fx_shape, range(0, 2) t(i) WHERE kind = 'unit' AND (i = 0 OR form = 'holed')", "fx_shape")
def e4p(spark, d):
    return J.expand_holes(shapes(spark, d).where("kind = 'unit'")).select("shape_id", "piece")


@query("G15_trace_loops", f"""WITH RECURSIVE {PX}, {cc('ink', 'lab')}, {FREE8} SELECT a.plan_id, CAST(n + COALESCE(holes, 0) AS INT) AS loops FROM (SELECT plan_id, COUNT(DISTINCT label) AS n FROM lab GROUP BY 1) a LEFT JOIN (SELECT plan_id, COUNT(*) AS holes FROM hole GROUP BY 1) b ON a.plan_id = b.plan_id""", "fx_pixels", "fx_plan")
def g15(spark, d):
    """Border walks of each plan's ink: one round each part (by sides), one for each hole (free pixels, by sides or corners, off the edge)."""
    return J.plan_loops(ink(spark, d), plan_table(spark, d), F.lit(1.0)).select("plan_id", "loops")


@query("R15_outline")
def r15(spark, d):
    z = plan_table(spark, d)
    opened = X.open_mask(ink(spark, d), z)
    return J.plan_loops(opened, z, F.lit(1.0)).select("plan_id", F.size("outline").alias("points"), F.abs(R.area(F.col("outline"))).alias("area"))


@query("R18_merge_small_spaces")
def r18(spark, d):
    s, z = spaces(spark, d), plan_table(spark, d)
    sizes = s.groupBy("plan_id", "region").agg(F.count(F.lit(1)).alias("n"))
    return J.merge_small_spaces(sizes, X.space_contacts(s, ink(spark, d).where("(x + y) % 3 = 0"), z), z.select("plan_id", F.col("min_room").alias("least")))


def kinds_of(spark, d, s):
    return X.classify_spaces(s, X.space_contacts(s, ink(spark, d).where("false"), plan_table(spark, d)), halves(spark, d))


@query("R21_space_polygons", f"""WITH RECURSIVE {PX}, {SPACES}, {KINDS}
SELECT plan_id, kind, COUNT(*) AS shapes, CAST(CASE WHEN kind = 'walkway' THEN SUM(n) END AS BIGINT) AS pixels FROM kd GROUP BY 1, 2""", "fx_pixels", "fx_plan")
def r21(spark, d):
    """Polygons of each kind, and pixels inside those of walkways: with no tolerance and no offset they are those of the spaces."""
    s, z = spaces(spark, d), plan_table(spark, d)
    got = J.space_polygons(s, kinds_of(spark, d, s), z.withColumns({"jog_tol": F.lit(0.0), "min_walk": F.lit(0.0)}), offset=0.0)
    inside = F.sum(F.when(F.col("kind") == "walkway", J.net_area(F.col("rings"))))
    return got.groupBy("plan_id", "kind").agg(F.count(F.lit(1)).alias("shapes"), F.round(inside).cast("long").alias("pixels"))


@query("R21_traced_polygons")
def r21b(spark, d):
    """The same polygons as traced: squared or smoothed by the plan's tolerance and moved onto the ink."""
    s, z = spaces(spark, d), plan_table(spark, d)
    got = J.space_polygons(s, kinds_of(spark, d, s), z.withColumns({"jog_tol": F.lit(2.0), "min_walk": F.lit(2.0)}))
    return got.select("plan_id", "region", "kind", F.size("rings").alias("rings"), F.aggregate(F.transform("rings", F.size), F.lit(0), lambda a, n: a + n).alias("points"))


@query("R23_partition_shapes")
def r23(spark, d):
    """Wall ink that the passes of R19 have folded into a space, as thin shapes."""
    z, before = plan_table(spark, d), spaces(spark, d)
    after = X.absorb_partitions(X.binarize(view(spark, d, "fx_pixels")), before, z)
    folded = X.erase(after.select("plan_id", "x", "y"), before).join(ink(spark, d), ["plan_id", "x", "y"], "left_semi")
    return J.partition_shapes(folded, z.withColumn("jog_tol", F.lit(2.0)), least=2).select("plan_id", "label", "piece", F.size("ring").alias("points"), F.abs(R.area(F.col("ring"))).alias("area"))


@query("R26_fit_shape")
def r26b(spark, d):
    """The clean shape fitted to each part of a plan's ink."""
    got = J.fit_shapes(X.components(ink(spark, d)), grow=0.5, keep_scraps=True, scrap=F.lit(3.0), plans=plan_table(spark, d))
    return got.select("plan_id", "label", "form", F.size("ring").alias("points"), F.round(F.abs(R.area(F.col("ring"))), 6).alias("area"))


@query("G18_grid_polygons", f"""WITH RECURSIVE {PX}, {cc('ink', 'lab')} SELECT plan_id, CAST(COUNT(*) AS BIGINT) AS pixels FROM lab GROUP BY 1""", "fx_pixels")
def g18(spark, d):
    """Area of the simple polygons that cover each plan's ink: its pixels, as none is lost and none covered twice."""
    return J.grid_polygons(ink(spark, d), plan_table(spark, d)).groupBy("plan_id").agg(F.round(F.sum(F.abs(R.area(F.col("ring"))))).cast("long").alias("pixels"))


@query("R24_dedupe_doors", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY building_id, level_id ORDER BY shape_id) AS seq FROM fx_line WHERE kind = 'opening' AND level_id IS NOT NULL)
SELECT level_id, shape_id FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.level_id = o.level_id AND p.seq < o.seq
  AND sqrt(pow((p.x1 + p.x2) / 2.0 - (o.x1 + o.x2) / 2.0, 2) + pow((p.y1 + p.y2) / 2.0 - (o.y1 + o.y2) / 2.0, 2)) < sqrt(pow(o.x2 - o.x1, 2) + pow(o.y2 - o.y1, 2)) / 2)""", "fx_shape", "fx_line")
def r24(spark, d):
    rows = view(spark, d, "fx_line").where("kind = 'opening' and level_id is not null").withColumn("seq", F.col("shape_id"))
    return J.dedupe_doors(rows, "level_id").select("level_id", "shape_id")


def walls(spark, d):
    b, rows = buildings(spark, d), kept(shapes(spark, d), "walls-shapes")
    s = kept(G.building_scale(b, G.building_extent(b, rows)), "walls-scale")
    raised = J.raised_levels(rows, b)
    return J.raised_walls(J.expand_holes(raised.where("kind = 'unit'")), b, s, G.doorway_boxes(raised.where("kind = 'opening'"), s)), s


@query("G22_extrude_walls")
def g22(spark, d):
    return walls(spark, d)[0].groupBy("level_id", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(R.area(F.col("ring")))), 4).alias("area"))


@query("E11_raised_walls")
def e11(spark, d):
    """Tops and faces as units of the unit file."""
    w, s = walls(spark, d)
    got = E.wall_units(w, s).where("category = 'unspecified'")
    return got.select("level_id", "feature_id", "seq", "piece", F.size(F.element_at("rings", 1)).alias("points"))


@query("E12_wall_hatching")
def e12(spark, d):
    w, s = walls(spark, d)
    faces = w.where("part = 'face'").join(s.select("building_id", "mpu"), "building_id")
    faces = faces.select(F.struct("level_id", "i", "mpu").alias("face"), F.array("ring").alias("rings"))
    step = E.STEP / F.col("face.mpu")
    got = K.hatch(faces, "face", step, step * E.THICK)
    return got.select("face.level_id", "face.i", F.round("y", 6).alias("y"), F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))
