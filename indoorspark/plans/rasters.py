"""Queries over floor-plan rasters; plans have two sizes, and thresholds of their own that fit them."""

from __future__ import annotations

from pyspark.sql import functions as F

from indoorspark.fixtures import view
from indoorspark.functions import rings as R
from indoorspark.operators import raster as X
from indoorspark.operators.shapes import scaled, shapes
from indoorspark.plans.registry import query
from indoorspark.sources.scratch import kept

#: Join of a mask m with its plan's size and thresholds.
PLAN = "JOIN fx_plan z ON {0}.plan_id = z.plan_id"
PX = """px AS (SELECT *, CASE WHEN a < 40 THEN 255 ELSE CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b END AS grey FROM fx_pixels),
ink AS (SELECT plan_id, x, y FROM px WHERE grey <= 180)"""


def cc(mask: str, out: str, corners: bool = False) -> str:
    """Parts of a mask that hang together by sides, or by corners too."""
    met = "GREATEST(abs(i.x - r.tx), abs(i.y - r.ty)) = 1" if corners else "abs(i.x - r.tx) + abs(i.y - r.ty) = 1"
    return f"""{out}_r AS (SELECT plan_id, x, y, x AS tx, y AS ty FROM {mask} UNION SELECT r.plan_id, r.x, r.y, i.x, i.y FROM {out}_r r JOIN {mask} i ON r.plan_id = i.plan_id AND {met}),
{out} AS (SELECT plan_id, x, y, CAST(MIN(ty * 65536 + tx) AS BIGINT) AS label FROM {out}_r GROUP BY 1, 2, 3)"""


def stats(labelled: str, out: str) -> str:
    return f"{out} AS (SELECT plan_id, label, MIN(x) AS min_x, MIN(y) AS min_y, MAX(x) AS max_x, MAX(y) AS max_y, COUNT(*) AS n FROM {labelled} GROUP BY 1, 2)"


def run_sql(mask: str, axis: str, out: str) -> str:
    line = "y" if axis == "x" else "x"
    return f"""{out} AS (SELECT plan_id, '{axis}' AS axis, {line} AS line, MIN({axis}) AS s, MAX({axis}) AS e, MAX({axis}) - MIN({axis}) + 1 AS len FROM (
  SELECT *, {axis} - row_number() OVER (PARTITION BY plan_id, {line} ORDER BY {axis}) AS i FROM {mask}) GROUP BY plan_id, {line}, i)"""


FREE = "free AS (SELECT plan_id, x, y FROM fx_pixels EXCEPT SELECT plan_id, x, y FROM ink)"
REGIONS = f"""{FREE}, {cc("free", "fc")}, edge AS (SELECT fc.plan_id, label, MAX(CASE WHEN x IN (0, width - 1) OR y IN (0, height - 1) THEN 1 ELSE 0 END) AS out FROM fc {PLAN.format('fc')} GROUP BY 1, 2),
reg AS (SELECT fc.plan_id, x, y, CASE WHEN out = 1 THEN -1 ELSE fc.label END AS region FROM fc JOIN edge ON fc.plan_id = edge.plan_id AND fc.label = edge.label)"""
#: Spaces for the later stages: components of the free pixels.
SPACES = f"{FREE}, {cc('free', 'sp')}"


def pixels(spark, d):
    return X.binarize(view(spark, d, "fx_pixels"))


def plan_table(spark, d):
    return view(spark, d, "fx_plan")


def ink(spark, d):
    return pixels(spark, d).where("ink").select("plan_id", "x", "y")


def spaces(spark, d):
    p = pixels(spark, d)
    return X.components(X.free_pixels(p, ink(spark, d))).withColumnRenamed("label", "region")


@query("R1_binarize", f"WITH {PX} SELECT plan_id, COUNT(*) FILTER (grey <= 180) AS ink, COUNT(*) FILTER (grey <= 245) AS mark FROM px GROUP BY 1", "fx_pixels")
def r1(spark, d):
    return pixels(spark, d).groupBy("plan_id").agg(F.count_if("ink").alias("ink"), F.count_if("mark").alias("mark"))


SIZES = "z AS (SELECT building_id, CAST(600 + seq * 700 AS DOUBLE) AS w, CAST(400 + x0 * 3 AS DOUBLE) AS h, CAST(200 + y0 + seq * 90 AS DOUBLE) AS b, shape_id FROM fx_shape)"


@query("R2_work_scale", f"""WITH {SIZES}, t AS (SELECT *, LEAST(1, 1200 / GREATEST(w, h)) AS s, LEAST(1, 1000 / b) AS f FROM z)
SELECT shape_id, ROUND(CASE WHEN f > s * 1.15::DOUBLE AND w * f * h * f < 4200000 THEN f ELSE s END, 9) AS scale FROM t""", "fx_shape")
def r2(spark, d):
    df = view(spark, d, "fx_shape").selectExpr("shape_id", "CAST(600 + seq * 700 AS DOUBLE) AS w", "CAST(400 + x0 * 3 AS DOUBLE) AS h", "CAST(200 + y0 + seq * 90 AS DOUBLE) AS b")
    return df.select("shape_id", F.round(X.work_scale(F.col("w"), F.col("h"), F.col("b")), 9).alias("scale"))


@query("R3_components", f"WITH RECURSIVE {PX}, {cc('ink', 'lab')} SELECT plan_id, x, y, label FROM lab", "fx_pixels")
def r3(spark, d):
    return X.components(ink(spark, d))


@query("R4_dominant_component", f"WITH RECURSIVE {PX}, {cc('ink', 'lab')}, {stats('lab', 'st')} SELECT plan_id, label, min_x, min_y, max_x, max_y, n FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY n DESC, label) AS k FROM st) WHERE k = 1", "fx_pixels")
def r4(spark, d):
    return X.dominant(X.component_stats(X.components(ink(spark, d))))


@query("R5_plan_thresholds", """WITH t AS (SELECT shape_id, CAST(300 + x0 * 9 + w AS DOUBLE) AS b, GREATEST(8, floor((300 + x0 * 9 + w) / 40.0 + 0.5)) AS g FROM fx_shape)
SELECT shape_id, CAST(GREATEST(20, floor(b / 28 + 0.5)) AS BIGINT) AS l_min, CAST(g AS BIGINT) AS gap_max, CAST(GREATEST(6, floor(b / 40 + 0.5)) AS BIGINT) AS dash_max, CAST(GREATEST(6, floor(g * 0.6::DOUBLE + 0.5)) AS BIGINT) AS wall_t,
  CAST(GREATEST(3, floor(g * 0.45::DOUBLE + 0.5)) AS BIGINT) AS jog_tol, CAST(floor(g * 1.6::DOUBLE + 0.5) AS BIGINT) AS foot_tol,
  CAST(floor(g * 2.2::DOUBLE + 0.5) AS BIGINT) AS gap_wide, CAST(GREATEST(5, floor(g * 0.45::DOUBLE + 0.5)) AS BIGINT) AS seal_min, CAST(GREATEST(5, floor(g * 0.45::DOUBLE + 0.5), floor(g * 0.6::DOUBLE + 0.5)) AS BIGINT) AS seal_depth, CAST(GREATEST(3, floor(g * 0.5 + 0.5)) AS BIGINT) AS k_open FROM t""", "fx_shape")
def r5(spark, d):
    t = X.thresholds((300 + F.col("x0") * 9 + F.col("w")).cast("double"))
    return view(spark, d, "fx_shape").select("shape_id", *[c.cast("long").alias(k) for k, c in t.items()])


@query("R6_runs", f"WITH {PX}, {run_sql('ink', 'x', 'rx')}, {run_sql('ink', 'y', 'ry')} SELECT plan_id, axis, line, s, e, len FROM rx UNION ALL SELECT plan_id, axis, line, s, e, len FROM ry", "fx_pixels")
def r6(spark, d):
    mask = ink(spark, d)
    return X.runs(mask, "x").unionByName(X.runs(mask, "y")).withColumnsRenamed({"start": "s", "end": "e"})


CORE = "core AS (SELECT i.plan_id, i.x, i.y FROM ink i JOIN ink j ON i.plan_id = j.plan_id AND abs(i.x - j.x) + abs(i.y - j.y) = 1 JOIN fx_plan z ON i.plan_id = z.plan_id WHERE i.x BETWEEN 1 AND width - 2 AND i.y BETWEEN 1 AND height - 2 GROUP BY 1, 2, 3 HAVING COUNT(*) = 4)"
WALLS = f"""{PX}, {cc('ink', 'lab')}, {CORE}, {run_sql('ink', 'x', 'rx')}, {run_sql('ink', 'y', 'ry')},
lng AS (SELECT i.* FROM ink i JOIN fx_plan z ON i.plan_id = z.plan_id JOIN rx ON i.plan_id = rx.plan_id AND i.y = rx.line AND i.x BETWEEN s AND e AND len >= l_min UNION SELECT i.* FROM ink i JOIN fx_plan z ON i.plan_id = z.plan_id JOIN ry ON i.plan_id = ry.plan_id AND i.x = ry.line AND i.y BETWEEN s AND e AND len >= l_min),
sol AS (SELECT DISTINCT lab.plan_id, label FROM lab JOIN core USING (plan_id, x, y)),
wall AS (SELECT * FROM core UNION SELECT lng.plan_id, lng.x, lng.y FROM lng JOIN lab USING (plan_id, x, y) JOIN sol USING (plan_id, label))"""


def walls(spark, d):
    return X.wall_pixels(ink(spark, d), plan_table(spark, d))


@query("R7_wall_pixels", f"WITH RECURSIVE {WALLS} SELECT plan_id, x, y FROM wall", "fx_pixels", "fx_plan")
def r7(spark, d):
    return walls(spark, d)


@query("R8_dilate1", f"WITH RECURSIVE {WALLS} SELECT plan_id, x, y FROM wall UNION SELECT p.plan_id, p.x, p.y FROM px p JOIN wall w ON p.plan_id = w.plan_id AND abs(p.x - w.x) + abs(p.y - w.y) = 1 JOIN fx_plan z ON p.plan_id = z.plan_id WHERE p.x BETWEEN 1 AND width - 2 AND p.y BETWEEN 1 AND height - 2", "fx_pixels", "fx_plan")
def r8(spark, d):
    return X.dilate(walls(spark, d), plan_table(spark, d))


DASHES = f"""{PX}, {cc('ink', 'lab', True)}, {stats('lab', 'st')}, th AS (SELECT st.*, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h, dash_max FROM st JOIN fx_plan z ON st.plan_id = z.plan_id),
dl AS (SELECT plan_id, label, w >= h AS flat, CASE WHEN w >= h THEN floor((min_y + max_y) / 2.0) ELSE floor((min_x + max_x) / 2.0) END AS line, CASE WHEN w >= h THEN min_x ELSE min_y END AS a, CASE WHEN w >= h THEN max_x ELSE max_y END AS b, GREATEST(w, h) AS len, dash_max
  FROM th WHERE GREATEST(w, h) <= dash_max AND LEAST(w, h) <= 3 AND n <= 1.6 * (w + h) + 2),
dn AS (SELECT *, CASE WHEN a - LAG(b) OVER o - 1 BETWEEN 1 AND LEAST(dash_max, GREATEST(3, len, LAG(len) OVER o)) THEN 0 ELSE 1 END AS nw FROM dl WINDOW o AS (PARTITION BY plan_id, flat, line ORDER BY a, label)),
dc AS (SELECT *, SUM(nw) OVER (PARTITION BY plan_id, flat, line ORDER BY a, label) AS chain FROM dn),
dash AS (SELECT plan_id, label FROM (SELECT *, COUNT(*) OVER (PARTITION BY plan_id, flat, line, chain) AS k FROM dc) WHERE k >= 3)"""


def dashes(spark, d):
    labelled = X.components(ink(spark, d), eight=True)
    return labelled, X.dashed_lines(X.component_stats(labelled), plan_table(spark, d))


@query("R9_dashed_lines", f"WITH RECURSIVE {DASHES} SELECT plan_id, label FROM dash", "fx_pixels", "fx_plan")
def r9(spark, d):
    return dashes(spark, d)[1].select("plan_id", "label")


@query("R10_erase", f"WITH RECURSIVE {DASHES} SELECT plan_id, x, y FROM lab WHERE NOT EXISTS (SELECT 1 FROM dash WHERE dash.plan_id = lab.plan_id AND dash.label = lab.label)", "fx_pixels", "fx_plan")
def r10(spark, d):
    labelled, lines = dashes(spark, d)
    gone = labelled.join(lines, ["plan_id", "label"], "left_semi")
    return X.erase(labelled, gone).select("plan_id", "x", "y")


def gap_sql(mask: str, axis: str, out: str) -> str:
    """Pixels (plan_id, x along the axis, y its line) of the gaps up to gap_wide between runs of two and more."""
    return f"""{run_sql(mask, axis, out + 'u')}, {out} AS (SELECT g.plan_id, CAST(x AS INT) AS x, line AS y FROM (SELECT *, LAG(e) OVER o AS pe, LAG(len) OVER o AS pl FROM {out}u WINDOW o AS (PARTITION BY plan_id, line ORDER BY s)) g
  JOIN fx_plan z ON g.plan_id = z.plan_id, range(0, 16) t(x) WHERE s - pe - 1 BETWEEN 1 AND gap_wide AND len >= 2 AND pl >= 2 AND x > pe AND x < s)"""


#: bl: blobs of gaps with their box; bp: their pixels.
BLOBS = f"""{gap_sql('ink', 'x', 'gx')}, {gap_sql('ink', 'y', 'gy')}, {cc('gx', 'bx')}, {cc('gy', 'bw')},
ba AS (SELECT 'x' AS axis, * FROM bx UNION ALL SELECT 'y' AS axis, * FROM bw),
bl AS (SELECT g.* FROM (SELECT plan_id, axis, label, MIN(x) AS lo, MAX(x) AS hi, MIN(y) AS fst, MAX(y) AS lst, MAX(x) - MIN(x) + 1 AS width, MAX(y) - MIN(y) + 1 AS depth, MIN(CASE WHEN axis = 'x' THEN y * 65536 + x ELSE x * 65536 + y END) AS turn FROM ba GROUP BY 1, 2, 3) g
  JOIN fx_plan z ON g.plan_id = z.plan_id WHERE g.width <= 3 OR depth <= seal_depth),
bp AS (SELECT ba.plan_id, ba.axis, ba.label, CASE WHEN ba.axis = 'x' THEN x ELSE y END AS x, CASE WHEN ba.axis = 'x' THEN y ELSE x END AS y, width FROM ba JOIN bl ON ba.plan_id = bl.plan_id AND ba.axis = bl.axis AND ba.label = bl.label)"""
#: The first limit that encloses a quarter of the building's box: fc_ parts of the free pixels of each plan and step as plan_id * 4 + step.
PICKED = f"""{BLOBS}, {cc('ink', 'lab')}, {stats('lab', 'st')}, box AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY n DESC, label) AS k FROM st) WHERE k = 1),
li AS (SELECT plan_id AS p, plan_id * 4 + step AS plan_id, step, width AS pw, height AS ph, CASE step WHEN 0 THEN gap_max WHEN 1 THEN floor(gap_max * 1.5 + 0.5) ELSE floor(floor(gap_max * 1.5 + 0.5) * 1.5 + 0.5) END AS lim FROM fx_plan, range(0, 3) t(step)),
sl AS (SELECT li.plan_id, x, y FROM ink JOIN li ON ink.plan_id = li.p UNION SELECT li.plan_id, x, y FROM bp JOIN li ON bp.plan_id = li.p WHERE width <= lim),
fr AS (SELECT li.plan_id, x, y FROM px JOIN li ON px.plan_id = li.p EXCEPT SELECT plan_id, x, y FROM sl), {cc('fr', 'fs')},
ed AS (SELECT fs.plan_id, label, MAX(CASE WHEN x IN (0, pw - 1) OR y IN (0, ph - 1) THEN 1 ELSE 0 END) AS out FROM fs JOIN li ON fs.plan_id = li.plan_id GROUP BY 1, 2),
oc AS (SELECT li.plan_id, COUNT(*) AS n FROM fs JOIN ed ON fs.plan_id = ed.plan_id AND fs.label = ed.label JOIN li ON fs.plan_id = li.plan_id JOIN box ON box.plan_id = li.p WHERE out = 1 AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY 1),
al AS (SELECT li.p, step, lim, 1 - COALESCE(oc.n, 0) / ((max_x - min_x + 1) * (max_y - min_y + 1))::DOUBLE AS share FROM li JOIN box ON box.plan_id = li.p LEFT JOIN oc ON li.plan_id = oc.plan_id),
pk AS (SELECT p, COALESCE(MIN(step) FILTER (share >= 0.25), MAX(step)) AS step FROM al GROUP BY 1),
pl AS (SELECT al.p AS plan_id, CAST(al.step AS INT) AS step, CAST(lim AS BIGINT) AS lim, share FROM al JOIN pk ON al.p = pk.p AND al.step = pk.step)"""
CLOSED = "cl AS (SELECT plan_id, x, y FROM ink UNION SELECT bp.plan_id, x, y FROM bp JOIN pl ON bp.plan_id = pl.plan_id WHERE width <= lim)"
LINES = """ln AS (SELECT bl.plan_id, bl.axis, bl.label, turn, CASE WHEN bl.axis = 'x' THEN CAST(lo AS DOUBLE) ELSE (fst + lst + 1) / 2.0::DOUBLE END AS x1, CASE WHEN bl.axis = 'x' THEN (fst + lst + 1) / 2.0::DOUBLE ELSE CAST(lo AS DOUBLE) END AS y1,
  CASE WHEN bl.axis = 'x' THEN CAST(hi + 1 AS DOUBLE) ELSE (fst + lst + 1) / 2.0::DOUBLE END AS x2, CASE WHEN bl.axis = 'x' THEN (fst + lst + 1) / 2.0::DOUBLE ELSE CAST(hi + 1 AS DOUBLE) END AS y2
  FROM bl JOIN pl ON bl.plan_id = pl.plan_id JOIN fx_plan z ON bl.plan_id = z.plan_id WHERE bl.width <= lim AND bl.width >= seal_min)"""
#: Pixels that can't be reached from the border once doorways are closed: cf parts of what is free.
REACHED = f"""cn AS (SELECT plan_id, x, y FROM fx_pixels EXCEPT SELECT plan_id, x, y FROM cl), {cc('cn', 'cf')},
ce AS (SELECT cf.plan_id, label, MAX(CASE WHEN x IN (0, width - 1) OR y IN (0, height - 1) THEN 1 ELSE 0 END) AS out FROM cf JOIN fx_plan z ON cf.plan_id = z.plan_id GROUP BY 1, 2),
ft AS (SELECT plan_id, x, y FROM fx_pixels EXCEPT SELECT cf.plan_id, x, y FROM cf JOIN ce ON cf.plan_id = ce.plan_id AND cf.label = ce.label WHERE out = 1)"""
BOTH = ("fx_pixels", "fx_plan")


def blobs(spark, d):
    return X.gap_blobs(ink(spark, d), plan_table(spark, d), run=2)


def picked(spark, d, blobs):
    boxes = X.dominant(X.component_stats(X.components(ink(spark, d))))
    return X.seal_doorways(pixels(spark, d), ink(spark, d), blobs, plan_table(spark, d), boxes, enough=0.25)


def sealed(spark, d):
    """(blobs, limits, closed pixels) with the limit that each plan takes."""
    b = kept(blobs(spark, d), "blobs")
    limit = kept(picked(spark, d, b), "limits")
    return b, limit, X.seal(ink(spark, d), b, limit)


def reachable(spark, d, closed):
    """(regions, what can't be reached from the border)."""
    p, z = pixels(spark, d).select("plan_id", "x", "y"), plan_table(spark, d)
    region = kept(X.regions(p, closed, z), "regions")
    return region, X.erase(p, region.where("region = -1"))


@query("R11_gap_scan", f"WITH RECURSIVE {PX}, {BLOBS} SELECT bp.plan_id, bp.axis, bp.label AS blob, x, y, bl.width, depth FROM bp JOIN bl ON bp.plan_id = bl.plan_id AND bp.axis = bl.axis AND bp.label = bl.label", *BOTH)
def r11(spark, d):
    """Pixels of every gap blob that may be a doorway."""
    n, across = F.explode(F.sequence("start", "end")).alias("n"), F.col("axis") == "x"
    got = blobs(spark, d).select("plan_id", "axis", "blob", "line", n, "width", "depth")
    return got.select("plan_id", "axis", "blob", F.when(across, F.col("n")).otherwise(F.col("line")).alias("x"), F.when(across, F.col("line")).otherwise(F.col("n")).alias("y"), "width", "depth")


@query("R12_seal_doorways", f"WITH RECURSIVE {PX}, {PICKED}, {CLOSED} SELECT plan_id, x, y FROM cl", *BOTH)
def r12(spark, d):
    return sealed(spark, d)[2]


@query("R12_pick_limit", f"WITH RECURSIVE {PX}, {PICKED} SELECT plan_id, step, lim, ROUND(share, 9) AS share FROM pl", *BOTH)
def r12b(spark, d):
    got = picked(spark, d, blobs(spark, d))
    return got.select("plan_id", "step", F.col("limit").alias("lim"), F.round("share", 9).alias("share"))


@query("R12_doorway_lines", f"WITH RECURSIVE {PX}, {PICKED}, {LINES} SELECT plan_id, axis, label AS blob, x1, y1, x2, y2 FROM ln", *BOTH)
def r12c(spark, d):
    b, limit, _ = sealed(spark, d)
    return X.doorway_lines(b, limit, plan_table(spark, d)).drop("turn")


@query("R24_plan_doors", f"""WITH RECURSIVE {PX}, {PICKED}, {CLOSED}, {LINES}, {REACHED},
lf AS (SELECT ln.* FROM ln JOIN fx_plan z ON ln.plan_id = z.plan_id JOIN ft ON ft.plan_id = ln.plan_id AND ft.x = LEAST(width - 1, floor((x1 + x2) / 2)) AND ft.y = LEAST(height - 1, floor((y1 + y2) / 2))),
dd AS (SELECT plan_id, CAST(COUNT(*) AS INT) AS n, list({{'a': axis, 'l': label, 'mx': (x1 + x2) / 2, 'my': (y1 + y2) / 2, 'reach': sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 2}} ORDER BY axis, turn) AS os FROM lf GROUP BY 1),
da AS (SELECT plan_id, 0 AS i, CAST([] AS INT[]) AS added FROM dd UNION ALL SELECT da.plan_id, i + 1, CASE WHEN len([1 for k in added if sqrt(pow(os[k].mx - os[i + 1].mx, 2) + pow(os[k].my - os[i + 1].my, 2)) < os[i + 1].reach]) = 0 THEN list_append(added, i + 1) ELSE added END FROM da JOIN dd ON da.plan_id = dd.plan_id WHERE i < n)
SELECT plan_id, o.a AS axis, o.l AS blob FROM (SELECT dd.plan_id, os[unnest(added)] AS o FROM da JOIN dd ON da.plan_id = dd.plan_id WHERE i = n)""", *BOTH)
def r24(spark, d):
    """Doors of each plan: doorway lines in what can't be reached from outside, one for each doorway."""
    b, limit, closed = sealed(spark, d)
    z = plan_table(spark, d)
    return X.plan_doors(X.doorway_lines(b, limit, z), reachable(spark, d, closed)[1], z).select("plan_id", "axis", "blob")


@query("R13_outside_and_regions", f"WITH RECURSIVE {PX}, {REGIONS} SELECT plan_id, x, y, region FROM reg", "fx_pixels", "fx_plan")
def r13(spark, d):
    return X.regions(pixels(spark, d), ink(spark, d), plan_table(spark, d))


@query("R14_open_mask", f"""WITH {PX}, er AS (SELECT p.plan_id, p.x, p.y, k_open FROM px p JOIN fx_plan z ON p.plan_id = z.plan_id JOIN ink i ON p.plan_id = i.plan_id AND abs(p.x - i.x) <= k_open AND abs(p.y - i.y) <= k_open
  WHERE p.x BETWEEN k_open AND width - 1 - k_open AND p.y BETWEEN k_open AND height - 1 - k_open GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = (2 * k_open + 1) * (2 * k_open + 1))
SELECT DISTINCT p.plan_id, p.x, p.y FROM px p JOIN er ON p.plan_id = er.plan_id AND abs(p.x - er.x) <= k_open AND abs(p.y - er.y) <= k_open""", "fx_pixels", "fx_plan")
def r14(spark, d):
    return X.open_mask(ink(spark, d), plan_table(spark, d))


@query("R16_region_state", f"""WITH RECURSIVE {PX}, {REGIONS}, g AS (SELECT plan_id, region, COUNT(*) AS n, COUNT(*) FILTER (x < 5) AS f, GREATEST(MAX(x) - MIN(x), MAX(y) - MIN(y)) + 1 AS side FROM reg WHERE region >= 0 GROUP BY 1, 2)
SELECT g.plan_id, region, CASE WHEN f * 2 < n THEN 'outside' WHEN n < GREATEST(12, 0.25 * gap_max * gap_max) OR n * 1.0 / side <= GREATEST(3, 0.3 * gap_max) THEN 'wall' ELSE 'space' END AS state FROM g {PLAN.format('g')}""", "fx_pixels", "fx_plan")
def r16(spark, d):
    p, z = pixels(spark, d), plan_table(spark, d)
    return X.region_state(X.regions(p, ink(spark, d), z), p.where("x < 5"), z)


def contact_sql(axis: str, out: str) -> str:
    line = "y" if axis == "x" else "x"
    return f"""{out} AS (SELECT g.plan_id, LEAST(label, b) AS a, GREATEST(label, b) AS b, EXISTS (SELECT 1 FROM dr WHERE dr.plan_id = g.plan_id AND dr.{line} = g.l AND dr.{axis} > g.p AND dr.{axis} < g.q) AS door
  FROM (SELECT plan_id, label, {line} AS l, {axis} AS p, LEAD(label) OVER o AS b, LEAD({axis}) OVER o AS q FROM sp WINDOW o AS (PARTITION BY plan_id, {line} ORDER BY {axis})) g {PLAN.format('g')} WHERE q - p - 1 BETWEEN 1 AND wall_t AND label <> b)"""


@query("R17_space_contacts", f"WITH RECURSIVE {PX}, {SPACES}, dr AS (SELECT * FROM ink WHERE (x + y) % 3 = 0), {contact_sql('x', 'kx')}, {contact_sql('y', 'ky')} SELECT plan_id, a, b, CAST(SUM(CASE WHEN door THEN 3 ELSE 1 END) AS BIGINT) AS weight, MAX(door) AS door FROM (SELECT * FROM kx UNION ALL SELECT * FROM ky) GROUP BY 1, 2, 3", "fx_pixels", "fx_plan")
def r17(spark, d):
    return X.space_contacts(spaces(spark, d), ink(spark, d).where("(x + y) % 3 = 0"), plan_table(spark, d))


def between_sql(axis: str, out: str, sp: str) -> str:
    line = "y" if axis == "x" else "x"
    return f"""{out} AS (SELECT i.plan_id, i.x, i.y, arg_max(a.region, a.{axis}) AS l, arg_min(b.region, b.{axis}) AS r, MIN(b.{axis}) - MAX(a.{axis}) - 1 AS gap FROM px i JOIN {sp} a ON i.plan_id = a.plan_id AND i.{line} = a.{line} AND a.{axis} < i.{axis}
  JOIN {sp} b ON i.plan_id = b.plan_id AND i.{line} = b.{line} AND b.{axis} > i.{axis} WHERE NOT EXISTS (SELECT 1 FROM {sp} o WHERE o.plan_id = i.plan_id AND o.x = i.x AND o.y = i.y) GROUP BY 1, 2, 3)"""


def absorb_sql(before: str, after: str) -> str:
    return f"""{between_sql('x', after + 'x', before)}, {between_sql('y', after + 'y', before)}, {after} AS (SELECT * FROM {before} UNION ALL SELECT plan_id, x, y, region FROM (SELECT i.plan_id, i.x, i.y,
  COALESCE(CASE WHEN bx.l = bx.r AND bx.gap <= wall_t THEN bx.l END, CASE WHEN bw.l = bw.r AND bw.gap <= wall_t THEN bw.l END) AS region FROM (SELECT px.*, wall_t FROM px {PLAN.format('px')}) i LEFT JOIN {after}x bx USING (plan_id, x, y) LEFT JOIN {after}y bw USING (plan_id, x, y)) WHERE region IS NOT NULL)"""


@query("R19_absorb_partitions", f"WITH RECURSIVE {PX}, {SPACES}, s0 AS (SELECT plan_id, x, y, label AS region FROM sp), {absorb_sql('s0', 's1')}, {absorb_sql('s1', 's2')}, {absorb_sql('s2', 's3')} SELECT plan_id, x, y, region FROM s3", "fx_pixels", "fx_plan")
def r19(spark, d):
    return X.absorb_partitions(pixels(spark, d), spaces(spark, d), plan_table(spark, d))


def halves(spark, d):
    """Plans with a footprint of three quarters of their pixels."""
    return plan_table(spark, d).withColumn("foot", F.col("width") * F.col("height") * 0.75)


CONTACTS = f"dr AS (SELECT * FROM ink WHERE (x + y) % 3 = 0), {contact_sql('x', 'kx')}, {contact_sql('y', 'ky')}, ct AS (SELECT plan_id, a, b, MAX(door) AS door FROM (SELECT * FROM kx UNION ALL SELECT * FROM ky) GROUP BY 1, 2, 3)"
KINDS = f"""{stats('sp', 'st')}, t AS (SELECT st.*, width * height * 0.75::DOUBLE AS foot, min_room, row_number() OVER (PARTITION BY st.plan_id ORDER BY n DESC, label) AS k FROM st JOIN fx_plan z ON st.plan_id = z.plan_id),
kd AS (SELECT plan_id, label, n, CASE WHEN n < 0.35 * min_room OR n / foot > 0.6 OR (n * 1.0 / ((max_x - min_x + 1) * (max_y - min_y + 1)) < 0.45 AND n / foot >= 0.01) OR (k = 1 AND n / foot >= 0.2) THEN 'walkway' ELSE 'room' END AS kind FROM t)"""


@query("R20_classify_spaces", f"""WITH RECURSIVE {PX}, {SPACES}, {CONTACTS}, {KINDS}
SELECT kd.plan_id, label AS region, n, (SELECT COUNT(*) FROM ct WHERE ct.plan_id = kd.plan_id AND door AND (a = label OR b = label)) AS doors, kind FROM kd""", *BOTH)
def r20(spark, d):
    s = spaces(spark, d)
    return X.classify_spaces(s, X.space_contacts(s, ink(spark, d).where("(x + y) % 3 = 0"), plan_table(spark, d)), halves(spark, d))


@query("R22_label_point", f"""WITH RECURSIVE {PX}, {SPACES}, {KINDS}, wm AS (SELECT sp.plan_id, x, y FROM sp JOIN kd ON sp.plan_id = kd.plan_id AND sp.label = kd.label WHERE kind = 'walkway'), {cc('wm', 'wl')},
wr AS (SELECT plan_id, label, y, MIN(x) AS s, MAX(x) AS e FROM (SELECT *, x - row_number() OVER (PARTITION BY plan_id, label, y ORDER BY x) AS i FROM wl) GROUP BY plan_id, label, y, i)
SELECT plan_id, label, (s + e + 1) / 2.0::DOUBLE AS x, y + 0.5::DOUBLE AS y FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, label ORDER BY e - s DESC, y, s) AS k FROM wr) WHERE k = 1""", *BOTH)
def r22(spark, d):
    """A point inside each part of a plan's walkways."""
    s = spaces(spark, d)
    kinds = X.classify_spaces(s, X.space_contacts(s, ink(spark, d).where("false"), plan_table(spark, d)), halves(spark, d))
    walk = s.join(kinds.where("kind = 'walkway'"), ["plan_id", "region"], "left_semi")
    return X.label_points(X.components(walk))


@query("R25_pocket_owner", f"""WITH RECURSIVE {PX}, {PICKED}, {CLOSED}, {REACHED}, {cc('ink', 'ls', True)}, {stats('ls', 'lz')},
pa AS (SELECT cf.* FROM cf JOIN ce ON cf.plan_id = ce.plan_id AND cf.label = ce.label WHERE out = 0), {stats('pa', 'ps')},
pf AS (SELECT ps.*, CASE WHEN label % 65536 * 2 < width THEN 1 ELSE 2 END AS space FROM ps JOIN fx_plan z ON ps.plan_id = z.plan_id),
fl AS (SELECT plan_id, space, label FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, space ORDER BY n DESC, label) AS k FROM pf) WHERE k = 1),
nb AS (SELECT pa.plan_id, pa.label AS patch, (pa.y * 65536 + pa.x) * 4 + k AS turn, pa.x + dx AS x, pa.y + dy AS y FROM pa JOIN fx_plan z ON pa.plan_id = z.plan_id, (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)) v(k, dx, dy) WHERE pa.x BETWEEN 1 AND width - 2 AND pa.y BETWEEN 1 AND height - 2),
ad AS (SELECT DISTINCT nb.plan_id, patch FROM nb JOIN cl ON nb.plan_id = cl.plan_id AND nb.x = cl.x AND nb.y = cl.y WHERE NOT EXISTS (SELECT 1 FROM ink WHERE ink.plan_id = nb.plan_id AND ink.x = nb.x AND ink.y = nb.y)),
v AS (SELECT nb.plan_id, patch, ls.label AS owner, COUNT(*) AS n, MIN(turn) AS turn FROM nb JOIN ls ON nb.plan_id = ls.plan_id AND nb.x = ls.x AND nb.y = ls.y GROUP BY 1, 2, 3),
ow AS (SELECT v.plan_id, patch, arg_min(owner, (-v.n, turn)) AS owner FROM v JOIN ps ON v.plan_id = ps.plan_id AND patch = ps.label JOIN lz ON v.plan_id = lz.plan_id AND owner = lz.label
  WHERE lz.min_x - 2 <= ps.min_x AND lz.min_y - 2 <= ps.min_y AND lz.max_x + 2 >= ps.max_x AND lz.max_y + 2 >= ps.max_y GROUP BY 1, 2)
SELECT pf.plan_id, pf.label AS patch, pf.space, CASE WHEN fl.label = pf.label THEN 'floor' WHEN ow.owner IS NOT NULL THEN CASE WHEN ad.patch IS NOT NULL THEN 'door' ELSE 'pocket' END END AS state, CASE WHEN fl.label <> pf.label THEN ow.owner END AS owner
FROM pf JOIN fl ON pf.plan_id = fl.plan_id AND pf.space = fl.space LEFT JOIN ow ON ow.plan_id = pf.plan_id AND ow.patch = pf.label LEFT JOIN ad ON ad.plan_id = pf.plan_id AND ad.patch = pf.label""", *BOTH)
def r25(spark, d):
    """Enclosed patches of each plan; its left and right half stand for spaces, sealed gaps for doors."""
    z = plan_table(spark, d)
    closed = kept(sealed(spark, d)[2], "closed")
    patches = reachable(spark, d, closed)[0].where("region >= 0").withColumnRenamed("region", "label")
    half = X.with_plan(pixels(spark, d).select("plan_id", "x", "y"), z, "width").select("plan_id", "x", "y", F.when(F.col("x") * 2 < F.col("width"), 1).otherwise(2).alias("region"))
    return X.pockets(patches, X.components(ink(spark, d), eight=True), half, X.erase(closed, ink(spark, d)), z)


@query("R26_trimmed_box", f"""WITH RECURSIVE {PX}, {cc('ink', 'lab')}, cx AS (SELECT plan_id, label, x, COUNT(*) AS n FROM lab GROUP BY 1, 2, 3), cy AS (SELECT plan_id, label, y, COUNT(*) AS n FROM lab GROUP BY 1, 2, 3),
fx AS (SELECT plan_id, label, MIN(x) AS x0, MAX(x) AS x1 FROM (SELECT *, MAX(n) OVER (PARTITION BY plan_id, label) AS m FROM cx) WHERE n >= m * 0.3 GROUP BY 1, 2),
fy AS (SELECT plan_id, label, MIN(y) AS y0, MAX(y) AS y1 FROM (SELECT *, MAX(n) OVER (PARTITION BY plan_id, label) AS m FROM cy) WHERE n >= m * 0.3 GROUP BY 1, 2)
SELECT fx.plan_id, fx.label, x0, x1, y0, y1 FROM fx JOIN fy ON fx.plan_id = fy.plan_id AND fx.label = fy.label""", "fx_pixels")
def r26(spark, d):
    return X.trimmed_box(X.components(ink(spark, d)))


CORNER = "(VALUES (1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1)) c(k, sx, sy)"


@query("R26_rounded_box", f"""WITH RECURSIVE {PX}, {cc('ink', 'lab')}, cx AS (SELECT plan_id, label, x, COUNT(*) AS n FROM lab GROUP BY 1, 2, 3), cy AS (SELECT plan_id, label, y, COUNT(*) AS n FROM lab GROUP BY 1, 2, 3),
fx AS (SELECT plan_id, label, MIN(x) AS x0, MAX(x) AS x1 FROM (SELECT *, MAX(n) OVER (PARTITION BY plan_id, label) AS m FROM cx) WHERE n >= m * 0.3 GROUP BY 1, 2),
fy AS (SELECT plan_id, label, MIN(y) AS y0, MAX(y) AS y1 FROM (SELECT *, MAX(n) OVER (PARTITION BY plan_id, label) AS m FROM cy) WHERE n >= m * 0.3 GROUP BY 1, 2),
bx AS (SELECT fx.plan_id, fx.label, x0, y0, x1, y1, GREATEST((x1 - x0 + 1) // 2, 1) AS qw, GREATEST((y1 - y0 + 1) // 2, 1) AS qh, LEAST(x1 - x0 + 1, y1 - y0 + 1) / 2.0::DOUBLE AS half FROM fx JOIN fy ON fx.plan_id = fy.plan_id AND fx.label = fy.label),
cr AS (SELECT bx.*, k, sx, sy, CASE WHEN sx < 0 THEN x0 ELSE x1 - qw + 1 END AS qx, CASE WHEN sy < 0 THEN y0 ELSE y1 - qh + 1 END AS qy FROM bx, {CORNER}),
ra AS (SELECT cr.plan_id, cr.label, k, sx, sy, LEAST(sqrt((qw * qh - COUNT(lab.x)) / (1 - pi() / 4)), half) AS raw FROM cr
  LEFT JOIN lab ON cr.plan_id = lab.plan_id AND cr.label = lab.label AND lab.x BETWEEN qx AND qx + qw - 1 AND lab.y BETWEEN qy AND qy + qh - 1 GROUP BY cr.plan_id, cr.label, k, sx, sy, qw, qh, half),
rr AS (SELECT plan_id, label, k, sx, sy, CASE WHEN raw >= CASE WHEN MIN(raw) OVER (PARTITION BY plan_id, label) >= 1.5 THEN 1.5 ELSE 2.5 END THEN raw ELSE 0 END AS r FROM ra),
cells AS (SELECT plan_id, label, x0, y0, x1, y1, x, y FROM (SELECT bx.*, unnest(generate_series(x0, x1)) AS x FROM bx) a, LATERAL (SELECT unnest(generate_series(a.y0, a.y1)) AS y) b),
gone AS (SELECT DISTINCT cells.plan_id, cells.label, x, y FROM cells JOIN rr ON cells.plan_id = rr.plan_id AND cells.label = rr.label AND r > 0
  WHERE sx * (x + 0.5 - CASE WHEN sx < 0 THEN x0 + r ELSE x1 + 1 - r END) > 0 AND sy * (y + 0.5 - CASE WHEN sy < 0 THEN y0 + r ELSE y1 + 1 - r END) > 0
    AND pow(x + 0.5 - CASE WHEN sx < 0 THEN x0 + r ELSE x1 + 1 - r END, 2) + pow(y + 0.5 - CASE WHEN sy < 0 THEN y0 + r ELSE y1 + 1 - r END, 2) > r * r),
model AS (SELECT plan_id, label, x, y FROM cells EXCEPT SELECT * FROM gone),
met AS (SELECT model.plan_id, model.label, COUNT(*) AS cells, COUNT(lab.x) AS shared FROM model LEFT JOIN lab ON model.plan_id = lab.plan_id AND model.label = lab.label AND model.x = lab.x AND model.y = lab.y GROUP BY 1, 2),
pn AS (SELECT plan_id, label, COUNT(*) AS n FROM lab GROUP BY 1, 2), rs AS (SELECT plan_id, label, string_agg(CAST(CAST(floor(r * 1000 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY k) AS radii FROM rr GROUP BY 1, 2)
SELECT pn.plan_id, pn.label, n, radii, shared / (n + cells - shared)::DOUBLE AS agree, shared / (n + cells - shared)::DOUBLE >= CASE WHEN n >= 60 THEN 0.9 ELSE 0.84 END AS fits
FROM pn JOIN met ON pn.plan_id = met.plan_id AND pn.label = met.label JOIN rs ON pn.plan_id = rs.plan_id AND pn.label = rs.label""", "fx_pixels")
def r26_rounded(spark, d):
    """The box with round corners of each part of a plan's ink, radii in thousandths, and whether it fits."""
    got = X.rounded_boxes(X.components(ink(spark, d)))
    thousandths = F.array_join(F.transform("radii", lambda r: F.floor(r * 1000 + 0.5).cast("string")), " ")
    return got.select("plan_id", "label", "n", thousandths.alias("radii"), "agree", "fits")


@query("R27_pen_width", f"""WITH RECURSIVE {PX}, {cc('ink', 'lab', True)}, {run_sql('ink', 'x', 'rx')}, {run_sql('ink', 'y', 'ry')},
t AS (SELECT lab.plan_id, label, LEAST(rx.len, ry.len) AS t FROM lab JOIN rx ON lab.plan_id = rx.plan_id AND lab.y = rx.line AND lab.x BETWEEN rx.s AND rx.e JOIN ry ON lab.plan_id = ry.plan_id AND lab.x = ry.line AND lab.y BETWEEN ry.s AND ry.e),
s AS (SELECT plan_id, label, list_sort(list(t)) AS ts FROM t GROUP BY 1, 2)
SELECT plan_id, label, ts[CAST(floor(len(ts) / 2.0) AS INT) + 1] AS width, ts[len(ts)] AS most FROM s""", "fx_pixels")
def r27(spark, d):
    return X.pen_width(X.components(ink(spark, d), eight=True))


@query("R28_upscale_result", "SELECT shape_id, ring, ROUND(MIN(x) / 0.4, 6) AS x0, ROUND(MAX(y) / 0.4, 6) AS y1 FROM fx_vertex WHERE kind = 'unit' GROUP BY 1, 2", "fx_shape", "fx_vertex")
def r28(spark, d):
    df = shapes(spark, d).where("kind = 'unit'").select("shape_id", F.posexplode(scaled(F.col("rings"), 1 / 0.4)).alias("ring", "r")).select("shape_id", "ring", R.bounds(F.col("r")).alias("b"))
    return df.select("shape_id", "ring", F.round("b.min_x", 6).alias("x0"), F.round("b.max_y", 6).alias("y1"))
