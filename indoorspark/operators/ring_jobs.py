"""Ring columns through the helpers, as Arrow-batched functions; raised walls by level; plan outlines by plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indoorspark.functions import kernels as K
from indoorspark.functions import rings as R
from indoorspark.operators import raster as X
from indoorspark.operators.reconcile import first_doors
from indoorspark.operators.walls import level_floors
from indoorspark.sources.scratch import kept, spread

# Fixed value: height of walls, in metres.
WALL = 0.35
#: The types of a ring and of several, as objects: functions are made before any session is.
RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
RINGS = T.ArrayType(RING)


def _points(ring) -> list:
    return [(p["x"], p["y"]) for p in ring]


def _structs(ring) -> list:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def ring_function(helper):
    """helper(points, parameter) over a ring column and a number column."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _structs(helper(_points(r), b)) for r, b in zip(rings, by, strict=True)])

    return run


clean_ring = ring_function(lambda r, _: K.clean(r))
rectilinear_simplify = ring_function(K.rectilinear_simplify)
simplify_path = ring_function(K.simplify_path)
simplify_ring = ring_function(K.simplify_ring)
snap_axes = ring_function(lambda r, _: K.snap_axes(r))


@F.arrow_udf(RINGS)
def split_holes(polygons: pa.Array) -> pa.Array:
    """Open rings of simple polygons that cover each polygon of closed rings; null gives null. Points stay Arrow columns on both ways."""
    of, rings = polygons.offsets.to_pylist(), polygons.values
    at, (x, y) = rings.offsets.to_pylist(), (rings.values.field(k).to_pylist() for k in (0, 1))
    ring_of, point_of, out_x, out_y = [0], [0], [], []
    for i, valid in enumerate(polygons.is_valid().to_pylist()):
        for ring in K.split_holes([list(zip(x[at[r] : at[r + 1]], y[at[r] : at[r + 1]])) for r in range(of[i], of[i + 1])]) if valid else []:
            out_x += [p[0] for p in ring]
            out_y += [p[1] for p in ring]
            point_of.append(len(out_x))
        ring_of.append(len(point_of) - 1)
    points = pa.StructArray.from_arrays([pa.array(out_x, pa.float64()), pa.array(out_y, pa.float64())], ["x", "y"])
    found = pa.ListArray.from_arrays(pa.array(point_of, pa.int32()), points)
    return pa.ListArray.from_arrays(pa.array(ring_of, pa.int32()), found, mask=polygons.is_null())


def expand_holes(shapes: DataFrame) -> DataFrame:
    """Shapes with holes as several without, `piece` from 0; only holed rows go to the helper, spread over all tasks."""
    from indoorspark.functions.scalars import piece_id

    many = F.coalesce(F.size("rings"), F.lit(0)) > 1
    plain = shapes.where(~many).withColumn("piece", F.lit(0))
    holed = spread(shapes.where(many), "shape_id")
    cut = holed.select(*[c for c in shapes.columns if c != "rings"], F.posexplode(split_holes(F.col("rings"))).alias("piece", "_r"))
    cut = cut.withColumn("shape_id", piece_id(F.col("shape_id"), F.col("piece"))).withColumn("rings", F.array(R.closed(F.col("_r")))).drop("_r")
    return plain.unionByName(cut.select(*plain.columns))


def ring_spans(df: DataFrame, key: str) -> DataFrame:
    """(key, row, from, to): pixels that the closed rings of `rings` fill, even-odd, sampled at pixel centres. Null rings give none."""

    def run(batches):
        for b in batches:
            polygons, keys = b.column("rings"), b.column(key)
            found = [(i, K.spans([np.column_stack([np.asarray(r.values.field(k)) for k in (0, 1)]) for r in polygons[i].values])) for i in range(len(keys)) if polygons[i].is_valid and len(polygons[i])]
            rows, first, last = (np.concatenate([f[k] for _, f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            of = np.repeat(np.array([i for i, _ in found], np.int64), [len(f[0]) for _, f in found])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(rows), pa.array(first), pa.array(last)], names=[key, "row", "from", "to"])

    schema = f"{key} {dict(df.dtypes)[key]}, row long, `from` long, `to` long"
    return df.select(key, "rings").mapInArrow(run, schema)


def raised_levels(shapes: DataFrame, buildings: DataFrame) -> DataFrame:
    """Shapes of levels whose walls are raised: only their holes need to be split for that."""
    return shapes.where("level_id is not null").join(buildings.where("effect3d").select("building_id"), "building_id", "left_semi")


def raised_walls(shapes: DataFrame, buildings: DataFrame, scale: DataFrame, doorways: DataFrame, metres: float = WALL) -> DataFrame:
    """(building_id, level_id, part, i, ring): tops and faces (closed rings, pixels) of each level with rooms, buildings with effect3d.

    shapes: rooms without holes (as pieces). Walls are a building's wall_height (metres) tall if it has one, else `metres`.

    A level is one task's group; Spark deals levels out by id. Without an outline the building's extent stands in.
    """
    chosen = buildings.where("effect3d").select("building_id", "outline", F.when(F.col("wall_height") > 0, F.col("wall_height")).otherwise(metres).alias("metres")).join(scale.select("building_id", "min_x", "min_y", "max_x", "max_y", "mpu"), "building_id")
    box = F.array(R.point(F.col("min_x"), F.col("min_y")), R.point(F.col("max_x"), F.col("min_y")), R.point(F.col("max_x"), F.col("max_y")), R.point(F.col("min_x"), F.col("max_y")))
    doors = doorways.groupBy("level_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1"))).alias("doors"))
    rows = level_floors(shapes).select("building_id", "level_id", "floors").join(chosen, "building_id").join(doors, "level_id", "left")
    rows = rows.select("building_id", "level_id", F.coalesce("outline", box).alias("footprint"), "floors", "doors", (F.col("metres") / F.col("mpu")).alias("height"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                floors = [[K.opened(_points(ring)) for ring in f["rings"][:1]] for f in r.floors]
                doors = [] if r.doors is None else [(d["x0"], d["y0"], d["x1"], d["y1"]) for d in r.doors]
                for part, rings in zip(("top", "face"), K.extrude(K.opened(_points(r.footprint)), floors, doors, r.height), strict=True):
                    out += [(r.building_id, r.level_id, part, i, _structs([*ring, ring[0]])) for i, ring in enumerate(rings)]
            yield pd.DataFrame(out, columns=["building_id", "level_id", "part", "i", "ring"])

    return spread(rows, "level_id").mapInPandas(run, f"building_id string, level_id string, part string, i int, ring {R.RING}")


def by_plan(mask: DataFrame, plans: DataFrame, helper, schema: str, *names: str) -> DataFrame:
    """helper(plan_id, mask, sub-table, plan's values) for each plan's pixels: a mask of the plan's size, drawn from its runs' pixels."""
    rows = mask.join(plans.select("plan_id", "width", "height", *names), "plan_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        m = np.zeros((int(first["height"]), int(first["width"])), bool)
        m[group["y"], group["x"]] = True
        return pd.DataFrame(helper(int(first["plan_id"]), m, group, first), columns=[x.split()[0] for x in schema.split(", ")])

    return spread(rows, "plan_id").groupBy("plan_id").applyInPandas(run, schema)


def plan_loops(mask: DataFrame, plans: DataFrame, tol) -> DataFrame:
    """(plan_id, loops, outline): border loops of each plan's mask, and the simplified ring of the largest."""
    helper = lambda plan, m, _, first: [(plan, len(K.loops(m)), _structs(K.outline(m, first["tol"])))]
    return by_plan(mask, plans.withColumn("tol", tol), helper, f"plan_id long, loops int, outline {R.RING}", "tol")


def grid_polygons(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, piece, ring): simple polygons, on the lines between pixels, that cover each plan's mask."""

    def helper(plan, m, _, first):
        return [(plan, i, _structs(r)) for i, r in enumerate(K.cell_polygons(range(m.shape[1] + 1), range(m.shape[0] + 1), m))]

    return by_plan(mask, plans, helper, f"plan_id long, piece int, ring {R.RING}")


def net_area(rings):
    """Area of a polygon's outer ring less its holes."""
    outer = F.abs(R.area(F.element_at(rings, 1)))
    return outer * 2 - R.total(F.transform(rings, lambda r: F.abs(R.area(r))))


def space_polygons(spaces: DataFrame, kinds: DataFrame, plans: DataFrame, offset: float = 1.0) -> DataFrame:
    """(plan_id, region, kind, rings): outer rings of rooms; of what no room claims (walkways), each part by sides as a polygon with holes.

    spaces: (plan_id, x, y, region); kinds: (plan_id, region, kind). Rings are squared, or smoothed where they run in steps, by
    the plan's jog_tol; squared ones move out by `offset`, holes in, as walls were drawn that much thicker. Walkways of fewer
    than min_walk pixels and holes smaller than jog_tol squared go. region of a walkway is its first pixel's.
    """
    rows = spaces.join(kinds.select("plan_id", "region", "kind"), ["plan_id", "region"])

    def helper(plan, _, group, first):
        tol, out = float(first["jog_tol"]), []
        shape = int(first["height"]), int(first["width"])

        def mask_of(part):
            m = np.zeros(shape, bool)
            m[part["y"], part["x"]] = True
            return m

        for region, part in group[group["kind"] == "room"].groupby("region"):
            ring, squared = K.regular(K.largest(K.loops(mask_of(part))), tol)
            if len(ring) >= 3:
                out.append((plan, region, "room", [_structs(K.moved(ring, offset) if squared else ring)]))
        walk = mask_of(group[group["kind"] == "walkway"])
        for part in K.pieces(walk):
            if part.sum() < first["min_walk"]:
                continue
            rings = []
            for k, loop in enumerate(sorted(K.loops(part), key=lambda r: -abs(K.area(r)))):
                if k and abs(K.area(loop)) < tol * tol:
                    continue
                ring, squared = K.regular(loop, tol)
                if len(ring) >= 3:
                    rings.append(_structs(K.moved(ring, -offset if k else offset) if squared else ring))
            y, x = (int(v[0]) for v in np.nonzero(part))
            if rings:
                out.append((plan, y * 65536 + x, "walkway", rings))
        return out

    return by_plan(rows, plans, helper, f"plan_id long, region long, kind string, rings array<{R.RING}>", "jog_tol", "min_walk")


def partition_shapes(folded: DataFrame, plans: DataFrame, least: int = 4) -> DataFrame:
    """(plan_id, label, piece, ring): parts (by sides) of wall ink folded into a space, of `least` pixels and jog_tol length, as simple rings."""

    def helper(plan, m, _, first):
        out = []
        for part in K.pieces(m):
            ys, xs = np.nonzero(part)
            if len(ys) < least or max(np.ptp(xs), np.ptp(ys)) < first["jog_tol"]:
                continue
            found = sorted(K.loops(part), key=lambda r: -abs(K.area(r)))
            rings = [r for r in (K.rectilinear_simplify(r, 2) for k, r in enumerate(found) if not k or abs(K.area(r)) >= 9) if len(r) >= 4]
            for i, ring in enumerate(K.split_holes(rings) if rings else []):
                out.append((plan, int(ys[0]) * 65536 + int(xs[0]), i, _structs(ring)))
        return out

    return by_plan(folded, plans, helper, f"plan_id long, label long, piece int, ring {R.RING}", "jog_tol")


def fit_shapes(labelled: DataFrame, grow: float, plans: DataFrame, scrap, keep_scraps: bool = False) -> DataFrame:
    """(plan_id, label, form, ring): a box with corners round or square, a polygon or a curve fitted to each component.

    Boxes are counted and drawn as columns (`raster.rounded_boxes`); only parts that are none go to the helper. A ring moves out by
    `grow`. A curve of fewer than `scrap` pixels is lettering and goes, unless keep_scraps.
    """
    found = X.rounded_boxes(labelled).where("fits").where((F.col("x1") - F.col("x0") + 1 + 2 * grow > 1) & (F.col("y1") - F.col("y0") + 1 + 2 * grow > 1))
    boxes = kept(found, "fitted-boxes")
    corners = [F.when(F.col("radii")[k] > 0, F.col("radii")[k] + grow).otherwise(0.0) for k in range(4)]
    ring = R.rounded_rect(F.col("x0") - grow, F.col("y0") - grow, F.col("x1") + 1 + grow, F.col("y1") + 1 + grow, corners)
    drawn = boxes.select("plan_id", "label", F.lit("box").alias("form"), ring.alias("ring"))

    def helper(plan, _, group, first):
        out = []
        for label, part in group.groupby("label"):
            x0, y0 = int(part["x"].min()), int(part["y"].min())
            m = np.zeros((int(part["y"].max()) - y0 + 1, int(part["x"].max()) - x0 + 1), bool)
            m[part["y"] - y0, part["x"] - x0] = True
            form, ring = K.outline_form(m, grow, 0 if keep_scraps else first["scrap"])
            if ring:
                out.append((plan, label, form, _structs([(x + x0, y + y0) for x, y in ring])))
        return out

    rest = labelled.join(boxes.select("plan_id", "label"), ["plan_id", "label"], "left_anti")
    return drawn.unionByName(by_plan(rest, plans.withColumn("scrap", scrap), helper, f"plan_id long, label long, form string, ring {R.RING}", "scrap"))


def merge_small_spaces(sizes: DataFrame, contacts: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, region, into): the smallest space below the plan's `least` joins the neighbour of the heaviest contact (the larger one
    on a tie), again and again."""
    a = sizes.select("plan_id", F.col("region").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n").cast("long").alias("v"))
    rows = a.unionByName(contacts.select("plan_id", "a", "b", F.col("weight").cast("long").alias("v"))).join(plans.select("plan_id", "least"), "plan_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        alone = group["b"].isna()
        size = {int(r): int(v) for r, v in zip(group["a"][alone], group["v"][alone])}
        near: dict[int, dict[int, int]] = {r: {} for r in size}
        for p, q, v in group.loc[~alone, ["a", "b", "v"]].astype("int64").itertuples(index=False):
            near[p][q] = near[q][p] = near[p].get(q, 0) + v
        into = K.merged(size, near, float(group["least"].iloc[0]))
        return pd.DataFrame({"plan_id": group["plan_id"].iloc[0], "region": list(into), "into": list(into.values())})

    return spread(rows, "plan_id").groupBy("plan_id").applyInPandas(run, "plan_id long, region long, into long")


def dedupe_doors(doors: DataFrame, by: str = "plan_id") -> DataFrame:
    """doors(by, seq, x1, y1, x2, y2) in order, without those whose middle is within half their length of an earlier one that stays."""
    return first_doors(doors, by)


def footprints(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, ring): the closed outline of each plan's mask, squared (and then moved in by one pixel, as walls were grown) or smoothed by
    the plan's foot_tol. Plans without a mask have no row."""

    def helper(plan, m, _, first):
        found = K.loops(m)
        ring, squared = K.regular(K.largest(found), float(first["foot_tol"])) if found else ([], False)
        ring = K.moved(ring, -1.0) if squared and len(ring) >= 3 else ring
        return [(plan, _structs([*ring, ring[0]]))] if len(ring) >= 3 else []

    return by_plan(mask, plans, helper, f"plan_id long, ring {R.RING}", "foot_tol")
