"""Joins of shapes by place, and the work of fitting newly detected shapes to existing ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indoorspark.functions import rings as R
from indoorspark.functions.scalars import text_or
from indoorspark.sources.scratch import kept, spread


def centre(side: str = "") -> tuple[Column, Column]:
    c = lambda n: F.col(side + n)
    return c("x0") + c("w") / 2, c("y0") + c("h") / 2


def covers(side: str, x: Column, y: Column) -> Column:
    """The box x0, y0, w, h (columns prefixed by side) holds the point, edges included."""
    c = lambda n: F.col(side + n)
    return (x >= c("x0")) & (x <= c("x0") + c("w")) & (y >= c("y0")) & (y <= c("y0") + c("h"))


def cell_sizes(boxes: DataFrame, by: str) -> DataFrame:
    """(by, cell) of boxes(by, x0, y0, w, h): the side of a grid cell, by each group's mean box and its number of boxes.

    As wide as the mean box, a box covers four cells or so; as wide as the extent over the root of the count, no box covers more cells
    than there are boxes. A group with many shapes thus falls into many cells, and its join into many tasks.
    """
    spread_ = lambda a, b: (F.max(F.col(a) + F.col(b)) - F.min(a)) / F.sqrt(F.count(F.lit(1)))
    return boxes.groupBy(by).agg(F.greatest(F.avg("w"), F.avg("h"), spread_("x0", "w"), spread_("y0", "h"), F.lit(1.0)).alias("_cell"))


def on_grid(boxes: DataFrame, sizes: DataFrame, by: str, prefix: str) -> DataFrame:
    """A row for each grid cell that a box touches, columns prefixed."""
    to = lambda lo, side: F.explode(F.sequence(F.floor(F.col(lo) / F.col("_cell")), F.floor((F.col(lo) + F.col(side)) / F.col("_cell"))))
    celled = boxes.join(sizes, by).withColumn("_cx", to("x0", "w")).withColumn("_cy", to("y0", "h")).drop("_cell")
    return celled.select(*[F.col(c).alias(prefix + c) for c in celled.columns])


def in_boxes(points: DataFrame, x: Column, y: Column, boxes: DataFrame, by: str, how: str = "inner", also: Column | None = None, prefix: str = "e_") -> DataFrame:
    """Join of points with the boxes (columns prefixed) of the same `by` that hold (x, y), edges included, by grid cell: a point is in
    one cell, so each pair is met once. Points of groups without boxes match nothing."""
    sizes = cell_sizes(boxes, by)
    right = on_grid(boxes, sizes, by, prefix)
    at = points.join(sizes, by, "left").withColumns({"_cx": F.floor(x / F.col("_cell")), "_cy": F.floor(y / F.col("_cell"))})
    c = lambda n: F.col(prefix + n)
    on = (F.col(by) == c(by)) & (F.col("_cx") == c("_cx")) & (F.col("_cy") == c("_cy")) & covers(prefix, x, y)
    return at.join(right, on if also is None else on & also, how).drop("_cell", "_cx", "_cy", f"{prefix}_cx", f"{prefix}_cy")


def room_candidates(detected: DataFrame, rooms: DataFrame) -> DataFrame:
    """Pairs (level_id, d_seq, e_id, e_seq) of one level in which each box holds the other's centre."""
    d = detected.select("level_id", "seq", "x0", "y0", "w", "h")
    met = in_boxes(d, *centre(), rooms.select("level_id", "shape_id", "seq", "x0", "y0", "w", "h"), "level_id", also=covers("", *centre("e_")))
    return met.select("level_id", F.col("seq").alias("d_seq"), F.col("e_shape_id").alias("e_id"), "e_seq")


def match_rooms(detected: DataFrame, rooms: DataFrame) -> DataFrame:
    """(level_id, d_seq, e_id): each detected room, in order, takes the first existing room still free.

    Pairs whose two sides have no other pair need no order; only levels with a contested room go to a
    helper that holds that level's pairs.
    """
    pairs = kept(room_candidates(detected, rooms), "room-pairs")
    twice = lambda *by: pairs.groupBy(*by).count().where("count > 1").select("level_id")
    contested = twice("level_id", "d_seq").unionByName(twice("level_id", "e_id")).distinct()

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        taken, done, out = set(), set(), []
        for r in group.sort_values(["d_seq", "e_seq", "e_id"]).itertuples():
            if r.d_seq not in done and r.e_id not in taken:
                taken.add(r.e_id)
                done.add(r.d_seq)
                out.append((r.level_id, r.d_seq, r.e_id))
        return pd.DataFrame(out, columns=["level_id", "d_seq", "e_id"])

    plain = pairs.join(contested, "level_id", "left_anti").select("level_id", F.col("d_seq").cast("int").alias("d_seq"), "e_id")
    return plain.unionByName(spread(pairs.join(contested, "level_id", "left_semi"), "level_id").groupBy("level_id").applyInPandas(greedy, "level_id string, d_seq int, e_id string"))


def uncovered(detected: DataFrame, existing: DataFrame, by: str = "level_id", also: Column | None = None, *more: str) -> DataFrame:
    """Detected boxes whose centre no existing box of the same `by` holds (of those that `also`, over e_ columns of `more`, lets count)."""
    return in_boxes(detected, *centre(), existing.select(by, "x0", "y0", "w", "h", *more), by, "left_anti", also).select(*detected.columns)


def _lost(by: str):
    """Helper over pairs (by, a_seq, b_seq), a before b: each b is lost if one of its a's is not."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for b_seq, earlier in group.groupby("b_seq")["a_seq"]:
            if any(x not in gone for x in earlier):
                gone.add(b_seq)
                out.append((group[by].iloc[0], b_seq))
        return pd.DataFrame(out, columns=[by, "seq"])

    return run


def first_come(detected: DataFrame, by: str = "level_id") -> DataFrame:
    """In the order of seq, boxes whose centre no earlier box that was taken holds; only levels with such a pair go to the helper."""
    met = in_boxes(detected.select(by, "seq", "x0", "y0", "w", "h"), *centre(), detected.select(by, "seq", "x0", "y0", "w", "h"), by, also=F.col("a_seq") < F.col("seq"), prefix="a_")
    pairs = met.select(by, "a_seq", F.col("seq").alias("b_seq"))
    return detected.join(spread(pairs, by).groupBy(by).applyInPandas(_lost(by), f"{by} string, seq {dict(detected.dtypes)['seq']}"), [by, "seq"], "left_anti")


def bucketed(df: DataFrame, x: Column, y: Column, cell, around: bool = False) -> DataFrame:
    """df with its grid cell (_cx, _cy), or a row for each of the nine cells around it."""
    cx, cy = F.floor(x / cell), F.floor(y / cell)
    if not around:
        return df.withColumns({"_cx": cx, "_cy": cy})
    near = lambda c: F.explode(F.sequence(c - 1, c + 1))
    return df.withColumn("_cx", near(cx)).withColumn("_cy", near(cy))


def _near_doors(doors: DataFrame, others: DataFrame, cell: int, by: str = "building_id") -> tuple[DataFrame, DataFrame, Column]:
    """doors and others with the middle, met by `by` and grid cell, and the test that the other's middle is within half a door's length.

    A door's cells are as wide as its reach, `cell` at least, in steps of two: one long line of a building leaves the cells of its other
    doors as they are. The others are dealt out for each step that the building's doors have.
    """
    mid = lambda df: df.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    reach = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2) / 2
    fresh = mid(doors).withColumn("reach", reach).withColumn("_cell", cell * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest("reach", F.lit(1.0)) / cell)).cast("double"))))
    steps = fresh.select(by, "_cell").distinct()
    fresh = bucketed(fresh, F.col("mx"), F.col("my"), F.col("_cell"))
    old = bucketed(mid(others).join(steps, by), F.col("mx"), F.col("my"), F.col("_cell"), around=True)
    old = old.select(F.col(by).alias("o_b"), F.col("mx").alias("o_x"), F.col("my").alias("o_y"), *[F.col(c).alias(f"o{c}") for c in ("_cell", "_cx", "_cy")], *([F.col("seq").alias("o_seq")] if "seq" in others.columns else []))
    near = F.sqrt((F.col("mx") - F.col("o_x")) ** 2 + (F.col("my") - F.col("o_y")) ** 2) < F.col("reach")
    return fresh, old, (F.col(by) == F.col("o_b")) & (F.col("_cell") == F.col("o_cell")) & (F.col("_cx") == F.col("o_cx")) & (F.col("_cy") == F.col("o_cy")) & near


def new_doors(doors: DataFrame, openings: DataFrame, cell: int = 200) -> DataFrame:
    """doors(building_id, seq, x1, y1, x2, y2) whose middle is not within half their length of an existing opening's."""
    fresh, old, near = _near_doors(doors, openings.drop("seq"), cell)
    return fresh.join(old, near, "left_anti").select(*doors.columns)


def accepted_doors(doors: DataFrame, openings: DataFrame, cell: int = 200) -> DataFrame:
    """new_doors that, in the order of seq (unique in a building), are not as near to an earlier one that was accepted either."""
    return first_doors(kept(new_doors(doors, openings, cell), "new-doors"), cell=cell)


def first_doors(doors: DataFrame, by: str = "building_id", cell: int = 200) -> DataFrame:
    """doors(by, seq, x1, y1, x2, y2) in the order of seq (unique in `by`), without those near an earlier one that stays.

    Only pairs of near doors go to the ordered helper. Doors whose `by` is null all stay.
    """
    fresh, old, near = _near_doors(doors, doors, cell, by)
    pairs = fresh.join(old, near & (F.col("o_seq") < F.col("seq"))).select(by, F.col("o_seq").alias("a_seq"), F.col("seq").alias("b_seq"))
    types = dict(doors.dtypes)
    gone = spread(pairs, by).groupBy(by).applyInPandas(_lost(by), f"{by} {types[by]}, seq {types['seq']}")
    return doors.join(gone, [by, "seq"], "left_anti").select(*doors.columns)


def hit_stack(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(point_id, shape_id, depth): shapes of the point's level whose box holds it, topmost (greatest z) first."""
    met = in_boxes(points, F.col("x"), F.col("y"), shapes.select("level_id", "shape_id", "z", "x0", "y0", "w", "h"), "level_id", prefix="s_")
    depth = F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("s_z"), "s_shape_id"))
    return met.select("point_id", F.col("s_shape_id").alias("shape_id"), depth.alias("depth"))


def points_in_shapes(points: DataFrame, shapes: DataFrame, cell: int = 200) -> DataFrame:
    """(point_id, shape_id): even-odd test behind the box test, behind a join by level and grid cell."""
    b = R.bounds(F.element_at("rings", 1))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    s = shapes.withColumn("b", b).withColumn("_cx", span(F.col("b.min_x"), F.col("b.max_x"))).withColumn("_cy", span(F.col("b.min_y"), F.col("b.max_y")))
    s = s.select(F.col("level_id").alias("s_level"), "shape_id", "rings", "b", F.col("_cx").alias("s_cx"), F.col("_cy").alias("s_cy"))
    p = bucketed(points, F.col("x"), F.col("y"), cell)
    inside = F.col("x").between(F.col("b.min_x"), F.col("b.max_x")) & F.col("y").between(F.col("b.min_y"), F.col("b.max_y"))
    met = p.join(s, (F.col("level_id") == F.col("s_level")) & (F.col("_cx") == F.col("s_cx")) & (F.col("_cy") == F.col("s_cy")) & inside)
    return met.where(R.point_in_rings(F.col("x"), F.col("y"), F.col("rings"))).select("point_id", "shape_id")


def is_room(kind: Column, category: Column) -> Column:
    return (kind == "unit") & (text_or(category, "") != "walkway")


def default_named(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"^Room \d+$")


def cleanup(shapes: DataFrame, matched: DataFrame) -> DataFrame:
    """What a rebuild keeps of a level's shapes: not its walkways without a directory id, drawn-only fixtures, doors, nor
    unmatched rooms without a directory id that still have their first name."""
    free = text_or(F.col("place_id"), "") == ""
    walkway = (F.col("kind") == "unit") & (text_or(F.col("category"), "") == "walkway") & free
    decor = (F.col("kind") == "fixture") & free & (text_or(F.col("category"), "") != "desk") & F.col("line").isNull()
    room = is_room(F.col("kind"), F.col("category")) & free & default_named(F.col("name"))
    kept = shapes.where(~(walkway | decor | (F.col("kind") == "opening")))
    gone = kept.where(room).join(matched.select(F.col("e_id").alias("shape_id")), "shape_id", "left_anti")
    return kept.join(gone.select("shape_id"), "shape_id", "left_anti")


def reconcile_fixtures(detected: DataFrame, shapes: DataFrame, rebuild: bool = True) -> DataFrame:
    """Detected furniture (building_id, level_id, seq, x0, y0, w, h) that is drawn: not where a fixture that stays, of any level
    of the building, already is. A rebuild clears drawn-only fixtures of the traced levels first."""
    fixtures = shapes.where("kind = 'fixture'")
    if rebuild:
        free = (text_or(F.col("place_id"), "") == "") & (text_or(F.col("category"), "") != "desk") & F.col("line").isNull()
        traced = detected.select("level_id").distinct().withColumn("_traced", F.lit(True))
        fixtures = fixtures.join(traced, "level_id", "left").where(~(free & F.coalesce("_traced", F.lit(False))))
    return uncovered(detected, fixtures, by="building_id")


def reconcile_walkways(detected: DataFrame, shapes: DataFrame, rebuild: bool = True) -> DataFrame:
    """Detected walkways of levels that have none left; a rebuild clears those without a directory id first."""
    walkways = shapes.where((F.col("kind") == "unit") & (F.col("category") == "walkway"))
    left = walkways.where(text_or(F.col("place_id"), "") != "") if rebuild else walkways
    return detected.join(left.select("level_id").distinct(), "level_id", "left_anti")


def restack(shapes: DataFrame) -> DataFrame:
    """Drawing order in each level after a rebuild: what it kept as desks or sections comes to the front."""
    front = (F.col("kind") == "section") | ((F.col("kind") == "fixture") & ((text_or(F.col("category"), "") == "desk") | (text_or(F.col("place_id"), "") != "") | F.col("line").isNotNull()))
    tier = F.when(front & (F.col("kind") == "section"), 1).when(front, 2).otherwise(0)
    return shapes.withColumn("z", F.row_number().over(Window.partitionBy("level_id").orderBy(tier, "seq", "shape_id")))


def cap_per_plan(drawings: DataFrame, most: int = 1500) -> DataFrame:
    """Drawings(plan_id, seq, n) until a plan has `most` shapes; the drawing that passes it stays whole."""
    before = F.sum("n").over(Window.partitionBy("plan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return drawings.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most).drop("_before")
