"""Jobs over floor-plan rasters: pixel tables (plan_id, x, y, ...) and run tables (plan_id, axis, line, start, end, len).

A plan is a drawing of bounded size; windows and helpers are keyed by plan or by a line of a plan. Sizes and thresholds differ
by plan: `plans` is a table (plan_id, width, height, and the lengths of `thresholds` that a stage names), joined where needed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indoorspark.functions.scalars import js_round
from indoorspark.operators.reconcile import first_doors
from indoorspark.sources.scratch import kept, spread

# What counts as transparent, as ink, as a mark of any kind.
ALPHA, INK, MARK = 40, 180, 245


def binarize(pixels: DataFrame) -> DataFrame:
    """grey, ink and mark of pixels(r, g, b, a)."""
    grey = F.when(F.col("a") < ALPHA, 255.0).otherwise(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    return pixels.withColumn("grey", grey).withColumns({"ink": F.col("grey") <= INK, "mark": F.col("grey") <= MARK})


def work_scale(width: Column, height: Column, building: Column) -> Column:
    """Scale at which a plan is traced: 1200 pixels on its long side, or finer where the building would get fewer than 1000."""
    s, fine = F.least(F.lit(1.0), 1200.0 / F.greatest(width, height)), F.least(F.lit(1.0), 1000.0 / building)
    return F.when((fine > s * 1.15) & (width * fine * height * fine < 4.2e6), fine).otherwise(s)


def thresholds(longest: Column) -> dict[str, Column]:
    """Lengths in pixels, from the longer side of the building."""
    gap = F.greatest(F.lit(8), js_round(longest / 40))
    least = F.greatest(F.lit(5), js_round(gap * 0.45))
    return {
        "l_min": F.greatest(F.lit(20), js_round(longest / 28)), "gap_max": gap, "dash_max": F.greatest(F.lit(6), js_round(longest / 40)),
        "wall_t": F.greatest(F.lit(6), js_round(gap * 0.6)), "jog_tol": F.greatest(F.lit(3), js_round(gap * 0.45)), "foot_tol": js_round(gap * 1.6),
        "gap_wide": js_round(gap * 2.2), "seal_min": least, "seal_depth": F.greatest(least, js_round(gap * 0.6)), "k_open": F.greatest(F.lit(3), js_round(gap * 0.5)),
    }


def with_plan(df: DataFrame, plans: DataFrame, *names: str) -> DataFrame:
    """df with columns of its plan; Spark broadcasts the plan table only if it is small."""
    return df.join(plans.select("plan_id", *names), "plan_id")


def runs(mask: DataFrame, axis: str) -> DataFrame:
    """Maximal straight runs of mask(plan_id, x, y): along rows for axis "x", along columns for "y"."""
    line = "y" if axis == "x" else "x"
    island = F.col(axis) - F.row_number().over(Window.partitionBy("plan_id", line).orderBy(axis))
    got = mask.withColumn("_i", island).groupBy("plan_id", line, "_i").agg(F.min(axis).alias("start"), F.max(axis).alias("end"))
    return got.select("plan_id", F.lit(axis).alias("axis"), F.col(line).alias("line"), "start", "end", (F.col("end") - F.col("start") + 1).alias("len"))


def run_lengths(mask: DataFrame) -> DataFrame:
    """mask with the length of the run that each pixel is in, across (len_x) and down (len_y)."""
    out = mask
    for axis, line in (("x", "y"), ("y", "x")):
        island = F.col(axis) - F.row_number().over(Window.partitionBy("plan_id", line).orderBy(axis))
        out = out.withColumn("_i", island).withColumn(f"len_{axis}", F.count(F.lit(1)).over(Window.partitionBy("plan_id", line, "_i"))).drop("_i")
    return out


def label_runs(line: np.ndarray, start: np.ndarray, end: np.ndarray, eight: bool) -> np.ndarray:
    """Component of each horizontal run (sorted by line, start): runs of neighbouring lines that touch are joined."""
    line, start, end = line.tolist(), start.tolist(), end.tolist()
    root = list(range(len(line)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach, j = int(eight), 0
    for i in range(len(line)):
        while j < i and (line[j] < line[i] - 1 or (line[j] == line[i] - 1 and end[j] + reach < start[i])):
            j += 1
        k = j
        while k < i and line[k] == line[i] - 1 and start[k] <= end[i] + reach:
            a, b = find(i), find(k)
            root[max(a, b)] = min(a, b)
            k += 1
    return np.array([find(i) for i in range(len(line))], np.int64)


def labelled_runs(rows: DataFrame, eight: bool = False) -> DataFrame:
    """rows(plan_id, axis, line, start, end), runs of one axis and plan at a time, with `label`: runs of neighbouring lines that touch (by
    corners too if `eight`) share that of the first of them, line * 65536 + start. Only runs, not pixels, go to the helper of a plan."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["line", "start"], ignore_index=True)
        line, start, end = (g[c].to_numpy(np.int64) for c in ("line", "start", "end"))
        root = label_runs(line, start, end, eight)
        return g.assign(label=line[root] * 65536 + start[root])[["plan_id", "axis", "line", "start", "end", "label"]]

    rows = rows.select("plan_id", "axis", "line", "start", "end")
    return spread(rows, "plan_id", "axis").groupBy("plan_id", "axis").applyInPandas(run, "plan_id long, axis string, line int, start int, end int, label long")


def components(mask: DataFrame, eight: bool = False) -> DataFrame:
    """(plan_id, x, y, label): label is the component's first pixel in reading order, as y * 65536 + x."""
    labelled = labelled_runs(runs(mask, "x"), eight)
    return labelled.select("plan_id", F.explode(F.sequence("start", "end")).alias("x"), F.col("line").alias("y"), "label")


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("plan_id", "label").agg(*[f(c).alias(n) for n, f, c in (("min_x", F.min, "x"), ("min_y", F.min, "y"), ("max_x", F.max, "x"), ("max_y", F.max, "y"))], F.count(F.lit(1)).alias("n"))


def dominant(stats: DataFrame) -> DataFrame:
    """The largest component of each plan, the first one if several are."""
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("n"), "label"))
    return stats.withColumn("_k", place).where("_k = 1").drop("_k")


NEXT = ((1, 0), (-1, 0), (0, 1), (0, -1))


def shifted(mask: DataFrame, offsets=NEXT) -> DataFrame:
    """A row for each pixel and offset, moved by it."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets])).alias("s")
    return mask.select("plan_id", "x", "y", steps).select("plan_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))


def within(df: DataFrame, plans: DataFrame, border: int = 0) -> DataFrame:
    """Pixels inside their plan, `border` away from its edge."""
    sized = with_plan(df, plans, "width", "height")
    return sized.where(F.col("x").between(border, F.col("width") - 1 - border) & F.col("y").between(border, F.col("height") - 1 - border)).select(*df.columns)


def core(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """Pixels off the border whose four neighbours are set too."""
    four = shifted(mask).groupBy("plan_id", "x", "y").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4").drop("_n")
    return within(mask.join(four, ["plan_id", "x", "y"], "left_semi"), plans, 1)


def wall_pixels(ink: DataFrame, plans: DataFrame) -> DataFrame:
    """Ink that is a core, or in a run of l_min or more whose component (by sides) has a core."""
    thick = core(ink, plans).select("plan_id", "x", "y")
    long = with_plan(run_lengths(ink), plans, "l_min").where(F.greatest("len_x", "len_y") >= F.col("l_min")).select("plan_id", "x", "y")
    labelled = components(ink)
    solid = labelled.join(thick, ["plan_id", "x", "y"], "left_semi").select("plan_id", "label").distinct()
    held = long.join(labelled.join(solid, ["plan_id", "label"], "left_semi"), ["plan_id", "x", "y"], "left_semi")
    return thick.unionByName(held).distinct()


def dilate(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """The mask and its four neighbours, but nothing new on the border."""
    return mask.select("plan_id", "x", "y").unionByName(within(shifted(mask), plans, 1)).distinct()


def erase(mask: DataFrame, pixels: DataFrame) -> DataFrame:
    return mask.join(pixels, ["plan_id", "x", "y"], "left_anti")


def dashed_lines(stats: DataFrame, plans: DataFrame) -> DataFrame:
    """stats of components with `chain` where three or more thin dashes follow each other on a line (axis x or y)."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    thin = with_plan(stats, plans, "dash_max").withColumns({"w": w, "h": h}).where((F.greatest("w", "h") <= F.col("dash_max")) & (F.least("w", "h") <= 3) & (F.col("n") <= 1.6 * (F.col("w") + F.col("h")) + 2))
    axis = F.when(F.col("w") >= F.col("h"), "x").otherwise("y")
    flat = axis == "x"
    lined = thin.withColumns({
        "axis": axis, "line": F.when(flat, F.floor((F.col("min_y") + F.col("max_y")) / 2)).otherwise(F.floor((F.col("min_x") + F.col("max_x")) / 2)),
        "a": F.when(flat, F.col("min_x")).otherwise(F.col("min_y")), "b": F.when(flat, F.col("max_x")).otherwise(F.col("max_y")), "len": F.greatest("w", "h"),
    })
    order = Window.partitionBy("plan_id", "axis", "line").orderBy("a", "label")
    gap = F.col("a") - F.lag("b").over(order) - 1
    most = F.least(F.col("dash_max"), F.greatest(F.lit(3), F.col("len"), F.lag("len").over(order)))
    starts = lined.withColumn("_new", F.when(gap.between(1, most), 0).otherwise(1))
    chained = starts.withColumn("chain", F.sum("_new").over(order))
    size = F.count(F.lit(1)).over(Window.partitionBy("plan_id", "axis", "line", "chain"))
    return chained.withColumn("_size", size).where("_size >= 3").select("plan_id", "label", "axis", "line", "chain")


def gap_scan(walls: DataFrame, axis: str, limits: DataFrame, run: int = 3) -> DataFrame:
    """Gaps of 1 to `limit` pixels (limits: plan_id, limit) between two wall runs of `run` or more on a line: (plan_id, axis, line, start, end, len)."""
    order = Window.partitionBy("plan_id", "line").orderBy("start")
    last = runs(walls, axis).withColumns({"_end": F.lag("end").over(order), "_len": F.lag("len").over(order)})
    gap = F.col("start") - F.col("_end") - 1
    got = with_plan(last, limits, "limit").where(gap.between(1, F.col("limit")) & (F.col("len") >= run) & (F.col("_len") >= run))
    return got.select("plan_id", "axis", "line", (F.col("_end") + 1).alias("start"), (F.col("start") - 1).alias("end"), gap.alias("len"))


def gap_blobs(walls: DataFrame, plans: DataFrame, run: int = 3) -> DataFrame:
    """(plan_id, axis, blob, line, start, end, width, depth, first, last, lo, hi, turn): gaps up to the plan's gap_wide of both axes, those of
    neighbouring lines that overlap as one blob, with its box. What is wider than 3 and deeper than seal_depth is a narrow room between
    two walls, not a doorway, and goes."""
    most = plans.select("plan_id", F.col("gap_wide").alias("limit"))
    gaps = labelled_runs(gap_scan(walls, "x", most, run).unionByName(gap_scan(walls, "y", most, run))).withColumnRenamed("label", "blob")
    first_pixel = F.when(F.col("axis") == "x", F.col("line") * 65536 + F.col("start")).otherwise(F.col("start") * 65536 + F.col("line")).cast("long")  # in reading order
    box = gaps.groupBy("plan_id", "axis", "blob").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.min("start").alias("lo"), F.max("end").alias("hi"), F.min(first_pixel).alias("turn"))
    box = with_plan(box, plans, "seal_depth").withColumns({"width": F.col("hi") - F.col("lo") + 1, "depth": F.col("last") - F.col("first") + 1})
    return gaps.join(box.where((F.col("width") <= 3) | (F.col("depth") <= F.col("seal_depth"))).drop("seal_depth"), ["plan_id", "axis", "blob"])


def seal(walls: DataFrame, blobs: DataFrame, limits: DataFrame) -> DataFrame:
    """walls with every gap blob of at most the plan's limit (limits: plan_id, limit) closed."""
    narrow = with_plan(blobs, limits, "limit").where(F.col("width") <= F.col("limit"))
    across, out = F.explode(F.sequence("start", "end")).alias("n"), walls.select("plan_id", "x", "y")
    for axis in ("x", "y"):
        fill = narrow.where(F.col("axis") == axis).select("plan_id", "line", across)
        out = out.unionByName(fill.select("plan_id", *[F.col("n" if c == axis else "line").alias(c) for c in ("x", "y")]))
    return out.distinct()


def seal_doorways(pixels: DataFrame, walls: DataFrame, blobs: DataFrame, plans: DataFrame, boxes: DataFrame, enough: float = 0.5) -> DataFrame:
    """(plan_id, step, limit, share): the first of three limits, gap_max and twice half as much again, with which `enough` of the
    building's box (boxes: plan_id, min_x, min_y, max_x, max_y) can't be reached from the border, else the last.

    All three are tried at once, each as a plan of its own. Walls in the box count as unreached, as do its free pixels behind them.
    """
    wider = js_round(F.col("gap_max") * 1.5)
    limits = plans.select("plan_id", "width", "height", F.posexplode(F.array(F.col("gap_max").cast("long"), wider, js_round(wider * 1.5))).alias("step", "limit"))
    tried = F.col("plan_id") * 4 + F.col("step")
    each = lambda df: df.join(limits.select("plan_id", "step"), "plan_id").withColumn("plan_id", tried).drop("step")
    as_plans = limits.select(tried.alias("plan_id"), "width", "height", "limit")
    every = each(pixels.select("plan_id", "x", "y"))
    reached = regions(every, seal(each(walls.select("plan_id", "x", "y")), each(blobs), as_plans), as_plans).where("region = -1")
    box = boxes.select("plan_id", "min_x", "min_y", "max_x", "max_y")
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    n = reached.join(each(box), "plan_id").where(inside).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    n = n.select(F.floor(F.col("plan_id") / 4).alias("plan_id"), (F.col("plan_id") % 4).cast("int").alias("step"), "n")
    area = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    shares = limits.select("plan_id", "step", "limit").join(box, "plan_id").join(n, ["plan_id", "step"], "left")
    return pick_limit(shares.select("plan_id", "step", "limit", (1 - F.coalesce("n", F.lit(0)) / area).alias("share")), enough)


def doorway_lines(blobs: DataFrame, limits: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, axis, blob, turn, x1, y1, x2, y2): from jamb to jamb along the middle of the wall, of sealed blobs of seal_min and wider."""
    one = blobs.select("plan_id", "axis", "blob", "turn", "width", "first", "last", "lo", "hi").distinct()
    wide = with_plan(with_plan(one, limits, "limit"), plans, "seal_min").where((F.col("width") <= F.col("limit")) & (F.col("width") >= F.col("seal_min")))
    middle, across = (F.col("first") + F.col("last") + 1) / 2, F.col("axis") == "x"
    end = lambda along, at: F.when(across if along else ~across, at.cast("double")).otherwise(middle)
    lo, hi = F.col("lo"), F.col("hi") + 1
    return wide.select("plan_id", "axis", "blob", "turn", end(True, lo).alias("x1"), end(False, lo).alias("y1"), end(True, hi).alias("x2"), end(False, hi).alias("y2"))


def plan_doors(lines: DataFrame, footprint: DataFrame, plans: DataFrame) -> DataFrame:
    """Doorway lines whose middle lies in the footprint's pixels, those of rows first, without those near an earlier one that stays."""
    mid = lambda a, b, side: F.least(F.col(side) - 1, F.floor((F.col(a) + F.col(b)) / 2)).cast("int")
    at = with_plan(lines, plans, "width", "height").withColumns({"x": mid("x1", "x2", "width"), "y": mid("y1", "y2", "height")})
    inside = at.join(footprint.select("plan_id", "x", "y"), ["plan_id", "x", "y"], "left_semi").select(*lines.columns)
    rows_first = F.when(F.col("axis") == "x", 0).otherwise(1).cast("long")
    return first_doors(inside.withColumn("seq", F.shiftleft(rows_first, 40) + F.col("turn")), "plan_id")


def free_pixels(pixels: DataFrame, closed: DataFrame) -> DataFrame:
    return erase(pixels.select("plan_id", "x", "y"), closed)


def regions(pixels: DataFrame, closed: DataFrame, plans: DataFrame) -> DataFrame:
    """Free pixels with `region`: -1 where they are joined to the border, else their component."""
    labelled = components(free_pixels(pixels, closed))
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    outside = with_plan(labelled, plans, "width", "height").groupBy("plan_id", "label").agg(F.max(edge).alias("_out"))
    return labelled.join(outside, ["plan_id", "label"]).select("plan_id", "x", "y", F.when(F.col("_out"), F.lit(-1).cast("long")).otherwise(F.col("label")).alias("region"))


def pick_limit(shares: DataFrame, enough: float = 0.5) -> DataFrame:
    """Of shares(plan_id, step, limit, share) the first step with `enough` enclosed, else the last."""
    ok = F.when(F.col("share") >= enough, F.col("step"))
    picked = shares.groupBy("plan_id").agg(F.coalesce(F.min(ok), F.max("step")).alias("step"))
    return shares.join(picked, ["plan_id", "step"]).select("plan_id", "step", "limit", "share")


def run_pixels(stretches: DataFrame, axis: str, start: Column, end: Column) -> DataFrame:
    """Pixels (plan_id, x, y) of runs along `axis` with new ends, of those that aren't empty: runs must not meet."""
    line = "y" if axis == "x" else "x"
    found = stretches.select("plan_id", F.col("line").alias(line), start.alias("start"), end.alias("end")).where("start <= end")
    return found.select("plan_id", line, F.explode(F.sequence("start", "end")).alias(axis)).select("plan_id", "x", "y")


def open_mask(mask: DataFrame, plans: DataFrame) -> DataFrame:
    """Erosion of mask(plan_id, x, y) by the full window of 2 k_open + 1, then dilation: (plan_id, x, y).

    Only runs are looked at, not the plan's free pixels: runs of rows lose k_open at both ends; runs of columns that are as long as
    the window stay, as they lose and win k_open; what is left of rows wins k_open at both ends, but where the run before has been.
    Nothing is beyond the border, so that nothing within k_open of it survives. Plans are dealt out once; mask has a pixel once.
    """
    k = F.col("k_open").cast("int")
    of = lambda df, axis: with_plan(runs(df, axis), plans, "k_open")
    narrow = run_pixels(of(spread(mask.select("plan_id", "x", "y"), "plan_id"), "x"), "x", F.col("start") + k, F.col("end") - k)
    tall = run_pixels(of(narrow, "y").where(F.col("len") > 2 * k), "y", F.col("start"), F.col("end"))
    before = F.lag("end").over(Window.partitionBy("plan_id", "line").orderBy("start"))
    return run_pixels(of(tall, "x").withColumn("_e", before), "x", F.greatest(F.col("start") - k, F.col("_e") + k + 1), F.col("end") + k)


def region_state(region: DataFrame, footprint: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, region, state): outside, wall or space, by share in the footprint and by size against gap_max."""
    inside = region.where("region >= 0").join(footprint.select("plan_id", "x", "y", F.lit(1).alias("f")), ["plan_id", "x", "y"], "left")
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) + 1
    s = with_plan(inside.groupBy("plan_id", "region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("f", F.lit(0))).alias("f"), side.alias("side")), plans, "gap_max")
    tiny = (F.col("n") < F.greatest(F.lit(12), 0.25 * F.col("gap_max") * F.col("gap_max"))) | (F.col("n") / F.col("side") <= F.greatest(F.lit(3), 0.3 * F.col("gap_max")))
    return s.select("plan_id", "region", F.when(F.col("f") * 2 < F.col("n"), "outside").when(tiny, "wall").otherwise("space").alias("state"))


def space_contacts(spaces: DataFrame, doors: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, a, b, weight, door): spaces(plan_id, x, y, region) that face each other across 1 to wall_t closed pixels, right and down.

    Each facing pair of pixels adds 1, or 3 if a door pixel lies between.
    """
    found = None
    for axis, line in (("x", "y"), ("y", "x")):
        d = doors.select("plan_id", F.col(axis).alias(axis), F.col(line).alias(line), F.lit(None).cast("long").alias("region"), F.lit(1).alias("door"))
        both = spaces.select("plan_id", axis, line, "region", F.lit(0).alias("door")).unionByName(d.select("plan_id", axis, line, "region", "door"))
        order = Window.partitionBy("plan_id", line).orderBy(axis)
        passed = both.withColumn("_d", F.sum("door").over(order)).where("door = 0")
        nxt = passed.withColumns({"b": F.lead("region").over(order), "to": F.lead(axis).over(order), "_e": F.lead("_d").over(order)})
        gap = F.col("to") - F.col(axis) - 1
        pairs = with_plan(nxt, plans, "wall_t").where(gap.between(1, F.col("wall_t")) & (F.col("region") != F.col("b"))).select("plan_id", F.least("region", "b").alias("a"), F.greatest("region", "b").alias("b"), (F.col("_e") > F.col("_d")).alias("door"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("plan_id", "a", "b").agg(F.sum(F.when(F.col("door"), 3).otherwise(1)).alias("weight"), F.max("door").alias("door"))


def absorb_pass(pixels: DataFrame, spaces: DataFrame, plans: DataFrame) -> DataFrame:
    """One pass: closed pixels with one space on both sides, across or else down, the closed stretch wall_t at most, join it."""
    df = with_plan(pixels.select("plan_id", "x", "y").join(spaces.select("plan_id", "x", "y", "region"), ["plan_id", "x", "y"], "left"), plans, "wall_t")
    for axis, line in (("x", "y"), ("y", "x")):
        before = Window.partitionBy("plan_id", line).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy("plan_id", line).orderBy(axis).rowsBetween(0, Window.unboundedFollowing)
        at = F.when(F.col("region").isNotNull(), F.col(axis))
        df = df.withColumns({"_l": F.last("region", True).over(before), "_r": F.first("region", True).over(after), "_a": F.last(at, True).over(before), "_b": F.first(at, True).over(after)})
        df = df.withColumn(f"_{axis}", F.when((F.col("_l") == F.col("_r")) & (F.col("_b") - F.col("_a") - 1 <= F.col("wall_t")), F.col("_l"))).drop("_l", "_r", "_a", "_b")
    return df.select("plan_id", "x", "y", F.coalesce("region", "_x", "_y").alias("region")).where("region is not null")


def absorb_partitions(pixels: DataFrame, spaces: DataFrame, plans: DataFrame, passes: int = 3) -> DataFrame:
    """`passes` passes, each over what the one before has joined, which is written between them."""
    for _ in range(passes):
        spaces = kept(absorb_pass(pixels, spaces, plans), "absorbed")
    return spaces


def classify_spaces(spaces: DataFrame, contacts: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, region, n, doors, kind): room or walkway, by area against the plan's min_room, share of its footprint (`foot`, in pixels)
    and how much of its box a space fills; doors counts the spaces that contacts(plan_id, a, b, door) lead to through a door."""
    s = component_stats(spaces.withColumnRenamed("region", "label")).withColumnRenamed("label", "region")
    ends = F.explode(F.array("a", "b")).alias("region")
    doors = contacts.where("door").select("plan_id", ends).groupBy("plan_id", "region").agg(F.count(F.lit(1)).alias("doors"))
    largest = s.groupBy("plan_id").agg(F.max_by("region", F.struct("n", -F.col("region"))).alias("largest"))
    s = with_plan(s.join(largest, "plan_id").join(doors, ["plan_id", "region"], "left"), plans, "min_room", "foot")
    solid = F.col("n") / ((F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1))
    share = F.col("n") / F.col("foot")
    other = (F.col("n") < 0.35 * F.col("min_room")) | (share > 0.6) | ((solid < 0.45) & (share >= 0.01)) | ((F.col("region") == F.col("largest")) & (share >= 0.2))
    return s.select("plan_id", "region", "n", F.coalesce("doors", F.lit(0)).cast("long").alias("doors"), F.when(other, "walkway").otherwise("room").alias("kind"))


def label_points(labelled: DataFrame) -> DataFrame:
    """(plan_id, label, x, y): middle of the longest horizontal run of each component of (plan_id, x, y, label), the first one if several
    are. The best run of a component is a maximum, added up in tasks."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("plan_id", "label", "y").orderBy("x"))
    got = labelled.withColumn("_i", island).groupBy("plan_id", "label", "y", "_i").agg(F.min("x").alias("start"), F.max("x").alias("end"))
    best = got.groupBy("plan_id", "label").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("len"), (-F.col("y")).alias("up"), (-F.col("start")).alias("left"))).alias("b"))
    return best.select("plan_id", "label", ((F.col("b.len") + 1) / 2 - F.col("b.left")).alias("x"), (0.5 - F.col("b.up")).alias("y"))


def pockets(patches: DataFrame, strokes: DataFrame, spaces: DataFrame, seals: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, patch, space, state, owner) of patches(plan_id, x, y, label), free pixels joined by sides.

    space: that of a patch's first pixel. state: floor, the largest patch of its space; pocket or door, one that a stroke cluster
    (strokes: plan_id, x, y, label, joined by corners too) owns, a door if it touches a seal; else null. The owner is the cluster that
    most of its pixels touch by sides, the first met on a tie, among those whose box, two pixels wider, holds it. Pixels on the
    border of the plan touch nothing.
    """
    boxes = lambda df, p: component_stats(df).select("plan_id", F.col("label").alias(p), F.col("n").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    mine = patches.select("plan_id", "x", "y", F.col("label").alias("patch"))
    first = (F.col("patch") % 65536 == F.col("x")) & (F.floor(F.col("patch") / 65536) == F.col("y"))
    whose = mine.where(first).join(spaces.select("plan_id", "x", "y", F.col("region").alias("space")), ["plan_id", "x", "y"], "left").select("plan_id", "patch", "space")
    every = boxes(patches, "patch").join(whose, ["plan_id", "patch"])
    floors = every.groupBy("plan_id", "space").agg(F.max_by("patch", F.struct("patch_n", -F.col("patch"))).alias("floor"))

    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("x") + a).alias("nx"), (F.col("y") + b).alias("ny")) for k, (a, b) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))])).alias("s")
    next_ = within(mine, plans, 1).select("plan_id", "patch", "x", "y", sides).select("plan_id", "patch", ((F.col("y") * 65536 + F.col("x")).cast("long") * 4 + F.col("s.k")).alias("turn"), F.col("s.nx").alias("x"), F.col("s.ny").alias("y"))
    at_door = next_.join(seals.select("plan_id", "x", "y"), ["plan_id", "x", "y"], "left_semi").select("plan_id", "patch").distinct().withColumn("at_door", F.lit(True))
    votes = next_.join(strokes.select("plan_id", "x", "y", F.col("label").alias("owner")), ["plan_id", "x", "y"]).groupBy("plan_id", "patch", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("turn"))
    votes = votes.join(every, ["plan_id", "patch"]).join(boxes(strokes, "owner"), ["plan_id", "owner"])
    holds = (F.col("owner_min_x") - 2 <= F.col("patch_min_x")) & (F.col("owner_min_y") - 2 <= F.col("patch_min_y")) & (F.col("owner_max_x") + 2 >= F.col("patch_max_x")) & (F.col("owner_max_y") + 2 >= F.col("patch_max_y"))
    owners = votes.where(holds).groupBy("plan_id", "patch").agg(F.max_by("owner", F.struct("n", -F.col("turn"))).alias("owner"))
    floors = floors.select(F.col("plan_id").alias("f_plan"), F.col("space").alias("f_space"), "floor")
    got = every.join(floors, (F.col("plan_id") == F.col("f_plan")) & F.col("space").eqNullSafe(F.col("f_space"))).select("plan_id", "patch", "space", "floor")
    got = got.join(owners, ["plan_id", "patch"], "left").join(at_door, ["plan_id", "patch"], "left")
    is_floor = F.col("patch") == F.col("floor")
    state = F.when(is_floor, "floor").when(F.col("owner").isNotNull(), F.when(F.coalesce("at_door", F.lit(False)), "door").otherwise("pocket"))
    return got.select("plan_id", "patch", "space", state.alias("state"), F.when(~is_floor, F.col("owner")).alias("owner"))


def pen_width(strokes: DataFrame) -> DataFrame:
    """(plan_id, label, width, most): upper median and maximum, by cluster, of the shorter run through each pixel."""
    thin = run_lengths(strokes).withColumn("t", F.least("len_x", "len_y"))
    got = thin.groupBy("plan_id", "label").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return got.select("plan_id", "label", F.element_at("ts", (F.floor(F.size("ts") / 2) + 1).cast("int")).alias("width"), F.element_at("ts", -1).alias("most"))


def trimmed_box(mask: DataFrame, share: float = 0.3) -> DataFrame:
    """(plan_id, label, x0, y0, x1, y1): a component's box without outer rows and columns that are less than `share` as full as the fullest."""
    out = None
    for axis in ("x", "y"):
        n = mask.groupBy("plan_id", "label", axis).agg(F.count(F.lit(1)).alias("n"))
        full = n.withColumn("m", F.max("n").over(Window.partitionBy("plan_id", "label"))).where(F.col("n") >= F.col("m") * share)
        side = full.groupBy("plan_id", "label").agg(F.min(axis).alias(f"{axis}0"), F.max(axis).alias(f"{axis}1"))
        out = side if out is None else out.join(side, ["plan_id", "label"])
    return out


# Least radius of a corner where all four have it, and where not; pixels from which a part is large; agreement that a small
# and a large part must reach to be a box.
ALL_ROUND, ONE_ROUND, LARGE, SMALL_AGREES, LARGE_AGREES = 1.5, 2.5, 60, 0.84, 0.9


def cut_off(radius: Column, line: Column) -> Column:
    """How many pixels of a line of a box, `line` lines away from a corner, have their middle outside the corner's arc."""
    away = radius - line - 0.5
    before = radius - F.sqrt(F.greatest(radius * radius - away * away, F.lit(0.0)))
    return F.when(away > 0, F.ceil(F.greatest(before - 0.5, F.lit(0.0)))).otherwise(F.lit(0).cast("long"))


def rounded_boxes(labelled: DataFrame) -> DataFrame:
    """(plan_id, label, x0, y0, x1, y1, n, radii, agree, fits): the box of trimmed_box with round corners, for each part of labelled(plan_id, label, x, y).

    x1 and y1 are its last pixels. radii (from the top left, clockwise on screen): the corner that a radius cuts off is as large as what the part lacks in
    that quarter of the box; small ones are 0. agree: pixels that part and box share, of all that either has. Counts by part only; no part is held whole.
    """
    part = ["plan_id", "label"]
    wide, high = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    met = labelled.select(*part, "x", "y").join(trimmed_box(labelled), part)
    # Steps from each corner's own pixel into the box, below 0 outside it.
    across, down = (F.col("x") - F.col("x0"), F.col("x1") - F.col("x")), (F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    corners = [(across[0], down[0]), (across[1], down[0]), (across[1], down[1]), (across[0], down[1])]
    half = lambda side: F.greatest(F.floor(side / 2), F.lit(1))
    quarter = [F.count_if(i.between(0, half(wide) - 1) & j.between(0, half(high) - 1)) for i, j in corners]
    counted = met.groupBy(*part, "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n"), F.array(*quarter).alias("filled"))
    radius = lambda filled: F.least(F.sqrt((half(wide) * half(high) - filled) / (1 - math.pi / 4)), F.least(wide, high) / 2)
    drawn = counted.withColumn("radii", F.transform("filled", radius)).drop("filled")
    least = F.when(F.array_min("radii") >= ALL_ROUND, ALL_ROUND).otherwise(ONE_ROUND)
    drawn = drawn.withColumn("least", least).withColumn("radii", F.transform("radii", lambda r: F.when(r >= F.col("least"), r).otherwise(0.0))).drop("least")

    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    for k, (i, j) in enumerate(corners):
        inside &= i >= cut_off(F.col("radii")[k], j)
    shared = labelled.select(*part, "x", "y").join(drawn, part).groupBy(*part).agg(F.count_if(inside).alias("shared"))
    lines = lambda r: F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(r)), lambda j: cut_off(r, j))
    lost = F.aggregate(F.flatten(F.transform("radii", lines)), F.lit(0).cast("long"), lambda a, c: a + c)
    agree = F.col("shared") / (F.col("n") + wide * high - lost - F.col("shared"))
    fits = F.col("agree") >= F.when(F.col("n") >= LARGE, LARGE_AGREES).otherwise(SMALL_AGREES)
    return drawn.join(shared, part).withColumn("agree", agree).withColumn("fits", fits).drop("shared")
