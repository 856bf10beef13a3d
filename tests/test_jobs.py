"""Jobs that SQL can't follow: raised walls, doors in order, plans of two sizes, writers, empty tables, nulls and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from indoorspark.fixtures import view
from indoorspark.operators import export as E
from indoorspark.operators import package as K
from indoorspark.operators import projects as P
from indoorspark.operators import raster as X
from indoorspark.operators import reconcile as C
from indoorspark.operators import ring_jobs as J
from indoorspark.operators.shapes import shapes
from indoorspark.plans.features import buildings
from indoorspark.sources import projects as S
from indoorspark.sources.scratch import scratch

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exported(spark):
    few = F.substring("building_id", -6, 6) < "00f000"
    b, rows, levels = buildings(spark, DIR).where(few), shapes(spark, DIR).where(few), P.level_defaults(view(spark, DIR, "fx_level")).where(few)
    return E.package(b, levels, rows).cache()


def test_export_order_and_ids(exported):
    rows = [r.asDict() for r in exported.select("building_id", "file", "paint", "tier", "feature_id", "level_id", "seq", "piece", "label").collect()]
    units = [r for r in rows if r["file"] == "unit.geojson"]
    assert len({r["feature_id"] for r in units}) == len(units) and {r["tier"] for r in units} == set(range(6))
    files = {}
    for r in sorted(rows, key=lambda r: r["paint"]):
        files.setdefault((r["building_id"], r["file"]), []).append(r)
    for found in files.values():
        assert [r["paint"] for r in found] == list(range(1, len(found) + 1))
        assert [r["tier"] for r in found] == sorted(r["tier"] for r in found)
    walls = {}
    for r in units:
        if r["tier"] == 5:
            walls.setdefault(r["level_id"], []).append(r)
    assert walls and all([r["seq"] for r in sorted(w, key=lambda r: r["paint"])] == sorted(r["seq"] for r in w) for w in walls.values())


def test_validator_finds_each_planted_fault_once(exported):
    features = E.properties(exported).withColumn("n_rings", F.size("rings"))
    sound = features.where("(feature_type <> 'unit' or level_id is not null) and coalesce(n_rings, 1) = 1")
    assert K.validate(sound).count() == 0
    put = lambda df, k, v: df.withColumn("properties", F.map_concat(F.map_filter("properties", lambda n, _: n != k), F.create_map(F.lit(k), F.lit(v))))
    one = lambda kind: sound.where(F.col("feature_type") == kind).limit(1)
    plant = {
        "geometry": one("building").withColumn("n_rings", F.lit(1)), "ordinal": put(one("level"), "ordinal", "1.5"), "outdoor": put(one("level"), "outdoor", "true"), "building_ids": put(one("level"), "building_ids", "[]"),
        "level_id": put(one("unit"), "level_id", "null"), "holes": one("unit").withColumn("n_rings", F.lit(2)), "property": put(one("section"), "colour", "1"), "label": put(one("unit"), "name", '"x"'), "file": one("unit").withColumn("file", F.lit("kiosk.geojson")),
    }
    for problem, df in plant.items():
        assert [r["problem"] for r in K.validate(df).collect()] == [problem], problem


def test_packages_are_json_in_order(spark, exported):
    import json

    path = scratch(spark, "packages")
    S.write_packages(E.feature_json(E.properties(exported)), exported.select("building_id", "file").distinct(), path)
    want = {}
    for r in exported.select("building_id", "file", "feature_id").orderBy("paint").collect():
        want.setdefault((r[0], r[1]), []).append(r[2])
    got = {(r["building_id"], r["file"]): json.loads(r["value"]) for r in S.read_written(spark, path).collect()}
    assert {k: [f["id"] for f in v["features"]] for k, v in got.items()} == want
    level = next(v for (_, file), v in got.items() if file == "level.geojson")["features"][0]["properties"]
    assert level["outdoor"] is False and isinstance(level["ordinal"], int) and set(level["name"]) == {"en"} and level["building_ids"]


def test_accepted_doors_equal_the_ordered_rule(spark):
    rnd = np.random.RandomState(4)
    rows = [(f"b{rnd.randint(2)}", i, *map(float, p := rnd.randint(0, 900, 2)), float(p[0] + rnd.choice([0, 20, 700])), float(p[1] + 30)) for i in range(60)]
    old = [(f"b{rnd.randint(2)}", *map(float, p := rnd.randint(0, 900, 2)), float(p[0] + 10), float(p[1])) for _ in range(8)]
    doors, openings = spark.createDataFrame(rows, "building_id string, seq int, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(old, "building_id string, x1 double, y1 double, x2 double, y2 double")
    mid = lambda r: (np.array(r[-4:-2]) + np.array(r[-2:])) / 2
    taken, want = [(r[0], mid(r)) for r in old], set()
    for r in rows:
        reach = np.hypot(r[4] - r[2], r[5] - r[3]) / 2
        if all(b != r[0] or np.hypot(*(mid(r) - m)) >= reach for b, m in taken):
            taken.append((r[0], mid(r)))
            want.add(r[1])
    assert {r["seq"] for r in C.accepted_doors(doors, openings).collect()} == want
    assert C.accepted_doors(doors.limit(0), openings).count() == 0 and C.accepted_doors(doors, openings.limit(0)).count() > 0


def test_first_doors_of_chains_equal_the_ordered_rule(spark):
    rnd = np.random.RandomState(5)
    rows = [(i % 3, i, float(x := rnd.randint(0, 400)), 0.0, float(x + rnd.choice([0, 40, 90, 900])), 0.0) for i in range(90)] + [(None, 1, 0.0, 0.0, 40.0, 0.0), (None, 2, 0.0, 0.0, 40.0, 0.0)]
    doors = spark.createDataFrame(rows, "plan_id long, seq int, x1 double, y1 double, x2 double, y2 double")
    stay, want = [], set()
    for plan, seq, x1, _, x2, _ in rows:
        if plan is None or all(p != plan or abs((x1 + x2) / 2 - m) >= (x2 - x1) / 2 for p, m in stay):
            stay.append((plan, (x1 + x2) / 2))
            want.add((plan, seq))
    got = J.dedupe_doors(doors)
    assert got.columns == doors.columns and {(r["plan_id"], r["seq"]) for r in got.collect()} == want and len(want) < 60
    assert J.dedupe_doors(doors.limit(0)).count() == 0


def test_walkways_and_rooms_of_two_plans(spark):
    ring = [(x, y) for x in range(12) for y in range(10) if not (3 <= x <= 8 and 3 <= y <= 6)]
    rows = [(1, x, y, 7) for x, y in ring] + [(2, x, y, 9) for x in range(1, 6) for y in range(1, 5)]
    spaces = spark.createDataFrame(rows, "plan_id long, x int, y int, region long")
    kinds = spark.createDataFrame([(1, 7, "walkway"), (2, 9, "room")], "plan_id long, region long, kind string")
    plans = spark.createDataFrame([(1, 12, 10, 2.0, 4.0), (2, 8, 7, 2.0, 4.0)], "plan_id long, width int, height int, jog_tol double, min_walk double")
    got = {r["plan_id"]: r for r in J.space_polygons(spaces, kinds, plans).withColumn("net", J.net_area(F.col("rings"))).collect()}
    assert got[1]["kind"] == "walkway" and len(got[1]["rings"]) == 2 and got[1]["net"] == 14 * 12 - 4 * 2
    assert got[2]["kind"] == "room" and got[2]["net"] == 7 * 6
    assert J.space_polygons(spaces.limit(0), kinds, plans).count() == 0


def test_raster_stages_on_empty_tables(spark):
    plans = view(spark, DIR, "fx_plan")
    none = spark.createDataFrame([], "plan_id long, x int, y int")
    for df in (X.wall_pixels(none, plans), X.dilate(none, plans), X.regions(none, none, plans), X.open_mask(none, plans), X.gap_blobs(none, plans), X.seal(none, X.gap_blobs(none, plans), plans.select("plan_id", F.lit(2).alias("limit"))), J.plan_loops(none, plans, F.lit(1.0))):
        assert df.count() == 0


def test_export_of_nothing_and_of_repeated_rows(spark):
    b, rows, levels = buildings(spark, DIR), shapes(spark, DIR), P.level_defaults(view(spark, DIR, "fx_level"))
    assert E.package(b.limit(0), levels.limit(0), rows.limit(0)).count() == 0
    alone = E.package(b.limit(3), levels.limit(0), rows.limit(0))
    assert {(r[0], r[1]) for r in alone.groupBy("file").count().collect()} == {("building.geojson", 3), ("footprint.geojson", 3)}
    one = rows.where("kind = 'unit' and form = 'box'").limit(1)
    assert J.expand_holes(one.unionByName(one)).count() == 2
    assert J.ring_spans(one.select("shape_id", F.lit(None).cast(dict(rows.dtypes)["rings"]).alias("rings")), "shape_id").count() == 0


def test_every_query_is_registered():
    assert {"X1_export_features", "E14_validate_export", "R21_space_polygons", "R23_partition_shapes", "R26_fit_shape", "G18_grid_polygons", "E17_add_missing", "J8_accepted_doors"} <= set(entry.queries())


def test_fitted_forms(spark):
    """A square box, a disc, a part with a corner cut out, and a zigzag; two plans, one of real size."""
    y, x = np.mgrid[:200, :300] + 0.5
    big = ((x > 10) & (x < 150) & (y > 10) & (y < 70)) | ((x - 230) ** 2 + (y - 60) ** 2 <= 40**2)
    big |= (x > 10) & (x < 110) & (y > 100) & (y < 180) & ~((x > 60) & (y > 140))
    big |= (np.abs(y - 140 - 2 * np.abs(x % 16 - 8)) < 3) & (x > 160) & (x < 290)  # a zigzag of too few pixels to be more than lettering
    rows = [(1, int(b), int(a)) for a, b in zip(*np.nonzero(big))] + [(2, 3, 4)]
    ink = spark.createDataFrame(rows, "plan_id long, x int, y int")
    plans = spark.createDataFrame([(1, 300, 200), (2, 8, 8), (3, 5, 5)], "plan_id long, width int, height int")
    got = J.fit_shapes(X.components(ink), 0.5, plans, F.lit(1000.0)).collect()
    area = lambda ring: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, [*ring[1:], ring[0]]))) / 2
    found = {(r.plan_id, r.label): (r.form, len(r.ring), area(r.ring)) for r in got}
    assert found[1, 10 * 65536 + 10] == ("box", 4, 141 * 61) and found[2, 4 * 65536 + 3] == ("box", 4, 4)
    assert found[1, 100 * 65536 + 10] == ("polygon", 6, pytest.approx(101 * 81 - 50 * 40))
    (disc,) = [v for k, v in found.items() if v[1] > 20]
    assert disc[0] == "box" and disc[2] == pytest.approx(np.pi * 40.5**2, rel=0.04) and len(found) == 4  # rows of under 0.3 of its width are left out, arcs have 8 steps
    kept = J.fit_shapes(X.components(ink), 0.5, plans, F.lit(1000.0), keep_scraps=True)
    assert {r.form for r in kept.join(spark.createDataFrame(list(found), "plan_id long, label long"), ["plan_id", "label"], "left_anti").collect()} == {"curve"}
    assert J.fit_shapes(X.components(ink.where("false")), 0.5, plans, F.lit(3.0)).count() == 0


def test_opening_of_a_plan_of_real_size_equals_brute_force(spark):
    import numpy as np

    rnd, rows, want = np.random.RandomState(5), [], set()
    for plan, (w, h, k) in enumerate(((900, 600, 3), (61, 83, 0), (240, 200, 7))):
        m = rnd.rand(h, w) < 0.02
        for _ in range(60):  # bars and blocks, also at the border
            x, y = rnd.randint(w), rnd.randint(h)
            m[y : y + rnd.randint(1, 40), x : x + rnd.randint(1, 40)] = True
        whole = np.lib.stride_tricks.sliding_window_view(m, (2 * k + 1, 2 * k + 1)).all(axis=(2, 3))
        opened = np.zeros_like(m)
        for y, x in zip(*np.nonzero(whole)):
            opened[y : y + 2 * k + 1, x : x + 2 * k + 1] = True
        ys, xs = np.nonzero(m)
        rows += [(plan, int(x), int(y)) for x, y in zip(xs, ys)]
        want |= {(plan, int(x), int(y)) for y, x in zip(*np.nonzero(opened))}
    plans = spark.createDataFrame([(0, 900, 600, 3), (1, 61, 83, 0), (2, 240, 200, 7)], "plan_id long, width int, height int, k_open int")
    got = [tuple(r) for r in X.open_mask(spark.createDataFrame(rows, "plan_id long, x int, y int"), plans).collect()]
    assert len(got) == len(want) > 5000 and set(got) == want
