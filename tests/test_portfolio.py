"""What a whole portfolio costs: few files for many texts, raised walls worked out once."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from indoorspark.operators import export as E
from indoorspark.operators import package as K
from indoorspark.operators import ring_jobs as J
from indoorspark.operators.shapes import shapes
from indoorspark.plans import io
from indoorspark.plans.features import buildings
from indoorspark.plans.helpers import walls
from indoorspark.plans.matching import exported
from indoorspark.sources import projects as S
from indoorspark.sources.scratch import kept, scratch

DIR = "/root/testdata/sf0.001"
files = lambda path: [f for f in glob.glob(f"{path.removeprefix('file://')}/**", recursive=True) if f.endswith((".txt", ".parquet"))]


def test_projects_share_files(spark, monkeypatch):
    path = scratch(spark, "projects")
    monkeypatch.setattr(io, "scratch", lambda *_: path)
    got = io.round_trip(spark, DIR)
    texts = [r[0] for r in spark.read.text(path).collect()]
    assert len(files(path)) < len(texts) == got.count() == buildings(spark, DIR).count()
    alone = scratch(spark, "alone")  # a project a file, over several lines, is read as well
    some = [json.loads(t) for t in texts[:3]]
    for p in some:
        spark.createDataFrame([(json.dumps(p, indent=1),)], "value string").coalesce(1).write.text(f"{alone}/{p['id']}")
    few = S.read_projects(spark, alone, "*.txt")
    assert few.count() == 3 and few.exceptAll(got).count() == 0


def test_packages_share_files(spark):
    path, out = scratch(spark, "packages"), scratch(spark, "unpacked")
    every = kept(exported(spark, DIR).where("building_id < '00000000-0000-4000-a000-00000001e000'"), "some-features")
    S.write_packages(E.feature_json(E.properties(every)), K.package_files(every, every.select("building_id")), path)
    texts = {(r["building_id"], r["file"]): r["value"] for r in S.read_written(spark, path).collect()}
    assert 4 < len(files(path)) + 4 < len(texts)
    one = min(texts)[0]
    S.unpack(spark.read.parquet(path).where(F.col("building_id") == one), out, "building_id", "file")
    assert len(files(out)) == sum(b == one for b, _ in texts)
    for r in spark.read.text(out, wholetext=True).collect():
        assert r["value"] == texts[r["building_id"], r["file"]] and json.loads(r["value"])["type"] == "FeatureCollection"


@pytest.mark.parametrize("drawn", ("walls", "export"))
def test_walls_are_raised_once(spark, drawn):
    if drawn == "walls":
        got = E.wall_units(*walls(spark, DIR))
    else:
        b, rows = buildings(spark, DIR), kept(shapes(spark, DIR), "test-shapes")
        from indoorspark.operators import geo as G

        got = E.unit_tiers(b, rows, G.building_scale(b, G.building_extent(b, rows)))["wall"]
    assert "MapInPandas" not in got._jdf.queryExecution().toString()  # what is read is the written table
    assert got.count() > 1000


def test_only_raised_levels_are_split(spark):
    b, rows = buildings(spark, DIR), shapes(spark, DIR)
    found = J.raised_levels(rows, b)
    raised = {r[0] for r in b.where("effect3d").select("building_id").collect()}
    assert {r[0] for r in found.select("building_id").distinct().collect()} <= raised
    assert found.count() == rows.where(F.col("building_id").isin(*raised) & F.col("level_id").isNotNull()).count()
