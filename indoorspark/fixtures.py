"""Representative project, level, shape and raster tables, as SQL that Spark and DuckDB run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "fx_building": r"""
SELECT '00000000-0000-4000-a000-' || printf('%012x', c_custkey * 4096 + 1) AS building_id,
       '00000000-0000-4009-a000-' || printf('%012x', c_custkey * 4096 + 1) AS footprint_id,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END              AS name,
       CASE WHEN c_custkey % 10 = 0 THEN '0, 0'
            WHEN c_custkey % 10 = 1 THEN CAST(c_custkey % 80 + 100 AS VARCHAR(20)) || ', ' || CAST(c_custkey % 60 AS VARCHAR(20))
            WHEN c_custkey % 10 = 2 THEN CAST(c_custkey % 60 AS VARCHAR(20))
            ELSE CAST(c_custkey % 120 - 60 AS VARCHAR(20)) || '.5, ' || CAST(c_custkey * 7 % 340 - 170 AS VARCHAR(20)) || '.25' END AS venue_text,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(20 + c_custkey % 80 AS DOUBLE) END AS width_meters,
       CASE WHEN c_custkey % 3 = 0 THEN true ELSE false END                AS has_outline,
       CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 500 ELSE 800 END END AS outline_size,
       c_custkey % 5 = 0                                                   AS effect3d,
       CAST(CASE WHEN c_custkey % 10 = 0 THEN 0.6 ELSE 0 END AS DOUBLE)    AS wall_height,
       CASE WHEN c_custkey % 2 = 0 THEN '10000000-0000-4000-a000-' || printf('%012x', c_custkey) END AS place_id
FROM {customer}""",
    "fx_level": r"""
SELECT '00000000-0000-4001-a000-' || printf('%012x', o_orderkey * 4096 + 1) AS level_id,
       '00000000-0000-4000-a000-' || printf('%012x', o_custkey * 4096 + 1)  AS building_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ordinal,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Floor ' || CAST(o_orderkey AS VARCHAR(20)) END AS name,
       CASE WHEN o_orderkey % 2 = 0 THEN '10000000-0000-4001-a000-' || printf('%012x', o_orderkey) END AS place_id
FROM {orders}""",
    "fx_shape": r"""
WITH s AS (
  SELECT l.*, o_custkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
  FROM {lineitem} l JOIN {orders} ON l_orderkey = o_orderkey)
SELECT '00000000-0000-4002-a000-' || printf('%012x', (l_orderkey * 16 + seq) * 4096)     AS shape_id,
       '00000000-0000-4000-a000-' || printf('%012x', o_custkey * 4096 + 1)  AS building_id,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE '00000000-0000-4001-a000-' || printf('%012x', l_orderkey * 4096 + 1) END AS level_id,
       CAST(seq AS INT) AS seq,
       CASE WHEN l_linenumber <= 3 THEN 'unit' WHEN l_linenumber = 4 THEN 'section'
            WHEN l_linenumber = 5 THEN 'fixture' WHEN l_linenumber = 6 THEN 'amenity' ELSE 'opening' END AS kind,
       CASE WHEN l_linenumber = 5 THEN (CASE l_returnflag WHEN 'R' THEN 'desk' WHEN 'A' THEN 'furniture' ELSE 'wall' END)
            WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 'walkway'
            WHEN l_returnflag = 'R' THEN 'conference' WHEN l_returnflag = 'A' THEN 'room' ELSE NULL END AS category,
       CASE WHEN l_partkey % 4 = 0 THEN 'Room ' || CAST(seq AS VARCHAR(20))
            WHEN l_partkey % 11 = 0 THEN NULL
            WHEN l_partkey % 13 = 0 THEN 'Quote "q", line'
            ELSE 'Space ' || CAST(l_partkey AS VARCHAR(20)) END AS name,
       CASE WHEN l_suppkey % 9 = 0 THEN '10000000-0000-4002-a000-' || printf('%012x', l_orderkey * 16 + seq) END AS place_id,
       CASE WHEN l_linenumber = 4 AND l_suppkey % 4 = 0 THEN false ELSE true END AS outline_only,
       CASE WHEN l_linenumber = 5 THEN CAST(l_partkey % 4 * 90 AS INT) END AS rotation,
       CASE WHEN l_partkey % 7 = 0 THEN 'holed' WHEN l_partkey % 5 = 0 THEN 'ell' ELSE 'box' END AS form,
       CAST((seq - 1) % 4 * 200 + l_partkey % 20 AS INT) AS x0,
       CAST(FLOOR((seq - 1) / 4) * 200 + l_suppkey % 20 AS INT) AS y0,
       CAST(100 + l_quantity AS INT) AS w,
       CAST(80 + l_partkey % 60 AS INT) AS h
FROM s""",
    "fx_vertex": r"""
WITH p AS (
  SELECT shape_id, building_id, kind, form, x0, y0, x0 + w AS x1, y0 + h AS y1,
         CAST(x0 + FLOOR(w / 2.0) AS INT) AS xm, CAST(y0 + FLOOR(h / 2.0) AS INT) AS ym
  FROM fx_shape WHERE kind IN ('unit', 'section', 'fixture'))
SELECT shape_id, building_id, kind, 0 AS ring, 0 AS pt, x0 AS x, y0 AS y FROM p
UNION ALL SELECT shape_id, building_id, kind, 0, 1, x0, y1 FROM p
UNION ALL SELECT shape_id, building_id, kind, 0, 2, x1, y1 FROM p WHERE form <> 'ell'
UNION ALL SELECT shape_id, building_id, kind, 0, 2, xm, y1 FROM p WHERE form = 'ell'
UNION ALL SELECT shape_id, building_id, kind, 0, 3, xm, ym FROM p WHERE form = 'ell'
UNION ALL SELECT shape_id, building_id, kind, 0, 4, x1, ym FROM p WHERE form = 'ell'
UNION ALL SELECT shape_id, building_id, kind, 0, 5, x1, y0 FROM p
UNION ALL SELECT shape_id, building_id, kind, 0, 6, x0, y0 FROM p
UNION ALL SELECT shape_id, building_id, kind, 1, 0, x0 + 20, y0 + 20 FROM p WHERE form = 'holed'
UNION ALL SELECT shape_id, building_id, kind, 1, 1, x0 + 20, y1 - 20 FROM p WHERE form = 'holed'
UNION ALL SELECT shape_id, building_id, kind, 1, 2, x1 - 20, y1 - 20 FROM p WHERE form = 'holed'
UNION ALL SELECT shape_id, building_id, kind, 1, 3, x1 - 20, y0 + 20 FROM p WHERE form = 'holed'
UNION ALL SELECT shape_id, building_id, kind, 1, 4, x0 + 20, y0 + 20 FROM p WHERE form = 'holed'""",
    "fx_line": r"""
SELECT shape_id, building_id, level_id, kind, x0 AS x1, y0 AS y1,
       CASE WHEN w % 2 = 0 THEN x0 + 30 ELSE x0 END AS x2,
       CASE WHEN w % 2 = 0 THEN y0 ELSE y0 + 30 END AS y2
FROM fx_shape WHERE kind = 'opening' OR (kind = 'fixture' AND w % 3 = 0)""",
    "fx_detect": r"""
SELECT level_id, building_id, seq, CAST(x0 + ((h - 80) % 3 - 1) * 60 AS INT) AS x0, y0, w, h
FROM fx_shape
WHERE kind = 'unit' AND level_id IS NOT NULL AND (h - 80) % 4 <> 0""",
    "fx_trace": r"""
SELECT building_id, level_id, 'room' AS kind, seq, CAST(x0 + ((h - 80) % 3 - 1) * 60 + CASE WHEN w % 5 = 0 THEN 110 ELSE 0 END AS INT) AS x0, y0, w, h
FROM fx_shape WHERE kind = 'unit' AND level_id IS NOT NULL AND (h - 80) % 4 <> 0
UNION ALL SELECT building_id, level_id, 'walkway', seq, 0, 900, 800, 60 FROM fx_shape WHERE kind = 'unit' AND level_id IS NOT NULL AND seq <= 2 AND h % 3 = 0
UNION ALL SELECT building_id, level_id, CASE WHEN h % 2 = 0 THEN 'partition' ELSE 'furniture' END, seq, CAST(x0 + w % 4 * 50 AS INT), y0, 40, 30 FROM fx_shape WHERE kind IN ('fixture', 'section') AND level_id IS NOT NULL
UNION ALL SELECT building_id, level_id, 'door', seq, CAST(x0 + w % 3 * 9 AS INT), y0, CASE WHEN w % 2 = 0 THEN 30 ELSE 0 END, CASE WHEN w % 2 = 0 THEN 0 ELSE 30 END
FROM fx_shape WHERE level_id IS NOT NULL AND (kind = 'opening' OR (kind = 'fixture' AND w % 3 = 0))""",
    "fx_saves": r"""
SELECT event_id, user_id AS project_id, event_type AS project_name, ts AS updated_at, value, props FROM {events}""",
    "fx_paste": r"""
SELECT shape_id, CASE WHEN place_id IS NULL THEN '  '
       WHEN w % 5 = 0 THEN upper(place_id) || ' Desk'
       WHEN w % 5 = 1 THEN place_id || ' ' || shape_id
       WHEN w % 5 = 2 THEN 'n/a' ELSE ' ' || place_id || ' ' END AS pasted
FROM fx_shape""",
}
VIEWS["fx_plan"] = r"""
SELECT vec_id AS plan_id, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS width, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 4 END AS height,
       CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 4 END AS l_min, CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 4 END AS dash_max,
       CASE WHEN vec_id % 4 < 2 THEN 2 ELSE 1 END AS gap_max, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS wall_t,
       CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 3 END AS min_room, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS k_open,
       CASE WHEN vec_id % 4 < 2 THEN 4 ELSE 2 END AS gap_wide, CASE WHEN vec_id % 4 < 2 THEN 2 ELSE 1 END AS seal_min, 2 AS seal_depth
FROM {embeddings}"""
#: Taking an array apart needs one spelling for each engine. Plans are 8 x 8 or 16 x 4 pixels.
_PIXEL = r"""
SELECT vec_id AS plan_id, CAST(i % CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS INT) AS x, CAST(FLOOR(i / CASE WHEN vec_id % 2 = 0 THEN 8.0 ELSE 16.0 END) AS INT) AS y,
       g AS r, g AS g, g AS b, CASE WHEN i % 17 = 0 THEN 30 ELSE 255 END AS a"""
PIXELS_SPARK = _PIXEL + r"""
FROM (SELECT vec_id, i, CAST(GREATEST(0, LEAST(255, FLOOR(200 + CAST(v AS DOUBLE) * 800))) AS INT) AS g
      FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS i, v)"""
PIXELS_DUCKDB = _PIXEL + r"""
FROM (SELECT vec_id, i, CAST(GREATEST(0, LEAST(255, FLOOR(200 + CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) * 800))) AS INT) AS g
      FROM {embeddings}, range(64) t(i))"""
NEEDS = {"fx_vertex": ["fx_shape"], "fx_line": ["fx_shape"], "fx_detect": ["fx_shape"], "fx_paste": ["fx_shape"], "fx_trace": ["fx_shape"]}


def _ctes(names: tuple[str, ...], pixels: str, tables: dict[str, str]) -> list[str]:
    order = [*VIEWS, "fx_pixels"]
    wanted = {n for name in names for n in (name, *NEEDS.get(name, []))}
    return [f"{n} AS ({(VIEWS | {'fx_pixels': pixels})[n].format(**tables)})" for n in order if n in wanted]


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the named views as leading CTEs; body is a SELECT, or `WITH ... SELECT`."""
    ctes = _ctes(names, PIXELS_DUCKDB, {t: t for t in BASE})
    body = body.strip()
    more = body[4:].lstrip() if body[:5].upper() == "WITH " else None
    recursive = "RECURSIVE " if more and more[:10].upper() == "RECURSIVE " else ""
    if more is not None:
        return f"WITH {recursive}{', '.join(ctes)}, {more[len(recursive):]}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def view_of_shapes(name: str, shapes: DataFrame) -> DataFrame:
    """A view that needs fx_shape alone, over a table of its rows: its branches don't each work them out."""
    return shapes.sparkSession.sql(VIEWS[name].replace("fx_shape", "{fx_shape}"), fx_shape=shapes)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}
    return spark.sql(f"WITH {', '.join(_ctes((name,), PIXELS_SPARK, tables))} SELECT * FROM {name}")
