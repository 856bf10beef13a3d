"""Orders of more than 16 lines, whose shapes go on into the ids of the next order's: each query against its SQL over such tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
EXACT = (
    "J1_attach_place_ids", "J2_drop_decor", "J5_delete_by_id", "J7_uncovered", "P16_close_open_ring", "G2_ring_bounds", "U2_package_files", "U3_correlation_union", "E15_correlations",
)
#: Their SQL orders points by corner alone, so where two shapes share an id DuckDB itself gives one value or another.
OPEN = ("P14_display_point", "G1_ring_area", "G4_ring_centroid")
IDS = "'00000000-0000-4002-a000-' || printf('%012x', (l_orderkey * 16 + seq) * 4096)"


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """(folder, DuckDB over it, shared ids). Order 2 has two new rooms, the second of which has its middle in the first."""
    folder = tmp_path_factory.mktemp("planted")
    lines = f"SELECT l_orderkey // 8 * 8 + l_orderkey % 2 AS l_orderkey, * EXCLUDE (l_orderkey) FROM '{DIR}/lineitem.parquet'"
    room = "SELECT 2 AS l_orderkey, * REPLACE ({}::BIGINT AS l_partkey, {}::INTEGER AS l_linenumber, {}::DOUBLE AS l_quantity, 1::BIGINT AS l_suppkey) FROM (SELECT * EXCLUDE (l_orderkey) FROM '" + DIR + "/lineitem.parquet' LIMIT 1)"
    con = duckdb.connect()
    con.sql(f"COPY ({lines} UNION ALL BY NAME {room.format(59, 1, 19)} UNION ALL BY NAME {room.format(3, 2, 1)}) TO '{folder}/lineitem.parquet'")
    for t in ("customer", "orders", "events", "embeddings"):
        con.sql(f"COPY (SELECT * FROM '{DIR}/{t}.parquet') TO '{folder}/{t}.parquet'")
    for t in ("customer", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    numbered = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq FROM lineitem"
    shared = {r[0] for r in con.sql(f"SELECT {IDS} AS id FROM ({numbered}) GROUP BY 1 HAVING COUNT(*) > 1").fetchall()}
    assert len(shared) > 20
    return str(folder), con, shared


def rows(table):
    names = sorted(table.column_names)
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return Counter(tuple(value(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", EXACT)
def test_shared_ids_as_in_sql(spark, planted, name):
    folder, con, _ = planted
    assert rows(entry.queries()[name](spark, folder).toArrow()) == rows(con.sql(entry.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("name", OPEN)
def test_shared_ids_are_one_shape(spark, planted, name):
    folder, con, shared = planted
    got, want = entry.queries()[name](spark, folder).toArrow().to_pylist(), con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pylist()
    assert sorted(r["shape_id"] for r in got) == sorted(r["shape_id"] for r in want)
    told = lambda found: {r["shape_id"]: tuple(round(v, 6) for k, v in sorted(r.items()) if k != "shape_id") for r in found if r["shape_id"] not in shared}
    assert told(got) == told(want)
