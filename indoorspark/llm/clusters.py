"""Centroid clustering: rounds of nearest-centroid assignment by a vantage-point tree over the centroids, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from indoorspark.llm.common import stored, table

#: Components of a vector, centroids, rounds, integers a unit; integers are held within REACH so that squares summed fit 64 bits.
WIDTH, CENTROIDS, ROUNDS, UNIT, REACH = 64, 40, 5, 256, 1 << 27
#: Centroids of a leaf, vectors searched at once; distances for pruning are floats, so that bounds are eased by this share.
LEAF, BATCH, EASE = 4, 8192, 1e-9


def integers(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, v): floor(256 x) of the vectors with exactly `width` components, none null, NaN or infinite."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), F.floor(F.lit(float(UNIT)) * x.cast("double")).cast("double"))).cast("int")
    return vectors.select("vec_id", "embedding").where(F.coalesce(F.size(e) == width, F.lit(False))).where(F.forall(e, finite)).select("vec_id", F.transform(e, whole).alias("v"))


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to one centroid c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Tree:
    """Vantage-point tree: a node has one centroid and two children, each with the least and greatest distance of its members to it.

    nodes: (centroid, [(child, least, greatest)]) or, for a leaf, (None, numbers of its centroids).
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.nodes = centroids, []
        self.grow(np.arange(len(centroids)))

    def grow(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((None, members))
        if len(members) > LEAF:
            top, rest = members[0], members[1:]
            d = np.sqrt(apart(self.centroids[rest], self.centroids[top]).astype(float))
            order = np.argsort(d, kind="stable")
            halves = [h for h in np.array_split(order, 2) if len(h)]
            self.nodes[at] = (top, [(self.grow(rest[h]), d[h].min(), d[h].max()) for h in halves])
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid to each row of x, the smaller number at equal distance.

        Best first for each row: it opens the node of least bound until that is beyond its best; equal bounds are opened too. Rows that
        open the same node are worked on together.
        """
        n = len(x)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0

        def seen(rows: np.ndarray, c: int) -> np.ndarray:
            d = apart(x[rows], self.centroids[c])
            nearer = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
            best[rows[nearer]], who[rows[nearer]] = d[nearer], c
            return d

        rows = np.arange(n)
        while len(rows):
            node = bound[rows].argmin(1)
            least = bound[rows, node]
            go = least <= np.sqrt(best[rows].astype(float)) * (1 + EASE)
            rows, node = rows[go], node[go]
            for at in np.unique(node):
                mine = rows[node == at]
                top, below = self.nodes[at]
                if top is None:
                    for c in below:
                        seen(mine, c)
                else:
                    d = np.sqrt(seen(mine, top).astype(float))
                    for child, lo, hi in below:
                        eased = np.maximum(d * (1 - EASE) - hi * (1 + EASE), lo * (1 - EASE) - d * (1 + EASE))
                        bound[mine, child] = np.maximum(bound[mine, at], eased)
                bound[mine, at] = np.inf
        return who, best


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, len(b), BATCH):
            part = b.slice(at, BATCH)
            yield part, part["v"].flatten().to_numpy().astype(np.int64).reshape(-1, width)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: each non-empty one the floor of its vectors' mean. Tasks send a sum for each centroid, not vectors."""
    spark, width = vectors.sparkSession, centroids.shape[1]
    tree = spark.sparkContext.broadcast(Tree(centroids))

    def sums(batches):
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x in matrices(batches, width):
            who, _ = tree.value.nearest(x)
            n += np.bincount(who, minlength=len(n))
            np.add.at(total, who, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    part = vectors.mapInArrow(sums, "cluster long, n long, total array<long>")
    whole = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for r in whole.collect():  # a row a centroid
        out[r[0]] = [s // r[1] for s in r[2:]]
    tree.unpersist()
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors(vec_id, embedding).

    The first centroids are the k kept vectors of least hash of `2:<vec_id>` (equal hashes, of repeated ids, by components; null ids
    last), fewer where there are fewer vectors. Vectors of another length, null ones and those with null, NaN or infinite components
    have no row; components beyond +-2^27 after scaling (x beyond 524288) are held there. Repeated rows are assigned each; an empty table
    gives no rows; other columns are left out. The centroids, at most k rows, are the only data at the driver and the only broadcast.
    """
    spark: SparkSession = vectors.sparkSession
    kept = stored(integers(vectors, width), "cluster-vectors")
    hashed = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    types = StructType().add(kept.schema["vec_id"]).add("cluster", IntegerType()).add("distance", LongType())
    if not first:
        got = spark.createDataFrame([], types)
        centroids = np.zeros((0, width), np.int64)
    else:
        centroids = np.array([r["v"] for r in first], np.int64)
        for _ in range(rounds):
            centroids = moved(kept, centroids)
        tree = spark.sparkContext.broadcast(Tree(centroids))

        def assigned(batches):
            for b, x in matrices(batches, width):
                who, d = tree.value.nearest(x)
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(who.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

        got = stored(kept.mapInArrow(assigned, types), "cluster-assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    of_one = got.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    facts = of_one.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))).join(names, "cluster")  # k rows at most
    return got.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT id, v, arg_min(c, (d, c)) AS c, MIN(d) AS d FROM (SELECT id, x.v, k.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, k.v)]) AS d FROM x CROSS JOIN c{i} k) GROUP BY id, v),
c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{i} k LEFT JOIN (SELECT c, list(s ORDER BY i) AS v FROM (SELECT c, i, CAST((SUM(e) - ((SUM(e) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT) AS s
  FROM (SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) m ON k.c = m.c)"""


SQL = f"""WITH x AS (SELECT row_number() OVER () AS id, vec_id, [CAST(floor({UNIT} * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {WIDTH}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM x ORDER BY sha256('2:' || vec_id), v LIMIT {CENTROIDS}),
{', '.join(_round(i) for i in range(ROUNDS + 1))},
h AS (SELECT c, sha256(list_aggregate([CAST(e AS VARCHAR) for e in v], 'string_agg', ',')) AS sha FROM c{ROUNDS})
SELECT x.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(SUM(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(SUM(a.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM a{ROUNDS} a JOIN x ON a.id = x.id JOIN h ON a.c = h.c"""
