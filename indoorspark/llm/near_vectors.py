"""Embedding near-dedup: collisions of one-dimensional projections counted for each pair, those with enough verified by their cosine."""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indoorspark.llm.common import components, lookup, stored, table

#: Cosine of a link, projections (the first is the one rows are sorted by), share of links that each of the two tests may lose.
COSINE, PROJECTIONS, LOSS, SEED = 0.98, 64, 1e-4, 12
#: Vectors of a chunk, queries held against a chunk at once.
CHUNK, QUERIES = 2_048, 256


@lru_cache(maxsize=8)
def directions(width: int, seed: int = SEED) -> np.ndarray:
    """width x PROJECTIONS normal numbers: the same in every task."""
    return np.random.default_rng([seed, width]).standard_normal((width, PROJECTIONS))


def within(x: float) -> float:
    """Probability that a normal number is within x of 0."""
    return erf(x / sqrt(2))


def plan(cosine: float = COSINE, loss: float = LOSS) -> tuple[float, float, int]:
    """(half window, reach along the sorted projection, least count) for links of this cosine and more.

    Unit vectors of that cosine are r = sqrt(2 - 2 cosine) apart, so a projection's difference is normal with deviation r at most. The
    window's half width is r; a link collides in it with probability 0.68 or more, and its count among the other projections is binomial.
    The reach and the least count each lose a share `loss` of links at the very threshold; closer ones, and copies, less or none.
    """
    r, n = sqrt(max(2 - 2 * cosine, 1e-12)), PROJECTIONS - 1
    p, reach = within(1), 1.0
    while 1 - within(reach) > loss:
        reach += 0.01
    below = np.cumsum([comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
    return r, reach * r, int(np.searchsorted(below, loss))


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least one that it reaches by edges a-b."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


class Side:
    """Distinct vectors of one chunk in the order of the sorted projection."""

    def __init__(self, t: pa.Table, width: int):
        unit = t["unit"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        spots = unit @ directions(width)
        order = np.argsort(spots[:, 0], kind="stable")
        self.unit, self.first, self.rest = unit[order], spots[order, 0], np.ascontiguousarray(spots[order, 1:].T, dtype=np.float32)
        self.copies, self.cid = t["copies"].to_numpy()[order], np.asarray(t["cid"].to_pylist(), object)[order]


def met(a: Side, b: Side, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's rows, of b's rows, and edges that join what hangs together, as positions in a and b laid end to end)."""
    half, reach, least = plan(cosine)
    links_a, links_b = np.zeros(len(a.cid), np.int64), np.zeros(len(b.cid), np.int64)
    edges = []
    for at in range(0, len(a.cid), QUERIES):
        q = slice(at, min(at + QUERIES, len(a.cid)))
        lo, hi = np.searchsorted(b.first, [a.first[q][0] - reach, a.first[q][-1] + reach], side="left")
        lo = max(lo, at + 1) if same else lo
        if lo >= hi:
            continue
        count = np.zeros((q.stop - at, hi - lo), np.uint8)
        for x, y in zip(a.rest[:, q], b.rest[:, lo:hi]):
            count += np.abs(x[:, None] - y[None, :]) <= half
        i, j = np.nonzero((count >= least) & (np.abs(a.first[q][:, None] - b.first[lo:hi][None, :]) <= reach))
        if same:
            i, j = i[keep := at + i < lo + j], j[keep]
        if not len(i):
            continue
        rows, cols = np.unique(i), np.unique(j)
        near = np.zeros(count.shape, bool)
        near[np.ix_(rows, cols)] = a.unit[q][rows] @ b.unit[lo:hi][cols].T >= cosine
        i, j = i[keep := near[i, j]], j[keep]
        np.add.at(links_a, at + i, b.copies[lo + j])
        np.add.at(links_b, lo + j, a.copies[at + i])
        low = least_reachable(count.shape[0] + count.shape[1], i, count.shape[0] + j)
        hung = np.flatnonzero(low != np.arange(len(low)))
        place = np.concatenate([at + np.arange(count.shape[0]), len(a.cid) * (not same) + np.arange(lo, hi)])
        edges.append(np.stack([place[hung], place[low[hung]]]))
    one, two = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    return links_a, links_b, one, two


def near_vectors(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label): links are pairs of one label (not null), of as many
    components, whose cosine in double precision is `cosine` or more.

    Copies of one vector are one class, told by 128 bits of hash, with a count; only classes are compared. Classes of a label are sorted
    along one projection and cut into chunks of about `chunk` rows; chunks within reach of each other meet, a task a pair, and count
    window collisions of all their pairs in small matrices, so that pairs are never rows. A task sends its rows' links and a forest of
    what hangs together. Found links are exact; of links at the threshold at most two in 10,000 are expected lost (`plan`), and none of
    copies of one vector.

    Null, empty or zero vectors and those with null, NaN or infinite components link with nothing; neither do rows without label. Repeated
    rows and ids count as rows each; a null id is kept if it is its component's only one. component_id is the least id that isn't null.
    An empty table gives no rows; other columns are left out.
    """
    e = F.col("embedding")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))
    usable = F.coalesce(F.col("label").isNotNull() & ok & (F.size(e) > 0) & (most > 0), F.lit(False))
    h = lambda *c: F.hex(F.xxhash64(*c))
    rows = vectors.select("vec_id", "label", "embedding", F.when(usable, F.concat(h("label", "embedding"), F.lit("-"), h(F.lit(7), "label", "embedding"))).alias("cid"))
    # scaled by the greatest component first, so that squares neither overflow nor vanish
    scaled = F.transform(F.first("embedding"), lambda x: x.cast("double") / F.array_max(F.transform(F.first("embedding"), lambda y: F.abs(y.cast("double")))))
    classes = rows.where("cid is not null").groupBy("cid", "label").agg(scaled.alias("s"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    classes = classes.select("cid", "label", "rep", "copies", F.size("s").alias("width"), F.transform("s", lambda x: x / norm).alias("unit"))
    classes = stored(classes, "near-classes")

    def placed(batches):
        for b in batches:
            first = np.array([np.asarray(u, float) @ directions(len(u))[:, 0] for u in b["unit"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.float64())], [*b.schema.names, "first"])

    lined = classes.select("cid", "label", "width", "copies", "unit").mapInArrow(placed, f"cid string, label {vectors.schema['label'].dataType.simpleString()}, width int, copies long, unit array<double>, first double")
    lined = lined.repartitionByRange(max(1, -(-classes.count() // chunk)), "label", "width", "first", "cid").withColumn("chunk", F.spark_partition_id())
    lined = stored(lined, "near-lined")
    spans = lined.groupBy("label", "width", "chunk").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    one, two = (spans.select("label", "width", *[F.col(c).alias(c + s) for c in ("chunk", "lo", "hi")]) for s in ("_a", "_b"))
    pairs = one.join(two, ["label", "width"]).where((F.col("chunk_a") <= F.col("chunk_b")) & (F.col("lo_b") - F.col("hi_a") <= plan(cosine)[1])).select("label", "width", "chunk_a", "chunk_b")
    side = lambda s: lined.withColumnRenamed("chunk", f"chunk_{s}").join(pairs, ["label", "width", f"chunk_{s}"]).select("label", "width", "chunk_a", "chunk_b", F.lit(s).alias("side"), "cid", "copies", "unit")

    def compare(t: pa.Table) -> pa.Table:
        width, same = t["width"][0].as_py(), t["chunk_a"][0] == t["chunk_b"][0]
        part = lambda s: Side(t.filter(pc.equal(t["side"], s)), width)
        a = part("a")
        b = a if same else part("b")
        links_a, links_b, x, y = met(a, b, same, cosine)
        cid = a.cid if same else np.concatenate([a.cid, b.cid])
        links = links_a + links_b if same else np.concatenate([links_a, links_b])
        some = np.flatnonzero(links)
        return pa.table({
            "cid": pa.array(np.concatenate([cid[some], cid[x]]), pa.string()), "links": pa.array(np.concatenate([links[some], np.zeros(len(x), np.int64)])),
            "other": pa.array(np.concatenate([np.full(len(some), None, object), cid[y]]), pa.string()),
        })

    both = side("a").unionByName(side("b").where("chunk_a <> chunk_b"))
    found = stored(both.groupBy("label", "width", "chunk_a", "chunk_b").applyInArrow(compare, "cid string, links long, other string"), "near-found")
    roots = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), "near-components")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "rep", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(links, "cid", "left")
    known = stored(known, "near-known")
    whole = stored(known.groupBy("root").agg(F.min("rep").alias("component_id")), "near-whole")
    facts = stored(lookup(known, whole, "root").select("cid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "near-facts")
    linked = lookup(rows.where("cid is not null").select("vec_id", "cid"), facts, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(e AS DOUBLE) for e in embedding] AS e, len(embedding) AS n FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = len(embedding) AND len([e for e in embedding if e <> 0]) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, MIN(b) AS low FROM r GROUP BY 1)
SELECT e.vec_id, (SELECT COUNT(*) FROM p WHERE p.a = e.vec_id) AS n_links, m.low AS component_id, e.vec_id = m.low AS kept FROM embeddings e JOIN m ON e.vec_id = m.a"""
