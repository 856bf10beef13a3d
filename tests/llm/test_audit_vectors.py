"""Divergence audit, near vectors and clusters: against SQL on the given tables, plain versions on hand-made ones, and edge rows."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from indoorspark.llm import clusters, divergence, near_vectors
from indoorspark.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
DOCS = "text string, lang string, source string"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_divergence", "op12_near_vectors", "op13_clusters"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DIR, t)}.parquet'")
    got, want = QUERIES[name](spark, DIR).toArrow(), con.sql(SQL[name]).to_arrow_table()
    rows = lambda t: sorted(tuple(str(r[c]) for c in sorted(t.column_names)) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want) and len(got)


def plain_audit(rows, least, top):
    count, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in low).split(" ")
        words = [w for w in words if w]
        for w in words:
            count[(*g, w)] = count.get((*g, w), 0) + 1
        for w in set(words):
            docs[(g[0], w)] = docs.get((g[0], w), 0) + 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]
        c = {s: {w: count.get((lang, s, w), 0) for w in kept} for s in sources}
        p = {s: {w: 1 + 10**9 * (c[s][w] + 5) // (sum(c[s].values()) + 5 * len(kept)) for w in kept} for s in sources}
        total = {w: sum(c[s][w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (total[w] + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if c[s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms)}
    return out


def audited(df, **how):
    got = [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_audit_is_plain_audit(spark, monkeypatch):
    r = random.Random(5)
    pool = ["Äpfel", "äpfel", "abc", "ABC", "zoo", "élan", "日本", "x", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(6)]]
    rows = [(" ".join(r.choices(pool, k=r.randrange(40))) + r.choice(["", " 12_3", "\x00a\x7fb"]), r.choice(["en", "de", None]), r.choice(["s", "t", "u", None])) for _ in range(300)]
    rows += [(None, "en", "s"), ("", "fr", "only"), ("word " * 5_000, "en", "t"), *[("abc zoo", "en", "hot")] * 200]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("n", "w", "term", "chunk", "value", "total", "p0", "docs")})
    want = plain_audit(rows, 3, 7)
    assert audited(df, least_docs=3, top=7) == want
    monkeypatch.setattr(divergence, "SOURCES", 2)  # several tiles of sources and blocks of terms
    monkeypatch.setattr(divergence, "TERMS", 10)
    assert audited(df, least_docs=3, top=7, rows_each=5) == want  # many chunks, merged twice
    assert divergence.audit(df.limit(0)).count() == 0
    assert {r[4] for r in audited(df.where("lang = 'en'"), least_docs=10_000)} == {0}


def test_skyband_keeps_what_fewer_than_k_dominate():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (700, 1), (1500, 4), (1300, 50)):
        a, b, rank = r.integers(0, 40, n), r.integers(0, 40, n), r.permutation(n)
        order = np.lexsort((rank, b, -a))
        a, b, rank = a[order], b[order], rank[order]
        beaten = ((a[None] >= a[:, None]) & (b[None] <= b[:, None]) & (rank[None] < rank[:, None])).sum(1)
        assert (divergence.in_band(a, b, rank, k) == (beaten < k)).all()


def test_probabilities_are_exact_for_large_counts(spark):
    n, total, kinds = 3 * 10**13 + 7, 9 * 10**15 + 1, 10**7
    df = spark.createDataFrame([(n, total, kinds)], "n long, total long, kinds long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("kinds"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kinds)


def brute_links(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        low = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((vec, len(near[i]), low, vec == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [2_048, 16])
def test_near_vectors_are_brute_links(spark, chunk):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 32))
    chain = np.cumsum(r.standard_normal((20, 32)) * 0.12, axis=0) + base[0]  # near one another only step by step
    parts = [*chain, *[b + r.standard_normal(32) * 0.08 for b in base for _ in range(9)], *[base[3]] * 40, base[3] * 2, base[3] * 1e30, *r.standard_normal((60, 32))]
    rows = [(1000 - i, [float(np.float32(x)) for x in v], int(i % 2) if i < 150 else 0) for i, v in enumerate(parts)]
    f = rows[0][1]
    rows += [(None, f, 0), (None, f, 0), (7, f, 0), (7, f, 0), (1, None, 0), (2, [], 0), (3, [0.0] * 32, 0), (4, [None, *f[1:]], 0), (5, [float("nan"), *f[1:]], 0), (6, [float("inf"), *f[1:]], 0), (8, f, None), (9, f[:8], 0), (10, f[:8], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("cid", "rep", "unit", "chunk", "root", "links", "side")})
    got = sorted((tuple(x) for x in near_vectors.near_vectors(df, chunk=chunk).collect()), key=str)
    assert got == brute_links(rows)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_counts_keep_links_at_the_threshold():
    half, reach, least = near_vectors.plan()
    r = np.random.default_rng(11)
    a = r.standard_normal((4_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = r.standard_normal(a.shape)
    off -= (off * a).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    d = np.abs((a - b) @ near_vectors.directions(64))
    kept = (d[:, 0] <= reach) & ((d[:, 1:] <= half).sum(1) >= least)
    assert kept.mean() > 0.998
    far = np.abs((a - a[::-1]) @ near_vectors.directions(64))
    assert ((far[:, 1:] <= half).sum(1) >= least).mean() < 0.001


def test_least_reachable():
    r = random.Random(2)
    for n, m in ((1, 0), (50, 40), (300, 200)):
        a, b = (np.array([r.randrange(n) for _ in range(m)], np.int64) for _ in "ab")
        root = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                root[x] = root[y] = min(root[x], root[y])
        assert near_vectors.least_reachable(n, a, b).tolist() == root


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [max(-(2**27), min(2**27, math.floor(256 * x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and None not in v and all(map(math.isfinite, v))]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for step in range(rounds + 1):
        got = [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for n in range(len(cents)):
                mine = [v for (_, v), (_, c) in zip(kept, got) if c == n]
                cents[n] = [sum(x) // len(mine) for x in zip(*mine)] if mine else cents[n]
    by = {n: sum(d for d, c in got if c == n) for n in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, by[c], sum(by.values()), sha[c]) for (i, _), (d, c) in zip(kept, got)), key=str)


def test_clusters_are_plain_clusters(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in r.integers(-3, 4, 8) / 8], 0) for i in range(300)]
    f = rows[0][1]
    rows += [(900, None, 0), (901, [], 0), (902, f[:7], 0), (903, [None, *f[1:]], 0), (904, [float("nan"), *f[1:]], 0), (905, [float("-inf"), *f[1:]], 0), (None, f, 0), (0, f, None), (0, f, None), (906, [3e38, *f[1:]], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("v", "h", "cluster", "n", "total", "distance")})
    for k in (1, 9, 40):
        assert sorted((tuple(x) for x in clusters.cluster(df, k, 3, 8).collect()), key=str) == plain_clusters(rows, k, 3, 8)
    assert clusters.cluster(df.limit(0)).count() == 0
    few = df.where("vec_id in (1, 2)")
    assert sorted((tuple(x) for x in clusters.cluster(few, 9, 2, 8).collect()), key=str) == plain_clusters(rows[1:3], 9, 2, 8)


def test_tree_finds_the_least_number_of_the_nearest():
    r = np.random.default_rng(4)
    for k in (1, 2, 5, 40, 200):
        c = r.integers(-4, 5, (k, 6)).astype(np.int64)  # many ties and equal centroids
        x = r.integers(-5, 6, (500, 6)).astype(np.int64)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        who, best = clusters.Tree(c).nearest(x)
        assert (best == d.min(1)).all() and (who == d.argmin(1)).all()


def test_tree_opens_few_nodes():
    """Of tight clusters, most subtrees are never opened."""
    r = np.random.default_rng(6)
    c = r.integers(-10_000, 10_000, (256, 16)).astype(np.int64)
    tree, asked = clusters.Tree(c), []
    plain = clusters.apart
    clusters.apart = lambda x, y: asked.append(len(x)) or plain(x, y)
    try:
        tree.nearest(c.repeat(20, axis=0) + r.integers(-5, 6, (256 * 20, 16)))
    finally:
        clusters.apart = plain
    assert sum(asked) < 0.8 * 256 * 256 * 20
