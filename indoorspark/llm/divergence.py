"""Source divergence audit: how far each source's words are from its language's and from other sources', by dominance skybands."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indoorspark.llm.common import stored, table

#: Letters of any script; what is not a letter of ASCII ends a term.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of its language a term must be in, count added to each term's, scale of probabilities, ranks kept of terms.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of a group that a task thins out at once, chunks merged at once, terms and sources of a block of the pairs.
ROWS, MERGED, TERMS, SOURCES = 50_000, 8, 4_000, 256


def terms(text: Column) -> Column:
    """All terms of a text in order, only A-Z lower-cased."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, SMALL)), F.lit(TERM), F.lit(0))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; combined in each task before the shuffle."""
    both = F.array(F.struct(F.col("w").alias("w"), F.lit(1).alias("n")), F.struct(F.array_distinct("w").alias("w"), F.lit(0).alias("n")))
    each = docs.select("lang", "source", terms(F.col("text")).alias("w")).select("lang", "source", F.inline(both)).select("lang", "source", F.explode("w").alias("term"), "n")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").cast("long").alias("n"), F.sum(1 - F.col("n")).cast("long").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kinds)), exact in decimals however large the counts are."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, below = (wide(count) + wide(F.lit(ADDED))) * wide(F.lit(SCALE)), wide(total) + wide(F.lit(ADDED)) * wide(kinds)
    return F.call_function("div", top, below) + 1


def in_band(n: np.ndarray, lang_n: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Which rows fewer than k others dominate: n at least as high, lang_n at most as high, rank lower. Rows come by n falling, lang_n, rank.

    A row that k rows dominate is dominated by k rows of the band too, so each block is held against the band found so far and itself.
    """
    out, step = np.zeros(len(n), bool), 512
    kept_n, kept_rank = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(n), step):
        a, r = lang_n[at : at + step], rank[at : at + step]
        before = np.tri(len(a), k=-1, dtype=bool)
        inside = ((a[None, :] <= a[:, None]) & (r[None, :] < r[:, None]) & before).sum(1)
        ok = inside + ((kept_n[None, :] <= a[:, None]) & (kept_rank[None, :] < r[:, None])).sum(1) < k
        out[at : at + step] = ok
        kept_n, kept_rank = np.concatenate([kept_n, a[ok]]), np.concatenate([kept_rank, r[ok]])
    return out


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """rows(lang, source, chunk, term, n, lang_n) without those that k or more of their chunk dominate."""

    def thin(t: pa.Table) -> pa.Table:
        rank = np.empty(len(t), np.int64)
        rank[pc.sort_indices(t["term"]).to_numpy()] = np.arange(len(t))
        n, lang_n = t["n"].to_numpy(), t["lang_n"].to_numpy()
        order = np.lexsort((rank, lang_n, -n))
        return t.take(pa.array(np.sort(order[in_band(n[order], lang_n[order], rank[order], k)])))

    return rows.groupBy("lang", "source", "chunk").applyInArrow(thin, rows.schema)


def candidates(rows: DataFrame, k: int, rows_each: int = ROWS) -> DataFrame:
    """The k-skyband of each group (lang, source) of rows(lang, source, term, n, lang_n): what may be among its first k terms.

    Chunks of a group keep their own skybands, which are merged some at a time; no task holds a whole group's rows.
    """
    size = rows.groupBy("lang", "source").agg(F.ceil(F.count(F.lit(1)) / rows_each).alias("chunks"))
    most = size.agg(F.max("chunks")).first()[0] or 1
    got = rows.join(size, ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).drop("chunks")
    got = skyband(got, k)
    while most > 1:
        most = -(-most // MERGED)
        got = skyband(got.withColumn("chunk", F.floor(F.col("chunk") / MERGED)), k)
    return got.drop("chunk")


def sums_apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): for sources a < b, the sum over rows' terms of |p_a - p_b| less |p0_a - p0_b|, p0 a source's p of a term it lacks.

    rows(lang, source, term, p), groups(lang, source, p0, kinds). Terms go in blocks and sources in tiles, so that a task's matrix has
    a bounded size; each tile meets every tile of its language, as the result has a row for each pair.
    """
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = -(-most // SOURCES)
    blocks = F.ceil(F.col("kinds") / TERMS)
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).alias("tile")
    head = groups.where("kinds > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), tile, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    body = rows.join(groups.select("lang", "source", "kinds"), ["lang", "source"]).select("lang", "source", "term", "p", tile, F.pmod(F.xxhash64("term"), blocks).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("other")
    met = head.unionByName(body).select("*", other).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})

    def apart(g: pd.DataFrame) -> pd.DataFrame:
        heads, rest = g[g["term"].isna()], g[g["term"].notna()]
        names = sorted(set(heads["source"]), key=lambda s: s.encode())
        at, first = {s: i for i, s in enumerate(names)}, heads.drop_duplicates("source").set_index("source")
        p0, tile_of = first["p"].reindex(names).to_numpy(np.int64), first["tile"].reindex(names).to_numpy(np.int64)
        code, kinds = pd.factorize(rest["term"])
        p = np.repeat(p0[:, None], len(kinds), axis=1)
        p[rest["source"].map(at).to_numpy(np.int64), code] = rest["p"].to_numpy(np.int64)
        ta, tb, out = int(g["ta"].iloc[0]), int(g["tb"].iloc[0]), []
        for i in range(len(names)):
            js = np.arange(i + 1, len(names))
            js = js[(np.minimum(tile_of[i], tile_of[js]) == ta) & (np.maximum(tile_of[i], tile_of[js]) == tb)]
            values = np.abs(p[js] - p[i]).sum(1) - len(kinds) * np.abs(p0[js] - p0[i])
            out += [(g["lang"].iloc[0], names[i], names[j], int(v)) for j, v in zip(js, values)]
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    part = met.groupBy("lang", "ta", "tb", "block").applyInPandas(apart, "lang string, a string, b string, value long")
    return part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, rows_each: int = ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source).

    Part `pair` ranks the other sources of a group's language by the sum of |p - q| over the language's kept terms; part `term` ranks the
    kept terms that a group uses more than its language does, up to `top`. Ranks go by value falling, then item in UTF-8 order.

    Nulls in text, lang and source count as ''; empty texts have no terms, but their groups have rows of part `pair` (value 0 where a
    language keeps no term). Repeated rows count each time; whole texts are read however long they are. An empty table gives no rows;
    other columns are left out.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = stored(term_counts(docs), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    rows = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit-rows")
    of_lang = rows.groupBy("lang").agg(F.count_distinct("term").alias("kinds"), F.sum("n").alias("lang_total"))
    of_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "kinds", "lang_total"])
    p0 = F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(0)
    groups = stored(groups.withColumn("p0", p0), "audit-groups")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    scored = candidates(rows, top, rows_each).join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    of_terms = scored.where("value > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    found = sums_apart(rows.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p")), groups)
    found = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, two = groups.select("lang", F.col("source").alias("a"), "kinds", F.col("p0").alias("p0a")), groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    value = F.col("kinds") * F.abs(F.col("p0a") - F.col("p0b")) + F.coalesce("value", F.lit(0).cast("long"))
    pairs = one.join(two, "lang").where("a <> b").join(found, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(of_terms)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS i, translate(coalesce(text, ''), '{UPPER}', '{SMALL}') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM w GROUP BY 1, 2, 3),
k AS (SELECT lang, term, COUNT(*) AS ln FROM w GROUP BY 1, 2 HAVING COUNT(DISTINCT i) >= {LEAST_DOCS}),
l AS (SELECT lang, COUNT(*) AS v, SUM(ln) AS nl FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(SUM(n) FILTER (k.term IS NOT NULL), 0) AS ng FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source LEFT JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY 1, 2),
s AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (ng + {ADDED} * v) AS BIGINT) AS p, CAST(1 + ({SCALE}::HUGEINT * (ln + {ADDED})) // (nl + {ADDED} * v) AS BIGINT) AS q
  FROM gn JOIN l ON gn.lang = l.lang JOIN k ON gn.lang = k.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
t AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
f AS (SELECT a.lang, a.source, b.source AS item, SUM(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM r)) WHERE part = 'pair' OR rank <= {TOP}"""
