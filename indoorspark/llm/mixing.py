"""Mixing sources to target weights (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.llm.common import lookup, ranked, stored, table

WEIGHTS = (5, 2, 1)
#: Turns of a source's draws that are tried.
TURNS = 64
WORD = r"[^\x20\x09-\x0D]+"


def source_plan(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Sources in code point order, null last, get `weights` in turn and share the sum of all sizes by
    weight. A target stops at `cap` times its source's size; the excess is shared again by weight
    until no target is above. A source of size 0 has target and rate 0; an empty table has no rows.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = ranked(by, ["source"], "_rank", "mix-sources")
    by = by.withColumn("weight", F.array(*map(F.lit, weights))[F.col("_rank") % len(weights)].cast("long"))
    # In the order of size by weight sources reach their caps; the first whose share stays under its cap sets the level,
    # and so do all after it: it is found by halving, one small aggregate a step.
    by = stored(ranked(by.withColumn("_ratio", cap * F.col("source_size") / F.col("weight")), ["_ratio", "_rank"], "_k", "mix-caps"), "mix-order")
    total, n = by.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    k, limit = F.col("_k"), F.col("source_size") * cap

    def level(at: int) -> tuple[float, bool]:
        """The level if the first `at` sources are at their caps, and whether the next one's share is under its cap."""
        full, weight, ratio = by.agg(F.sum(F.when(k < at, limit)), F.sum(F.when(k >= at, F.col("weight"))), F.max(F.when(k == at, F.col("_ratio")))).first()
        found = float(total - (full or 0)) / float(weight)
        return found, found <= ratio

    lo, hi = 0, max(0, (n or 0) - 1)
    while lo < hi:
        at = (lo + hi) // 2
        lo, hi = (lo, at) if level(at)[1] else (at + 1, hi)
    found = level(lo)[0] if n else 0.0
    target = F.when(k < lo, limit.cast("double")).otherwise(F.lit(found) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return by.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(seed: int = 0) -> Column:
    """A number from 0 to below 1 by seed, doc_id and text alone."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def picked(turn: Column) -> Column:
    """Whether a row gets the copy of the fraction: its draw, turned on by `turn` of TURNS, is below the fraction."""
    at = F.col("draw") + turn / float(TURNS)
    return F.when(at >= 1, at - 1).otherwise(at) < F.col("rate") - F.floor("rate")


def dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, size, draw, ...) with source_size, target and n, the copies of each: floor(rate), and one more by its draw.

    All draws of a source are turned by one of TURNS steps, the one whose words come nearest to the target (the least of several): each
    turn is a draw of the same probability, and a sum for each turn and source, added up in tasks, is all that choosing takes.
    """
    met = lookup(rows.select("source", "size", "draw"), plan, "source")
    tried = [F.sum(F.when(picked(F.lit(t)), F.col("size")).otherwise(0)).alias(f"w{t}") for t in range(TURNS)]
    sums = met.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("rate").alias("rate"), *tried)
    wanted = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{t}") - wanted), F.lit(t).alias("t")) for t in range(TURNS)]))["t"]
    turns = stored(sums.select("source", "source_size", "target", "rate", best.alias("turn")), "mix-turns")
    out = lookup(rows, turns, "source")
    return out.withColumn("n", (F.floor("rate") + F.when(picked(F.col("turn")), 1).otherwise(0)).cast("long")).drop("rate", "turn")


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last. Rows that share id (or have none) and text
    each count and share a draw. Texts of any length count all their words. Sources of equal size by weight are taken
    in their order. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(docs.select("doc_id", "source", words().alias("size"), draw(seed).alias("draw")), "mix-sizes")
    met = dealt(rows, source_plan(rows))
    return met.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("n")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as its source's rate asks; all columns kept, whatever their names."""
    rows = docs.select("source", words().alias("size"), draw(seed).alias("draw"), F.struct(*docs.columns).alias("row"))
    plan = source_plan(stored(docs.groupBy("source").agg(F.sum(words()).alias("size")), "mix-sizes"))
    met = dealt(rows, plan).where("n > 0")
    return met.select("row", F.explode(F.expr("sequence(1L, n)")).alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(table(spark, sf_dir, "documents"))


SQL = r"""
WITH s AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST(('0x' || substr(md5('0:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw FROM documents),
b AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CAST((SELECT SUM(source_size) FROM b) AS BIGINT) AS total FROM b),
o AS (
  SELECT *, 3.0 * source_size / weight AS ratio,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM w),
l AS (
  SELECT *, CAST(total - COALESCE(SUM(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(SUM(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
m AS (SELECT MIN(k) AS first_open FROM l WHERE level <= CAST(3 * source_size AS DOUBLE) / weight),
t AS (
  SELECT source, source_size,
         CASE WHEN k < first_open THEN CAST(3 * source_size AS DOUBLE) ELSE (SELECT level FROM l WHERE k = first_open) * weight END AS target
  FROM l, m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
d AS (
  SELECT r.source, i, abs(SUM(CASE WHEN draw + i / CAST(64 AS DOUBLE) - CASE WHEN draw + i / CAST(64 AS DOUBLE) >= 1 THEN 1 ELSE 0 END < rate - FLOOR(rate) THEN size ELSE 0 END) - MAX(rate - FLOOR(rate)) * MAX(source_size)) AS off
  FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source, range(0, 64) n(i) GROUP BY 1, 2),
u AS (SELECT source, arg_min(i, (off, i)) AS i FROM d GROUP BY 1)
SELECT doc_id, size, source_size, ROUND(target, 6) AS target,
       CAST(size * (FLOOR(rate) + CASE WHEN draw + i / CAST(64 AS DOUBLE) - CASE WHEN draw + i / CAST(64 AS DOUBLE) >= 1 THEN 1 ELSE 0 END < rate - FLOOR(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source JOIN u ON s.source IS NOT DISTINCT FROM u.source
"""
