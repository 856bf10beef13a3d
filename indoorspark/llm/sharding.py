"""Sharding (operator 7): balanced label propagation under row quotas."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.llm.common import slots, stored, table

SHARDS = 40


def _at(values: list[int], index: F.Column) -> F.Column:
    """values[index] for a column; one value a shard."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int")).cast("long")


def _counts(df: DataFrame, by: str, shards: int) -> list[int]:
    got = dict(df.groupBy(by).count().collect())
    return [got.get(s, 0) for s in range(shards)]


def _deal(place: F.Column, ends: list[int]) -> F.Column:
    """Shard of a place from 0, ends being the places at which shards end."""
    return F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= place)).cast("int")


def propagate(rows: DataFrame, quotas: list[int]) -> DataFrame:
    """rows(r, g, ...) with `shard`, linked rows of one g gathered as the quotas allow; rows without g have no shard.

    r: a number of its own for each row, h: a hash of what it holds; rows of equal g (not null) are linked. A group of more than
    half a quota is first cut into pieces by h (r for rows of equal h), as it could not be one shard's. Linked rows start dealt out piece after piece, each
    shard up to the same part of its quota, so that one piece an end of a shard is cut at most. In each round a piece asks
    for the shard that most of its rows are in; the rows elsewhere move there, whole pieces first, up to that shard's free
    places, until no row moves: a move gathers more rows of a piece, so rounds come to an end.
    Shard counts (one number a shard) are all that reaches the driver.
    """
    shards = len(quotas)
    half = max(1, min(quotas) // 2)
    groups = stored(rows.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"), "shard-groups")
    linked = rows.join(groups, "g").withColumn("_piece", F.xxhash64("g", F.pmod(F.xxhash64("h", "r"), F.ceil(F.col("_m") / half))))
    linked = stored(linked.drop("_m").withColumn("_all", F.lit(0)), "shard-linked")
    total, every = linked.count(), max(1, sum(quotas))
    ends = [end * total // every for end in accumulate(quotas)]
    linked = slots(linked, "_all", [F.col("_piece"), F.col("h"), F.col("r")], "_place").withColumn("shard", _deal(F.col("_place"), ends)).drop("_all", "_place")
    linked = stored(linked, "shard-linked")
    while True:
        held = _counts(linked, "shard", shards)
        free = [max(0, q - h) for q, h in zip(quotas, held, strict=True)]
        votes = linked.groupBy("_piece", "shard").agg(F.count(F.lit(1)).alias("n"))
        votes = votes.groupBy("_piece").agg(F.max(F.struct("n", F.xxhash64("_piece", "shard").alias("tie"), "shard")).alias("top"), F.count(F.lit(1)).alias("spread")).where("spread > 1")
        asked = linked.select("r", "h", "_piece", "shard").join(votes.select("_piece", F.col("top.shard").alias("to")), "_piece").where("shard <> to")
        asked = stored(asked, "shard-asked")
        if asked.isEmpty():
            break
        moved = stored(slots(asked, "to", [F.col("_piece"), F.col("h"), F.col("r")], "_place").where(F.col("_place") < _at(free, F.col("to"))), "shard-moved")
        if moved.isEmpty():
            break
        linked = linked.join(moved.select("r", "to"), "r", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
        linked = stored(linked, "shard-linked")
    rest = rows.join(linked.select("r"), "r", "left_anti").withColumn("shard", F.lit(None).cast("int"))
    return linked.select(*rest.columns).unionByName(rest)


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot and grown_shard (null) of every document.

    Documents with equal texts are linked and share a shard where its quota allows; counts of shards differ by one at
    most. Unlinked documents, and linked ones above a quota, fill what is left. Null text: size 16, checksum 0, no
    links. Repeated rows are rows of their own, and only which of them goes where depends on how the input is split. Texts
    of any length count whole; other columns are ignored; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text", F.length("text"))).alias("g"), F.monotonically_increasing_id().alias("r"))
    rows = stored(rows.withColumn("h", F.xxhash64("doc_id", "g")), "shard-rows")
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    placed = stored(propagate(rows, quotas).select("doc_id", "size", "text_crc32", "r", "h", "shard"), "shard-placed")
    kept = slots(placed.where("shard is not null"), "shard", [F.col("h"), F.col("r")], "_place").withColumn("shard", F.when(F.col("_place") < _at(quotas, F.col("shard")), F.col("shard")))
    kept = stored(kept.drop("_place"), "shard-kept")
    held = _counts(kept.where("shard is not null"), "shard", shards)
    ends, end = [], 0
    for q, h in zip(quotas, held, strict=True):
        end += q - h
        ends.append(end)
    loose = placed.where("shard is null").unionByName(kept.where("shard is null")).withColumn("_all", F.lit(0))
    place = slots(loose, "_all", [F.col("h"), F.col("r")], "_place")
    filled = place.withColumn("shard", _deal(F.col("_place"), ends))
    both = stored(kept.where("shard is not null").unionByName(filled.select(*kept.columns)), "shard-all")
    final = slots(both, "shard", [F.col("h"), F.col("r")], "slot")
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
