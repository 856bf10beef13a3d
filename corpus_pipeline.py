"""A corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.llm import bpe, jaccard_join, language, mixing, substring
from indoorspark.llm.common import finished, small_batches, stored, table

#: Below this probability a document's language counts as unknown, if no held-out row told rightly has less.
LEAST_SCORE = 0.4
NEAR = jaccard_join.Join(words=5, percent=80)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, but for those whose language is told with less probability than LEAST_SCORE and than any
    row, of the fifth that the fit holds out, that is told rightly: with many languages clean texts have low ones.

    Without any known lang nothing is learned, and all documents with letters stay. Null and empty texts go, whatever their
    id or lang; repeated rows are told alike; texts of any length are read whole. All columns come out as they were,
    whatever their names; an empty table gives no rows.
    """
    small_batches(spark)
    model = language.fit(docs)
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language.add_language(docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row")), model, "_lang", "_score")
    told = told.where((F.col("_lang") != "und") & (F.col("_score") >= min(LEAST_SCORE, model["least"])))
    return told.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones, that of the smallest doc_id; of repeated rows one.

    Rows are told apart by id and text: texts that share an id but are not similar all stay, of similar ones that share
    the smallest id that of the least hash. A null doc_id counts as greater than any. Null and empty texts are similar to
    nothing. Texts of any length are read whole. All columns come out as they were, whatever their names; an empty
    table gives no rows.
    """
    small_batches(spark)
    row = ["none", "doc_id", "t"]
    labels = finished(spark, lambda: jaccard_join.labelled(docs, NEAR).select(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "root"), "pipe-labels")
    first = stored(labels.where("root is not null").groupBy("root").agg(F.min(F.struct(*row)).alias("first")), "pipe-first")
    gone = labels.join(first, "root").where(F.struct(*row) != F.col("first")).select("doc_id", "t").distinct()
    twice = stored(labels.groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t"), "pipe-twice")
    keyed = docs.select(F.col("doc_id").alias("_id"), jaccard_join.text_hash().alias("_t"), F.struct(*docs.columns).alias("row"))
    here = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_t") == other["t"])
    kept = keyed.join(gone, here(gone), "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice, here(twice), "left_semi").dropDuplicates(["_id", "_t"])
        kept = kept.join(twice, here(twice), "left_anti").unionByName(once)
    return kept.select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has; a document that loses every word goes.

    Null and empty texts, and documents of null id, stay as they are; repeated rows are cut alike; texts of any length are
    read whole. Columns other than text and n_chars come out as they were, whatever their names; an empty table gives no rows.
    """
    small_batches(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring.removed(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("row")))
    cut = cut.where("_removed = 0 or _removed < _words")
    text = F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weight of its source asks: none, once or up to three times.

    Null and empty texts count no words and are drawn like others; a null source is a source of its own, the last.
    Repeated rows share a draw; texts of any length count all their words. All columns come out as they were, whatever
    their names; an empty table gives no rows.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (binary, little-endian unsigned 32-bit).

    Null and empty texts have no tokens; repeated rows are encoded alike; texts of any length are encoded whole. Other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(spark)
    ids = bpe.add_ids(docs.select("doc_id", "text", "lang", "source"))
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("repeats", without_repeats),
    ("mix", mixed),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; see the stages for nulls,
    repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipe-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
