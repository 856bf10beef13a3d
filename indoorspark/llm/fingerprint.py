"""Document fingerprints (operator 3): a homomorphic multiset hash of paragraphs."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indoorspark.llm.common import parts, table
from indoorspark.llm.words import PLAIN, Words, chunks

#: 16-bit lanes: SAME tell equal multisets of paragraphs, NEAR hold signed counts of their word pairs.
SAME, NEAR = 64, 128
LANES = SAME + NEAR


def paragraph(text: bytes) -> np.ndarray:
    """The SAME lanes of one paragraph."""
    return np.frombuffer(hashlib.shake_128(text).digest(2 * SAME), "<u2")


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of LANES 16-bit sums for each text: the sum, modulo 2**16, of its paragraphs' vectors.

    A paragraph is a line that is not empty. Its vector has SAME lanes hashed from its bytes, and NEAR lanes
    to which each of its word pairs (its word, if it has but one) adds 1 or -1 in a place hashed from the pair.
    So texts with the same paragraphs in any order are equal, and paragraphs can be added or taken off.
    """
    out = np.zeros((len(texts), LANES), np.uint16)
    for at, to, data, offsets in chunks(texts):
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        cuts = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
        owner = np.searchsorted(offsets, cuts[:-1], side="right") - 1
        raw, whole = data.tobytes(), cuts.tolist()
        pieces = [raw[s:e].rstrip(b"\n") for s, e in zip(whole[:-1], whole[1:], strict=True)]
        keep = [i for i, p in enumerate(pieces) if p]
        if not keep:
            continue
        lanes = np.frombuffer(b"".join(hashlib.shake_128(pieces[i]).digest(2 * SAME) for i in keep), "<u2").reshape(-1, SAME)
        same = np.zeros((to - at, SAME), np.uint16)
        rows = owner[keep]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        same[rows[first]] = np.add.reduceat(lanes, first, axis=0, dtype=np.uint16)
        words = Words(data, cuts, PLAIN)
        places, code = words.grams(2)
        lone = words.first[:-1][words.count == 1]
        code = np.r_[code, words.code[lone]]
        of = owner[words.doc[np.r_[places, lone]]] if len(code) else np.zeros(0, np.int64)
        sign = np.where(code & np.uint64(1 << 40), 1.0, -1.0)
        cell = of * NEAR + (code & np.uint64(NEAR - 1)).astype(np.int64)
        near = np.bincount(cell, sign, (to - at) * NEAR).astype(np.int64).astype(np.uint16)
        out[at:to, :SAME], out[at:to, SAME:] = same, near.reshape(-1, NEAR)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row: 1 for equal fingerprints, else the cosine of the NEAR lanes (as signed numbers), from 0 to 0.999999."""
    x, y = (m[:, SAME:].astype(np.int16).astype(np.float64) for m in (a, b))
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cos, 0.0, 0.999999))


def text_of(rows: np.ndarray) -> list[str]:
    return [base64.b64encode(r.tobytes()).decode() for r in rows.astype("<u2")]


def add_fingerprint(docs: DataFrame, out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of the text (null: empty) as base64; a column of that name is replaced."""
    docs = docs.drop(out)

    def run(batches):
        for b in batches:
            text = b.column("text").cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text_of(fingerprints(text)), pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def with_next(docs: DataFrame, cells_each: int = 4) -> DataFrame:
    """Rows (_bucket, _guest, doc_id, text), dealt and sorted so that each row's follower by doc_id comes next.

    Ids (nulls first, ties by the text's hash) are cut into buckets of like row counts: at quantiles of the ids, and a
    quantile that is the id of many rows (or null) by their hashes too. The first row of a bucket also goes to the bucket
    before as its last row, a guest; the first of all follows the last. Texts are shuffled once; the driver gets some
    numbers for each partition. Rows equal in id and text stand together.
    """
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    q = n * cells_each
    edges = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / q for i in range(q + 1)], 10 * q)).first()[0] or []))
    cuts = np.array(edges, np.int64)

    @F.arrow_udf("int")
    def cell_of(ids: pa.Array) -> pa.Array:
        """0 for null, odd numbers for ids between quantiles, even ones for those that are a quantile."""
        x = np.asarray(ids.fill_null(0), np.int64)
        at = np.searchsorted(cuts, x)
        equal = (at < len(cuts)) & (cuts[np.minimum(at, len(cuts) - 1)] == x) if len(cuts) else np.zeros(len(x), bool)
        return pa.array(np.where(np.asarray(ids.is_null()), 0, 2 * at + 1 + equal).astype(np.int32))

    docs = docs.withColumn("_cell", cell_of("doc_id"))
    counts = {r[0]: r[1] for r in docs.groupBy("_cell").count().collect()}
    total, done, split, start = sum(counts.values()), 0, [], []
    for cell in sorted(counts):  # cells of one id are cut by hash into as many parts as they have shares of a bucket
        many = -(-counts[cell] * n // total) if cell % 2 == 0 else 1
        split += [F.lit(cell), F.struct(F.lit(len(start)).alias("at"), F.lit(many).alias("many"))]
        start += [min(n - 1, (done + counts[cell] * i // many) * n // total) for i in range(many)]
        done += counts[cell]
    if not counts:
        return docs.select(F.lit(0).alias("_bucket"), F.lit(0).alias("_guest"), "doc_id", "text")
    part = F.create_map(*split)[F.col("_cell")]
    nth = F.least(F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * part["many"]), part["many"] - 1)
    rows = docs.withColumn("_bucket", F.element_at(F.array(*map(F.lit, start)), (part["at"] + nth + 1).cast("int"))).drop("_cell")
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_h")
    firsts = sorted(rows.groupBy("_bucket").agg(F.min(key).alias("key")).collect())
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    is_first = F.create_map(*[x for b, k in firsts for x in (F.lit(b), F.struct(F.lit(k[1]).cast("long").alias("i"), F.lit(k[2]).alias("h")))])[F.col("_bucket")]
    guests = rows.where(F.col("doc_id").eqNullSafe(is_first["i"]) & (F.col("_h") == is_first["h"])).groupBy("_bucket").agg(F.first(F.struct("doc_id", "text", "_h")).alias("row"))
    goes = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_bucket")]
    both = rows.select("_bucket", F.lit(0).alias("_guest"), "doc_id", "text", "_h").unionByName(guests.select(goes.alias("_bucket"), F.lit(1).alias("_guest"), "row.*"))
    return both.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_bucket", "_guest", F.asc_nulls_first("doc_id"), "_h").drop("_h")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_rows(docs: DataFrame, rows_each: int = 500) -> DataFrame:
    """Fingerprints of every text and its edited text, with likenesses.

    Null text counts as empty. One document follows itself. Repeated rows and ids each give a row, in the order of the
    hashes of their texts; null ids come first. Texts of any length are read whole. Other columns are ignored; an empty
    table gives no rows.
    """

    def done(rows):
        ids, texts, after = zip(*rows, strict=True)
        edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
        own, new, nxt = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, edited, [*after]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(text_of(own), pa.string()), pa.array(text_of(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, nxt)),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    def run(batches):
        last, rows, size = None, [], 0
        for b in batches:
            for bucket, guest, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if last and last[0] == bucket and not last[1]:
                    rows.append((last[2], last[3], text))
                    size += len(last[3])
                    if len(rows) >= rows_each or size > 2_000_000:
                        yield done(rows)
                        rows, size = [], 0
                last = (bucket, guest, doc, text)
        if rows:
            yield done(rows)

    return with_next(docs).mapInArrow(run, SCHEMA)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_rows(table(spark, sf_dir, "documents"))
