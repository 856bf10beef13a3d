"""Language ID (operator 5): sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indoorspark.llm.common import lookup, stored, table
from indoorspark.llm.words import text_groups

#: Hashed n-gram buckets and the orders of the n-grams.
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: Bound of the fitted sample: rows a language, rows in all (two a language at least), n-grams in all.
PER_LANG, IN_ALL, GRAMS_IN_ALL = 1_000, 20_000, 20_000_000


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 1 + ln count) of the text's character n-grams, lower-cased, with a space at each end."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    found, h = [], np.zeros(len(cp), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(cp) - n + 1] + cp[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            found.append((h >> np.uint64(50)).astype(np.int64))
    count = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at.astype(np.int32), (1 + np.log(count[at])).astype(np.float32)


def weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of each bucket over all of docs(text): summed in tasks, BUCKETS + 1 numbers reach the driver."""

    def run(batches):
        seen = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for text in (t for _, texts in text_groups(b.column(0)) for t in texts if has_letter(t)):
                seen[grams(text)[0]] += 1
                seen[BUCKETS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(seen)], names=["bucket", "n"])

    n = np.zeros(BUCKETS + 1)
    for bucket, count in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        n[bucket] = count
    return (1 + np.log((1 + n[BUCKETS]) / (1 + n[:BUCKETS]))).astype(np.float32)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic loss with elastic-net penalties l1, l2."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores, from 1/e to e**4, with the least log loss, by golden sections of its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = -1.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def trained(rows, idf: np.ndarray, langs: list[str], epochs: int) -> dict:
    """weights, temperature and least from (lang, buckets, tf) in the order of the draw, a fifth of them held out."""
    sample = [(at, weighted(at, tf, idf), langs.index(lang)) for lang, at, tf in rows]
    learn, test = [s for k, s in enumerate(sample) if k % 5], [s for k, s in enumerate(sample) if not k % 5]
    model = Ftrl(len(langs))
    for epoch in range(epochs):
        for k in np.random.RandomState(epoch).permutation(len(learn)):
            model.learn(*learn[k])
    w = model.weights().astype(np.float32)
    t, least, right, error = 1.0, 0.0, 0.0, 0.0
    if test and len(langs) > 1:
        scores, y = np.array([x @ w[at] for at, x, _ in test]), np.array([y for _, _, y in test])
        t = temperature(scores, y)
        p, hit = softmax(scores / t).max(axis=1), scores.argmax(axis=1) == y
        least = float(p[hit].min()) if hit.any() else 0.0
        right, error = float(hit.mean()), calibration_error(p, hit)
    return {"weights": w, "temperature": t, "least": least, "accuracy": right, "calibration_error": error}


def calibration_error(p: np.ndarray, hit: np.ndarray, bins: int = 10) -> float:
    """Mean distance of stated probability and share of right answers, over `bins` bins, weighted by their rows."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum(abs(p[at == k].mean() - hit[at == k].mean()) * (at == k).mean() for k in np.unique(at)))


def fit(docs: DataFrame, per_lang: int = PER_LANG, in_all: int = IN_ALL, epochs: int = 4, grams_in_all: int = GRAMS_IN_ALL) -> dict:
    """Languages, idf, weights, temperature, and of held-out rows accuracy, calibration_error and least (probability of a row told rightly), from docs(doc_id, text, lang).

    idf counts all rows, and every language is learned: the more there are, the fewer rows each has in the sample. Weights come from at most `per_lang` rows a
    language, `in_all` rows and about `grams_in_all` n-grams in all, chosen by hash of id and text and trained on in one
    task, so that the driver gets the weights alone. A fifth of those rows is held out for temperature and `least`.
    Null langs are left out; rows of null or equal ids are drawn by their texts.
    """
    docs = docs.where("lang is not null")
    counts = stored(docs.groupBy("lang").count(), "language-counts")
    langs = sorted(r[0] for r in counts.select("lang").collect())  # the model has a column a language
    if not langs:
        return {"langs": []}
    idf = document_frequencies(docs)
    n = max(2, min(per_lang, in_all // len(langs)))
    draw = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30))
    edges = counts.select("lang", F.least(F.lit(1 << 30), F.floor(1.2 * n * (1 << 30) / F.col("count")) + 1).alias("edge"))
    picked = lookup(docs.select("doc_id", "lang", "text", draw.alias("draw")), edges, "lang").where("draw < edge").drop("edge")
    # what is left holds about 1.2 n rows a language, so this window is small
    picked = picked.selectExpr("*", "row_number() over (partition by lang order by draw, doc_id, md5(text)) as place").where(F.col("place") <= n)

    def featured(batches):
        for b in batches:
            rows = [(lang, place, *grams(t)) for lang, place, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if t and has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.float32()))], names=["lang", "place", "at", "tf"])

    def train(batches):
        rows, held = [], 0
        for b in batches:
            for lang, at, tf in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if held < grams_in_all:
                    rows.append((lang, np.array(at.values), np.array(tf.values)))
                    held += len(at)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(rows, idf, langs, epochs))], pa.binary())], names=["model"])

    features = picked.select("lang", "place", "text").mapInArrow(featured, "lang string, place int, at array<int>, tf array<float>")
    model = features.repartition(1).sortWithinPartitions("place", "lang").mapInArrow(train, "model binary").first()
    return {"langs": langs, "idf": idf, **pickle.loads(model[0])} if model else {"langs": []}


def predictor(model: dict):
    """text -> (lang, score); und with score 0 for null, for no letter, or if nothing was learned."""

    def predict(text: str | None) -> tuple[str, float]:
        if not text or not model["langs"] or not has_letter(text):
            return "und", 0.0
        at, tf = grams(text)
        p = softmax((weighted(at, tf, model["idf"]) @ model["weights"][at]) / model["temperature"])
        k = int(p.argmax())
        return model["langs"][k], float(p[k])

    return predict


def add_language(docs: DataFrame, model: dict, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a predicted language and its calibrated probability; only the text is read.

    The model, BUCKETS numbers a language, is broadcast. Columns of the same two names are
    replaced. Null text or text without letters: und, 0. Texts of any length are read whole; of languages with the same
    score the first by name is taken.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang, score)

    def run(batches):
        predict = predictor(held.value)
        for b, texts in ((whole.slice(at, len(texts)), texts) for whole in batches for at, texts in text_groups(whole.column("text"))):
            rows = [predict(t) for t in texts]
            new = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_rows(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from documents whose crc32(doc_id) mod 4 is not 2 and whose lang is known; a null doc_id is not
    held out and not learned from. Null text or text without letters: und, 0. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return add_language(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_rows(table(spark, sf_dir, "documents"))
