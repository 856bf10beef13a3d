"""Substring dedup (operator 10): prefix-partitioned suffix trees, cut at the depth from which a repeat counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.llm.common import parts, stored, table
from indoorspark.llm.words import Words, batches, text_groups

#: Words of a repeat, and words of the shorter prefixes that split the suffixes.
DEPTH, PREFIX = 13, 4
#: Suffixes under one shorter prefix, at most; beyond, the prefix is lengthened. Also what a task sorts at once.
GROUP = 100_000


def leading(w: Words, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least `depth` words: (first word, hash of those words, hash of the least prefix among them).

    A suffix is sorted under a prefix of its own choice: of the prefixes that start in its first words and end
    within `depth`, the one of least hash. Equal beginnings of that depth choose the same one; neighbours mostly
    share it, so that they are sent as one stretch of words.
    """
    at, code = w.grams(depth)
    start, gram = w.grams(prefix)
    every = np.full(len(w.code), np.iinfo(np.uint64).max, np.uint64)
    every[start] = gram
    least = every[at]
    for i in range(1, depth - prefix + 1):
        np.minimum(least, every[at + i], out=least)
    return at, code, least.view(np.int64)


def text_class():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.length("text"))


def text_check():
    """A second hash of the text, so that texts are told apart by 96 bits."""
    return F.coalesce(F.crc32("text"), F.lit(0)).cast("long")


def flagged(first: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by keys then `first`; True where a row differs from the one before in the keys."""
    order = np.lexsort((first, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches that begin where `breaks` is true (the first place always does)."""
    first = np.flatnonzero(np.r_[True, breaks[1:]]) if len(breaks) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(breaks)])


def prefixes(docs: DataFrame, depth: int, prefix: int) -> DataFrame:
    """(c, p, n, known): prefixes p of each text class with n suffixes; of a stretch's rows for one prefix all but two are
    known to be shared, and their suffixes are counted with the second's."""

    def run(batches_):
        for b in batches_:
            ids = np.asarray(b.column(0), np.int64)
            for at, w in batches(b.column(1)):
                s, _, p = leading(w, depth, prefix)
                c = ids[at + w.doc[s]]
                order, new = flagged(c, p, c)
                head, n = runs(new)
                c, p = c[order][head], p[order][head]
                first, rows = runs(np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool))
                nth = np.arange(len(p)) - np.repeat(first, rows)
                if len(p):
                    total = np.add.reduceat(n, first)
                    second = first[rows > 1] + 1
                    n = n.copy()
                    n[second] = total[rows > 1] - n[first[rows > 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p), pa.array(n, pa.int64()), pa.array(nth > 1)], names=["c", "p", "n", "known"])

    return docs.select("c", "text").mapInArrow(run, "c long, p long, n long, known boolean")


def batch(names: str, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k]) for k in names.split()], names=names.split())


SUFFIX = "p long, s long, doc long, c long, place int, n int, codes array<long>"


def suffixes(texts: DataFrame, depth: int, prefix: int) -> DataFrame:
    """Stretches of suffixes under shared prefixes: (p, s, doc, c, place, n, codes).

    texts: (doc, c, text, shared, long). n suffixes start at place, place + 1, ...; codes are the hashes of their words, of
    the last one's first `depth`. Under a prefix in `long` each suffix stands alone, without codes, s being the hash of its
    first `depth` words: the lengthened prefix. Of equal beginnings in one stretch of texts only that of the least doc is
    sent to be compared; the others, of greater docs, are known to repeat: they have no p.
    """

    def run(batches_):
        for b in batches_:
            doc, c = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
            lists = [(np.asarray(x.offsets, np.int64), np.asarray(x.values, np.int64)) for x in (b.column(3), b.column(4))]
            for at, w in batches(b.column(2)):
                s, code, p = leading(w, depth, prefix)
                of, code = w.doc[s], code.view(np.int64)

                def listed(edge, values, p=p, of=of, at=at, w=w):
                    own = np.repeat(np.arange(w.n), np.diff(edge[at : at + w.n + 1]))
                    key = lambda p, d: p.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + d.astype(np.uint64)
                    return np.isin(key(p, of), key(np.ascontiguousarray(values[edge[at] : edge[at + w.n]]), own))

                short, long = (listed(*x) for x in lists)
                keep = short | long
                s, of, code, p, long = s[keep], of[keep], code[keep], p[keep], long[keep]
                d = doc[at + of]
                order, new = flagged(d, code)
                head, n = runs(new)
                least = np.empty(len(d), np.int64)
                least[order] = np.repeat(d[order][head], n)
                known = d > least
                place = s - w.first[of]
                kind = known * 2 + (long & ~known)
                first, n = runs(np.r_[True, (np.diff(s) != 1) | (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 1) | ((kind[1:] == 0) & (p[1:] != p[:-1]))] if len(s) else np.zeros(0, bool))
                kind, sent = kind[first], (kind[first] == 0)
                size = np.where(sent, n + depth - 1, 0)
                edge = np.r_[0, np.cumsum(size)]
                flat = np.repeat(s[first] - edge[:-1], size) + np.arange(edge[-1])
                codes = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(w.code[flat].view(np.int64)))
                yield batch("p s doc c place n codes", p=pa.array(p[first], mask=kind == 2), s=pa.array(code[first], mask=kind != 1), doc=d[first], c=c[at + of][first], place=place[first].astype(np.int32), n=n.astype(np.int32), codes=codes)

    return texts.mapInArrow(run, SUFFIX)


def subtree(group: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree as a sorted list: (order, lcp) of suffixes given by the codes of their first words, one row each.

    lcp[i] is the number of words that the i-th suffix in order shares with the one before, -1 at the first of a group;
    an internal node of depth d is a stretch of suffixes with lcp >= d. Suffixes are cut at the width of the rows.
    """
    rows = np.column_stack([group, suffix])
    order = np.argsort(np.ascontiguousarray(rows.view(np.uint64).astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel())
    rows = rows[order]
    return order, np.r_[-1, np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1) - 1] if len(rows) else np.zeros(0, np.int64)


def repeated(rows: pa.Table, depth: int) -> pa.RecordBatch:
    """Of whole groups of suffixes (p, doc, c, place, n, codes): stretches (c, doc, place, n) of those at a node of depth
    `depth` or more that has a smaller doc."""
    p, doc, c, place, n = (np.asarray(rows[k].combine_chunks()).astype(np.int64) for k in ("p", "doc", "c", "place", "n"))
    codes = rows["codes"].combine_chunks()
    edge, flat = np.asarray(codes.offsets, np.int64), np.asarray(codes.values, np.int64)
    of = np.repeat(np.arange(len(p)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    order, lcp = subtree(p[of], flat[(edge[:-1][of] + nth)[:, None] + np.arange(depth)])
    head, size = runs(lcp < depth)
    least = np.empty(len(of), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[of][order], head) if len(head) else head, size)
    again = doc[of] > least
    of, nth = of[again], nth[again]
    first, n = runs(np.r_[True, (np.diff(of) != 0) | (np.diff(nth) != 1)] if len(of) else np.zeros(0, bool))
    return batch("c doc place n", c=c[of[first]], doc=doc[of[first]], place=(place[of[first]] + nth[first]).astype(np.int32), n=n.astype(np.int32))


def in_subtrees(found: DataFrame, depth: int, group: int) -> DataFrame:
    """repeated() for all suffixes, dealt out and sorted by prefix: a task holds whole groups of about `group` suffixes at a time."""

    def run(batches_):
        held, n = [], 0
        for b in batches_:
            held.append(b)
            n += int(np.asarray(b.column("n")).sum())
            if n >= group:
                rows = pa.Table.from_batches(held)
                p = np.asarray(rows["p"].combine_chunks())
                cut = int(np.searchsorted(p, p[-1])) if len(p) else 0
                if cut:
                    yield repeated(rows.slice(0, cut), depth)
                held = rows.slice(cut).to_batches()
                n = sum(int(np.asarray(x.column("n")).sum()) for x in held)
        if held:
            yield repeated(pa.Table.from_batches(held), depth)

    dealt = found.select("p", "doc", "c", "place", "n", "codes").repartition(parts(found.sparkSession), "p").sortWithinPartitions("p")
    return dealt.mapInArrow(run, "c long, doc long, place int, n int")


def repeats(docs: DataFrame, depth: int = DEPTH, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, c, k) → (c, k, doc, places): a row for each text class, with stretches (place, n) of its first
    document's suffixes whose first `depth` words also start a suffix of a document with a smaller id.

    The prefixes under which suffixes stand are matched first; only suffixes under a prefix of two classes are sent on. A
    prefix of `prefix` words with up to `group` suffixes is one subtree, whose nodes of depth `depth` or more give the
    repeats. One with more is lengthened to `depth` words, where each group is one node: a minimum, combined before the
    shuffle, finds its least document. What a stretch of texts (1 MB) can tell alone is not sent, so that a group with a
    third of all texts is some rows for each stretch.
    """
    docs = docs.where("doc_id is not null")
    classes = stored(docs.groupBy("c", "k").agg(F.min("doc_id").alias("doc")), "sub-classes")
    rows = prefixes(docs, depth, prefix)
    sent, known = rows.where("not known").select("c", "p", "n"), rows.where("known").select("c", "p")
    two = sent.groupBy("p").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.sum("n").alias("n")).where("_lo < _hi")
    two = stored(two.select("p", (F.col("n") > group).alias("long")), "sub-prefixes")
    shared = sent.select("c", "p").join(two, "p").select("c", "p", "long")
    longs = two.where("long")
    known = known.withColumn("long", F.lit(False)) if longs.isEmpty() else known.join(longs, "p", "left").select("c", "p", F.coalesce("long", F.lit(False)).alias("long"))
    of = lambda when: F.collect_set(F.when(when, F.col("p")))
    shared = stored(shared.unionByName(known).groupBy("c").agg(of(~F.col("long")).alias("shared"), of(F.col("long")).alias("long")).join(classes, "c"), "sub-shared")
    texts = docs.join(shared.withColumnsRenamed({"c": "_c", "doc": "_doc", "k": "_k"}), (F.col("c") == F.col("_c")) & (F.col("k") == F.col("_k")) & (F.col("doc_id") == F.col("_doc")))
    found = stored(suffixes(texts.select(F.col("doc_id").alias("doc"), "c", "text", "shared", "long"), depth, prefix), "sub-suffixes")
    again = in_subtrees(found.where("p is not null and s is null"), depth, group).unionByName(found.where("p is null").select("c", "doc", "place", "n"))
    if not longs.isEmpty():
        alone = found.where("s is not null")
        least = stored(alone.groupBy("p", "s").agg(F.min("doc").alias("_least")), "sub-nodes")
        again = again.unionByName(alone.join(least, ["p", "s"]).where("doc > _least").select("c", "doc", "place", "n"))
    places = again.groupBy("c", "doc").agg(F.sort_array(F.collect_set(F.struct("place", "n"))).alias("places"))
    return classes.join(places, ["c", "doc"], "left").select("c", "k", "doc", F.coalesce("places", F.array().cast("array<struct<place:int,n:int>>")).alias("places"))


OUT = "doc_id long, n_words long, n_removed long, kept string"


def covered(n: int, places: pa.StructArray, depth: int) -> np.ndarray:
    """Which of n words the windows that start in the stretches (place, n) cover."""
    at, many = (np.asarray(places.field(i), np.int64) for i in (0, 1))
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + many + depth - 1, -1)
    return np.cumsum(step[:-1]) > 0


def removed(docs: DataFrame, depth: int = DEPTH, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """docs with _words (count), _removed (count) and _kept (the kept words joined by one space).

    A document whose text is that of a smaller doc_id loses every word, if it has `depth` words or more. A null doc_id
    is neither smaller nor greater than any: such a document keeps its words. Null text: no words. Repeated rows (equal
    id and text) don't remove each other. Texts of any length are read whole; an empty table gives no rows. Other columns
    stay, whatever their names; columns of the three names are replaced.
    """
    docs = docs.drop("_words", "_removed", "_kept")
    rows = docs.select("doc_id", "text", text_class().alias("c"), text_check().alias("k"), F.struct(*[x for x in docs.columns if x != "text"]).alias("row"))
    found = repeats(rows.select("doc_id", "text", "c", "k"), depth, prefix, group)
    found = found.select(F.col("c").alias("_c"), F.col("k").alias("_k"), F.col("doc").alias("_doc"), "places")
    met = rows.join(found, (F.col("c") == F.col("_c")) & (F.col("k") == F.col("_k")) & (F.col("doc_id") == F.col("_doc")), "left").select("row", "doc_id", "text", "places")

    def run(batches_):
        for b, texts in ((whole.slice(at, len(texts)), texts) for whole in batches_ for at, texts in text_groups(whole.column("text"))):
            n, gone, kept = [], [], []
            for doc, text, places in zip(b.column("doc_id").to_pylist(), texts, b.column("places"), strict=True):
                words = text.encode().split()
                if not places.is_valid:
                    out = np.full(len(words), doc is not None and len(words) >= depth)
                else:
                    out = covered(len(words), places.values, depth) if len(places.values) else np.zeros(len(words), bool)
                n.append(len(words))
                gone.append(int(out.sum()))
                kept.append((b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if gone[-1] else words)).decode())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "text", "_words", "_removed", "_kept"])

    kinds = dict(met.dtypes)
    out = met.mapInArrow(run, f"row {kinds['row']}, text string, _words long, _removed long, _kept string")
    return out.select(*[F.col("text") if x == "text" else F.col("row").getField(x).alias(x) for x in docs.columns], "_words", "_removed", "_kept")


def dedup_rows(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; repeated rows (equal id and text) don't remove each other.

    Other columns are ignored; an empty table gives no rows.
    """
    return removed(docs.select("doc_id", "text"), depth).select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_rows(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, CAST(len(words) AS BIGINT) - 11)) AS i FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, MIN(doc_id) OVER (PARTITION BY k) AS least FROM g) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(13) t(j)),
d AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, words, COALESCE(len(gone), 0) AS n_removed,
        [words[i] FOR i IN range(1, CAST(len(words) AS BIGINT) + 1) IF gone IS NULL OR NOT list_contains(gone, i)] AS kept
      FROM w LEFT JOIN d ON w.doc_id = d.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
