"""Null, empty, very long and repeated texts, null ids, clashing columns and empty tables, through every operator."""

import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from indoorspark.llm import bpe, fingerprint, jaccard_join, language, licenses, media, mixing, sharding, substring, url_filter
from indoorspark.llm.common import new_path

LONG = " ".join(random.Random(3).choices(["der", "the", "und", "of", "Zug", "train", "läuft", "runs"], k=60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (0, None, "en", "a"), (1, "", "en", None), (2, SAME, "en", "a"), (2, SAME, "en", "a"), (3, SAME, "de", "b"), (4, SAME + " fifteen", None, "b"),
    (5, "12 34 !!", "en", "c"), (6, LONG, "de", "c"), (None, SAME, "en", "c"), (7, "word " * 20, "en", "a"), (8, "zwei\n\nZeilen  mit <|endoftext|> Zeichen", "de", "a"),
]
CLASHING = ("n", "c", "size", "ids", "score", "place", "g", "r", "shard", "_c", "_doc", "_rate", "row", "shared", "head", "rate", "places", "doc", "s", "h")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASHING}).cache()


def run(operator, docs):
    assert operator(docs.limit(0)).count() == 0
    return [r.asDict() for r in operator(docs).collect()]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    rows = run(bpe.digest_rows, docs)
    assert len(rows) == len(ROWS)
    want = sorted((d is None, d or 0, sha(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()), sha((t or "").encode())) for d, t, *_ in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    kept = bpe.add_ids(docs)
    assert set(kept.columns) == set(docs.columns) and kept.where("doc_id = 8").first()["score"] == "x"


def test_fingerprint(docs):
    rows = run(fingerprint.edit_rows, docs)
    assert len(rows) == len(ROWS)
    same = {r["fingerprint"] for r in rows if r["n_chars"] == len(SAME)}
    assert len(same) == 1 and all(0 <= r[k] <= 1 for r in rows for k in ("near_edited", "near_next"))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for (d, t, *_), (_, nxt, *_) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 2
        want.append((d, sha((t[: len(t) - k] + nxt[:k]).encode())))
    assert sorted((r["doc_id"] or -1, r["edited_sha256"]) for r in rows) == sorted((d or -1, s) for d, s in want)


def test_fingerprint_is_homomorphic():
    import pyarrow as pa

    a, b = "first line of a\nsecond line\n", "another line here\nand one more"
    whole, one, two, other = fingerprint.fingerprints(pa.array([a + b, a, b, b + "\n" + a], pa.large_string()))
    assert (one + two == whole).all() and (whole - one == two).all() and (whole == other).all()


def test_mixing(docs):
    rows = run(mixing.mix_rows, docs)
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in rows)
    total = {r["source_size"]: r["target"] for r in rows}
    assert abs(sum(total.values()) - sum(r["size"] for r in rows)) < 1e-3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(r["text"].split()) for r in mixed.select("text").collect() if r["text"])
    assert words == sum(r["taken"] for r in rows)


def test_language(docs):
    rows = run(language.language_rows, docs)
    assert len(rows) == len(ROWS)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (0, 1, 5))
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in rows)


def test_media(docs, spark):
    def through(d):
        folder = new_path(spark, "media")
        return media.read_back(media.add_metadata(media.write_shards(d, folder), folder), folder)

    rows = run(through, docs)
    want = sorted(sha(media.padded(t)[1]) for _, t, *_ in ROWS)
    assert sorted(r["payload_sha256"] for r in rows) == want
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["n_bytes"] == len(SAME)}) == 1


def test_sharding(docs):
    rows = run(sharding.shard_rows, docs)
    sizes = [sum(r["shard"] == s for r in rows) for s in range(40)]
    assert len(rows) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s])) for s in range(40))


def test_jaccard(docs):
    rows = run(jaccard_join.link, docs)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in rows)
    assert len(got) == len(ROWS)
    assert {c for d, _, c in got if d in (2, 3, 4, -1)} == {2}  # 11 of 12 shingles are shared with document 4
    assert {(d, n, c) for d, n, c in got if d in (0, 1, 7)} == {(0, 0, 0), (1, 0, 1), (7, 1, 7)}


def test_substring(docs):
    rows = run(substring.dedup_rows, docs)
    got = by_id(rows)
    assert len(rows) == len(ROWS) and (got[2]["n_removed"], got[3]["n_removed"], got[4]["n_removed"]) == (0, 14, 14)
    assert got[4]["kept_sha256"] == sha(b"fifteen") and got[None]["n_removed"] == 0 and got[0]["kept_sha256"] == sha(b"")
    cut = substring.removed(docs)
    assert cut.columns[: len(docs.columns)] == docs.columns and cut.where("doc_id = 3").first()["_c"] == "x"


def test_licenses(docs):
    rows = run(licenses.scan_rows, docs)
    assert len(rows) == len(ROWS) and all(r["first_word"] is None and r["labels"] == "" for r in rows if r["n_base"] == 0 and r["score"] == 0)


def test_urls(spark):
    pages = [(1, None, None), (2, "no scheme", "<p>"), (3, "http://M.Example.net/x?utm_source=a#b", ""), (4, "https://example.net/x.html", None), (5, "http://c.example.com/en/1", "<link href='/de/1' rel=canonical>"), (5, "http://c.example.com/en/1", ""), (6, "http://c.example.com/de/1/", ""), (7, "ftp://de.example.org/fr/1", ""), (None, "http://a.b/", "")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumns({c: F.lit(1) for c in ("host", "rule", "root", "address", "ruled", "a", "b")})
    assert url_filter.judge(df.limit(0)).count() == 0
    got = {(r["page_id"], r["rule"], r["verdict"], r["host"]) for r in url_filter.judge(df).collect()}
    assert got == {(1, None, "allow", ""), (2, None, "allow", ""), (3, "net/", "block", "m.example.net"), (4, "net/", "block", "example.net"), (5, None, "block", "c.example.com"), (6, "example.com/de/", "block", "c.example.com"), (7, "org/fr/", "allow", "de.example.org"), (None, None, "allow", "a.b")}


def test_pipeline_on_edges(spark, docs):
    sys.modules.pop("corpus_pipeline", None)
    import corpus_pipeline

    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
