"""The queries on the given tables against brute force, round trips or held-out labels."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from indoorspark.llm import bpe, fingerprint, jaccard_join, language, media, sharding, substring, url_filter
from indoorspark.llm.common import table

DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in table(spark, DIR, "documents").collect()]


def brute_components(rows, k, percent):
    """doc_id -> (set size, least doc_id reachable)."""
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    by, root = defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in by[g] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_op8_equals_brute_force_and_searches(spark, documents, monkeypatch):
    found, search = [], jaccard_join.asked
    monkeypatch.setattr(jaccard_join, "asked", lambda *a: found.append(search(*a)) or found[-1])
    rows = jaccard_join.op8_jaccard_join(spark, DIR).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in documents], 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert any(c != d for d, (_, c) in want.items()) and found[0].count() > 0  # links come from the T-occurrence search


def test_pipeline_stages_equal_brute_force(spark, documents):
    import corpus_pipeline

    df = table(spark, DIR, "documents")
    near = {d: c for d, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in documents], 5, 80).items()}
    kept = corpus_pipeline.without_near_copies(spark, df, DIR)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, c in near.items() if d == c)
    seen, want = {}, {}
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        w = WORD.findall((r["text"] or "").encode())
        windows = [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
        gone = {i + j for i, k in enumerate(windows) if seen.get(k, r["doc_id"]) < r["doc_id"] for j in range(13)}
        for k in windows:
            seen.setdefault(k, r["doc_id"])
        if len(gone) < max(1, len(w)):
            want[r["doc_id"]] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r["text"]
    cut = corpus_pipeline.without_repeats(spark, df, DIR)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, df, DIR).select("doc_id").collect())
    from indoorspark.llm.mixing import mix_rows

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix_rows(df).collect()}
    assert all(mixed[d] * size == t for d, (t, size) in taken.items()) and max(mixed.values()) <= 3
    ids = {r["doc_id"]: hashlib.sha256(r["ids"]).hexdigest() for r in corpus_pipeline.encoded(spark, df, DIR).collect()}
    assert ids == {r["doc_id"]: r["ids_sha256"] for r in bpe.op1_bpe(spark, DIR).collect()}


def test_near_copies_leave_no_table_of_their_search(spark, documents):
    import corpus_pipeline

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(folder))
    twice = table(spark, DIR, "documents").select("doc_id", "text")
    twice = twice.unionByName(twice.where("doc_id % 3 = 0").selectExpr("doc_id + 1000000 AS doc_id", "text")).repartition(4, "doc_id")  # copies in other tasks
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, twice, DIR).collect()}
    near = brute_components([(r["doc_id"], r["text"]) for r in twice.collect()], 5, 80)
    assert kept == {d for d, (_, c) in near.items() if d == c}
    left = set(os.listdir(folder)) - there
    assert left and all(x.startswith("pipe-") and "-steps-" not in x for x in left)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    names = ("_lang", "_score", "_key", "_t", "_id", "_words", "_removed", "_kept", "row", "none", "root", "first")
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, "other words here", "de"), (3, "und noch mehr Worte", "de"), (None, "nameless text", None)], "doc_id long, text string, lang string")
    df = df.withColumns({c: F.lit(f"own {c}") for c in names})
    for stage in (corpus_pipeline.known_language, corpus_pipeline.without_near_copies, corpus_pipeline.without_repeats):
        got = stage(spark, df, "")
        rows = got.collect()
        assert got.columns == df.columns and rows and all(r[c] == f"own {c}" for r in rows for c in names)


def test_op5_is_right_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = language.op5_language(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows]
    assert len(rows) > 100 and sum(right) / len(right) >= 0.98
    import numpy as np

    assert language.calibration_error(np.array([r["score"] for r in rows]), np.array(right)) < 0.1


def test_op2_equals_brute_force(spark):
    pages = [(i, f"{s}://{h}{p}", html) for i, (s, h, p, html) in enumerate(
        (s, h, p, html) for s in ("http", "https") for h in ("www.a.net", "b.example.com", "x.org", "m.example.net", "c.io", "www.c.io") for p, html in (
            ("/", None), ("/de/1", "<link rel=canonical href='http://c.io/k'>"), ("/fr/2?utm_source=q", ""), ("/en/3.html", "<meta http-equiv=refresh content='0; url=http://x.org/fr/2'>"), ("/k/", "")))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

    def split(url):
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return host.lower(), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    def ruled(url):
        host, path = split(url)
        return next((v for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None)

    def implied(url):
        host, path = split(url)
        query = [p for p in (url.split("?", 1)[1].split("&") if "?" in url else []) if p and not p.startswith("utm_")]
        path = re.sub("/+$", "", re.sub(r"(?i)(/index)?\.html?$", "", path))
        return re.sub(r"^(www|m|mobile|amp)\.", "", host) + path + ("?" + "&".join(sorted(query)) if query else "")

    def exact(url):
        host, path = split(url)
        return host + path + ("?" + url.split("?", 1)[1] if "?" in url else "")

    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for _, url, html in pages:
        join(exact(url), implied(url))
        for target in re.findall(r"href='([^']+)'|url=([^']+)'", html or ""):
            t = "".join(target)
            join(exact(url), exact(t))
            join(exact(t), implied(t))
    groups = defaultdict(set)
    for _, url, _ in pages:
        groups[find(exact(url))].add(ruled(url))
    want = {i: ruled(u) or ("block" if "block" in groups[find(exact(u))] and "allow" not in groups[find(exact(u))] else "allow") for i, u, _ in pages}
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.judge(df).collect()}
    assert {i: v for i, (v, _) in got.items()} == want
    assert any(v == "block" and rule is None for v, rule in got.values())  # some decisions have travelled


def test_op6_and_op3_columns(spark, documents):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents}
    for r in media.op6_media(spark, DIR).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stored = media.encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload)) and media.decode(stored) == payload
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in fingerprint.op3_fingerprint(spark, DIR).collect()}
    for d, n in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, after = texts[d].decode(), texts[n].decode()
        k = len(t) // 2
        assert rows[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest() and rows[d]["n_chars"] == len(t)


def test_op7_cuts_no_group_of_the_given_table(spark, documents):
    rows = sharding.op7_sharding(spark, DIR).collect()
    text = {r["doc_id"]: r["text"] for r in documents}
    shards, sizes = defaultdict(set), Counter(text.values())
    for r in rows:
        if text[r["doc_id"]] is not None:
            shards[text[r["doc_id"]]].add(r["shard"])
    small = max(1, len(rows) // 40 // 2)
    assert all(len(s) == 1 for t, s in shards.items() if sizes[t] <= small)
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.get(s, 0) for s in range(40)) <= 1


def test_op10_prefixes_lengthen_alike(spark):
    df = table(spark, DIR, "documents").select("doc_id", "text")
    few, many = ({tuple(r) for r in substring.removed(df, group=g).select("doc_id", "_removed", F.sha2("_kept", 256)).collect()} for g in (5, substring.GROUP))
    assert few == many


def test_pipeline_sends_texts_to_python_in_small_batches(spark):
    """64 MB of texts at once, several times over in an executor, are more than its memory has room for beside the heap."""
    import corpus_pipeline

    key, bound = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    docs = spark.range(3_000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 1000) as text", "'en' as lang", "'s' as source", "0L as n_chars").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes for b in batches]})

    few = docs.limit(5)
    for stage in (corpus_pipeline.known_language, corpus_pipeline.without_near_copies, corpus_pipeline.without_repeats, corpus_pipeline.encoded):
        spark.conf.unset(key)
        stage(spark, few, DIR)
        got = [r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()]
        assert sum(got) > 20_000_000 and max(got) <= 1.1 * bound, stage.__name__
    spark.conf.set(key, "1048576")
    corpus_pipeline.encoded(spark, few, DIR)
    assert spark.conf.get(key) == "1048576"  # a bound of the session's own stays
    spark.conf.unset(key)
