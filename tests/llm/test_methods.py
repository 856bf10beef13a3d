"""The methods against plainer, slower ones."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from indoorspark.llm import bpe, jaccard_join, language, licenses, sharding, substring, words
from indoorspark.llm.common import components, ranked, slots


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_encoder_is_exact(tokenizer, tmp_path):
    vocabulary = bpe.Vocabulary(bpe.default_tokenizer())
    lexicon = sorted([b" the", b" then", b" and", b"the", b",", b" nation"])
    body = bpe.Transducer.compile([(w, vocabulary.merge(w)) for w in lexicon])
    (tmp_path / "lexicon").write_bytes(body)
    transducer = bpe.Transducer(str(tmp_path / "lexicon"))
    assert [i is None for i in transducer.find_ids([b" the", b" th", b"", b" then", b" thens"])] == [False, True, True, False, True]
    encoder, rnd = bpe.Encoder(vocabulary, transducer, kept=500), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "​", "\xa0", "the", " and", "é", "'s", "9", "½", "!", "<|endoftext|>", "日本", "\r\n", "😀", "\x00", "aaaa", "x" * 250, "́", "क्ष", ", ", "."]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(4000)]
    for some in (texts[:2000], texts[2000:]):
        for text, ids in zip(some, encoder.encode(some), strict=True):
            ids = np.frombuffer(ids, "<u4")
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and vocabulary.decode(ids) == text


def test_transducer_shares_suffixes():
    words_ = sorted(a + b for a in (b"walk", b"talk", b"bark") for b in (b"", b"s", b"ed", b"ing"))
    body = bpe.Transducer.compile([(w, [i]) for i, w in enumerate(words_)])
    first = int.from_bytes(body[:8], "little")
    assert first - 1 < 16  # a trie would have more than 30 states


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t, k)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets}


def edited(rnd, base, n):
    w = list(base)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return w


@pytest.mark.parametrize("long", [2, 64])
def test_join_finds_every_link(spark, long):
    rnd = random.Random(long)
    make = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    passage, texts = make(60), []
    for _ in range(4):  # groups of near copies, some with a passage that all groups share
        base = make(rnd.randint(5, 150)) + passage[: rnd.choice([0, 60])]
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 4))) for _ in range(30)]
    texts += [" ".join(make(rnd.randint(1, 40)) + passage) for _ in range(20)] + ["a b", "A  b", "a b c", "", None]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    for k, percent in ((4, 85), (5, 80)):
        join = jaccard_join.Join(words=k, percent=percent, long=long, chunk=7)
        got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), join)
        assert {tuple(r) for r in got.collect()} == brute(rows, k, percent)


def test_repeated_rows_and_ids_keep_their_links(spark):
    rnd = random.Random(8)
    make = lambda n: [f"w{rnd.randrange(9000)}" for _ in range(n)]
    passage, texts = make(120), []
    for _ in range(30):  # pairs that share a passage with all others, each row four times
        base = make(25)
        texts += [" ".join(edited(rnd, base, 1) + passage), " ".join(edited(rnd, base, 1) + passage)]
    join = jaccard_join.Join(words=4, percent=90, long=2, chunk=7)
    rows = [r for r in enumerate(texts) for _ in range(4)]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), join).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == brute(list(enumerate(texts)), 4, 90)
    odd = texts[1::2]  # null ids link too: each even one, with its like of a null id, makes a component of its own
    got = jaccard_join.link(spark.createDataFrame([(None, t) for t in odd] * 2 + [(d, texts[d]) for d in range(0, 60, 2)], "doc_id long, text string"), join).collect()
    want = {d: c for d, _, c in brute(list(enumerate(texts)), 4, 90)}
    assert len(got) == 90 and Counter(r["component_id"] for r in got) == Counter(None if c % 2 else c for d, c in want.items() for _ in range(2 if d % 2 else 1))


def test_near_copies_go_by_id_and_text(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (1, c), (1, c), (3, b), (1, c + " end"), (None, "null " + a[:30]), (None, "null " + b[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in corpus_pipeline.without_near_copies(spark, df, "").collect())
    ends = [(1, t) for t in (c, c + " end") if got.pop((1, t), 0) == 1]
    assert len(ends) == 1 and got == Counter([(1, a), (1, b), (None, "null " + a[:30]), (None, "null " + b[:30])])


def test_divide_skip_equals_brute_force():
    rnd = random.Random(5)
    sets = [(i, np.array(sorted(rnd.sample(range(60), rnd.randint(1, 40))))) for i in range(150)]
    index = jaccard_join.DivideSkip(sets, 60)
    for _, q in sets:
        want = {c for c, s in sets if 100 * len(set(q) & set(s)) >= 60 * len(set(q) | set(s))}
        assert {index.members[i][0] for i in index.search(q)} == want
    assert not len(index.search(np.zeros(0, np.int64))) and not len(jaccard_join.DivideSkip([], 60).search(np.array([3])))
    for _ in range(300):
        lists = [sorted(rnd.sample(range(30), rnd.randint(1, 20))) for _ in range(rnd.randint(1, 15))]
        t, count = rnd.randint(1, 12), Counter(x for found in lists for x in found)
        assert sorted(jaccard_join.occurrences(lists, t)) == sorted((x, n) for x, n in count.items() if n >= t)


@pytest.mark.parametrize("group", [3, 1000])  # with 3, most prefixes are lengthened
def test_substring_equals_brute_force(spark, group):
    rnd = random.Random(9)
    passages = [[f"p{rnd.randrange(50)}" for _ in range(rnd.randint(10, 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += rnd.choice(passages)[rnd.randint(0, 5) :] + [f"f{rnd.randrange(9999)}" for _ in range(rnd.randint(0, 9))]
        texts.append(" ".join(w))
    texts += texts[:5]
    seen, want = {}, set()
    for d, t in enumerate(texts):
        w = t.split()
        gone, own = set(), set()
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            own.add(key)
            if key in seen:
                gone |= set(range(i, i + 13))
        for k in own:
            seen.setdefault(k, d)
        want.add((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=group)
    assert {tuple(r) for r in got.select("doc_id", "_words", "_removed", "_kept").collect()} == want


def test_subtree_is_sorted_and_knows_common_words():
    rnd = np.random.RandomState(7)
    group, rows = rnd.randint(-1, 2, 300), rnd.randint(-1, 2, (300, 5))
    order, lcp = substring.subtree(group, rows)
    whole = [(int(group[i]), *map(int, rows[i])) for i in order]
    unsigned = lambda t: tuple(x % (1 << 64) for x in t)
    assert whole == sorted(whole, key=unsigned) and sorted(order.tolist()) == list(range(300))
    for i in range(1, 300):
        same = [a == b for a, b in zip(whole[i], whole[i - 1], strict=True)]
        assert lcp[i] == (same + [False]).index(False) - 1


def test_language_learns():
    rnd = np.random.RandomState(0)
    alphabets = ["aeiou bcdf", "aeou klmnz"]
    model = language.Ftrl(2)
    sample = [(language.grams("".join(rnd.choice(list(alphabets[k % 2]), 80))), k % 2) for k in range(300)]
    idf = np.ones(language.BUCKETS, np.float32)
    for (at, tf), y in sample[:200]:
        model.learn(at, language.weighted(at, tf, idf), y)
    w = model.weights()
    assert np.mean([(language.weighted(at, tf, idf) @ w[at]).argmax() == y for (at, tf), y in sample[200:]]) > 0.95
    assert (w == 0).mean() > 0.5  # the penalty leaves most weights at none


def test_language_stage_keeps_clean_documents(spark):
    import corpus_pipeline

    texts = ["some words", "zwei Wörter", "日本", "12 34", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, df, "").collect()} == {0, 1, 2}
    rnd = random.Random(3)
    common, own = ["das", "les", "uno", "the", "ett"], "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(1200):  # 12 languages that share most words: a right one has a low probability
        k = i % 12
        rows.append((i, " ".join([*rnd.choices(common, k=8), *(own[rnd.choice([k, k + 1, k + 2])] * 3 for _ in range(2))]), f"l{k:02}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    right = language.add_language(df, model).where("lang_pred = lang").cache()
    assert right.where("score < 0.4").count() > 20 and 0 < model["least"] < 0.4  # an absolute cut of 0.4 would lose these
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, df, "").collect()}
    assert {r["doc_id"] for r in right.where(F.col("score") >= model["least"]).collect()} <= kept


def test_automaton_matches_are_longest():
    rnd = random.Random(2)
    seqs = [[rnd.randrange(4) for _ in range(30)] for _ in range(3)]
    automaton, text = licenses.Automaton(seqs), [rnd.randrange(5) - (rnd.random() < 0.1) * 9 for _ in range(300)]
    stretches = {tuple(s[i:j]) for s in seqs for i in range(30) for j in range(i + 1, 31)}
    for start, end, state in automaton.matches(text, 3):
        assert tuple(text[start:end]) in stretches
        assert end == len(text) or tuple(text[start : end + 1]) not in stretches
        assert start == 0 or tuple(text[start - 1 : end]) not in stretches
        assert all(seqs[t][e - (end - start) : e] == text[start:end] for t, e in automaton.ends[state].items())


def test_license_scan_labels():
    s = licenses.Scanner()
    text = "x CC-BY, All rights  Reserved. all rights reserved; " + licenses.TEMPLATES["mit"].upper() + " y"
    n, base, first, last, labels, every, score = s.scan(text.encode())
    assert (base, first, last, labels) == (3, 1, 6, "cc-by,reserved") and every == "cc-by,mit,reserved" and score == 1.0


def test_words_and_grams():
    import pyarrow as pa

    texts = ["a b  c", None, "", "b c a b c", "ab"]
    ((_, w),) = words.batches(pa.array(texts))
    assert w.count.tolist() == [3, 0, 0, 5, 1] and w.code[0] == w.code[5] != w.code[1] and w.code[1] == w.code[3]
    at, code = w.grams(3)
    assert at.tolist() == [0, 3, 4, 5] and len(set(code.tolist())) == 3 and code[0] == code[3]


def test_nul_is_a_byte_of_a_word():
    import pyarrow as pa

    texts = ["a\0b c", "\0", "a\0", "b", "\0a", "a", "\0\0", "\x7f"]
    ((_, w),) = words.batches(pa.array(texts))
    assert w.count.tolist() == [len(t.encode().split()) for t in texts]
    assert len(set(w.code[2:].tolist())) == len(texts) - 1  # "a\0" is not "b", nor "\0" "\0\0"
    ((_, w),) = words.batches(pa.array(["A\0B", "a\0b"]), words.LOWER)
    assert w.code[0] == w.code[1]


def test_nul_in_shared_passages(spark):
    passage = " ".join(f"w{i}\0x" for i in range(20))
    rows = [(0, f"one {passage}"), (1, f"\0 two\0 {passage} three"), (2, passage.replace("\0", " ")), (3, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["_words"], r["_removed"], r["_kept"]) for r in substring.removed(df).collect()}
    assert got == {0: (21, 0, rows[0][1]), 1: (23, 20, "\0 two\0 three"), 2: (40, 0, rows[2][1]), 3: (20, 20, "")}
    for k, percent in ((4, 85), (5, 80)):
        got = jaccard_join.link(df, jaccard_join.Join(words=k, percent=percent))
        assert {tuple(r) for r in got.collect()} == brute(rows, k, percent)


@pytest.mark.parametrize(("loose", "cut"), [(0, 39), (400, 0)])
def test_shards_gather_copies_when_most_rows_have_one(spark, loose, cut):
    texts = [f"pair {i}" for i in range(500)] * 2 + [f"ten {i}" for i in range(100)] * 10 + [f"one {i}" for i in range(loose)]
    rows = [r.asDict() for r in sharding.shard_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    found = {}
    for r in rows:
        found.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert set(Counter(r["shard"] for r in rows).values()) == {len(texts) // 40}
    assert sum(len(s) > 1 for s in found.values()) <= cut


def test_components_ranks_and_slots(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {tuple(r) for r in got.collect()} == {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, v int")
    assert sorted(r["at"] for r in ranked(df, ["v"], "at", "test").collect() if r["v"] == r["at"]) == list(range(100))
    numbered = Counter((r["g"], r["s"]) for r in slots(df, "g", [df["v"]], "s", rows_each=10).collect())
    assert numbered == Counter((g, s) for g, n in ((0, 34), (1, 33), (2, 33)) for s in range(n))


def test_license_notices_of_the_given_table(spark):
    from indoorspark.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.join(licenses.scan_rows(docs), "doc_id").select("text", "labels").collect()
    want = {"Released under the MIT License": "mit", "Licensed under the Apache License, Version 2.0": "apache-2.0", "GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc"}
    met = Counter(label for text, labels in rows for line, label in want.items() if text and line in text and label in labels.split(","))
    assert met == Counter(label for text, _ in rows for line, label in want.items() if text and line in text) and len(met) == 4
    assert not any(labels for text, labels in rows if text and not any(x in text.lower() for x in ("licen", "rights reserved", "cc by")))


def test_base_phrases_equal_brute_force():
    rnd, s = random.Random(6), licenses.Scanner()
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC-BY", "All rights", "x", "Éa", "12"]
    for _ in range(300):
        text = " ".join(rnd.choices(bits, k=rnd.randint(0, 30)))
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text)
        words_ = [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
        places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words_)) if words_[i : i + len(p.split())] == p.split())
        n, base, first, last, labels, *_ = s.scan(text.encode())
        assert (n, base, first, last) == (len(words_), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert labels == ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("ids", ["spread", "outlier", "gaps", "equal", "null"])
def test_followers_whatever_the_ids(spark, ids):
    from indoorspark.llm import fingerprint

    rnd, n = random.Random(1), 600
    make = {"spread": lambda i: i, "outlier": lambda i: i if i else (1 << 63) - 1, "gaps": lambda i: -(1 << 63) + i % 7 * (1 << 59) + i, "equal": lambda i: 5 if i % 3 else i, "null": lambda i: None if i % 3 else i}[ids]
    rows = [(make(i), f"text {rnd.random()} of {i}\n" * 3) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = fingerprint.with_next(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r[1] for r in sizes) < 2 * n / 4
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    want = Counter()
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 2
        e = t[: len(t) - k] + after[:k]
        own, new, nxt = fingerprint.fingerprints(__import__("pyarrow").array([t, e, after], "large_string"))
        near = lambda a, b: round(float(fingerprint.likeness(a[None], b[None])[0]), 9)
        want[d, __import__("hashlib").sha256(e.encode()).hexdigest(), near(own, new), near(own, nxt)] += 1
    assert Counter((r["doc_id"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprint.edit_rows(df).collect()) == want


@pytest.mark.parametrize("label", ["mit", "bsd", "isc", "zlib", "unlicense", "gpl", "lgpl", "agpl", "apache-2.0"])
def test_licence_with_words_lost_and_put_in_is_spanned(label):
    s, rnd = licenses.Scanner(), random.Random(label)
    whole = licenses.TEMPLATES[label].split()
    prose = lambda n: [f"prose{rnd.randrange(99)}" for _ in range(n)]
    for lost in (0, 13, 10):  # one word in so many is lost, and another is put in elsewhere
        body, stretches = [], [0]  # stretches: template words that stand unbroken
        for i, w in enumerate(whole):
            if lost and i % lost == lost - 1 and w not in ("lesser", "affero"):  # without these the words are another licence's
                stretches.append(0)
                continue
            body.append(w)
            stretches[-1] += 1
            if lost and i % lost == lost // 2 and i % 3 == 0:
                body.append("x")
                stretches.append(0)
        covered = sum(n for n in stretches if n >= s.least) / len(whole)
        words_ = prose(50) + body + prose(30)
        *_, base, every, score = s.scan(" ".join(words_).title().encode())
        assert label in every.split(",") and set(every.split(",")) == {label} | set(base.split(",") if base else ()), (lost, every)
        t = s.names.index(label)
        found = [x for x in s.spans([s.ids.get(w.encode(), -1) for w in words_]) if x[0] == t and x[3] >= 0.5]
        assert len(found) == 1 and found[0][1] <= 50 + 12 and found[0][2] >= 50 + len(body) - 12 and score >= found[0][3] >= covered - 1e-9 and covered > 0.7
    assert label not in s.scan(" ".join(whole[: len(whole) // 2 - 5]).encode())[5].split(",") or label == "gpl"  # less than half is no licence


def longest_matches(s, words_):
    """(template, longest match at each word), by comparing with every place of every template."""
    out = []
    for t, name in enumerate(s.names[: s.whole]):
        seq = licenses.TEMPLATES[name].split()
        run = lambda i, j, seq=seq: next((k for k in range(len(seq) - j) if i + k >= len(words_) or words_[i + k] != seq[j + k]), len(seq) - j)
        best = [max((run(i, j) for j in range(len(seq))), default=0) for i in range(len(words_))]
        out.append((t, best))
    return out


def test_matching_statistics_equal_brute_force():
    rnd, templates = random.Random(12), dict(list(licenses.TEMPLATES.items())[:3])
    s = licenses.Scanner()
    for _ in range(4):
        words_ = []
        for _ in range(5):
            seq = rnd.choice(list(templates.values())).split()
            at = rnd.randrange(len(seq) - 20)
            words_ += seq[at : at + rnd.randint(3, 20)] + [f"y{rnd.randrange(5)}"] * rnd.randint(0, 2)
        ids = [s.ids.get(w.encode(), -1) for w in words_]
        met = {(a, b) for a, b, state in s.automaton.matches(ids, 4)}
        longest = [max(best[i] for _, best in longest_matches(s, words_)) for i in range(len(words_))]
        want = {(i, i + n) for i, n in enumerate(longest) if n >= 4 and (i == 0 or longest[i - 1] <= n)}
        assert want <= met and all(longest[a] == b - a or b - a > longest[a] for a, b in met)
        spanned = [s.spans(ids), s.best(s.spans(ids))]
        assert set(spanned[1]) <= set(spanned[0])


def test_decisions_travel_over_links(spark):
    """Thousands of pages whose verdict is decided by their links alone, a hub that a third of them point at, and chains."""
    from indoorspark.llm import url_filter

    rnd, pages, links = random.Random(3), [], []
    add = lambda url, to=None: pages.append((len(pages), url, f'<link rel="canonical" href="{to}">' if to else None))
    for g in range(300):  # groups of ten sites in a chain; some end at a blocked, an allowed or both kinds of page
        hosts = [f"http://g{g}s{i}.test/p" for i in range(10)]
        ends = [f"http://g{g}.net/x"] * (g % 3 == 1 or g % 6 == 2) + [f"http://g{g}.example.net/en/x"] * (g % 6 == 2 or g % 6 == 5)
        for a, b in zip(hosts, hosts[1:], strict=False):
            add(a, b) if rnd.random() < 0.5 else add(b, a)
        for e in ends:
            add(e, rnd.choice(hosts))
    for i in range(1500):
        add(f"http://hub{i}.test/a", "http://zz.net/hub")
    got = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in url_filter.judge(got).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, url, html in pages:
        if html:
            root[find(url)] = find(html.split('href="')[1].split('"')[0])
    rule = lambda url: "allow" if "example.net/en/" in url else "block" if ".net/" in url else None
    groups = {}
    for _, url, _ in pages:
        groups.setdefault(find(url), set()).add(rule(url))
    for page, url, _ in pages:
        seen = groups[find(url)]
        want = rule(url) or ("block" if "block" in seen and "allow" not in seen else "allow")
        assert got[page]["verdict"] == want, url
    decided = sum(got[p]["rule"] is None and got[p]["verdict"] == "block" for p, _, _ in pages)
    assert len(got) == len(pages) and decided > 800
