"""N-gram Jaccard join (operator 8): T-occurrence search over inverted lists, short lists merged, long ones probed."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from dataclasses import dataclass
from itertools import groupby
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.llm.common import components, parts, stored, table
from indoorspark.llm.words import LOWER, batches


@dataclass(frozen=True)
class Join:
    """words: words of a shingle. percent: two sets link when 100 * intersection >= percent * union.

    depth: percent of a set that two linked sets must share among their least hashes (the T of the search).
    long: an inverted list with more members is never gathered in one row; members are looked up in their own sets instead.
    chunk: members of such a list that are indexed together in one task.
    """

    words: int = 4
    percent: int = 85
    depth: int = 5
    long: int = 64
    chunk: int = 400

    def least(self, n: Column) -> Column:
        """Shingles that a set of n shares at least with any it links with."""
        return F.ceil(n * self.percent / 100)

    def shared(self, n: Column) -> Column:
        """T: entries that the heads of two linked sets have in common at least, n being the smaller set's size."""
        return F.greatest(F.lit(1), F.floor(n * self.depth / 100))

    def overlap(self, a: Column, b: Column) -> Column:
        """Least intersection of linked sets of a and b shingles."""
        return F.ceil((a + b) * self.percent / (100 + self.percent))

    def alike(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def head(self, n: int) -> int:
        """Least hashes of a set of n that are its head: whoever links with it shares `shared` of them."""
        return min(n, n - -(-n * self.percent // 100) + max(1, n * self.depth // 100))


def shingle_sets(texts: pa.Array, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; a shorter text's whole sequence is one."""
    for _, w in batches(texts, LOWER):
        at, code = w.grams(k)
        doc = w.doc[at]
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        doc, code = np.r_[doc, short], np.r_[code, w.whole(short)]
        code = code.view(np.int64)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])] if len(doc) else np.zeros(0, bool)
        doc, code = doc[new], code[new]
        cut = np.searchsorted(doc, np.arange(w.n + 1))
        yield from (code[cut[i] : cut[i + 1]] for i in range(w.n))


def class_of(codes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_hash() -> Column:
    return F.xxhash64("text", F.length("text"))


def heads(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, t, n, c, head): hash of the text, set size, class of equal sets (null if empty) and, once a task and class, the set's head."""

    def run(batches_):
        seen = set()
        for b in batches_:
            n, c, h = [], [], []
            for codes in shingle_sets(b.column(1), join.words):
                n.append(len(codes))
                c.append(class_of(codes) if len(codes) else None)
                h.append(codes[: join.head(len(codes))] if c[-1] not in seen else codes[:0])
                seen.add(c[-1])
            head = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in h])].astype(np.int32), pa.array(np.concatenate(h) if h else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64()), head], names=["doc_id", "t", "n", "c", "head"])

    return docs.select("doc_id", "text", text_hash().alias("t")).mapInArrow(run, "doc_id long, t long, n long, c long, head array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(c, n, codes, hot), one row for each of wanted(c, hot), from the text of a document of each; of repeated rows one is taken."""
    by = wanted.join(classes, "c").select(F.col("one.doc_id").alias("_doc"), F.col("one.t").alias("_t"), "c", "hot")

    def run(batches_):
        for b in batches_:
            rows = [(class_of(s), s) for s in shingle_sets(b.column(0), join.words)]
            keep = [(c, s, hot) for (c, s), want, hot in zip(rows, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if c == want]
            codes = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for _, s, _ in keep])].astype(np.int32), pa.array(np.concatenate([s for _, s, _ in keep]) if keep else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in keep], pa.int64()), pa.array([len(s) for _, s, _ in keep], pa.int64()), codes, pa.array([hot for _, _, hot in keep], pa.bool_())], names=["c", "n", "codes", "hot"])

    named = docs.select("doc_id", "text", text_hash().alias("t"))
    texts = named.join(by, named["doc_id"].eqNullSafe(by["_doc"]) & (named["t"] == by["_t"])).select("text", "c", "hot")
    sets = stored(texts.mapInArrow(run, "c long, n long, codes array<long>, hot boolean"), "join-sets")
    rows, distinct = sets.agg(F.count("c"), F.count_distinct("c")).first()
    return sets if rows == distinct else stored(sets.dropDuplicates(["c"]), "join-sets")


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    a = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("codes").alias("sa"))
    b = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").distinct().join(a, "a").join(b, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * join.percent).select("a", "b")


def occurrences(lists: list[list[int]], t: int):
    """(member, how many of the sorted lists it is on) for each member that is on `t` of them at least: DivideSkip.

    The L longest lists are put aside, the more of them the larger t is; the others are merged by a heap, which skips
    what can't be on t - L of them; a member that is on so many is looked up in the long ones by binary search.
    """
    if len(lists) < t:
        return
    if len(lists) == 1:
        yield from ((m, 1) for m in lists[0])
        return
    lists = sorted(lists, key=len)
    cut = len(lists) - aside(t, len(lists[-1]))
    short, long = lists[:cut], lists[cut:]
    least = t - len(long)
    heap = [(m[0], k, 0) for k, m in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        at, moved = heap[0][0], []
        while heap and heap[0][0] == at:
            moved.append(heapq.heappop(heap))
        count, on = len(moved), at + 1
        if count >= least:
            if count + len(long) >= t:
                for other in long:
                    i = bisect_left(other, at)
                    count += i < len(other) and other[i] == at
                if count >= t:
                    yield at, count
        else:  # no member before the least-th head can be on enough lists: skip to that head
            moved += [heapq.heappop(heap) for _ in range(min(len(heap), least - 1 - count))]
            if not heap:
                return
            on = heap[0][0]
        for _, k, i in moved:
            i = bisect_left(short[k], on, i)
            if i < len(short[k]):
                heapq.heappush(heap, (short[k][i], k, i))


def aside(t: int, longest: int) -> int:
    """How many of the longest lists a search for t occurrences puts aside to be probed."""
    return min(t - 1, int(t / (0.01 * log2(longest + 1) + 1)))


class DivideSkip:
    """T-occurrence search over the inverted lists of some whole sets: (class, sorted hashes) each.

    The lists stand one after another, sorted by hash and member, so that one sort merges all short lists of a query and
    one binary search probes all long ones for all members that are left.
    """

    def __init__(self, members: list[tuple[int, np.ndarray]], percent: int):
        self.percent, self.members = percent, members
        self.sizes = np.array([len(codes) for _, codes in members], np.int64)
        codes, of = np.concatenate([c for _, c in members]) if members else np.zeros(0, np.int64), np.repeat(np.arange(len(members)), self.sizes)
        order = np.lexsort((of, codes))
        self.hashes, self.first, self.length = np.unique(codes[order], return_index=True, return_counts=True)
        self.of = of[order]
        self.key = np.repeat(np.arange(len(self.hashes)), self.length) * max(1, len(members)) + self.of

    def search(self, codes: np.ndarray) -> np.ndarray:
        """Places of the members that link with the set."""
        n, t, none = len(codes), -(-len(codes) * self.percent // 100), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, codes), max(0, len(self.hashes) - 1))
        lists = at[self.hashes[at] == codes] if len(self.hashes) else none
        if not n or len(lists) < t:
            return none
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        cut = len(lists) - aside(t, int(self.length[lists[-1]]))
        short, long = lists[:cut], lists[cut:]
        size = self.length[short]
        entries = self.of[np.repeat(self.first[short] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        found, count = np.unique(entries, return_counts=True)
        found, count = found[count >= t - len(long)], count[count >= t - len(long)]
        need = -(-(n + self.sizes[found]) * self.percent // (100 + self.percent))
        found, count, need = (x[count + len(long) >= need] for x in (found, count, need))
        probe = long[:, None] * len(self.members) + found
        place = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
        return found[count + (self.key[place] == probe).sum(axis=0) >= need]


def asked(posts: DataFrame, asks: Column, meets, join: Join) -> DataFrame:
    """Candidate pairs (a, b) by T-occurrence search, for posts (h, c, n, far, ...) whose lists have up to `long` members.

    Each list goes, less what its reader needn't meet, to each of its members that asks. Reader by reader (with its
    lists only, as many as its set has entries) the lists are merged. Those of more than `long` members are not there: a
    reader on `far` of them needs so many common entries less. meets(reader, member) says who is looked for.
    """
    member = F.struct(*[x for x in posts.columns if x != "h"])
    lists = posts.groupBy("h").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    rows = lists.select(F.explode("members").alias("reader"), "members").where(asks)
    met = F.filter("members", lambda m: meets(F.col("reader"), m))
    rows = rows.select(F.col("reader.c").alias("q"), F.col("reader.far").alias("far"), F.least("reader.n", F.array_min(F.transform(met, lambda m: m["n"]))).alias("low"), F.array_sort(F.transform(met, lambda m: m["c"])).alias("members")).where(F.size("members") > 0)

    def run(batches_):
        def each():
            for b in batches_:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        a, b = [], []
        for q, own in groupby(each(), key=lambda r: r[0]):
            own = list(own)
            t = max(1, max(1, min(r[2] for r in own) * join.depth // 100) - own[0][1])
            found = [m for m, _ in occurrences([r[3] for r in own], t)]
            a += [q] * len(found)
            b += found
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = rows.repartition(parts(posts.sparkSession), "q").sortWithinPartitions("q").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def search_lists(lists: DataFrame, sets: DataFrame, join: Join) -> DataFrame | None:
    """Links (a, b) between members of one long list that earlier links have not joined; None if there are no such lists.

    lists: (h, c, n, root). The members outside the list's largest component are the queries. Members are dealt out by
    the logarithm of their size, and in chunks of `join.chunk`; a query meets those of the sizes it can link with. A task
    holds one chunk's index and one chunk of queries.
    """
    sizes = lists.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size"))
    tops = sizes.groupBy("h").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    tops = stored(tops.select("h", F.col("top.root").alias("top"), F.ceil((F.col("m") - F.col("top.size")) / join.chunk).alias("asked")), "join-tops")
    if tops.isEmpty():
        return None
    rows = lists.withColumn("band", F.floor(F.log(F.col("n") + 1e-9) / log(100 / join.percent)).cast("long")).join(tops, "h").join(sets.select("c", "codes"), "c")
    bands = rows.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / join.chunk).alias("chunks"))
    spread = lambda k: F.pmod(F.xxhash64("c"), F.col(k))
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    index = rows.join(bands, ["h", "band"]).select("h", "band", spread("chunks").alias("i"), upto("asked").alias("j"), F.lit(False).alias("ask"), "c", "root", "codes")
    ask = rows.where("root <> top").withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    ask = ask.join(bands, ["h", "band"]).select("h", "band", upto("chunks").alias("i"), spread("asked").alias("j"), F.lit(True).alias("ask"), "c", "root", "codes")

    def run(group: pa.Table) -> pa.Table:
        ask, c, root = (group[k].to_pylist() for k in ("ask", "c", "root"))
        codes = [np.asarray(x.values) for x in group["codes"].combine_chunks()] if group.num_rows else []
        index, roots = DivideSkip([(c[k], codes[k]) for k in range(len(c)) if not ask[k]], join.percent), dict(zip(c, root, strict=True))
        seen, links = set(), []
        for k in (k for k in range(len(c)) if ask[k]):
            for at in index.search(codes[k]):
                other = index.members[at][0]
                if roots[other] != root[k] and (root[k], roots[other]) not in seen:
                    seen.add((root[k], roots[other]))
                    links.append((c[k], other))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return index.unionByName(ask).groupBy("h", "band", "i", "j").applyInArrow(run, "a long, b long")


def link(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: see labelled."""
    return labelled(docs, join).select("doc_id", "n_shingles", "component_id")


def hot_links(sets: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For classes that are mostly on long lists: candidate pairs (a, b), pairs with the leader of each list that is long
    here too, and those lists (h, c, n).

    They are sorted anew, by their rarest shingles of all: linked ones share one of the n - least(n) + 1 rarest.
    """
    n = F.col("n")
    every = sets.where("hot").select("c", "n", F.explode("codes").alias("h"))
    rare = stored(every.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "join-rare")
    ordered = every.join(rare, "h").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("rarest"))
    front = ordered.select("c", "n", F.posexplode(F.slice("rarest", 1, n - join.least(n) + 1)).alias("place", "x")).where("x.df > 1")
    front = stored(front.select(F.col("x.h").alias("h"), "c", "n", "place", F.lit(0).alias("far")), "join-front")
    size = front.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    few, many = (front.join(size.where(w).select("h"), "h", "left_semi") for w in (f"size <= {join.long}", f"size > {join.long}"))
    bound = lambda q, m: F.least(q["n"] - q["place"], m["n"] - m["place"]) >= join.overlap(q["n"], m["n"])
    pairs = asked(few, F.lit(True), lambda q, m: (m["c"] > q["c"]) & join.alike(q["n"], m["n"]) & bound(q, m), Join(words=join.words, percent=join.percent, depth=0))
    many = stored(many, "join-many")
    leaders = many.groupBy("h").agg(F.min(F.struct("place", "c")).alias("lead")).select("h", F.col("lead.c").alias("a"))
    star = many.join(leaders, "h").where("a <> c").select("a", F.col("c").alias("b"))
    return pairs, star, many.select("h", "c", "n")


def labelled(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, root (of the component, null if the text is empty) and component_id of every document.

    Equal sets are one class, whose head (its least hashes) is posted to inverted lists. A class on too few lists drops
    out. Of linked sets the heads have T entries in common at least; a class on F < T lists of more than `long` members
    asks its shorter ones for members that are on T - F of them (`asked`). What is mostly on long lists is met from its
    partners' side, and among its like through the lists of its rarest shingles (`hot_links`); members of lists that are
    long there too are linked to one leader each, then searched for links between what is still apart (`search_lists`).
    Candidates are verified on whole sets.
    Null or empty text: size 0, a component of its own. Null doc_ids link but give no component_id (null if
    no member has an id). Repeated rows give repeated results; other columns, whatever their names, are ignored; texts
    of any length are read whole; an empty table gives no rows. Ties of hashes, sizes and places are broken by class.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(heads(docs, join).withColumn("at", F.monotonically_increasing_id()), "join-heads")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    at = F.when(F.size("head") > 0, F.col("at"))
    classes = stored(rows.where("c is not null").groupBy("c").agg(one.alias("one"), F.min(at).alias("first"), F.count(at).alias("heads")), "join-classes")
    # heads are the bulk: they stay where they are, and only those of a class that another task has too are left out
    headed = rows.where(F.size("head") > 0)
    again = headed.select("c", "at").join(classes.where("heads > 1").select("c", "first"), "c").where("at <> first").select("at")
    again = stored(again, "join-again")
    posts = headed if again.isEmpty() else headed.join(again, "at", "left_anti")
    posts = posts.select("c", "n", F.explode("head").alias("h"))
    lists = stored(posts.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-lists")
    met = posts.join(lists, "h").groupBy("c", "n").agg(F.collect_list(F.struct((F.col("size") > join.long).alias("far"), "h")).alias("on"))
    n, need = F.col("n"), join.shared(join.least(F.col("n")))
    far = F.size(F.filter("on", lambda x: x["far"]))
    near = F.transform(F.filter("on", lambda x: ~x["far"]), lambda x: x["h"])
    known = stored(met.where(F.size("on") >= need).select("c", "n", far.alias("far"), (far >= need).alias("hot"), near.alias("near")), "join-known")
    first_is_less = lambda q, m: (m["n"] > q["n"]) | ((m["n"] == q["n"]) & (m["c"] > q["c"]))
    pairs = asked(known.select(F.explode("near").alias("h"), "c", "n", "far", "hot"), ~F.col("reader.hot"), lambda q, m: (m["hot"] | first_is_less(q, m)) & join.alike(q["n"], m["n"]), join)
    pairs, hot = stored(pairs, "join-pairs"), not known.where("hot").isEmpty()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.lit(False).alias("hot")).unionByName(known.where("hot").select("c", "hot"))
    wanted = wanted.groupBy("c").agg(F.max("hot").alias("hot"))
    sets = sets_of(docs, wanted, classes.select("c", "one"), join)
    if hot:
        close, star, many = hot_links(sets, join)
        pairs = stored(pairs.unionByName(close), "join-pairs")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(verified(first.unionByName(star) if hot else first, sets, join), "join-links")
    roots = stored(components(links, "join-roots", rounds=None if hot else 2), "join-roots")
    # what these links have not joined
    root_of = lambda of: roots.select(F.col("node").alias(of), F.col("root").alias(f"root_{of}"))
    apart = pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")
    apart = stored(apart.distinct(), "join-apart")
    links = links if apart.isEmpty() else links.unionByName(verified(apart, sets, join))
    if hot:
        more = search_lists(many.join(roots.withColumnRenamed("node", "c"), "c", "left").select("h", "c", "n", F.coalesce("root", "c").alias("root")), sets, join)
        links = links if more is None else links.unionByName(more)
    roots = components(links, "join-roots").withColumnRenamed("node", "c")
    classes = classes.select("c", F.col("one.doc_id").alias("first_doc")).join(roots, "c", "left").select("c", "first_doc", F.coalesce("root", "c").alias("root"))
    least = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    final = classes.join(least, "root").select("c", "root", "component_id")
    out = rows.select("doc_id", "t", F.col("n").alias("n_shingles"), "c").join(final, "c", "left")
    return out.select("doc_id", "t", "n_shingles", "root", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
