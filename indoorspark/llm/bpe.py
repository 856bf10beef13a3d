"""BPE encoding and decoding (operator 1): a minimal acyclic transducer as lexicon, exact merges for other words."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indoorspark.llm.common import stored, table
from indoorspark.llm.words import text_groups

# Fixed value: how the tokenizer cuts a text before merging; white space is Unicode's.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words in the lexicon, and words an encoder keeps in memory; both bound what tasks hold.
LEXICON, KEPT = 50_000, 300_000
# White space, letters and numbers below U+0180. Texts of such characters alone, as most are, are cut by this
# pattern, which gives the same words and takes a third of the time.
_S1, _L1, _N1 = r"\t-\r \x85\xa0", r"A-Za-zªµºÀ-ÖØ-öø-ſ", r"0-9²³¹¼-¾"
CUT_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L1}]+| ?[{_N1}]+| ?[^{_S1}{_L1}{_N1}]+|[{_S1}]+(?![^{_S1}])|[{_S1}]+")
BEYOND = re.compile("[^\0-ſ]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else 256 and on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id, ids of bytes, rank of each merge and the special strings, from a tokenizer's JSON file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate((to_bytes(x), to_bytes(y)) for x, y in merges)}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        # Pairs as one sorted number each, for many words at once.
        self.size = max(self.bytes) + 1
        pairs = sorted((a * self.size + b, r, new) for (a, b), (r, new) in self.ranks.items())
        self.pair, self.rank, self.new = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self._hash_pairs()
        # If no token is used before it is made, all places of a word's best pair can merge in one step.
        made = {new: r for r, new in self.ranks.values()}
        self.ordered = len(made) == len(self.ranks) and all(made.get(t, -1) < r for p, (r, _) in self.ranks.items() for t in p)
        lengths = np.array([len(self.bytes.get(i, b"")) for i in range(self.size)], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(self.size)), np.uint8)

    SLOTS = 20

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _hash_pairs(self) -> None:
        """An open table from pair to place, mostly empty, so that nearly every look-up ends at its first slot."""
        n = 1 << self.SLOTS
        self.table = np.full(n, -1, np.int64)
        left, slot = np.arange(len(self.pair)), self._slot(self.pair)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) % n
        self.pair = np.append(self.pair, -1)  # what an empty slot leads to

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair in the list of merges by pair, -1 for one that isn't there."""
        slot = self._slot(pairs)
        at = self.table[slot]
        odd = np.flatnonzero((at >= 0) & (self.pair[at] != pairs))
        while len(odd):
            slot[odd] = (slot[odd] + 1) % len(self.table)
            at[odd] = self.table[slot[odd]]
            odd = odd[(at[odd] >= 0) & (self.pair[at[odd]] != pairs[odd])]
        return at

    def decode(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at].tobytes().decode("utf-8", "replace")

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words, each as little-endian 32-bit numbers: every step merges each word's best pair."""
        long = [i for i, w in enumerate(words) if len(w) > 200 or not self.ordered]
        out: list = [None] * len(words)
        for i in long:
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        short = np.array([i for i, w in enumerate(words) if out[i] is None], np.int64)
        if not len(short):
            return out
        n = np.array([len(words[i]) for i in short])
        ids = self.single[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), n)
        none = np.int64(1 << 40)
        done_ids, done_owner = [], []
        rank_of = np.append(self.rank, none)
        while len(ids):
            at = self.places(ids[:-1] * self.size + ids[1:])
            at[owner[:-1] != owner[1:]] = -1
            rank = np.append(rank_of[at], none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            more = best < none
            ends = np.r_[first[1:], len(ids)]
            over = np.repeat(~more, ends - first)
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            live = ~over
            hit = (rank == np.repeat(best, ends - first)) & live
            # of places that overlap (a run of one id), every second one, from the left
            place = np.flatnonzero(hit)
            run = np.r_[True, np.diff(place) > 1]
            odd = (np.arange(len(place)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 1
            place = place[~odd]
            ids[place] = self.new[at[place]]
            live[place + 1] = False
            ids, owner = ids[live], owner[live]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        cut = (4 * np.searchsorted(owner[order], np.arange(len(short) + 1))).tolist()
        for i, k in enumerate(short.tolist()):
            out[k] = raw[cut[i] : cut[i + 1]]
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the adjacent pair of least rank, leftmost first, is merged until none is left."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        if len(ids) > 200:
            return self._merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best = min(((ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i : i + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words so long that scanning them for each merge would not end."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            (_, new), i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over bytes whose arcs add up to a word's number, in flat arrays.

    Arcs of a state stand together, sorted by byte: `first[s] .. first[s + 1]`. The number leads to the word's ids.
    """

    FIELDS = (("first", np.int32), ("final", np.uint8), ("label", np.uint8), ("target", np.int32), ("add", np.int32), ("place", np.int32), ("ids", np.uint32), ("root", np.int32))

    @classmethod
    def compile(cls, words: list[tuple[bytes, list[int]]]) -> bytes:
        """The file of sorted, distinct (word, ids): states with the same future are one (shared suffixes)."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(int(key[0]) + sum(counts[t] for _, t in key[1]))
            return register[key]

        path, last = [[False, []]], b""
        for word, _ in [*words, (b"", None)]:
            same = 0 if not word else next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            for _ in word[same:]:
                path.append([False, []])
            if word:
                path[-1][0] = True
            last = word
        root = close(path[0])
        first, label, target, add = [0], [], [], []
        for final, arcs in states:
            below = int(final)
            for byte, to in arcs:
                label.append(byte)
                target.append(to)
                add.append(below)
                below += counts[to]
            first.append(len(label))
        place = np.cumsum([0, *(len(i) for _, i in words)])
        ids = [x for _, i in words for x in i]
        values = (first, [f for f, _ in states], label, target, add, place, ids, [root])
        return b"".join(len(v).to_bytes(8, "little") + (b := np.asarray(v, t).tobytes()) + b"\0" * (-len(b) % 8) for v, (_, t) in zip(values, cls.FIELDS, strict=True))

    def __init__(self, file: str):
        with open(file, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = 0
        for name, kind in self.FIELDS:
            n = int.from_bytes(held[at : at + 8], "little")
            setattr(self, name, np.frombuffer(held, kind, n, at + 8))
            at += 8 + -(-n * np.dtype(kind).itemsize // 8) * 8
        self.root = int(self.root[0])
        # one sorted key for an arc, so that many words step at once by binary search
        self.key = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * 256 + self.label

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that isn't in the lexicon; all words take their next step together."""
        n = np.array([len(w) for w in words], np.int64)
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero(n), 0
        while len(live) and len(self.key):
            want = state[live] * 256 + data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live], number[live] = self.target[at], number[live] + self.add[at]
            depth += 1
            live = live[n[live] > depth]
        known = (state >= 0) & (n > 0) & bool(len(self.key))
        known[known] = self.final[state[known]] == 1
        return np.where(known, number, -1)

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.place[number] : self.place[number + 1]]

    def find_ids(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as little-endian 32-bit numbers; None for one that isn't in the lexicon."""
        ids, place = self.ids.astype("<u4").tobytes(), self.place.tolist()
        return [ids[4 * place[k] : 4 * place[k + 1]] if k >= 0 else None for k in self.find(words).tolist()]


def words_of(text: str) -> list[str]:
    """The tokenizer's words of a text without special strings."""
    return (CUT if BEYOND.search(text) else CUT_LATIN).findall(text)


class Encoder:
    """Whole texts to ids. Words come from the lexicon; others are merged, and the last `kept` are remembered."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer, kept: int = KEPT):
        self.vocabulary, self.lexicon, self.kept = vocabulary, lexicon, kept
        self.pieces: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def words(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if not any(s in text for s in self.vocabulary.special):
            return words_of(text)
        return [w for k, t in enumerate(self.special.split(text)) for w in ([t] if k % 2 else words_of(t))]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of these words: from the lexicon, or else merged, all at once."""
        special, words = self.vocabulary.special, list(words)
        raw = [w.encode() for w in words]
        found = self.lexicon.find_ids(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.vocabulary.merge_all([raw[i] for i in unseen]), strict=True):
            found[i] = ids
        self.pieces.update(zip(words, found, strict=True))
        self.pieces.update((s, i.to_bytes(4, "little")) for s, i in special.items() if s in self.pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        words = [self.words(t) for t in texts]
        new = set().union(*words).difference(self.pieces)
        if len(self.pieces) + len(new) > self.kept:
            self.pieces.clear()
            new = set().union(*words)
        if new:
            self.learn(new)
        get = self.pieces.__getitem__
        return [b"".join(map(get, w)) for w in words]


@lru_cache(maxsize=1)
def encoder_of(tokenizer: str, lexicon: str) -> Encoder:
    """The encoder of files that were shipped to this worker, built once."""
    return Encoder(Vocabulary(SparkFiles.get(tokenizer)), Transducer(SparkFiles.get(lexicon)))


def frequent_words(docs: DataFrame, most: int = LEXICON, held: int = 200_000) -> DataFrame:
    """word: those whose count, over all of docs(text), is high enough that at most `most` are.

    Tasks count before the shuffle, up to `held` words at a time; a histogram of counts (some hundred numbers) gives the least count.
    """

    def counted(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        words: Counter = Counter()
        for b in batches:
            for _, texts in text_groups(b.column(0)):
                for t in texts:
                    words.update(words_of(t))
                if len(words) > held:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 and length(word) <= 64")
    counts = stored(counts.withColumn("level", F.floor(F.log2("n") * 16)), "bpe-counts")
    total, least = 0, None
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = level
    return counts.where(F.lit(False) if least is None else F.col("level") >= least).select("word")


def shipped(spark: SparkSession, file: str) -> str:
    """The name under which tasks find the file."""
    name = os.path.basename(file)
    if name not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(file)
    return name


def ship(spark: SparkSession, tokenizer: str, words: DataFrame) -> tuple[str, str]:
    """Names under which tasks find the tokenizer's file and the lexicon, which one task compiles; both are of bounded size."""
    tokenizer = shipped(spark, tokenizer)

    def run(batches):
        vocabulary = Vocabulary(SparkFiles.get(tokenizer))
        raw = sorted(w.encode() for b in batches for w in b.column(0).to_pylist())
        ids = [np.frombuffer(b, "<u4").tolist() for b in vocabulary.merge_all(raw)]
        yield pa.RecordBatch.from_arrays([pa.array([Transducer.compile(list(zip(raw, ids, strict=True)))], pa.binary())], names=["lexicon"])

    made = words.repartition(1).mapInArrow(run, "lexicon binary").first()
    body = made[0] if made else Transducer.compile([])
    file = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{hashlib.sha256(body).hexdigest()[:16]}.bin")
    with open(file, "wb") as f:
        f.write(body)
    return tokenizer, shipped(spark, file)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def add_ids(docs: DataFrame, tokenizer: str | None = None, most: int = LEXICON, out: str = "ids") -> DataFrame:
    """docs with `out`, the ids of the whole text as binary (little-endian unsigned 32-bit); null text is empty.

    Special strings in a text give their ids. Texts of any length are encoded whole; repeated rows give repeated results.
    A column of that name is replaced; an empty table gives no rows.
    """
    docs = docs.drop(out)
    files = ship(docs.sparkSession, tokenizer or default_tokenizer(), frequent_words(docs, most))

    def run(batches):
        for b in batches:
            encoder, ids = encoder_of(*files), []
            for _, texts in text_groups(b.column("text")):
                ids += encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_rows(docs: DataFrame, tokenizer: str | None = None, most: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the text decoded from them, for every document.

    Null text: no tokens, digests of nothing. Texts of any length are encoded whole. Repeated rows give repeated results;
    other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    files = ship(docs.sparkSession, tokenizer or default_tokenizer(), frequent_words(docs, most))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        for b in batches:
            docs_, encoder = b.column(0).to_pylist(), encoder_of(*files)
            for at, texts in text_groups(b.column(1)):
                ids = encoder.encode(texts)
                back = [encoder.vocabulary.decode(np.frombuffer(i, "<u4")) for i in ids]
                columns = docs_[at : at + len(ids)], [len(i) // 4 for i in ids], [sha(i) for i in ids], [sha(t.encode()) for t in back]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(table(spark, sf_dir, "documents"))
