"""Stupid-backoff scores of all documents under the counts of all other documents.

For a word w after v, with counts c' over the other documents and N' their words:
S(w|v) = c'(vw)/c'(v) if c'(vw) > 0, else BACKOFF * S(w); S(w) = c'(w)/N' if
c'(w) > 0, else 1/(N' + 1). A document's first word scores S(w). The score is the
mean of the natural logarithms.

A table of word counts is summed over the corpus. Documents are exploded into bigrams with
their counts in the document: a row holds those of some documents that fall
into one bucket of the bigrams' hashes, column by column and packed. Bucket by bucket the bigrams' counts are summed over all
documents and joined to the exploded bigrams. A bigram of a document then needs the count of one
word more: that of v if other documents have the bigram, else that of w. Where a task does
not know it, it is summed by word and document and joins the table of word counts. At last all
is summed by document, which a number stands for until then: a text meets a bucket about once in a
large corpus, so hashes of texts would be most of what is moved and summed. A bucket holds about BUCKET_WORDS bigrams, so there are as many as the
corpus asks for and a task holds one at a time.

No key is hot. Words with FREQUENT_WORD of all words, and bigrams with FREQUENT_PAIR of
those of a bounded sample, are at most 1 / FREQUENT_WORD and 1 / FREQUENT_PAIR many whatever
the corpus; their counts, summed over all texts where the words are, go to the tasks, which
settle what needs no other. So a word that moves has less than that share of the words,
and a bigram hardly more.

Defined results: words are split at ASCII blanks and A-Z lower-cased. A text
without words (null included) has 0 words and score 0. Every row is a document of
its own, repeated rows and null ids too; rows of equal text have equal scores, the mean of
theirs. Texts are numbered in the order of their hashes in a partition, so a task may be repeated. Other columns
are ignored. An empty table gives an empty table. Words, bigrams and texts are told apart by
64 bits of hash: of 10^13 bigrams one in two million meets another's count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm._arrow import columns
from waymark.scratch import Scratch

BACKOFF = 0.4
#: Shares of all words from which the counts of a word and of a bigram are known to all tasks.
FREQUENT_WORD, FREQUENT_PAIR = 5e-7, 1e-6
#: Words of the corpus for each bucket of bigrams.
BUCKET_WORDS = 1_800_000
#: Different words that a task numbers before it starts anew.
VOCABULARY = 250_000
#: Code points of the sample of texts that shows which bigrams are likely to be frequent, and its seed.
SAMPLE_CHARS, SEED = 40_000_000, 11
#: Bytes of a batch of texts or of exploded bigrams.
BATCH_BYTES = 8 << 20
#: Code points of text that a task explodes at once.
SLICE_CHARS = 1_500_000
#: Exploded bigrams that a task deals to buckets at once, so that a row has many of a bucket.
HELD = 1_500_000
#: A row of exploded bigrams is bytes: the number of the first of the texts held, then how far each of its texts is from the one
#: before, and by bigram how far its text is in the row's texts from that of the one before, its and its
#: words' counts in the text, which words are known (1: the first, 2: the second), and each word's place in the table that all
#: tasks have, or its hash if it is not there.
TEXT = {"skip": np.dtype(np.int32), "n_words": np.dtype(np.int32)}
GRAM = {"step": np.dtype(np.int32), "n": np.dtype(np.int32), "own_v": np.dtype(np.int32), "own_w": np.dtype(np.int32), "known": np.dtype(np.uint8), "v": np.dtype(np.int64), "w": np.dtype(np.int64)}
CODEC = pa.Codec("zstd", compression_level=1)
#: What a task settled itself, a value for each of its documents, and first words with a count that is not known.
TOLD = {"told_t": pa.int64(), "told_uid": pa.int64(), "told": pa.float64(), "told_words": pa.int32()}
FIRST = {"first": pa.int64(), "first_t": pa.int64(), "first_own": pa.int64(), "first_words": pa.int32()}
ROWS = (
    "bucket long, grams binary, told_t array<long>, told_uid array<long>, told array<double>, told_words array<int>, "
    "first array<long>, first_t array<long>, first_own array<long>, first_words array<int>"
)
#: Sums by number of text, and for each word u whose count is lacking how often its logarithm is taken off and added.
SUMS = {"u": pa.int64(), "t": pa.int64(), "uid": pa.int64(), "s": pa.float64(), "own": pa.int64(), "minus": pa.int64(), "plus": pa.int64(), "n_words": pa.int64()}
SUM_ROWS = "u long, t long, uid long, s double, own long, minus long, plus long, n_words long"


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    z = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x632BE59BD9B4E019))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Counts:
    """Counts by hash, of which all tasks have the same few."""

    def __init__(self, rows: pa.Table) -> None:
        keys = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], rows.column("n").to_numpy()[order]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the table, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def hashes(self, places: np.ndarray) -> np.ndarray:
        """Hashes by place, any where it is not known."""
        return np.append(self.keys, np.uint64(0))[places]

    def at(self, places: np.ndarray) -> np.ndarray:
        """Counts by place, -1 where it is not known."""
        return np.where(places >= 0, np.append(self.n, -1)[places], -1)


class Texts:
    """Words of a slice of texts as numbers, with the hash of each number's word."""

    def __init__(self, most: int) -> None:
        self.most, self.epoch, self.numbers, self.hashes = most, 0, _Numbers(), np.zeros(0, np.uint64)

    def read(self, texts: list[str | None]) -> None:
        if len(self.numbers) > self.most:
            self.epoch, self.numbers, self.hashes = self.epoch + 1, _Numbers(), self.hashes[:0]
        numbers = self.numbers
        split = [(t or "").encode().lower().split() for t in texts]
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(self.lengths.sum()))
        if len(numbers) > len(self.hashes):
            words = list(numbers)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))])
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        inner = np.ones(len(self.ids), bool)
        inner[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = False
        #: Places of words that have one before them, and of those that have none.
        self.inner, self.first = np.flatnonzero(inner), np.flatnonzero(~inner)

    def pairs(self) -> np.ndarray:
        return _pair_hash(self.hashes[self.ids[self.inner - 1]], self.hashes[self.ids[self.inner]])


def _counted(kind: int, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(n), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "h", "n"])


def _sampled_pairs(most: int):
    """kind 0: how many words there are; kind 1: bigrams that occur again in a slice, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(most)
        for batch in batches:
            for (some,) in columns(batch, "text", chars=SLICE_CHARS):
                texts.read(some)
                pairs, n = np.unique(texts.pairs(), return_counts=True)
                yield _counted(0, np.zeros(1, np.uint64), np.array([len(texts.ids)]))
                yield _counted(1, pairs[n > 1], n[n > 1])

    return run


def _survey(wanted, most: int):
    """kind 0: words and their counts; kind 1: counts of the bigrams in ``wanted``, a broadcast sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, total, known = Texts(most), np.zeros(0, np.int64), wanted.value
        held = np.zeros(len(known), np.int64)
        for batch in batches:
            for (some,) in columns(batch, "text", chars=SLICE_CHARS):
                if len(texts.numbers) > most:
                    yield _counted(0, texts.hashes, total)
                    total = np.zeros(0, np.int64)
                texts.read(some)
                here = np.bincount(texts.ids, minlength=len(texts.numbers))
                here[: len(total)] += total
                total = here
                if len(known):
                    pairs = texts.pairs()
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    held += np.bincount(at[known[at] == pairs], minlength=len(known))
        yield _counted(0, texts.hashes, total)
        yield _counted(1, known[held > 0], held[held > 0])

    return run


def _planes(columns: dict[str, np.ndarray], kinds: dict[str, np.dtype]) -> bytes:
    """First bytes of all of a column's values, then second ones: high bytes of small numbers are all alike."""
    return b"".join(columns[c].astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes() for c, kind in kinds.items())


def _packed(base: int, texts: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> bytes:
    sizes = np.array([base, len(texts["skip"]), len(grams["n"])], np.int64)
    return sizes.tobytes() + CODEC.compress(_planes(texts, TEXT) + _planes(grams, GRAM), asbytes=True)


def _unpacked(row: bytes) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Texts, with their numbers as t, and bigrams."""
    (base, *sizes), at, found = np.frombuffer(row, np.int64, 3).tolist(), 0, []
    size = sum(n * kind.itemsize for n, kinds in zip(sizes, (TEXT, GRAM)) for kind in kinds.values())
    planes = np.frombuffer(CODEC.decompress(row[24:], size, asbytes=True), np.uint8)
    for n, kinds in zip(sizes, (TEXT, GRAM)):
        found.append({})
        for c, kind in kinds.items():
            found[-1][c] = np.ascontiguousarray(planes[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind)[:, 0]
            at += n * kind.itemsize
    found[0]["t"] = base + np.cumsum(found[0].pop("skip"), dtype=np.int64)
    return found[0], found[1]


class _Waiting:
    """Bigrams that wait for their counts, of some slices of texts."""

    def __init__(self, buckets: int, base: int) -> None:
        self.buckets, self.base, self.slices, self.size, self.n_texts = buckets, base, [], 0, 0

    def add(self, g: dict[str, np.ndarray], waits: np.ndarray, lengths: np.ndarray) -> None:
        bucket = (g["k"][waits] >> np.uint64(20)) % np.uint64(self.buckets)
        pv, pw = g["pv"][waits], g["pw"][waits]
        some = {
            "order": (bucket * np.uint64(4)).astype(np.min_scalar_type(4 * self.buckets)), "doc": g["doc"][waits].astype(np.int32) + np.int32(self.n_texts), "known": ((pv >= 0) + 2 * (pw >= 0)).astype(np.uint8),
            "v": np.where(pv >= 0, pv, g["v"][waits].view(np.int64)), "w": np.where(pw >= 0, pw, g["w"][waits].view(np.int64)),
        } | {c: g[c][waits].astype(np.int32) for c in ("n", "own_v", "own_w")}
        some["order"] += some["known"]
        self.slices.append((some, lengths))
        self.size += len(waits)
        self.n_texts += len(lengths)

    def rows(self) -> pa.RecordBatch:
        """A row for each bucket, and nothing waits any more."""
        g = {c: np.concatenate([some[c] for some, _ in self.slices]) for c in self.slices[0][0]}
        lengths, base = np.concatenate([x for _, x in self.slices]), self.base
        self.base, self.slices, self.size, self.n_texts = base + self.n_texts, [], 0, 0
        order = np.argsort(g["order"], kind="stable")
        bucket = g.pop("order")[order] // 4
        g = {c: x[order] for c, x in g.items()}
        names, begin = np.unique(bucket, return_index=True)
        packed = []
        for a, b in zip(begin, np.append(begin, len(bucket))[1:]):
            row = {c: x[a:b] for c, x in g.items()}
            here = np.zeros(len(lengths), bool)
            here[row["doc"]] = True
            row["step"] = np.diff((np.cumsum(here) - 1)[row["doc"]], prepend=0)
            packed.append(_packed(base, {"skip": np.diff(np.flatnonzero(here), prepend=0), "n_words": lengths[here]}, row))
        return _rows(names.astype(np.int64), pa.array(packed, pa.binary()))


def _rows(bucket: np.ndarray, grams: pa.Array, lists: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of ROWS; ``lists`` are the values of TOLD and FIRST of a single row."""
    kinds = [*TOLD.values(), *FIRST.values()]
    if lists is None:
        rest = [pa.nulls(len(bucket), pa.list_(kind)) for kind in kinds]
    else:
        rest = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(kind)) for x, kind in zip(lists, kinds)]
    return pa.record_batch([pa.array(bucket), grams, *rest], ["bucket", "grams", *TOLD, *FIRST])


def _sums(**columns: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMS; a column that is not given is null for u and uid and zero for others."""
    size = len(columns["t"])
    rest = {name: pa.nulls(size, kind) if name in ("u", "uid") else pa.array(np.zeros(size), kind) for name, kind in SUMS.items() if name not in columns}
    return pa.record_batch([pa.array(columns[name]).cast(kind) if name in columns else rest[name] for name, kind in SUMS.items()], list(SUMS))


def _log_alone(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """ln S(w) from the word's count in other documents and their words."""
    return np.where(x > 0, np.log(np.maximum(x, 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1.0))


def _prepared(texts: Texts, places: np.ndarray, words: Counts, pairs: Counts) -> dict[str, np.ndarray]:
    """The bigrams of some documents, and x: each word's count in other texts, or minus that in its own where no more is known."""
    ids, doc = texts.ids, texts.doc
    _, word, own = np.unique(doc * len(texts.numbers) + ids, return_inverse=True, return_counts=True)
    own, place = own[word], places[ids]
    x = np.where(place >= 0, words.at(place) - own, -own)
    hashes = texts.pairs()
    distinct, number = np.unique(hashes, return_inverse=True)
    _, one, n = np.unique(doc[texts.inner] * len(distinct) + number, return_index=True, return_counts=True)
    at, d = texts.inner[one], doc[texts.inner[one]]
    return {
        "k": hashes[one], "pv": place[at - 1], "pw": place[at], "n": n, "own_v": own[at - 1], "own_w": own[at],
        "xv": x[at - 1], "xw": x[at], "n_words": texts.lengths[d], "v": texts.hashes[ids[at - 1]], "w": texts.hashes[ids[at]], "doc": d, "x": x, "c": pairs.at(pairs.places(hashes[one])),
    }


class _Known:
    """Places of words in the table that all tasks have, by their numbers in ``texts``."""

    def __init__(self, texts: Texts, counts: Counts) -> None:
        self.texts, self.counts, self.epoch, self.n = texts, counts, 0, np.zeros(0, np.int64)

    def __call__(self) -> np.ndarray:
        if self.epoch != self.texts.epoch:
            self.n, self.epoch = self.n[:0], self.texts.epoch
        self.n = np.concatenate([self.n, self.counts.places(self.texts.hashes[len(self.n) :])])
        return self.n


def _settled(g: dict[str, np.ndarray]) -> np.ndarray:
    """Bigrams of which all is known that their score needs."""
    return (g["c"] >= 0) & np.where(g["c"] > g["n"], g["xv"] >= 0, g["xw"] >= 0)


def _worth(g: dict[str, np.ndarray], all_words: int) -> np.ndarray:
    """Scores of bigrams by their count; the logarithm of a word's count that is lacking is left out."""
    alone = math.log(BACKOFF) + np.where(g["xw"] >= 0, _log_alone(g["xw"], all_words - g["n_words"]), 0.0)
    joint = np.log(np.maximum(g["c"] - g["n"], 1)) - np.log(np.maximum(g["xv"], 1))
    return g["n"] * np.where(g["c"] > g["n"], joint, alone)


def _explode(buckets: int, all_words: int, words, pairs, most: int):
    """Rows of ROWS: bigrams that wait for their counts, by bucket, and for each slice of texts one row of what is settled.

    Texts are numbered as they come, which must be the same when a task is repeated: they are sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(most)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        known, waiting = _Known(texts, words.value), _Waiting(buckets, number)
        for batch in batches:
            for uids, some in columns(batch, "uid", "text", chars=SLICE_CHARS):
                texts.read(some)
                uids, t = np.array(uids, np.int64), number + np.arange(len(uids))
                number += len(uids)
                g = _prepared(texts, known(), words.value, pairs.value)
                settled = _settled(g)
                sums = np.bincount(g["doc"][settled], weights=_worth(g, all_words)[settled], minlength=len(some)).astype(float)
                first, d = g["x"][texts.first], texts.doc[texts.first]
                sums[d] += np.where(first >= 0, _log_alone(first, (all_words - texts.lengths)[d]), 0.0)
                lacks, f = first < 0, d[first < 0]
                lone = (texts.hashes[texts.ids[texts.first[lacks]]].view(np.int64), t[f], -first[lacks], texts.lengths[f])
                home = int(uids[0]) % buckets if len(uids) else 0
                yield _rows(np.array([home]), pa.nulls(1, pa.binary()), [t[d], uids[d], sums[d], texts.lengths[d], *lone])
                waiting.add(g, np.flatnonzero(~settled), texts.lengths)
                del g
                if waiting.size >= HELD:
                    yield waiting.rows()
        if waiting.size:
            yield waiting.rows()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that arrive sorted by bucket, a bucket at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column("bucket")[0].as_py() != names[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _summed(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each value, the sum over all of its key."""
    _, number = np.unique(keys, return_inverse=True)
    return np.bincount(number, weights=n).astype(np.int64)[number]


def _met(rows: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Texts and bigrams of a bucket's rows; doc is the place of a bigram's text among those."""
    texts, grams, n = [], [], 0
    for row in rows:
        t, g = _unpacked(row)
        g["doc"] = np.cumsum(g.pop("step"), dtype=np.int64) + n
        n += len(t["t"])
        texts.append(t)
        grams.append(g)
    joined = lambda some: {c: np.concatenate([x.pop(c) for x in some]) for c in list(some[0])}
    return joined(texts), joined(grams)


def _join(all_words: int, words):
    """Rows of SUMS of each bucket: bigrams are counted over all documents and joined to their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            told = {c: table.column(c).combine_chunks().flatten().to_numpy() for c in [*TOLD, *FIRST]}
            rows = table.column("grams").drop_null().to_pylist()
            del table
            yield _sums(t=told["told_t"], uid=told["told_uid"], s=told["told"], n_words=told["told_words"])
            yield _sums(u=told["first"], t=told["first_t"], own=told["first_own"], plus=np.ones(len(told["first"]), np.int64), n_words=told["first_words"])
            if not rows:
                continue
            texts, g = _met(rows)
            del rows
            counts, (kv, kw) = words.value, (g["known"] & 1 > 0, g["known"] & 2 > 0)
            pv, pw = np.where(kv, g["v"], -1), np.where(kw, g["w"], -1)
            g["xv"], g["xw"] = np.where(kv, counts.at(pv), 0) - g["own_v"], np.where(kw, counts.at(pw), 0) - g["own_w"]
            g["c"] = np.zeros(len(kv), np.int64)
            # Places tell bigrams of known words apart, hashes the others.
            both = np.flatnonzero(kv & kw)
            g["c"][both] = _summed(pv[both] << 32 | pw[both], g["n"][both])
            rest = np.flatnonzero(~(kv & kw))
            v, w = (np.where(known[rest], counts.hashes(places[rest]), g[c][rest].view(np.uint64)) for known, places, c in ((kv, pv, "v"), (kw, pw, "w")))
            g["c"][rest] = _summed(_pair_hash(v, w), g["n"][rest])
            del kv, kw, pv, pw, both, rest, v, w
            g["n_words"] = texts["n_words"][g["doc"]]
            yield _sums(t=texts["t"], s=np.bincount(g["doc"], weights=_worth(g, all_words), minlength=len(texts["t"])))
            seen = g["c"] > g["n"]
            lacks = np.where(seen, g["xv"], g["xw"]) < 0
            seen, g = seen[lacks], {c: x[lacks] for c, x in g.items()}
            own = -np.where(seen, g["xv"], g["xw"])
            yield _sums(u=np.where(seen, g["v"], g["w"]), t=texts["t"][g["doc"]], own=own, minus=np.where(seen, g["n"], 0), plus=np.where(seen, 0, g["n"]), n_words=g["n_words"])

    return run


def _alone(others: Column, rest: Column) -> Column:
    """ln S(w) from the word's count in other documents and their words."""
    return F.when(others > 0, F.log(others) - F.log(rest)).otherwise(-F.log(rest + 1))


@contextmanager
def _batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches between Spark and Python of at most so many bytes, unless a row is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent_word: float = FREQUENT_WORD, frequent_pair: float = FREQUENT_PAIR, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``doc_id, n_words, score`` for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("uid", F.xxhash64("text"))
    # Texts and rows of bigrams are long, so that batches of the usual size would be held several times over.
    with _batches_of(spark, BATCH_BYTES):
        # Which bigrams are likely to be frequent is read off a bounded sample; their counts are of all texts.
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        sampled = texts.select("text").sample(min(1.0, SAMPLE_CHARS / max(1, chars)), SEED).mapInArrow(_sampled_pairs(VOCABULARY), "kind int, h long, n long")
        sampled = scratch.keep(sampled.groupBy("kind", "h").agg(F.sum("n").alias("n")), "sampled")
        sampled_words = sampled.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
        likely = sampled.filter((F.col("kind") == 1) & (F.col("n") >= max(2.0, frequent_pair * sampled_words))).select("h").toArrow().column("h")
        wanted = spark.sparkContext.broadcast(np.sort(likely.to_numpy().view(np.uint64)))
        surveyed = scratch.keep(texts.select("text").mapInArrow(_survey(wanted, VOCABULARY), "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "survey")
        words = surveyed.filter("kind = 0").select("h", "n")
        all_words = words.agg(F.sum("n")).first()[0] or 0
        # Each side is bounded by the shares, whatever the corpus.
        known_words = Counts(words.filter(F.col("n") >= max(1.0, frequent_word * all_words)).toArrow())
        known_pairs = Counts(surveyed.filter("kind = 1").select("h", "n").toArrow())
        tables = spark.sparkContext.broadcast(known_words), spark.sparkContext.broadcast(known_pairs)
        buckets = all_words // bucket_words + 1
        rows = texts.select("uid", "text").sortWithinPartitions("uid")
        exploded = rows.mapInArrow(_explode(buckets, all_words, *tables, VOCABULARY), ROWS).repartition("bucket").sortWithinPartitions("bucket")
        met = scratch.keep(exploded.mapInArrow(_join(all_words, tables[0]), SUM_ROWS), "joined")
    others = F.col("c") - F.col("own")
    taken = F.when(F.col("minus") > 0, -F.col("minus") * F.log(others)).otherwise(0.0)
    added = F.when(F.col("plus") > 0, F.col("plus") * _alone(others, F.lit(all_words) - F.col("n_words"))).otherwise(0.0)
    # Words that are looked up here are rare, so no key of this join is hot.
    lacking = met.filter("u IS NOT NULL").drop("s")
    looked_up = lacking.join(words.select(F.col("h").alias("u"), F.col("n").alias("c")), "u").select("t", "uid", (taken + added).alias("s"), "n_words")
    by_number = met.filter("u IS NULL").select("t", "uid", "s", "n_words").unionByName(looked_up).groupBy("t").agg(F.max("uid").alias("uid"), F.sum("s").alias("s"), F.max("n_words").alias("n_words"))
    # Written, so that either side of the join is a plain exchange and a text that many rows have can be split.
    sums = scratch.keep(by_number.groupBy("uid").agg(F.max("n_words").alias("n_words"), F.avg(F.col("s") / F.col("n_words")).alias("score")), "sums")
    uids = scratch.keep(texts.select("doc_id", "uid"), "uids")
    return uids.join(sums, "uid", "left").select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP5_SQL = r"""
WITH lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), tokens AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM lists
), places AS (
  SELECT doc_id, pos, n, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM tokens
), total AS (SELECT count(*) AS n FROM tokens),
uni AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
uni_own AS (SELECT doc_id, w, count(*) AS c FROM tokens GROUP BY doc_id, w),
bi AS (SELECT v, w, count(*) AS c FROM places WHERE v IS NOT NULL GROUP BY v, w),
bi_own AS (SELECT doc_id, v, w, count(*) AS c FROM places WHERE v IS NOT NULL GROUP BY doc_id, v, w),
counted AS (
  SELECT p.doc_id, p.pos, p.v, t.n - p.n AS rest, u.c - uo.c AS cw, x.c - xo.c AS cv, coalesce(b.c - bo.c, 0) AS cb
  FROM places p, total t
  JOIN uni u ON u.w = p.w JOIN uni_own uo ON uo.doc_id = p.doc_id AND uo.w = p.w
  LEFT JOIN uni x ON x.w = p.v LEFT JOIN uni_own xo ON xo.doc_id = p.doc_id AND xo.w = p.v
  LEFT JOIN bi b ON b.v = p.v AND b.w = p.w LEFT JOIN bi_own bo ON bo.doc_id = p.doc_id AND bo.v = p.v AND bo.w = p.w
), scored AS (
  SELECT doc_id,
         CASE WHEN cb > 0 THEN ln(cb) - ln(cv)
              ELSE CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END
                   + CASE WHEN cw > 0 THEN ln(cw) - ln(rest) ELSE -ln(rest + 1.0) END END AS s
  FROM counted
)
SELECT l.doc_id, CAST(len(l.ws) AS BIGINT) AS n_words, round(coalesce(avg(s), 0), 6) AS score
FROM lists l LEFT JOIN scored USING (doc_id) GROUP BY l.doc_id, len(l.ws)
"""
