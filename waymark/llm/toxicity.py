"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, of toxic and of ordinary text, predict each character of a word from
up to ORDER - 1 before it, the word's beginning included. Their highest order has
counts of its own for each class; all lower orders are one set of continuation
counts that the classes share, so an expression too rare to be counted for a
class is judged by how words are built in either. A text's evidence is the
difference of its log-likelihoods divided by its number of words, taken over all
words and over those alone whose own difference exceeds SURE nats, which sampling
noise rarely reaches. A logistic curve fitted on sampled documents that the models
have not seen turns evidence into a score.

The sample is bounded: at most SAMPLE_DOCS labelled documents of each class, those
with the smallest hash of the id. Words are counted where the documents are; one
task turns the counts into a table of log-ratios by character sequence, whose size
follows from the sample. Every text is scored whole.

Defined results: a text without words (null, empty, signs only) has evidence 0 and
gets the score that the curve gives there. A label that is null is no label; of
several labels of a document the largest counts. Without labelled documents of
both classes every score is 0.5; without any to calibrate on the curve is a fixed one. Rows are scored one by one, so repeated rows and
null ids are scored as well (a null id is never held out). Other columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm._arrow import columns
from waymark.llm._sample import lowest
from waymark.scratch import Scratch

ORDER = 6
DISCOUNT = 0.75
#: Counts that a class gives up to what the classes share, for each sequence.
CLASS_DISCOUNT = 3.0
SAMPLE_DOCS = 1500
#: Of this many sampled documents one calibrates the score and takes no part in the models.
CALIBRATE_ONE_IN = 4
THRESHOLD = 0.7
SURE = 3.0
CACHE_WORDS = 400_000
START, END = "\x02", "\x03"

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(word: str, order: int) -> list[str]:
    """For each character of the word and its end: it, and what comes before it."""
    marked = START + word + END
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def fit_ratios(counts: Iterable[tuple[str, int, int]], order: int = ORDER, discount: float = DISCOUNT) -> tuple[dict[str, float], dict[str, float]]:
    """From (word, ordinary count, toxic count): log-ratios by seen sequence, and by context
    for a character not seen after it."""
    own = (Counter(), Counter())
    for word, *by_class in counts:
        for gram in _grams(word, order):
            for c in (0, 1):
                if by_class[c]:
                    own[c][gram] += by_class[c]
    # Continuation counts: how many different characters come before a shorter sequence.
    below: list[set[str]] = [set() for _ in range(order + 1)]
    for gram in {*own[0], *own[1]}:
        below[len(gram)].add(gram)
    shared = [Counter() for _ in range(order + 1)]
    for length in range(order, 1, -1):
        for gram in below[length]:
            shared[length - 1][gram[1:]] += 1
        below[length - 1] |= shared[length - 1].keys()
    total, kinds = defaultdict(int), defaultdict(int)
    for level in shared[1:order]:
        for gram, n in level.items():
            total[gram[:-1], len(gram)] += n
            kinds[gram[:-1], len(gram)] += 1
    letters = max(1, len(shared[1]))
    memo: dict[str, float] = {}

    def backed(gram: str) -> float:
        """Shared probability of the last character after the others."""
        if gram in memo:
            return memo[gram]
        if not gram:
            return 1 / letters
        key = (gram[:-1], len(gram))
        lower = backed(gram[1:]) if len(gram) > 1 else 1 / (letters + 1)
        if total[key]:
            lower = (max(shared[len(gram)][gram] - discount, 0) + discount * kinds[key] * lower) / total[key]
        memo[gram] = lower
        return lower

    pooled = own[0] + own[1]
    size, types, spare = (Counter(), Counter(), Counter()), (Counter(), Counter(), Counter()), (Counter(), Counter(), Counter())
    for c, level in enumerate((*own, pooled)):
        for gram, n in level.items():
            h = gram[:-1]
            size[c][h] += n
            types[c][h] += 1
            spare[c][h] += min(n, discount if c == 2 else CLASS_DISCOUNT)

    def together(gram: str) -> float:
        """Probability under both classes together, discounted towards the shared lower orders."""
        h = gram[:-1]
        low = backed(gram[1:])
        return (max(pooled[gram] - discount, 0) + spare[2][h] * low) / size[2][h] if size[2][h] else low

    def likelihood(c: int, gram: str) -> float:
        h = gram[:-1]
        p = together(gram)
        return (max(own[c][gram] - CLASS_DISCOUNT, 0) + spare[c][h] * p) / size[c][h] if size[c][h] else p

    seen = {g: math.log(likelihood(1, g) / likelihood(0, g)) for g in pooled}
    weight = lambda c, h: spare[c][h] / size[c][h] if size[c][h] else 1.0
    unseen = {h: math.log(weight(1, h) / weight(0, h)) for h in size[2]}
    return seen, unseen


class Evidence:
    """Log-ratios of a text's words, with a bounded cache of words."""

    def __init__(self, seen: dict[str, float], unseen: dict[str, float], order: int = ORDER) -> None:
        self.seen, self.unseen, self.order = seen, unseen, order
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        seen, unseen = self.seen, self.unseen
        value = 0.0
        for gram in _grams(word, self.order):
            ratio = seen.get(gram)
            value += unseen.get(gram[:-1], 0.0) if ratio is None else ratio
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = value
        return value

    def __call__(self, text: str | None) -> tuple[float, float]:
        """Per word: the difference over all words, and its excess over SURE."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self.word(w) if v is None else v for w, v in zip(words, found)]
        return math.fsum(found) / len(words), math.fsum(v - SURE for v in found if v > SURE) / len(words)


def features(evidence: np.ndarray) -> np.ndarray:
    """The excess on a scale on which a text's length matters little: texts hold rare expressions at any length."""
    return np.stack([np.ones(len(evidence)), evidence[:, 0], np.log1p(300 * evidence[:, 1])], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> list[float]:
    """Logistic regression by Newton's method with a light ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, texts in columns(batch, "toxic", "text"):
            for label, text in zip(toxic, texts):
                counts[label].update(words_of(text))
    words = list({*counts[0], *counts[1]})
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([counts[0][w] for w in part], pa.int64()), pa.array([counts[1][w] for w in part], pa.int64())], ["word", "n0", "n1"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, int]] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("word", "n0", "n1")))
    if any(n for _, n, _ in rows) and any(n for _, _, n in rows):
        yield pa.record_batch([pa.array([pickle.dumps(fit_ratios(rows))], pa.binary())], ["model"])


def _score(model: bytes, curve: list[float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*pickle.loads(model))
        for batch in batches:
            for ids, texts in columns(batch, "doc_id", "text"):
                found = np.array([evidence(t) for t in texts], float).reshape(-1, 2)
                if curve is None:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "mean", "excess"])
                else:
                    z = np.clip(features(found) @ np.array(curve), -30, 30)
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return run


def _keep(model: bytes, curve: list[float], column: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*pickle.loads(model))
        for batch in batches:
            found = np.array([evidence(t) for (texts,) in columns(batch, column) for t in texts], float).reshape(-1, 2)
            z = np.clip(features(found) @ np.array(curve), -30, 30)
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) < threshold))

    return run


class ToxicityModel:
    """A fitted model: a table of log-ratios and a curve, both of bounded size."""

    def __init__(self, model: bytes | None, curve: list[float] | None) -> None:
        self.model, self.curve = model, curve

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
        spark = docs.sparkSession
        scratch = Scratch(spark, "toxicity")
        marks = (
            labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
            .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
            .groupBy("doc_id")
            .agg(F.max("toxic").alias("toxic"))
        )
        # At most 2 * sample_docs rows whatever the number of labels, so the side can be broadcast.
        sampled = lowest(marks, "toxic", sample_docs, 2)
        sampled = scratch.keep(sampled.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(CALIBRATE_ONE_IN))), "sampled")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = scratch.keep(texts.join(F.broadcast(sampled), "doc_id"), "rows")
        counts = rows.filter("fold > 0").select("toxic", "text").mapInArrow(_count_words, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        made = counts.repartition(1).mapInArrow(_fit, "model binary").collect()
        if not made:
            return cls(None, None)
        model = bytes(made[0].model)
        held = rows.filter("fold = 0")
        shown = held.select("doc_id", "text").mapInArrow(_score(model, None), "doc_id long, mean double, excess double").join(sampled.select("doc_id", "toxic"), "doc_id").collect()
        shown.sort()
        y = np.array([float(r.toxic) for r in shown])
        if not 0 < y.sum() < len(y):
            return cls(model, [-3.0, 0.0, 1.5])
        return cls(model, fit_curve(features(np.array([[r.mean, r.excess] for r in shown])), y))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score`` for each row."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        if self.model is None:
            return rows.select("doc_id", F.lit(0.5).alias("score"))
        return rows.mapInArrow(_score(self.model, self.curve), "doc_id long, score double")

    def keep(self, docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
        """The rows that score less than ``threshold``, whole; each is decided where it is, so nothing is shuffled."""
        if self.model is None:
            return docs if 0.5 < threshold else docs.limit(0)
        return docs.mapInArrow(_keep(self.model, self.curve, text_col, threshold), docs.schema)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = ToxicityModel.fit(docs, labels)
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
