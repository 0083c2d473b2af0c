"""Languages of texts, span by span.

A word's script narrows the candidates to languages that are written in it: those with at
least SCRIPT_SHARE of their letters in it, or all where there is none. A word is a run of
letters, of 40 at most; a longer run, as in scripts without spaces, is several. Each
candidate scores the word by smoothed character trigrams. Viterbi over the words
of a text, with a penalty for each switch of language, labels the spans; the
text's language is the one whose spans hold most letters, and its score is the
share of the letters in them. Texts of a batch go through Viterbi side by side.

The models learn from a bounded sample: of each language at most SAMPLE_DOCS
documents, those with the smallest hash of the id, whole. Words are counted where
the documents are and one task turns the counts into the table.

Defined results: a text that is null or has no letters is ``und`` with score 0,
and so is every text if nothing could be learnt. Equal numbers of letters go to the
language first by name. Rows are judged one by one, so repeated rows and null ids
are judged as well (a null id is never held out, nor learnt from). Other columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm._arrow import columns
from waymark.llm._sample import lowest
from waymark.llm.toxicity import held_out
from waymark.scratch import Scratch

SAMPLE_DOCS = 400
MAX_LANGUAGES = 1000
SWITCH_PENALTY = 9.0
#: Scores of a word's candidates lie within this of the best one's, so that no single word forces a switch.
CLIP = 7.0
#: A language that the word's script rules out lies this far below: more than a switch to another and back.
RULED_OUT = 2.5 * SWITCH_PENALTY
SMOOTH = 2.0
CACHE_WORDS = 300_000
#: Words that go through Viterbi side by side.
BATCH_WORDS = 300_000
#: A language is written in a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
START, END = "\x02", "\x03"

#: First code points of blocks and their scripts; letters before the first are Latin.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF65, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
_FIRST = [a for a, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]{1,40}")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; marks such as raised figures that the pattern lets by make no word alone."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def script_of(word: str) -> str:
    """Of its letters outside Latin the first one's script, else Latin."""
    if word.isascii():
        return "Latin"
    return next((s for c in word if (s := SCRIPTS[bisect_right(_FIRST, ord(c)) - 1][1]) != "Latin"), "Latin")


def fit_table(rows: list[tuple[str, str, int]]) -> dict:
    """From (language, word, count): candidates by script, and log-probabilities by trigram,
    then by its last two characters, then by its last, a number for each language."""
    languages = sorted({lang for lang, _, _ in rows})
    at = {lang: k for k, lang in enumerate(languages)}
    grams: tuple[dict, ...] = tuple(defaultdict(lambda: np.zeros(len(languages))) for _ in range(3))
    scripts = Counter()
    for lang, word, n in rows:
        k = at[lang]
        scripts[lang, script_of(word)] += n * len(word)
        marked = START + START + word + END
        for i in range(2, len(marked)):
            grams[2][marked[i - 2 : i + 1]][k] += n
            grams[1][marked[i - 1 : i + 1]][k] += n
            grams[0][marked[i]][k] += n
    letters = {lang: sum(n for (other, _), n in scripts.items() if other == lang) for lang in languages}
    candidates = defaultdict(lambda: np.zeros(len(languages), bool))
    for (lang, script), n in scripts.items():
        if n >= SCRIPT_SHARE * letters[lang]:
            candidates[script][at[lang]] = True
    total = sum(grams[0].values())
    p1 = {g: (n + SMOOTH / len(grams[0])) / (total + SMOOTH) for g, n in grams[0].items()}
    context = defaultdict(lambda: np.zeros(len(languages)))
    for level in (1, 2):
        for g, n in grams[level].items():
            context[g[:-1]] += n
    p2 = {g: (n + SMOOTH * p1[g[1:]]) / (context[g[:-1]] + SMOOTH) for g, n in grams[1].items()}
    p3 = {g: (n + SMOOTH * p2[g[1:]]) / (context[g[:-1]] + SMOOTH) for g, n in grams[2].items()}
    index, table = [], [np.zeros(len(languages))]
    for level in (p1, p2, p3):
        index.append({g: len(table) + i for i, g in enumerate(level)})
        table += [np.log(p) for p in level.values()]
    return {"languages": languages, "scripts": dict(candidates), "index": index, "table": np.array(table, np.float32)}


class Labeller:
    """Scores of words, with a bounded cache, and Viterbi over texts side by side."""

    def __init__(self, table: dict) -> None:
        self.languages, self.scripts, self.index, self.table = table["languages"], table["scripts"], table["index"], table["table"]
        self.everyone = np.ones(len(self.languages), bool)
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        one, two, three = self.index
        places, starts, allowed = [], [], []
        for word in words:
            marked = START + START + word + END
            starts.append(len(places))
            for i in range(2, len(marked)):
                place = three.get(marked[i - 2 : i + 1])
                if place is None:
                    place = two.get(marked[i - 1 : i + 1])
                    if place is None:
                        place = one.get(marked[i], 0)
                places.append(place)
            allowed.append(self.scripts.get(script_of(word), self.everyone))
        score = np.add.reduceat(self.table[places], starts, axis=0)
        ruled_out = ~np.array(allowed)
        score[ruled_out] = -np.inf
        score = np.maximum(score - score.max(axis=1, keepdims=True), -CLIP)
        score[ruled_out] = -RULED_OUT
        self.ids.update(zip(words, range(len(self.scores), len(self.scores) + len(words))))
        self.scores = np.concatenate([self.scores, score.astype(np.float32)])

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the number of the language of each word."""
        new = list(set().union(*texts).difference(self.ids))
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids, self.scores = {}, self.scores[:0]
            new = list(set().union(*texts))
        if new:
            self._learn(new)
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        longest = int(lengths.max(initial=0))
        if not longest:
            return [np.zeros(0, np.int64) for _ in texts]
        get = self.ids.__getitem__
        flat = np.concatenate([np.fromiter(map(get, texts[i]), np.int32, len(texts[i])) for i in order])
        begin = np.cumsum(lengths) - lengths
        # Texts with a word at place t are the first alive[t] of the order.
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        rows = np.arange(len(texts))
        value = self.scores[flat[begin[: alive[0]]]].copy()
        final = np.zeros((len(texts), len(self.languages)), np.float32)
        moves: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(1, longest):
            n = alive[t]
            if n < len(value):
                final[n : len(value)] = value[n:]
                value = value[:n]
            top = value.argmax(axis=1)
            switched = value[rows[:n], top] - SWITCH_PENALTY
            move = value < switched[:, None]
            value = np.where(move, switched[:, None], value) + self.scores[flat[begin[:n] + t]]
            moves.append((top, move))
        final[: len(value)] = value
        state = final.argmax(axis=1)
        out = np.zeros(len(flat), np.int64)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            out[begin[:n] + t] = state[:n]
            if t:
                top, move = moves[t - 1]
                now = state[:n]
                state[:n] = np.where(move[rows[:n], now], top, now)
        labels: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for k, i in enumerate(order):
            labels[i] = out[begin[k] : begin[k] + lengths[k]]
        return labels

    def spans(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(language, first word, word after the last) of one text."""
        (labels,) = self.label([words])
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
        return [(self.languages[labels[a]], a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def judge(self, texts: list[list[str]]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for words, labels in zip(texts, self.label(texts)):
            if not words:
                names.append("und")
                scores.append(0.0)
                continue
            letters = np.bincount(labels, weights=[len(w) for w in words], minlength=len(self.languages))
            best = int(letters.argmax())
            names.append(self.languages[best])
            scores.append(float(letters[best] / letters.sum()))
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for batch in batches:
        for langs, texts in columns(batch, "lang", "text"):
            for lang, text in zip(langs, texts):
                for word, n in Counter(words_of(text)).items():
                    counts[lang, word] += n
    items = list(counts.items())
    for at in range(0, len(items), 50_000):
        part = items[at : at + 50_000]
        yield pa.record_batch([pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "word", "n"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, str, int]] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")))
    if rows:
        yield pa.record_batch([pa.array([pickle.dumps(fit_table(rows))], pa.binary())], ["model"])


def fit_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes | None:
    scratch = Scratch(docs.sparkSession, "language-id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    chosen = scratch.keep(lowest(rows.select("doc_id", "lang"), "lang", sample_docs, MAX_LANGUAGES), "chosen")
    # At most sample_docs rows for each of MAX_LANGUAGES.
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"])
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    made = counts.repartition(1).mapInArrow(_fit, "model binary").collect()
    return bytes(made[0].model) if made else None


def _predict(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(pickle.loads(model))
        for batch in batches:
            for ids, texts in columns(batch, "doc_id", "text"):
                split = [words_of(t) for t in texts]
                names: list[str] = []
                scores: list[float] = []
                at = 0
                while at < len(split):
                    end, n = at, 0
                    while end < len(split) and (end == at or n + len(split[end]) <= BATCH_WORDS):
                        n += len(split[end])
                        end += 1
                    more = labeller.judge(split[at:end])
                    names += more[0]
                    scores += more[1]
                    at = end
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out("doc_id", 4, 2)
    return predict_languages(docs, fit_languages(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
