"""Toxicity and language: accuracy on documents held out from learning, and odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from waymark.llm._sample import lowest
from waymark.llm.language_id import Labeller, fit_languages, fit_table, op7_language_id, predict_languages, script_of, words_of
from waymark.llm.toxicity import THRESHOLD, Evidence, ToxicityModel, fit_curve, fit_ratios, op6_toxicity
from waymark.llm.toxicity import words_of as toxic_words

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_documents(spark):
    rows = op6_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.toxic for r in got) > 0.85
    assert sum(r.predicted and not r.toxic for r in got) / len(got) < 0.01
    assert rows.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert rows.filter(f"(score >= {THRESHOLD}) <> (predicted = 1)").count() == 0


def test_toxicity_odd_rows(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(["green", "house", "river", "stone", "cloud"]) for _ in range(30))
    texts = [(i, clean() + (" rotten" if i % 2 else ""), "clash") for i in range(80)]
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([*texts, (3, texts[3][1], "clash"), (900, None, None), (901, "", ""), (None, "rotten rotten", ""), (902, "rotten " * 50_000, "")], schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    got = {}
    for r in ToxicityModel.fit(docs, labels).score(docs).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert len(got[3]) == 2 and min(got[3]) > 0.5 > max(got[4]) and got[None][0] > 0.5 and got[902][0] > 0.5
    assert got[900] == got[901] and got[900][0] < 0.5
    empty = docs.limit(0)
    assert ToxicityModel.fit(empty, labels).score(empty).collect() == []
    assert {r.score for r in ToxicityModel.fit(docs, labels.limit(0)).score(docs).collect()} == {0.5}


class SlowKneserNey:
    """The two models by their definition: (word, ordinary count, toxic count), one probability at a time."""

    def __init__(self, rows, order, discount, class_discount):
        self.order, self.d, self.cd = order, discount, class_discount
        self.own = [Counter(), Counter()]
        for word, *n in rows:
            for gram in self.grams(word):
                for c in (0, 1):
                    self.own[c][gram] += n[c]
        self.own = [+x for x in self.own]
        self.pooled = self.own[0] + self.own[1]
        # A shorter sequence is counted by the different characters seen before it.
        self.shared = {order: set(g for g in self.pooled if len(g) == order)}
        self.n = {}
        for length in range(order - 1, 0, -1):
            self.n[length] = Counter(g[1:] for g in self.shared[length + 1])
            self.shared[length] = set(self.n[length]) | {g for g in self.pooled if len(g) == length}
        self.letters = sorted(self.n[1])
        self.memo = {}

    def grams(self, word):
        marked = "\x02" + word + "\x03"
        return [marked[max(0, i - self.order + 1) : i + 1] for i in range(1, len(marked))]

    def after(self, counts, h):
        if (id(counts), h) not in self.memo:
            self.memo[id(counts), h] = [n for g, n in counts.items() if g[:-1] == h]
        return self.memo[id(counts), h]

    def lower(self, gram):
        if not gram:
            return 1 / (len(self.letters) + 1)
        counts = self.n[len(gram)]
        seen = self.after(counts, gram[:-1])
        rest = self.lower(gram[1:])
        return (max(counts[gram] - self.d, 0) + self.d * len(seen) * rest) / sum(seen) if seen else rest

    def together(self, gram):
        seen = self.after(self.pooled, gram[:-1])
        rest = self.lower(gram[1:])
        return (max(self.pooled[gram] - self.d, 0) + sum(min(n, self.d) for n in seen) * rest) / sum(seen) if seen else rest

    def p(self, c, gram):
        seen = self.after(self.own[c], gram[:-1])
        rest = self.together(gram)
        return (max(self.own[c][gram] - self.cd, 0) + sum(min(n, self.cd) for n in seen) * rest) / sum(seen) if seen else rest

    def evidence(self, word):
        return sum(math.log(self.p(1, g) / self.p(0, g)) for g in self.grams(word))


@pytest.mark.parametrize("order", [3, 5])
def test_ratios_are_of_proper_distributions(order):
    """Over all characters after a context, the unknown one included, both models sum to one; log-ratios are theirs."""
    rng = random.Random(order)
    rows = [("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))), rng.choice([0, 1, 5, 40]), rng.choice([0, 0, 2, 9])) for _ in range(60)]
    rows = [r for r in {w: (w, x, y) for w, x, y in rows}.values() if r[1] or r[2]]
    slow = SlowKneserNey(rows, order, 0.75, 3.0)
    contexts = {g[:-1] for g in slow.pooled} | {"\x02dd"[: order - 1], "a" * (order - 1)}
    for h in contexts:
        for c in (0, 1):
            total = sum(slow.p(c, h + x) for x in [*slow.letters, "?"])
            assert total == pytest.approx(1.0, abs=1e-9), (h, c)
    fast = Evidence(*fit_ratios(rows, order=order), order=order)
    for word in [*(r[0] for r in rows), "dcba", "zz", "abz", "q", "aaaaaaa"]:
        assert fast.word(word) == pytest.approx(slow.evidence(word), abs=1e-9)


def test_toxicity_query_equals_a_slow_version(spark):
    """Sample, counts, models, evidence and curve by their definitions, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    held = lambda i, m, r: zlib.crc32(str(i).encode()) % m == r
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and not held(r.doc_id, 3, 1)}
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in docs], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(7, doc_id), 4) AS f").collect()}
    counts = defaultdict(lambda: [0, 0])
    for i, y in labels.items():
        if fold[i]:
            for w in toxic_words(docs[i]):
                counts[w][y] += 1
    slow = SlowKneserNey([(w, *n) for w, n in counts.items()], 6, 0.75, 3.0)
    told = {}

    def features_of(text):
        words = toxic_words(text)
        told.update((w, slow.evidence(w)) for w in set(words) - set(told))
        values = [told[w] for w in words]
        mean, excess = (sum(values) / len(words), sum(v - 3.0 for v in values if v > 3.0) / len(words)) if words else (0.0, 0.0)
        return [1.0, mean, math.log1p(300 * excess)]

    shown = sorted(i for i in labels if not fold[i])
    y = np.array([float(labels[i]) for i in shown])
    curve = fit_curve(np.array([features_of(docs[i]) for i in shown]), y) if 0 < y.sum() < len(y) else [-3.0, 0.0, 1.5]
    rows = op6_toxicity(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        z = float(np.dot(features_of(docs[r.doc_id]), curve))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)
        assert r.held_out == held(r.doc_id, 3, 1) and r.predicted == (r.score >= 0.7)


def test_samples_are_the_lowest_and_no_task_gathers_them(spark):
    rows = spark.range(40_000).selectExpr("id % 39000 AS doc_id", "CASE WHEN id % 100 < 97 THEN 'a' WHEN id % 100 < 99 THEN 'b' ELSE 'c' END AS k").repartition(7)
    got = {(r.k, r.doc_id) for r in lowest(rows, "k", 50, 3).collect()}
    lots = rows.distinct().selectExpr("k", "doc_id", f"pmod(xxhash64(doc_id), {1 << 31}) AS lot").collect()
    want = {(k, i) for k in "abc" for _, i in sorted((r.lot, r.doc_id) for r in lots if r.k == k)[:50]}
    assert got == want and lowest(rows.limit(0), "k", 50, 3).collect() == []
    with pytest.raises(ValueError):
        lowest(rows, "k", 50, 2)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op7_language_id(spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang_pred == r.lang for r in got if r.lang_pred != "und"]) > 0.97


def _slow_viterbi(scores, penalty):
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for t in range(1, n):
        options = value[:, None] - penalty * (1 - np.eye(k))
        back.append(options.argmax(axis=0))
        value = options.max(axis=0) + scores[t]
    state, total = [int(value.argmax())], value.max()
    for b in back[::-1]:
        state.append(int(b[state[-1]]))
    return state[::-1], total


def test_viterbi_is_optimal():
    rng = random.Random(3)
    rows = [(lang, "".join(rng.choice(letters) for _ in range(5)), 3) for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "efghi")) for _ in range(200)]
    labeller = Labeller(fit_table(rows))
    texts = [[rng.choice(rows)[1] for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(60)]
    for words, labels in zip(texts, labeller.label(texts)):
        if not words:
            assert len(labels) == 0
            continue
        scores = labeller.scores[[labeller.ids[w] for w in words]].astype(float)
        value = sum(scores[i, s] for i, s in enumerate(labels)) - 9.0 * int((np.diff(labels) != 0).sum())
        assert value == pytest.approx(_slow_viterbi(scores, 9.0)[1], abs=1e-3)


def slow_language(rows, texts):
    """Language and score of each text, from (language, word, count) by formulas, word by word."""
    languages = sorted({r[0] for r in rows})
    grams, letters = [defaultdict(Counter) for _ in range(3)], defaultdict(Counter)
    for lang, word, n in rows:
        letters[script_of(word)][lang] += n * len(word)
        marked = "\x02\x02" + word + "\x03"
        for i in range(2, len(marked)):
            for k in range(3):
                grams[k][marked[i - k : i + 1]][lang] += n
    size = {lang: sum(x[lang] for x in letters.values()) for lang in languages}

    context = [defaultdict(Counter) for _ in range(3)]
    for k in range(3):
        for g, c in grams[k].items():
            context[k][g[:-1]].update(c)

    def p(g, lang):
        k, low = len(g) - 1, 0.0
        if k:
            low = p(g[1:], lang)
        else:
            low = 1 / len(grams[0])
        return (grams[k][g][lang] + 2.0 * low) / (context[k][g[:-1]][lang] + 2.0)

    known = {}

    def scores(word):
        if word in known:
            return known[word]
        marked, out = "\x02\x02" + word + "\x03", np.zeros(len(languages))
        for i in range(2, len(marked)):
            for k in (2, 1, 0):
                g = marked[i - k : i + 1]
                if g in grams[k]:
                    out += [math.log(p(g, lang)) for lang in languages]
                    break
        allowed = np.array([letters[script_of(word)][lang] >= max(1, 0.01 * size[lang]) for lang in languages])
        allowed = allowed if allowed.any() else ~allowed
        known[word] = np.where(allowed, np.maximum(out - out[allowed].max(), -7.0), -22.5)
        return known[word]

    found = []
    for text in texts:
        words = words_of(text)
        if not words:
            found.append(("und", 0.0))
            continue
        states, _ = _slow_viterbi(np.array([scores(w) for w in words]), 9.0)
        n = Counter()
        for w, k in zip(words, states):
            n[languages[k]] += len(w)
        best = min(n, key=lambda x: (-n[x], x))
        found.append((best, n[best] / sum(n.values())))
    return found


def test_language_query_equals_a_slow_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    counts = Counter((lang, w) for i, text, lang in docs if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 for w in words_of(text))
    want = slow_language([(lang, w, n) for (lang, w), n in counts.items()], [d[1] for d in docs])
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in op7_language_id(spark, sf).collect())
    assert len(got) == len(docs)
    # Sums in another order may settle a tie of spans the other way.
    off = [(g, w) for g, w in zip(got, want) if g[1] != w[0] or abs(g[2] - w[1]) > 1e-6]
    assert len(off) <= 0.01 * len(docs), off[:3]


def test_scripts_rule_languages_out():
    """One word of another script inside a text gets a language of its script, and the text goes on after it."""
    rows = [("de", w, 5) for w in "das haus und der fluss mit steinen am wasser".split()] + [("el", w, 5) for w in "το σπίτι και το ποτάμι με πέτρες".split()]
    labeller = Labeller(fit_table(rows))
    assert [s[0] for s in labeller.spans(words_of("das haus ποτάμι und der fluss"))] == ["de", "el", "de"]


def test_mixed_text_has_spans_and_scripts_narrow():
    rows = [("en", w, 5) for w in "the house and the river with stones".split()] + [("ru", w, 5) for w in "дом река камень вода".split()] + [("fr", w, 5) for w in "la maison des rivières avec une pierre".split()]
    labeller = Labeller(fit_table(rows))
    words = words_of("the house and the river, la maison des rivières avec une pierre дом река вода камень дом")
    assert [s[0] for s in labeller.spans(words)] == ["en", "fr", "ru"]
    assert script_of("дом") == "Cyrillic" and script_of("été") == "Latin" and script_of("a中") == "Han"


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    learn = spark.createDataFrame([(1, "the house and the river", "en", 1), (2, "la maison des rivières", "fr", 1), (3, None, "de", 1), (None, "x", "zz", 1), (4, "y", None, 1)], schema)
    model = fit_languages(learn)
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", None, 1), (3, "12 ²½ !!", None, 1), (4, "the river", None, 1), (4, "the river", None, 1), (None, "maison " * 20_000, None, 1)], schema)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in predict_languages(docs, model).collect())
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert fit_languages(learn.limit(0)) is None
    assert predict_languages(docs.limit(0), model).collect() == []
