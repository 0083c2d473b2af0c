"""Scores against counting by hand, over chunks of several sizes."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from waymark.llm import lm_score
from waymark.llm.lm_score import lm_scores


def by_hand(texts):
    docs = [(t or "").encode().lower().split() for t in texts]
    uni, bi = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:]))
    out = []
    for d in docs:
        u, b, rest, total = Counter(d), Counter(zip(d, d[1:])), sum(uni.values()) - len(d), 0.0
        for n, w in enumerate(d):
            c = uni[w] - u[w]
            s = c / rest if c else 1 / (rest + 1)
            if n:
                v = d[n - 1]
                pair = bi[v, w] - b[v, w]
                s = pair / (uni[v] - u[v]) if pair else 0.4 * s
            total += math.log(s)
        out.append((len(d), total / len(d) if d else 0.0))
    return out


@pytest.mark.parametrize("word_share,pair_share,bucket_words,vocabulary", [(4e-6, 2e-5, 10**6, 10**6), (0.05, 0.06, 100, 3), (2.0, 2.0, 3, 10**6), (1e-9, 2.0, 50, 5), (0.01, 0.02, 20, 10**6)])
def test_scores_equal_counting(spark, monkeypatch, word_share, pair_share, bucket_words, vocabulary):
    """All words and bigrams known to the tasks, some of them, and none."""
    monkeypatch.setattr(lm_score, "VOCABULARY", vocabulary)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdeFGh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += [None, "", "lonely", "a", " \t a\nA b ", *texts[:3], *texts[:3]]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(3)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_scores(frame, frequent_word=word_share, frequent_pair=pair_share, bucket_words=bucket_words).collect()}
    want = by_hand(texts)
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(want):
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-9)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert lm_scores(spark.createDataFrame([], schema)).collect() == []
    alone = lm_scores(spark.createDataFrame([(1, "a b a")], schema)).collect()
    assert alone[0].score == pytest.approx(math.log(0.4) * 2 / 3)
    rows = lm_scores(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b " * 30_000)], schema)).collect()
    assert sorted(r.n_words for r in rows) == [2, 2, 60_000] and all(math.isfinite(r.score) for r in rows)


class Held:
    """What a broadcast gives to tasks."""

    def __init__(self, value):
        self.value = value


def exploded(texts, known, buckets):
    """Batches of exploded bigrams, the first ``known`` words being in the table that tasks have."""
    split = [t.lower().split() for t in texts]
    words = Counter(w for d in split for w in d)
    table = pa.table({"h": pa.array(np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64).view(np.int64)), "n": pa.array([words[w] for w in known], pa.int64())})
    none = lm_score.Counts(pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}))
    batch = pa.record_batch([pa.array([random.Random(n).getrandbits(63) for n in range(len(texts))], pa.int64()), pa.array(texts)], ["uid", "text"])
    out = list(lm_score._explode(buckets, sum(words.values()), Held(lm_score.Counts(table)), Held(none), 10**6)(iter([batch])))
    return out, sum(len(set(zip(d, d[1:]))) for d in split)


def test_exploded_bigrams_take_few_bytes():
    """They are most of what is on disk: whole columns of numbers took 32 bytes a bigram of known words, 56 of others."""
    rng = random.Random(4)
    names = [f"w{n}" for n in range(4000)]
    texts = [" ".join(rng.choice(names) for _ in range(400)) for _ in range(300)]
    for known, most in ((names, 12), ([], 24)):
        batches, bigrams = exploded(texts, known, 4)
        assert sum(b.nbytes for b in batches) < most * bigrams


def test_all_bigrams_are_exploded_however_they_are_held(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(50)] + ["", "a", "a b " * 70_000]
    found = []
    for held, chars in ((1, 100), (10**6, 10**6), (40, 300)):
        monkeypatch.setattr(lm_score, "HELD", held)
        monkeypatch.setattr(lm_score, "SLICE_CHARS", chars)
        batches, bigrams = exploded(texts, list("abc"), 5)
        found.append(Counter())
        for row in (r for b in batches for r in b.column("grams").drop_null().to_pylist()):
            t, g = lm_score._unpacked(row)
            doc = np.cumsum(g["step"])
            found[-1].update(zip(t["t"][doc].tolist(), t["n_words"][doc].tolist(), *(g[c].tolist() for c in ("n", "own_v", "own_w", "known", "v", "w"))))
        assert len(found[-1]) == found[-1].total() == bigrams
    assert found[0] == found[1] == found[2]
    assert max(n for _, _, n, *_ in found[0]) == 70_000


def test_exploded_bigrams_take_few_bytes_in_many_buckets():
    """In a large corpus a text meets a bucket once: its hash beside each bigram took more than the bigram."""
    rng = random.Random(6)
    names = [f"w{n}" for n in range(4000)]
    texts = [" ".join(rng.choice(names) for _ in range(400)) for _ in range(300)]
    batches, bigrams = exploded(texts, names, 1000)
    assert sum(b.nbytes for b in batches) < 9 * bigrams
