"""Greedy tiling against a slow version, planted passages and odd rows."""

import random

import pytest

from waymark.llm import decontaminate
from waymark.llm.decontaminate import Matcher, contaminated, op4_decontaminate, tokens_of


def slow_tiling(doc, item, k):
    """Longest common free stretch, first in item and then in document, until none of k tokens is left."""
    d_marked, i_marked, covered, n_tiles = [False] * len(doc), [False] * len(item), 0, 0
    while True:
        best = (k - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and not i_marked[j + n] and not d_marked[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < k:
            return covered, n_tiles
        for x in range(n):
            d_marked[i + x] = i_marked[j + x] = True
        covered, n_tiles = covered + n, n_tiles + 1


@pytest.mark.parametrize("seed", range(4))
def test_tiling_equals_slow_version(seed):
    rng = random.Random(seed)
    for _ in range(40):
        item = [rng.choice("abc") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(3, 18))]
        doc = [rng.choice("abc") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(item))
            doc[rng.randrange(len(doc) + 1) : 0] = item[a : a + rng.randrange(9)]
        covered, n_tiles = slow_tiling(doc, item, 3)
        got = Matcher([(7, " ".join(item))], 3).find(" ".join(doc), 0.01)
        assert got == ([(7, covered / len(item), covered, len(item), n_tiles)] if covered and len(item) >= 3 else [])


def test_query_equals_containment(spark, sf):
    """On the given tables documents hold items whole or not at all."""
    items = {r.item_id: " ".join(tokens_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(tokens_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {item} " in f" {text} "}
    assert whole and {(r.doc_id, r.item_id) for r in op4_decontaminate(spark, sf).collect()} == whole


@pytest.mark.parametrize("block_tokens", [1_000_000, 60])
def test_reordered_and_partial_passages(spark, monkeypatch, block_tokens):
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", block_tokens)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[[word() for _ in range(8)] for _ in range(4)] for _ in range(6)]
    noise = lambda: [word() for _ in range(40)]
    docs, want = [], set()
    for n, item in enumerate(items):
        shuffled = item[::-1]
        docs.append((n, " ".join(noise() + sum(shuffled, []) + noise()).upper() + "!"))
        want.add((n, n))
        docs.append((100 + n, " ".join(noise() + item[0] + noise())))
        docs.append((200 + n, " ".join(noise() + sum(items[(n + 1) % 6], []) + noise() + sum(item, []))))
        want |= {(200 + n, n), (200 + n, (n + 1) % 6)}
    docs.append((900, " ".join(noise())))
    bench = spark.createDataFrame([(n, ". ".join(" ".join(s) for s in item)) for n, item in enumerate(items)], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two three four five six", "x"), (3, "one two three four five six", "x"), (None, "one two three four five", "x"), (4, "ab " * 60_000, "x")], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(1, "One two, three four five."), (1, "One two, three four five."), (2, "one two"), (3, None), (4, ""), (None, "one two three four five"), (5, "ab " * 40)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.coverage) for r in contaminated(docs, bench).collect())
    assert got == [(0, 1, 1.0)] * 2 + [(3, 1, 1.0)] * 4 + [(4, 5, 1.0)]
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []
