"""Near copies by similarity against the Jaccard similarity of all pairs."""

import math
import random

import pytest

from waymark.llm import simhash
from waymark.llm.simhash import first_of_groups, simhash_groups


def shingles(text, ngram=5):
    words = text.lower().split()
    return {tuple(words[i : i + ngram]) for i in range(max(1, len(words) - ngram + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def slow_groups(docs, similarity=0.8):
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in docs}
    links = [(a, b) for a in docs for b in docs if a < b and jaccard(sets[a], sets[b]) >= similarity]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def edited(rng, words, similarity):
    """A copy with words changed until one more would fall below the similarity."""
    base, copy = shingles(" ".join(words)), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        tried = list(copy)
        tried[at] = f"x{rng.getrandbits(40)}"
        if jaccard(base, shingles(" ".join(tried))) < similarity:
            break
        copy = tried
    return copy


def made(rng, n):
    return [f"w{rng.getrandbits(40)}" for _ in range(n)]


def groups(spark, docs):
    rows = simhash_groups(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: r.component_id for r in rows}


@pytest.mark.parametrize("similarity", [0.8, 0.7])
def test_pairs_at_the_limit(spark, similarity):
    """All pairs at 0.8 or just above are joined, those between 0.7 and 0.8 are not."""
    rng, docs = random.Random(11), {}
    for n in range(150):
        words = made(rng, rng.choice([60, 150, 400, 900]))
        docs[2 * n] = " ".join(words)
        docs[2 * n + 1] = " ".join(edited(rng, words, similarity))
    assert groups(spark, docs) == slow_groups(docs)


def test_short_texts_with_one_shingle_more(spark):
    """Four shingles and five: similarity 0.8, where fingerprints differ most."""
    rng, docs = random.Random(12), {}
    for n in range(150):
        words = made(rng, 9)
        docs[2 * n], docs[2 * n + 1] = " ".join(words), " ".join(words[:8])
    assert groups(spark, docs) == slow_groups(docs)


def test_large_group_whose_members_are_not_all_near(spark, monkeypatch):
    """One block of many texts, near to different others of it, beside copies of one."""
    monkeypatch.setattr(simhash, "SMALL", 5)
    rng, docs = random.Random(13), {}
    words = made(rng, 120)
    for n in range(160):
        if n % 40 == 0:
            words = edited(rng, words, 0.78)
        docs[n] = " ".join(edited(rng, words, rng.choice([0.8, 0.9, 0.97])))
    assert groups(spark, docs) == slow_groups(docs)


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_crowded_blocks_lose_no_pair(spark, monkeypatch, block_rows):
    """Groups whose blocks are split into chunks are joined as in whole blocks."""
    monkeypatch.setattr(simhash, "CHUNK_ROWS", block_rows)
    monkeypatch.setattr(simhash, "SMALL", 5)
    rng, docs = random.Random(14), {}
    for _ in range(3):
        words = made(rng, 120)
        for n in range(70):
            if n % 35 == 0:
                words = edited(rng, words, 0.78)
            docs[len(docs)] = " ".join(edited(rng, words, rng.choice([0.8, 0.85, 0.97])))
    assert groups(spark, docs) == slow_groups(docs)


def test_chunks_are_small_and_all_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 50)
    prints = [bytes([n // 256, n % 256]) for n in range(1000)]
    rows = spark.createDataFrame([(7, p, p) for p in prints], "block long, print binary, label binary")
    sizes = spark.createDataFrame([(7, 1000, prints[0])], "block long, n long, least binary")
    parts = {}
    for r in simhash._split(rows.select("block", "print"), sizes).collect():
        parts.setdefault(r.block, set()).add(bytes(r.print))
    assert set().union(*parts.values()) == set(prints) and all(prints[0] in p and len(p) <= 100 for p in parts.values())
    met = {}
    for r in simhash._meetings(rows, sizes.select("block", "n")).collect():
        met.setdefault(r.block, set()).add(bytes(r.print))
    assert all(len(p) <= 200 for p in met.values())
    assert len({frozenset((a, b)) for p in met.values() for a in p for b in p if a < b}) == 1000 * 999 // 2


def near_pairs(texts, similarity=0.8):
    """All pairs of texts at the similarity, by an inverted index of the rarest shingles: two sets at
    0.8 share one of the rarest n - ceil(0.8 n) + 1 of either."""
    from collections import Counter, defaultdict

    sets = [shingles(t) for t in texts]
    seen = Counter(x for s in sets for x in s)
    index, pairs = defaultdict(list), set()
    for n, s in enumerate(sets):
        rarest = sorted(s, key=lambda x: (seen[x], x))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
        for other in {o for x in rarest for o in index[x]}:
            if jaccard(s, sets[other]) >= similarity - 1e-12:
                pairs.add((other, n))
        for x in rarest:
            index[x].append(n)
    return pairs


@pytest.mark.parametrize("block_rows", [4096, 50])
def test_recall_on_given_documents(spark, monkeypatch, block_rows):
    """Of all pairs of different texts at 0.8 or more in the documents, whatever the size of a block."""
    monkeypatch.setattr(simhash, "CHUNK_ROWS", block_rows)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.text: r.doc_id for r in docs.collect() if r.text and r.text.split()}
    pairs = near_pairs(list(texts))
    ids = list(texts.values())
    group = {r.doc_id: r.component_id for r in simhash_groups(docs).collect()}
    together = sum(group[ids[a]] == group[ids[b]] for a, b in pairs)
    assert len(pairs) > 40 and together >= 0.99 * len(pairs)
    # No component holds more than the pairs explain.
    label = {i: i for i in ids}
    for _ in range(20):
        for a, b in pairs:
            label[ids[a]] = label[ids[b]] = min(label[ids[a]], label[ids[b]])
    assert len({group[i] for i in ids}) >= len(set(label.values()))


def test_rows_of_a_group_but_the_first_go(spark):
    """Ids that are shared or missing, repeated rows and columns named like those within."""
    rng = random.Random(15)
    a, b, c = (made(rng, 80) for _ in range(3))
    text = " ".join
    near = edited(rng, a, 0.9)
    rows = [(5, text(a), 1), (4, text(near), 2), (7, text(b), 3), (7, text(c), 4), (None, text(edited(rng, b, 0.9)), 5), (None, text(made(rng, 30)), 6), (9, None, 7), (8, "", 8), (4, text(near), 9)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key int, text_key string")
    left = first_of_groups(frame)
    assert left.columns == frame.columns and sorted(r.key for r in left.collect()) == [2, 3, 4, 6, 8, 9]
    assert first_of_groups(frame.limit(0)).collect() == []
