"""Groups of near copies against all pairs of a small table."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from waymark.llm import simhash
from waymark.llm.simhash import exact_masks, finer_masks, op1_simhash, simhash_groups


def slow_print(text, ngram=3):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + ngram] for i in range(max(1, len(words) - ngram + 1))] if words else []
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints, radius):
    ids = list(prints)
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[b] < label[a]:
                    label[a], moved = label[b], True
    return label


def test_query_equals_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in docs.items()}
    rows = op1_simhash(spark, sf).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == slow_groups(prints, 3)


@pytest.mark.parametrize("radius", [1, 3])
def test_masks_keep_every_link(radius):
    rng = random.Random(3)
    masks = [int.from_bytes(m, "big") for m in exact_masks(64, radius)]
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        held = [m for m in masks if not m & flips]
        assert held
        finer = [int.from_bytes(m, "big") for m in finer_masks(held[0].to_bytes(8, "big"), radius, True)]
        assert all(f & held[0] == held[0] for f in finer) and any(not f & flips for f in finer)


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_dense_groups_of_fingerprints(spark, monkeypatch, block_rows):
    """Hundreds of fingerprints in a few dense groups and chains, in one block and dealt again."""
    rng = random.Random(4)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    made = []
    for _ in range(3):
        at = rng.getrandbits(64)
        for n in range(90):
            made.append(at ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
            if n % 9 == 0:
                at ^= 1 << rng.randrange(64)
    prints = dict(enumerate(made))
    monkeypatch.setattr(simhash, "_fingerprints", lambda ngram, words: _given)
    frame = spark.createDataFrame([(i, f"{p:016x}") for i, p in prints.items()], "doc_id long, text string")
    rows = simhash_groups(frame, ngram=3, bits=64, radius=3, exact=True).collect()
    assert {r.doc_id: r.component_id for r in rows} == slow_groups(prints, 3)


def _given(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch([b.column("doc_id"), pa.array([bytes.fromhex(t) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "print"])


def test_near_copies_join_and_others_stay_apart(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, group = [], {}
    for g in range(40):
        base = [word() for _ in range(rng.randrange(120, 400))]
        for _ in range(5):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            group[len(docs)] = g
            docs.append((len(docs), " ".join(copy)))
    rows = simhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.component_id].add(group[r.doc_id])
    assert all(len(x) == 1 for x in found.values())
    assert len(found) <= 42


def test_odd_rows(spark):
    schema = "doc_id long, text string, fingerprint string"
    assert simhash_groups(spark.createDataFrame([], schema)).collect() == []
    docs = [(3, None), (5, ""), (7, " \t"), (9, "one"), (9, "one"), (None, "one"), (4, "ONE"), (None, "x y")]
    rows = simhash_groups(spark.createDataFrame([(*d, "z") for d in docs], schema), ngram=3, bits=64, radius=3, exact=True).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.component_id)
    assert got[3] == got[5] == got[7] == [3] and got[9] == [4, 4] and sorted(got[None], key=str) == [4, None]


def test_large_block_equals_all_pairs():
    rng = random.Random(8)
    prints = []
    for _ in range(4):
        at = rng.getrandbits(64)
        prints += [at ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(60)]
    prints = sorted(set(prints))
    wide = np.array(prints, np.uint64).reshape(-1, 1)
    root = simhash._large_block(wide, simhash.pivot_table(wide, simhash.pivots(1)), 3)
    assert root.tolist() == list(slow_groups(dict(enumerate(prints)), 3).values())
