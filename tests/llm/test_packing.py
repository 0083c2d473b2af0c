"""Packing against its own inputs: every id once, gapless sequences, the mixture in every window."""

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from waymark.llm.packing import Encoder, Mixture, op3_packing, pack

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a \n b", " a\t", "x\n\n y's it's  ", "é  ü ", "a  b 　c", "1 2  33 ,,  ;", "<|endoftext|> a", "'s 't a's ' s", " " * 200_000 + "a", "a" * 30_000])
def test_texts_encode_as_the_vocabulary_says(text):
    got = np.frombuffer(Encoder(VOCABULARY).encode(text), "<u2").tolist()
    assert got == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_random_texts_encode_alike():
    rng, encoder, exact = random.Random(5), Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["".join(rng.choice("ab é1.,'s \n\t ") for _ in range(rng.randrange(60))) for _ in range(400)]
    got = [np.frombuffer(encoder.encode(t), "<u2").tolist() for t in texts]
    assert got == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_code_point_encodes_alike():
    """All characters, each between letters, digits, spaces and signs: versions of Unicode must not differ."""
    rng, encoder, exact = random.Random(6), Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) + rng.choice("a1 .") for c in points[at : at + 256]) for at in range(0, len(points), 256)]
    off = [i for i, t in enumerate(texts) if np.frombuffer(encoder.encode(t), "<u2").tolist() != exact.encode(t, add_special_tokens=False).ids]
    assert not off, [hex(points[256 * i]) for i in off[:5]]


def test_given_documents_encode_alike(spark):
    encoder, exact = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert all(np.frombuffer(encoder.encode(t), "<u2").tolist() == exact.encode(t, add_special_tokens=False).ids for t in texts)


def check(rows, docs, seq_len):
    exact = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d[0] for d in docs}
    for doc_id, text, _ in docs:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for n in sorted(sequences):
        at = 0
        for r in sorted(sequences[n], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == seq_len for n in lengths[:-1]) and 0 < lengths[-1] <= seq_len


def test_query_places_every_id_once(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op3_packing(spark, sf).collect(), docs, 2048)


def test_targets_hold_in_every_window(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(80))), rng.choice(["a", "b", None])) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = pack(frame, VOCABULARY, targets={"a": 0.75, "b": 0.25}, seq_len=64, window_seqs=4).collect()
    check(rows, docs, 64)
    source = {d[0]: d[2] for d in docs}
    windows = defaultdict(lambda: defaultdict(int))
    for r in rows:
        windows[r.sequence_id // 4][source[r.doc_id]] += r.length
    left = {s: sum(n for w in windows.values() for k, n in w.items() if k == s) for s in ("a", "b")}
    for n in sorted(windows):
        if left["a"] > 256 and left["b"] > 256:
            assert abs(windows[n]["a"] - 192) <= 3 and abs(windows[n]["b"] - 64) <= 3 and not windows[n][None]
        for s in left:
            left[s] -= windows[n][s]


def test_mixture_equals_stepwise_deficit_round_robin():
    rng = random.Random(2)
    for _ in range(200):
        tokens = [rng.randrange(0, 90) for _ in range(rng.randrange(1, 6))]
        weights = [rng.randrange(1, 9) for _ in tokens]
        window = rng.randrange(1, 40)
        if not sum(tokens):
            continue
        m = Mixture(tokens, weights, window)
        served, owed = [0] * len(tokens), [Fraction(0)] * len(tokens)
        for k in range(m.windows):
            # Pour the window's time into the counters, phase by phase as queues run dry.
            room = min(window, sum(tokens) - sum(owed))
            while room > 0:
                live = [j for j in range(len(tokens)) if owed[j] < tokens[j]]
                speed = sum(weights[j] for j in live)
                step = min([room / Fraction(speed), *(Fraction(tokens[j] - owed[j], weights[j]) for j in live)])
                for j in live:
                    owed[j] += step * weights[j]
                room -= step * speed
            served = [min(n, int(o + Fraction(1, 2))) for n, o in zip(tokens, owed)]
            assert m.served(k) == served
        assert served == tokens


def test_empty_table_and_empty_texts(spark):
    schema = "doc_id long, text string, source string, start string"
    assert pack(spark.createDataFrame([], schema), VOCABULARY).collect() == []
    docs = [(1, None, None), (2, "", "x"), (2, "", "x"), (None, "a b", "y")]
    rows = pack(spark.createDataFrame([(*d, "clash") for d in docs], schema), VOCABULARY).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.length) for r in rows) == [(-1, 3), (1, 1), (2, 1), (2, 1)]
