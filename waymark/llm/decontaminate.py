"""Benchmark passages in documents, found by greedy string tiling.

The benchmark's runs of MIN_MATCH tokens are the seeds. A rolling Karp-Rabin hash
over a document finds the windows that are seeds, and each is compared with the
seed token by token. Seeds in a row on one diagonal make a match. Of the matches
of a document with an item the longest is marked as a tile, again and again, a
match that meets marked tokens shrinking to its free stretches, until none of
MIN_MATCH tokens is left. Tiles do not overlap and may lie in any order, so a
passage whose sentences were shuffled is covered as one that was copied whole.
A document is reported with every item of which tiles cover COVERAGE or more.

The benchmark goes to the tasks in blocks of at most BLOCK_TOKENS tokens; each
block is a pass over the documents, so what is broadcast stays bounded whatever
the size of the benchmark. Documents are never shuffled.

Defined results: tokens are runs of letters and digits, lower-cased. An item of
fewer than MIN_MATCH tokens, or with a null text or id, is never found: so short a
phrase stands in clean texts as well. An item longer than a block is a block by itself. Repeated items are found each. Null
and empty documents hold nothing; repeated documents are reported each. Other
columns are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waymark.llm._arrow import columns
from waymark.scratch import Scratch

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_TOKENS = 1_000_000
FOUND = "doc_id long, item_id long, coverage double, covered_tokens long, item_tokens long, tiles long"

_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + ids[k : k + n].astype(np.uint64)
    return out


def tiles(matches: list[tuple[int, int, int]], doc_len: int, item_len: int, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from maximal matches (length, place in item, place in document)."""
    doc_marked, item_marked = np.zeros(doc_len, bool), np.zeros(item_len, bool)
    heap = [(-n, j, i) for n, j, i in matches]
    heapq.heapify(heap)
    out = []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        taken = doc_marked[i : i + n] | item_marked[j : j + n]
        if not taken.any():
            doc_marked[i : i + n] = item_marked[j : j + n] = True
            out.append((n, j, i))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= shortest:
                heapq.heappush(heap, (int(a - b), j + int(a), i + int(a)))
    return out


class Matcher:
    """A block of items, with the vocabulary and the seeds of their tokens."""

    def __init__(self, items: list[tuple[int, str]], min_match: int) -> None:
        self.k = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = tokens_of(text)
            if len(words) >= min_match:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)))
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, ids) in enumerate(self.items):
            for j, h in enumerate(rolling(ids, min_match).tolist()):
                self.seeds[h].append((n, j))
        self.known = np.array(sorted(self.seeds), np.uint64)

    def find(self, text: str | None, coverage: float) -> list[tuple[int, float, int, int, int]]:
        if not len(self.known):
            return []
        words = tokens_of(text)
        get = self.vocabulary.get
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        # Windows without a foreign token.
        foreign = np.concatenate([[0], np.cumsum(ids == 0)])
        places = np.flatnonzero(foreign[self.k :] == foreign[: -self.k]) if len(ids) >= self.k else np.zeros(0, int)
        if not len(places):
            return []
        hashes = rolling(ids, self.k)[places]
        hit = self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] == hashes
        places, hashes = places[hit], hashes[hit]
        # Seeds of the items in the document; items too few of whose tokens could be covered end here.
        reach: dict[int, set[int]] = defaultdict(set)
        for h in set(hashes.tolist()):
            for n, j in self.seeds[h]:
                reach[n].add(j)
        hopeful = {n for n, js in reach.items() if self._covered(js) >= coverage * len(self.items[n][1])}
        if not hopeful:
            return []
        pairs: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for i, h in zip(places.tolist(), hashes.tolist()):
            for n, j in self.seeds[h]:
                if n in hopeful and (ids[i : i + self.k] == self.items[n][1][j : j + self.k]).all():
                    pairs[n].add((i, j))
        out = []
        for n, found in pairs.items():
            item_id, item = self.items[n]
            matches = []
            for i, j in found:
                if (i - 1, j - 1) not in found:
                    end = 1
                    while (i + end, j + end) in found:
                        end += 1
                    matches.append((end + self.k - 1, j, i))
            made = tiles(matches, len(ids), len(item), self.k)
            covered = sum(t[0] for t in made)
            if covered >= coverage * len(item):
                out.append((item_id, covered / len(item), covered, len(item), len(made)))
        return out

    def _covered(self, places: set[int]) -> int:
        total, last = 0, -1
        for j in sorted(places):
            total += j + self.k - max(j, last)
            last = j + self.k
        return total


def _find(items: list[tuple[int, str]], min_match: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, min_match)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for ids, texts in columns(batch, "doc_id", "text"):
                rows = [(i, *x) for i, t in zip(ids, texts) for x in matcher.find(t, coverage)]
                yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "item_id", "coverage", "covered_tokens", "item_tokens", "tiles"])

    return run


def _free(items: list[tuple[int, str]], min_match: int, coverage: float, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, min_match)
        for batch in batches:
            free = [not matcher.find(t, coverage) for (texts,) in columns(batch, column) for t in texts]
            yield batch.filter(pa.array(free, pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_TOKENS tokens, one after the other."""
    scratch = Scratch(benchmark.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    # An upper bound on tokens: every second code point.
    size = (F.length("text") / 2 + 1).cast("long")
    running = F.sum(size).over(Window.partitionBy("lane").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lanes = max(1, int((items.agg(F.sum(size)).first()[0] or 0) // BLOCK_TOKENS))
    dealt = scratch.keep(items.withColumn("lane", F.pmod(F.xxhash64("item_id"), F.lit(lanes))).withColumn("block", (running / BLOCK_TOKENS).cast("long")), "items")
    for b in sorted((r.lane, r.block) for r in dealt.select("lane", "block").distinct().collect()):
        yield [(r.item_id, r.text) for r in dealt.filter((F.col("lane") == b[0]) & (F.col("block") == b[1])).collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that it holds, see ``FOUND``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out: DataFrame | None = None
    for block in _blocks(benchmark, item_col, item_text_col):
        found = texts.mapInArrow(_find(block, min_match, coverage), FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, whole; each is decided where it is, so nothing is shuffled."""
    for block in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_free(block, min_match, coverage, text_col), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
