"""SimHash fingerprints and the groups of near copies that they link.

Two fingerprints link at ``radius`` differing bits or fewer. Distances to a table of
pivots - fixed reference fingerprints, and in a large block also some of its own -
decide most pairs without comparing them: where any coordinate of two rows of the
table differs by more than the radius, the triangle inequality rules the pair out.
Pairs that survive all coordinates are verified bit by bit.

A pivot's distances alone cannot deal pairs out to tasks: between unrelated
fingerprints of 64 bits a coordinate has a standard deviation of 4, so a
tolerance of 3 either way keeps 46 % of them, and a grid over k coordinates grows
by up to 7^k probes, faster than it thins the pairs. So fingerprints first meet in
blocks that agree in the bits of a mask. With exact masks the bits are divided into
``radius + 2`` bands and a mask holds all but ``radius`` of them, so no link is lost.
A block with more than BLOCK_ROWS fingerprints is dealt again by finer masks that
are exact as well: the free bits are divided into ``radius + 1`` parts, at least one of
which a link leaves alone, until no block can hold more. Copies collapse to one fingerprint first. A block yields a
spanning forest of its links, not its pairs: at most a row for each of its fingerprints.

Near copies by similarity (``exact=False``) link where the Jaccard similarity of their
shingles, computed from the texts, is ``similarity`` or more. A radius wide enough for that
is too wide for masks: at 56 of 256 bits a mask of 16 bits finds a pair with probability
0.018. So these texts meet in blocks of equal min-hashes, BANDS times BAND_ROWS of them: a
pair at 0.8 misses all blocks with probability 0.00006. Fingerprints, here of distinct
shingles, collapse copies. A block's pivots are rows of its own: their table rules out most
of what met by chance, the distance of the two fingerprints the rest of it, and the texts
of the pairs that survive both are compared. A large block first offers its rows against hubs only. Of those blocks the ones
whose rows are still in different groups get the rows' shingles, and count common ones of all
rows in the task: it sends out a link for each two groups that it joins, not pairs. A block with more than CHUNK_ROWS rows is
split into chunks, which first share the block's least row as a hub and then meet each
other, chunk against chunk, so a pair's chance does not depend on the size of its block.

Defined results: words are split at ASCII blanks and A-Z lower-cased; a text
with fewer words than a shingle is one shingle; null, empty and blank texts have
the fingerprint zero, which links like any other. Rows with a null id take part
and do not name a component. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm._arrow import columns, unused
from waymark.llm._links import components
from waymark.scratch import Scratch

SEED = 42
#: Reference fingerprints in the pivot table.
PIVOTS = 16
#: A block with more fingerprints is dealt again by finer masks, LEVELS times at most. For 64 bits
#: and a radius of 3 that leaves 11 free bits, so no block has more than 2048 fingerprints in the end.
BLOCK_ROWS = 4096
LEVELS = 5
#: Rows of a block of near copies that are its reference fingerprints.
OWN_PIVOTS = 4
#: Up to this many rows a block compares all its pairs at once.
SMALL = 48
#: Blocks of near copies agree in BAND_ROWS min-hashes; a text is in BANDS blocks.
BANDS, BAND_ROWS = 32, 6
#: Standard deviations that the radius adds to the expected distance: fingerprints of few
#: shingles differ more (48 bits at 0.8 for four shingles, not 38), and survivors are compared anyway.
MARGIN = 5
#: A block of near copies with more rows is split into chunks of about as many.
CHUNK_ROWS = 512
#: Shingles that count as one row where a block's texts are dealt to chunks.
CHUNK_SHINGLES = 500
#: A text that many others are compared with is dealt to this many tasks.
SALTS = 32


# -- fingerprints ------------------------------------------------------------


def shingle_hashes(text: str | None, ngram: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= ngram:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(s), SEED) for s in zip(*(words[k:] for k in range(ngram)))], "<u8")


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """Independent 64 bits for each further word of a wide fingerprint."""
    if not word:
        return h
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, ngram: int, words: int) -> bytes:
    """``words`` times 64 bits, big-endian; a bit is set if it is set in over half of the hashes."""
    return _print_of(shingle_hashes(text, ngram), words)


def _print_of(h: np.ndarray, words: int) -> bytes:
    if not len(h):
        return bytes(8 * words)
    out = []
    for w in range(words):
        ones = np.zeros(64, np.int64)
        for part in np.array_split(_spread(h, w), max(1, len(h) // 65536)):
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def _fingerprints(ngram: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in columns(batch, "doc_id", "text"):
                prints = [fingerprint(t, ngram, words) for t in texts]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "print"])

    return run


# -- masks ---------------------------------------------------------------------


def _mask(bits, width: int) -> bytes:
    out = np.zeros(width, np.uint8)
    out[list(bits)] = 1
    return np.packbits(out).tobytes()


def exact_masks(width: int, radius: int) -> list[bytes]:
    """Every choice of two of ``radius + 2`` bands: a link leaves two bands alone at least."""
    bands = np.array_split(np.arange(width), radius + 2)
    return [_mask(np.concatenate(pair), width) for pair in combinations(bands, 2)]


def finer_masks(mask: bytes, radius: int, exact: bool) -> list[bytes]:
    """Masks that hold ``mask`` and one part of the free bits each; a link leaves one part alone at least."""
    if not exact:
        raise ValueError("masks that are not exact would lose links where a block is dealt again")
    taken = np.unpackbits(np.frombuffer(mask, np.uint8))
    free = np.flatnonzero(taken == 0)
    parts = np.array_split(free, radius + 1)
    return [_mask(np.concatenate([np.flatnonzero(taken), p]).astype(int), len(taken)) for p in parts]


class Masks:
    """Masks by path: the number of a first mask, then of a finer mask in each further byte."""

    def __init__(self, first: list[bytes], radius: int, exact: bool) -> None:
        self.first, self.radius, self.exact = first, radius, exact
        self.made: dict[bytes, list[bytes]] = {}

    def __call__(self, path: bytes) -> bytes:
        return self.first[path[0]] if len(path) == 1 else self.finer(path[:-1])[path[-1]]

    def finer(self, path: bytes) -> list[bytes]:
        if path not in self.made:
            self.made[path] = finer_masks(self(path), self.radius, self.exact)
        return self.made[path]


def _wide(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _block(prints: np.ndarray, mask: bytes, path: bytes) -> np.ndarray:
    """A number for the masked bits. Where two blocks get the same number they are only compared as one."""
    bits = np.frombuffer(mask, ">u8").astype(np.uint64)
    number = np.full(len(prints), xxhash.xxh64_intdigest(path), np.uint64)
    for w in range(prints.shape[1]):
        number = _spread(number ^ (prints[:, w] & bits[w]), 1)
    return number.view(np.int64)


def _deal(masks: Masks, words: int):
    """Rows (block, path, print): one for each first mask, or for each finer mask of a row that has a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("print")
            prints = _wide(raw, words)
            if "path" in batch.schema.names:
                paths = batch.column("path").to_pylist()
                own: dict[bytes, list[int]] = {}
                for i, p in enumerate(paths):
                    own.setdefault(p, []).append(i)
                dealt = [(p + bytes([j]), m, rows) for p, rows in own.items() for j, m in enumerate(masks.finer(p))]
            else:
                dealt = [(bytes([j]), m, None) for j, m in enumerate(masks.first)]
            for path, mask, rows in dealt:
                part, sent = (prints, raw) if rows is None else (prints[rows], raw.take(pa.array(rows)))
                yield pa.record_batch([pa.array(_block(part, mask, path)), pa.array([path] * len(part), pa.binary()), sent], ["block", "path", "print"])

    return run


# -- links within blocks -------------------------------------------------------


def pivots(words: int, number: int = PIVOTS) -> np.ndarray:
    rng = random.Random(SEED + 1)
    return np.array([[rng.getrandbits(64) for _ in range(words)] for _ in range(number)], np.uint64)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (row) to each pivot (column)."""
    return np.stack([np.bitwise_count(prints ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def _verified(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no pivot rules out and whose fingerprints are near indeed."""
    for column in table.T:
        if not len(a):
            break
        near = np.abs(column[a] - column[b]) <= radius
        a, b = a[near], b[near]
    near = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int16) <= radius
    return a[near], b[near]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _large_block(prints: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Roots within a block of many rows.

    Rows of the block become pivots in turn: whatever is within the radius of one is joined
    to it without being compared further, so a dense group costs one pass. Then rows that
    lie in different trees are compared, smaller trees against all, through the pivot table.
    """
    n = len(prints)
    left, a_all, b_all = np.arange(n), [], []
    extra = []
    while len(left) and len(extra) < PIVOTS:
        hub = left[0]
        d = np.bitwise_count(prints ^ prints[hub]).sum(axis=1, dtype=np.int16)
        extra.append(d)
        near = np.flatnonzero(d <= radius)
        a_all.append(np.full(len(near), hub))
        b_all.append(near)
        left = left[(d[left] > radius)]
    root = _forest(n, np.concatenate(a_all), np.concatenate(b_all))
    table = np.concatenate([table, np.stack(extra, axis=1)], axis=1)
    trees, sizes = np.unique(root, return_counts=True)
    largest = trees[np.argmax(sizes)]
    rest = np.flatnonzero(root != largest)
    for x in rest:
        others = np.flatnonzero(root != root[x])
        a, b = _verified(prints, table, np.full(len(others), x), others, radius)
        if len(a):
            root = _forest(n, np.concatenate([np.arange(n), root[a]]), np.concatenate([root, root[b]]))
    return root


def _links(words: int, radius: int):
    """Blocks arrive sorted and may span batches; (a, b): a member and its tree's least fingerprint."""

    def solve(prints: np.ndarray, starts: np.ndarray, refs: np.ndarray) -> tuple[list[int], list[int]]:
        table = pivot_table(prints, refs)
        ends = np.append(starts[1:], len(prints))
        sizes = ends - starts
        a_all, b_all = [], []
        # Small blocks together: row i with row i + step, as long as a block has both.
        small = np.zeros(len(prints), np.int64)
        for s, e in zip(starts[sizes <= SMALL], ends[sizes <= SMALL]):
            small[s:e] = e
        for step in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
            a = np.flatnonzero(np.arange(len(prints)) + step < small)
            x, y = _verified(prints, table, a, a + step, radius)
            a_all.append(x)
            b_all.append(y)
        root = _forest(len(prints), np.concatenate(a_all), np.concatenate(b_all)) if a_all else np.arange(len(prints))
        for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
            root[s:e] = s + _large_block(prints[s:e], table[s:e], radius)
        moved = np.flatnonzero(root != np.arange(len(prints)))
        return moved.tolist(), root[moved].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(words)
        held_blocks, held = np.zeros(0, np.int64), np.zeros((0, words), np.uint64)

        def flush(blocks: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            # Rows alone in their block have nobody to link to.
            same = blocks[1:] == blocks[:-1]
            shared = np.append(same, False) | np.append(False, same) if len(blocks) else np.zeros(0, bool)
            blocks, prints = blocks[shared], prints[shared]
            if not len(blocks):
                return
            a, b = solve(prints, np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), refs)
            if a:
                raw = prints.astype(">u8")
                yield pa.record_batch([pa.array([raw[i].tobytes() for i in a], pa.binary()), pa.array([raw[i].tobytes() for i in b], pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = np.concatenate([held_blocks, batch.column("block").to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held, _wide(batch.column("print"), words)])
            cut = np.searchsorted(blocks, blocks[-1])
            yield from flush(blocks[:cut], prints[:cut])
            held_blocks, held = blocks[cut:], prints[cut:]
        yield from flush(held_blocks, held)

    return run


# -- near copies by similarity ---------------------------------------------------


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(SEED + 2)
    made = [(rng.getrandbits(64), rng.getrandbits(64) | 1) for _ in range(BANDS * BAND_ROWS)]
    return np.array([[x] for x, _ in made], np.uint64), np.array([[f] for _, f in made], np.uint64)


def band_blocks(h: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A number for the min-hashes of each band; none for a text without shingles."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        np.minimum(least, ((h[at : at + 4096] ^ salts) * factors).min(axis=1), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(bands)], np.uint64).view(np.int64)


def _near_rows(ngram: int, words: int):
    """Fingerprints and blocks of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, factors = _permutations()
        for batch in batches:
            for ids, keys, texts in columns(batch, "doc_id", "key", "text"):
                sets = [np.unique(shingle_hashes(t, ngram)) for t in texts]
                prints = pa.array([_print_of(h, words) for h in sets], pa.binary())
                blocks = pa.array([band_blocks(h, salts, factors) for h in sets], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), prints, blocks], ["doc_id", "key", "print", "blocks"])

    return run


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that arrive sorted by block, in tables that end where a block ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(blocks, blocks[-1]))
        if not cut and held and held[-1].column("block")[-1].as_py() == blocks[0]:
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    return starts, np.append(starts[1:], len(blocks))


def own_pivot_table(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hamming distances of each row to OWN_PIVOTS rows of its block. Against references that are near some rows
    the coordinates of copies and strangers differ by more than the radius; against fixed ones all are about half the bits."""
    sizes = ends - starts
    refs = [np.repeat(starts + k * sizes // OWN_PIVOTS, sizes) for k in range(OWN_PIVOTS)]
    return np.stack([np.bitwise_count(prints ^ prints[r]).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def _within(prints: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int16) <= radius


def _hub_pairs(prints: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each row against the first row within the radius that has no such row itself."""
    a_all, b_all, left = [], [], np.arange(len(prints))
    while len(left) > 1:
        hub, left = left[0], left[1:]
        near = _within(prints, left, np.full(len(left), hub), radius)
        a_all.append(left[near])
        b_all.append(np.full(int(near.sum()), hub))
        left = left[~near]
    return a_all, b_all


def _offers(words: int, radius: int, most: int):
    """Pairs to compare (a, b): all near ones in a block of up to ``most`` rows, each row and its hub in a large one.

    The rows of a large block follow with their block and without b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            blocks = table.column("block").to_numpy()
            same = blocks[1:] == blocks[:-1]
            shared = np.append(same, False) | np.append(False, same)
            if not shared.any():
                continue
            blocks, raw = blocks[shared], table.column("print").filter(pa.array(shared)).combine_chunks()
            prints = _wide(raw, words)
            starts, ends = _bounds(blocks)
            small = ends - starts <= most
            end_of = np.zeros(len(prints), np.int64)
            for s, e in zip(starts[small], ends[small]):
                end_of[s:e] = e
            a_all, b_all, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            pivots_of = own_pivot_table(prints, starts, ends)
            for step in range(1, int((ends - starts)[small].max(initial=0))):
                b = np.flatnonzero(np.arange(len(prints)) + step < end_of)
                a, b = _verified(prints, pivots_of, b + step, b, radius)
                a_all.append(a)
                b_all.append(b)
            for s, e in zip(starts[~small], ends[~small]):
                a, b = _hub_pairs(prints[s:e], radius)
                a_all += [x + s for x in a]
                b_all += [x + s for x in b]
                members.append(np.arange(s, e))
            a, b, m = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(members)
            yield pa.record_batch([raw.take(pa.array(a)), raw.take(pa.array(b)), pa.nulls(len(a), pa.int64())], ["a", "b", "block"])
            yield pa.record_batch([raw.take(pa.array(m)), pa.nulls(len(m), pa.binary()), pa.array(blocks[m])], ["a", "b", "block"])

    return run


def _shingle_sets(ngram: int):
    """The distinct shingles of each text, sorted, as 64-bit hashes in a row of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prints, texts in columns(batch, "print", "text"):
                sets = [np.unique(shingle_hashes(t, ngram)) for t in texts]
                yield pa.record_batch([pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["print", "shingles", "size"])

    return run


def block_links(sets: list[np.ndarray], labels: np.ndarray, chunk: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of one block that join its labels: for each row, one to each label it is similar to.

    Common shingles of a row with all rows before it are counted at once, from lists of the rows that have
    each shingle. Where two chunks meet, rows of the same one have met elsewhere. ``labels`` are joined in place.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(number, kind="stable")]
    counts = np.bincount(number)
    begins = np.cumsum(counts) - counts
    two, links = (chunk != chunk[0]).any(), []
    for x in range(1, len(sets)):
        apart = labels[:x] != labels[x]
        if two:
            apart &= chunk[:x] != chunk[x]
        if not apart.any():
            continue
        own = number[ends[x] - sizes[x] : ends[x]]
        n = counts[own]
        at = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owners[at], minlength=len(sets))[:x]
        near = np.flatnonzero(apart & (common > 0) & (common >= similarity * (sizes[:x] + sizes[x] - common) - 1e-9))
        for y in near:
            if labels[y] != labels[x]:
                links.append((x, int(y)))
                labels[labels == labels[y]] = labels[x]
    return links


def _across(similarity: float):
    """Links (a, b) that join the labels of a block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            raw = table.column("print").combine_chunks()
            labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy().copy()
            chunk, a, b = table.column("chunk").to_numpy(), [], []
            for s, e in zip(*_bounds(table.column("block").to_numpy())):
                sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").slice(s, e - s).to_pylist()]
                for x, y in block_links(sets, labels[s:e], chunk[s:e], similarity):
                    a.append(s + x)
                    b.append(s + y)
            yield pa.record_batch([raw.take(pa.array(a, pa.int64())), raw.take(pa.array(b, pa.int64()))], ["a", "b"])

    return run


def _chunk(n: str):
    """A row's chunk in a block of n rows: about CHUNK_ROWS share one."""
    return F.pmod(F.xxhash64("print"), F.ceil(F.col(n) / F.lit(CHUNK_ROWS)))


def _split(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """Crowded blocks as chunks, each with the block's least row; ``large`` has block, n and least."""
    crowded = dealt.join(large, "block").withColumn("chunk", _chunk("n"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(CHUNK_ROWS)) - 1))
    hubs = large.select("block", F.col("least").alias("print"), every.alias("chunk"))
    return crowded.select("block", "print", "chunk").union(hubs).distinct().select(F.xxhash64("block", "chunk").alias("block"), "print")


def _meetings(labelled: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of blocks with several labels, once for each chunk that theirs meets; ``open_`` has block and n."""
    rows = labelled.join(open_, "block").withColumn("chunk", _chunk("n"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(CHUNK_ROWS)) - 1)))
    return met.select(F.xxhash64("block", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"), "chunk", "print", "label", *[c for c in labelled.columns if c == "shingles"])


def _similar(ngram: int, similarity: float):
    """The pairs whose shingles have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = lru_cache(maxsize=64)(lambda text: np.unique(shingle_hashes(text, ngram)))
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("text_a"), batch.column("text_b")):
                x, y = shingles(a.as_py()), shingles(b.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(0 < common >= similarity * (len(x) + len(y) - common) - 1e-9)
            mask = pa.array(kept, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _near_links(prints: DataFrame, texts: DataFrame, words: int, radius: int, ngram: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the fingerprints that have the similarity; ``texts`` has key and text."""

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct().join(prints.select("print", "key"), "print")
        own = scratch.keep(texts.join(wanted, "key").select("print", "text").dropDuplicates(["print"]), f"texts-{name}")
        hubs = pairs.select("b", "salt").distinct().join(own.select(F.col("print").alias("b"), F.col("text").alias("text_b")), "b")
        both = pairs.join(own.select(F.col("print").alias("a"), F.col("text").alias("text_a")), "a").join(hubs, ["b", "salt"])
        return scratch.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(ngram, similarity), "a binary, b binary"), f"links-{name}")

    dealt = prints.select(F.explode("blocks").alias("block"), "print")
    sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("least"))
    large = scratch.keep(sizes.filter(F.col("n") > CHUNK_ROWS), "crowded")
    is_crowded = large.limit(1).count() > 0
    whole = dealt.join(large, "block", "left_anti").unionByName(_split(dealt, large)) if is_crowded else dealt
    offers = scratch.keep(whole.repartition("block").sortWithinPartitions("block", "print").mapInArrow(_offers(words, radius, SMALL), "a binary, b binary, block long"), "offers")
    first = scratch.keep(offers.filter("b IS NOT NULL").select("a", "b").distinct(), "pairs-1")
    links = compared(first, "1")
    members = offers.filter("b IS NULL").select("block", F.col("a").alias("print"))
    if is_crowded:
        members = members.unionByName(dealt.join(large, "block", "left_semi"))
    if not members.limit(1).count():
        return links
    labels = components(_thinned(links), scratch)
    labelled = scratch.keep(members.join(labels, F.col("print") == F.col("node"), "left").select("block", "print", F.coalesce("label", "print").alias("label")), "labelled")
    several = labelled.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("block")
    several = scratch.keep(several, "several")
    if not several.limit(1).count():
        return links
    rest = scratch.keep(labelled.join(several, "block", "left_semi"), "rest")
    keys = rest.select("print").distinct().join(prints.select("print", "key"), "print")
    sets = texts.join(keys, "key").select("print", "text").dropDuplicates(["print"]).mapInArrow(_shingle_sets(ngram), "print binary, shingles binary, size long")
    rest = scratch.keep(rest.join(scratch.keep(sets, "sets"), "print"), "rest-sets")
    # A chunk is of CHUNK_ROWS texts of usual length, or of fewer long ones.
    open_ = scratch.keep(rest.groupBy("block").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") / F.lit(CHUNK_SHINGLES))).alias("n")), "open")
    met = _meetings(rest, open_).repartition("block").sortWithinPartitions("block", "print")
    return links.unionByName(scratch.keep(met.mapInArrow(_across(similarity), "a binary, b binary"), "links-2"))


# -- groups ----------------------------------------------------------------------


def _thinned(links: DataFrame) -> DataFrame:
    """Links with the same components: a member keeps its least root, and its roots are linked to that one.

    A member has a root for each mask at most. Members of a dense group have the same few roots, so
    most of what links them becomes one row.
    """
    roots = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b"))
    least = F.col("b")[0]
    others = F.transform(F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), lambda r: F.struct(least.alias("a"), r.alias("b")))
    return roots.select(F.explode(F.concat(F.array(F.struct("a", least.alias("b"))), others)).alias("x")).select("x.a", "x.b").distinct()


def radius_for(similarity: float, bits: int) -> int:
    """Expected differing bits at a Jaccard similarity of shingles, the angle between sets of one size, and MARGIN deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


def _exact_links(prints: DataFrame, bits: int, radius: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the fingerprints at the radius or less."""
    words = bits // 64
    masks = Masks(exact_masks(bits, radius), radius, True)
    dealt_schema = "block long, path binary, print binary"
    dealt = prints.select("print").mapInArrow(_deal(masks, words), dealt_schema)
    links: DataFrame | None = None
    for level in range(LEVELS + 1):
        crowded = False
        if level < LEVELS:
            sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
            large = scratch.keep(sizes.filter(F.col("n") > BLOCK_ROWS).select("block"), f"large-{level}")
            crowded = large.limit(1).count() > 0
        here = dealt.join(large, "block", "left_anti") if crowded else dealt
        # In order of fingerprints, so that a tree's root is its least one and blocks name the same roots.
        found = here.select("block", "print").repartition("block").sortWithinPartitions("block", "print").mapInArrow(_links(words, radius), "a binary, b binary")
        links = found if links is None else links.unionByName(found)
        if not crowded:
            break
        dealt = scratch.keep(dealt.join(large, "block", "left_semi").select("path", "print").mapInArrow(_deal(masks, words), dealt_schema), f"dealt-{level + 1}")
    return links


def _grouped(texts: DataFrame, ngram: int, bits: int, radius: int | None, similarity: float, exact: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and of each fingerprint its least rows and the least fingerprint of its group."""
    words = bits // 64
    radius = radius_for(similarity, bits) if radius is None else radius
    if exact:
        rows = scratch.keep(texts.mapInArrow(_fingerprints(ngram, words), "doc_id long, print binary"), "prints")
        prints = scratch.keep(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct")
        links = _exact_links(prints, bits, radius, scratch)
    else:
        texts = texts.withColumn("key", F.xxhash64("text"))
        rows = scratch.keep(texts.mapInArrow(_near_rows(ngram, words), "doc_id long, key long, print binary, blocks array<long>"), "prints")
        least = rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("key", "blocks")).alias("x"), F.min(_row_order()).alias("first"))
        prints = scratch.keep(least.select("print", "least_id", "first", "x.key", "x.blocks"), "distinct")
        links = _near_links(prints, texts.select("key", "text"), words, radius, ngram, similarity, scratch)
    labels = components(_thinned(links), scratch)
    labelled = prints.join(labels, prints["print"] == labels["node"], "left").withColumn("label", F.coalesce("label", "print")).drop("node", "key", "blocks")
    # Written, so that the joins that follow have a plain exchange on either side and a large group can be split.
    return rows, scratch.keep(labelled, "labelled-prints")


def _row_order():
    """The order in which rows stand for their group: least id, then least hash of the text; rows without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("key").alias("of_text"))


def simhash_groups(
    docs: DataFrame,
    ngram: int = 5,
    bits: int = 256,
    radius: int | None = None,
    similarity: float = 0.8,
    exact: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    ``exact``: fingerprints link at ``radius`` bits or fewer, and no link is lost. Otherwise texts
    link at a Jaccard similarity of ``similarity`` or more; ``radius`` defaults to one that rules none of those out.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, labelled = _grouped(texts, ngram, bits, radius, similarity, exact, scratch)
    least = scratch.keep(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "least")
    of_print = scratch.keep(labelled.join(least, "label").select("print", "component_id"), "components")
    return rows.join(of_print, "print").select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, ngram: int = 5, bits: int = 256, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose group of near copies has an earlier one: of each group the least id stays.

    A row is told by its id and its text, so rows that share an id, or have none, are judged each;
    a row that is repeated with id and text stays or goes as one.
    """
    scratch = Scratch(docs.sparkSession, "simhash-first")
    (key,) = unused(docs, "text_key")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, labelled = _grouped(texts, ngram, bits, None, similarity, False, scratch)
    first = scratch.keep(labelled.groupBy("label").agg(F.min("first").alias("winner")), "winners")
    of_print = scratch.keep(labelled.join(first, "label").select("print", "winner"), "winner-of-print")
    gone = rows.join(of_print, "print").filter(_row_order() != F.col("winner")).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    gone = scratch.keep(gone, "gone")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    same = (keyed[key] == gone["gone_key"]) & F.col(id_col).cast("long").eqNullSafe(gone["gone_id"])
    return keyed.join(gone, same, "left_anti").drop(key)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), ngram=3, bits=64, radius=3, exact=True)
