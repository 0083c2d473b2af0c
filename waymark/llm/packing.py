"""Mixture-controlled packing by deficit round-robin over one queue per source.

A source's queue is the stream of its documents' tokens. The output stream is
filled window by window. For each window every queue's deficit counter gains the
tokens that the target mixture gives it, the queue serves as many whole tokens
as the counter holds (rounded), and the rest, at most half a token either way,
stays in the counter for the next window. A queue that runs dry leaves its share
to the others. Sequences are consecutive spans of the output stream, so only the
last one is not full.

Serving whole tokens from carried counters has a closed form: after the mixture
time T a queue with weight w and N tokens has served min(N, floor(w*T + 1/2)).
So no task has to walk the windows in order: a document that knows where its
tokens lie in its queue knows in which windows they go and where. Offsets within
queues come from token counts per task and source; tasks carry on where the
task before ended, so counters run across partitions as well.

Ids are written once to the shared folder, two bytes each where the vocabulary
allows. They are read back by the tasks that cut them and never shuffled, unless
the table of offsets is too large to broadcast.

Defined results: a null text is empty and still gives its end token; a null
source is a queue of its own; repeated rows are packed each. Other columns are
ignored. An empty table gives an empty table. A very long document spans as many
windows as it needs.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from waymark.llm._arrow import columns
from waymark.scratch import Scratch

SEQ_LEN = 2048
#: Sequences in a window: the span over which the mixture holds.
WINDOW_SEQS = 32
END_ID = 1
#: Queues a mixture may have; the table of queues is held by every task.
MAX_SOURCES = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# -- tokens ------------------------------------------------------------------


class Encoder:
    """Byte-level BPE: the vocabulary's own tokenizer for texts that hold a special token's string,
    and for the rest a faster one with the same ranks and split pattern."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.specials = [t.content for t in self.exact.get_added_tokens_decoder().values() if t.special]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in word): i for word, i in self.exact.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in word) and word not in self.specials}
        self.fast = tiktoken.Encoding("same ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary need more than two bytes")

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if any(s in text for s in self.specials):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u2").tobytes()


#: Fixed value: the split pattern of the vocabulary's published tokenizer.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(shifted)}


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _tokenise(vocabulary: str):
    """Rows of ids, each with its place in its source's queue within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, served = TaskContext.get().partitionId(), _encoder(vocabulary), {}
        for batch in batches:
            for ids, queues, texts in columns(batch, "doc_id", "queue", "text"):
                codes = [encoder.encode(t or "") for t in texts]
                counts = [len(c) // 2 + 1 for c in codes]
                starts = []
                for q, n in zip(queues, counts):
                    starts.append(served.get(q, 0))
                    served[q] = starts[-1] + n
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(queues, pa.string()), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(codes, pa.binary())],
                    ["doc_id", "queue", "task", "task_start", "n_tokens", "ids"],
                )

    return run


# -- the mixture ---------------------------------------------------------------


class Mixture:
    """Queues with token counts and weights, and what each has served at the end of each window."""

    def __init__(self, tokens: list[int], weights: list[int], window: int) -> None:
        self.tokens, self.weights, self.window = tokens, weights, window
        self.total = sum(tokens)
        self.windows = -(-self.total // window)
        # Phases between the moments at which a queue runs dry: time at the end, tokens of dry queues, live weight.
        self.phases: list[tuple[Fraction, int, int]] = []
        live, dry = sum(w for w, n in zip(weights, tokens) if n), 0
        ends = sorted((Fraction(n, w), n, w) for n, w in zip(tokens, weights) if n)
        for moment, group in itertools.groupby(ends, key=lambda x: x[0]):
            self.phases.append((moment, dry, live))
            for _, n, w in group:
                dry, live = dry + n, live - w
        self.served = lru_cache(maxsize=4096)(self._served)
        self.layout = lru_cache(maxsize=4096)(self._layout)

    def moment(self, k: int) -> Fraction:
        """Mixture time at which windows 0..k are full."""
        filled = min((k + 1) * self.window, self.total)
        for end, dry, live in self.phases:
            if (filled - dry) <= end * live:
                return Fraction(filled - dry, live)
        return self.phases[-1][0]

    def _quota(self, j: int, t: Fraction) -> int:
        return min(self.tokens[j], (2 * self.weights[j] * t.numerator + t.denominator) // (2 * t.denominator))

    def _served(self, k: int) -> list[int]:
        """Tokens of each queue served in windows 0..k."""
        if k < 0:
            return [0] * len(self.tokens)
        t = self.moment(k)
        return [self._quota(j, t) for j in range(len(self.tokens))]

    def _layout(self, k: int) -> list[int]:
        """Where each queue's run of window k begins in the output stream."""
        before, now = self.served(k - 1), self.served(k)
        return list(itertools.accumulate((b - a for a, b in zip(before, now)), initial=sum(before)))

    def runs(self, j: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Tokens ``start`` to ``end`` of queue ``j`` as (first, last, place in the output stream)."""
        if start >= end:
            return
        # The first window that has served more than ``start`` tokens of the queue.
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high) // 2
            if self._quota(j, self.moment(mid)) > start:
                high = mid
            else:
                low = mid + 1
        k = low
        while start < end:
            last = self.served(k)[j]
            if last > start:
                stop = min(end, last)
                yield start, stop, self.layout(k)[j] + start - self.served(k - 1)[j]
                start = stop
            k += 1


def _cut(tokens: list[int], weights: list[int], window: int, seq_len: int, order: dict[str, int]):
    """Rows of pieces: each run of a document cut again at the ends of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(tokens, weights, window)
        for batch in batches:
            for ids, queues, task_starts, befores, counts, codes in columns(batch, "doc_id", "queue", "task_start", "before", "n_tokens", "ids"):
                out: list[list] = [[], [], [], [], [], [], []]
                for i, queue, task_start, before, n, code in zip(ids, queues, task_starts, befores, counts, codes):
                    wide = np.append(np.frombuffer(code, "<u2").astype("<u4"), np.uint32(END_ID)).astype("<u4").tobytes()
                    first = before + task_start
                    for a, b, place in mixture.runs(order[queue], first, first + n):
                        while a < b:
                            step = min(b - a, seq_len - place % seq_len)
                            s = a - first
                            for column, value in zip(out, (i, s, step, zlib.crc32(wide[4 * s : 4 * (s + step)]), n, place // seq_len, place % seq_len)):
                                column.append(value)
                            a, place = a + step, place + step
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    targets: dict[str | None, float] | None = None,
    seq_len: int = SEQ_LEN,
    window_seqs: int = WINDOW_SEQS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents by sequence, see ``PIECES``.

    ``targets`` gives proportions by source; sources it leaves out follow when those are used
    up. Without it the target is the sources' own proportions, so that all last to the end.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    queue = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), F.col(text_col).alias("text"))
    coded = scratch.keep(rows.mapInArrow(_tokenise(vocabulary), "doc_id long, queue string, task int, task_start long, n_tokens long, ids binary"), "ids")

    by_task = coded.groupBy("queue", "task").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.keep(by_task.select("queue", "task", before.alias("before"), "n"), "offsets")
    queues = sorted((r.queue, r.n) for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect())
    if len(queues) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before packing")
    tokens = [n for _, n in queues]
    weights = _weights([q for q, _ in queues], tokens, targets)
    order = {q: j for j, (q, _) in enumerate(queues)}
    # Broadcast by the planner if the offsets' files are under its threshold; a sort-merge join beyond.
    placed = coded.join(offsets.drop("n"), ["queue", "task"])
    return placed.mapInArrow(_cut(tokens, weights, seq_len * window_seqs, seq_len, order), PIECES)


def _weights(queues: list[str], tokens: list[int], targets: dict[str | None, float] | None) -> list[int]:
    """Whole-number weights. A queue without a target weighs so little that it is served last."""
    if targets is None:
        return tokens
    named = {("n" if s is None else f"s{s}"): Fraction(t).limit_denominator(10**6) for s, t in targets.items() if t > 0}
    scale = max((f.denominator for f in named.values()), default=1)
    for f in named.values():
        scale = scale * f.denominator // np.gcd(scale, f.denominator).item()
    last = max(1, sum(tokens)) * 4
    return [int(named[q] * scale) * last if q in named else 1 for q in queues]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
