"""Lines that many documents share are dropped wherever they occur.

Every text is split into lines, the lines' normalised keys are hashed, distinct
documents are counted per hash, and each document is put together again from
the lines whose hash stays under the threshold, in their old order.

Only hashes travel: (document, hash) pairs are shuffled for the count and for
finding each document's common lines; the text itself is shuffled once, to meet
the list of hashes that its document loses.

Defined results: a null or empty text is one empty line, and an empty key is
never dropped when ``min_chars`` is 1 or more. A document is a ``doc_id``; rows
that repeat one count once towards the threshold and are each rewritten. Null
ids count as one document. Columns other than the id and the text are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from waymark.llm._arrow import columns
from waymark.scratch import Scratch

MIN_DOCS = 10
MIN_CHARS = 1
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """ASCII blanks off both ends, A-Z to lower case; other letters are left as they are."""
    return line.strip(BLANK).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in columns(batch, "id", "text"):
                out_ids, out = [], []
                for i, text in zip(ids, texts):
                    keys = {line_key(x) for x in (text or "").encode().split(b"\n")}
                    found = [key_hash(k) for k in keys if _long_enough(k, min_chars)]
                    out_ids += [i] * len(found)
                    out += found
                yield pa.record_batch([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], ["id", "hash"])

    return run


def _rebuild(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, gone, texts in columns(batch, "id", "gone", "text"):
                kept, lines_in, lines_out = [], [], []
                for drop, text in zip(gone, texts):
                    lines = (text or "").encode().split(b"\n")
                    stay = lines
                    if drop:
                        drop = set(drop)
                        stay = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and key_hash(k) in drop)]
                    kept.append(b"\n".join(stay).decode())
                    lines_in.append(len(lines))
                    lines_out.append(len(lines) - len(stay))
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(lines_in, pa.int64()), pa.array(lines_out, pa.int64())],
                    ["doc_id", "text", "n_lines", "n_dropped"],
                )

    return run


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: one row per row of ``docs``; ``text`` is what stays."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pairs = scratch.keep(texts.mapInArrow(_hashes(min_chars), "id long, hash binary"), "pairs")
    # Partial counts before the shuffle, so a line of a third of all documents is one row per task.
    # A null id is a document too, hence the coalesce beside the null flag.
    common = scratch.keep(
        pairs.groupBy("hash").agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n_docs")).filter(F.col("n_docs") >= min_docs).select("hash"),
        "common",
    )
    # With its size known from the files, ``common`` is broadcast only under the session's threshold;
    # otherwise both sides are exchanged and AQE splits a hot hash.
    gone = pairs.join(common, "hash").groupBy("id").agg(F.collect_set("hash").alias("gone"))
    met = texts.alias("t").join(gone.alias("g"), F.col("t.id").eqNullSafe(F.col("g.id")), "left").select("t.id", "g.gone", "t.text")
    return met.mapInArrow(_rebuild(min_chars), "doc_id long, text string, n_lines long, n_dropped long")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u
), common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
