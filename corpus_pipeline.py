"""From raw documents to packed sequences: five stages, each written and read again.

Every row is judged by itself: toxicity and benchmark where it is, exact and near copies by its id
and its text. So rows that share an id may fare differently, and rows without one are judged as
well. Of equal rows one stays. Empty tables pass through; columns of any name pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waymark.llm._arrow import unused
from waymark.llm.decontaminate import uncontaminated
from waymark.llm.exact_dedup import exact_dedup
from waymark.llm.packing import pack
from waymark.llm.simhash import first_of_groups
from waymark.llm.toxicity import ToxicityModel, held_out
from waymark.scratch import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; labels decide nothing themselves."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return ToxicityModel.fit(docs, labels).keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that are repeated with their id, the first by its other columns."""
    kept = exact_dedup(docs).filter("kept")
    i, none, sha, nth = unused(docs, "kept_id", "kept_null", "kept_sha", "kept_nth")
    # Plain keys that window and join share, so that rows move once; a task cuts repeated rows to one before they move.
    keys = kept.select(F.coalesce("doc_id", F.lit(0)).alias(i), F.isnull("doc_id").alias(none), F.col("text_sha256").alias(sha))
    marked = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.isnull("doc_id"), sha: F.sha2(F.coalesce("text", F.lit("")), 256)})
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    once = marked.withColumn(nth, F.row_number().over(Window.partitionBy(i, none, sha).orderBy(others))).filter(F.col(nth) == 1)
    return once.join(keys, [i, none, sha], "left_semi").select(*[f"`{c}`" for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, sources in their proportions."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("decontaminate", benchmark), ("packing", packing)]

#: Models, fingerprints and tokens are not SQL; tests hold the stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
