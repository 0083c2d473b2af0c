"""The table of generated files: snapshots that are replaced whole, and how it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.functions.text import hash_content
from waymark.functions.urls import display_url
from waymark.scratch import delete_path, move_new

GENERATIONS = (
    "url string, llms_txt string, content_hash string, generated_at timestamp, structure_hash string, sitemap_hash string, "
    "last_checked_at timestamp, changed_at timestamp, change_count int, source string, published_at string"
)
SUMMARY = ["url", "generated_at", "last_checked_at", "changed_at", "source"]


class Snapshots:
    """A table that is replaced whole: each write makes a new snapshot and renames it into place, so a
    reader or a lost job sees one whole state. A write may have a tag, under which it is made once."""

    schema: str

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return hadoop(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def snapshots(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(n for x in fs.listStatus(path(self.root)) if (n := x.getPath().getName()).startswith("s-"))

    def has(self, tag: str) -> bool:
        """Whether one of the newest snapshots was written under the tag."""
        return any(n[10:] == f"-{tag}" for n in self.snapshots())

    def read(self) -> DataFrame:
        found = self.snapshots()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{found[-1]}")

    def replace(self, rows: DataFrame, tag: str | None = None) -> None:
        found = self.snapshots()
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        number = int(found[-1][2:10]) + 1 if found else 1
        move_new(self.spark, draft, f"{self.root}/s-{number:08d}" + (f"-{tag}" if tag else ""))
        for old in found[:-1]:
            delete_path(self.spark, f"{self.root}/{old}")


class GenerationStore(Snapshots):
    """The generated files, one row for each site."""

    schema = GENERATIONS

    def upsert(self, new: DataFrame) -> None:
        self.replace(upserted(self.read(), new))

    def record_checks(self, outcomes: DataFrame) -> None:
        self.replace(recorded(self.read(), outcomes))


class LinkStore(Snapshots):
    """What is known of the pages of watched sites."""

    schema = "site string, url string, title string"


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with rows of url, llms_txt, structure_hash, source, published_at, now: written anew, what they lack kept."""
    kept = old.select("url", F.col("sitemap_hash").alias("k_sitemap"), F.col("changed_at").alias("k_changed"), F.col("change_count").alias("k_count"))
    written = new.join(kept, "url", "left").select(
        "url", "llms_txt", hash_content("llms_txt").alias("content_hash"), F.col("now").alias("generated_at"), "structure_hash",
        F.col("k_sitemap").alias("sitemap_hash"), F.col("now").alias("last_checked_at"), F.col("k_changed").alias("changed_at"),
        F.coalesce("k_count", F.lit(0)).alias("change_count"), F.coalesce("source", F.lit("generated")).alias("source"), "published_at",
    )
    return old.join(new.select("url"), "url", "left_anti").select(*written.columns).unionByName(written)


def recorded(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``stored`` with outcomes of checks (url, result, changed, structure_hash, sitemap_hash, llms_txt or null,
    now; deferred ones write nothing): fingerprints and the time always, the text and its times if there is a new one."""
    o = outcomes.filter("result <> 'deferred'").select("url", F.lit(True).alias("hit"), "changed", F.col("structure_hash").alias("n_structure"), F.col("sitemap_hash").alias("n_sitemap"), F.col("llms_txt").alias("n_text"), "now")
    rows = stored.join(o, "url", "left")
    hit, text = F.col("hit").isNotNull(), F.col("n_text").isNotNull()
    pick = lambda cond, new, old: F.when(cond, new).otherwise(F.col(old)).alias(old)
    return rows.select(
        "url", pick(text, F.col("n_text"), "llms_txt"), pick(text, hash_content("n_text"), "content_hash"), pick(text, F.col("now"), "generated_at"),
        pick(hit, F.coalesce("n_structure", F.lit("")), "structure_hash"), pick(hit, F.col("n_sitemap"), "sitemap_hash"), pick(hit, F.col("now"), "last_checked_at"),
        pick(hit & F.col("changed"), F.col("now"), "changed_at"), "change_count", "source", "published_at",
    )


def read_one(generations: DataFrame, url: str) -> DataFrame:
    return generations.filter(F.col("url") == url).limit(1)


def list_latest(generations: DataFrame, limit: int = 100) -> DataFrame:
    """The newest files, without their text."""
    return generations.select(*SUMMARY).orderBy(F.col("generated_at").desc(), "url").limit(limit)


def queue(generations: DataFrame, limit: int) -> DataFrame:
    return generations.orderBy(F.col("last_checked_at").asc_nulls_first(), "url").limit(limit)


def matches_address(url: Column, query: Column) -> Column:
    """Every term of the query is part of the address as displayed."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")
    shown = F.lower(display_url(url))
    return F.forall(terms, lambda t: F.contains(shown, t))


def to_ndjson(events: DataFrame, order: str) -> DataFrame:
    """``value``: events as lines of JSON, in order; ``write.text`` makes the file."""
    return events.orderBy(order).select(F.to_json(F.struct(*[c for c in events.columns if c != order])).alias("value"))


def sample_links(page: DataFrame, pattern: str, n: int, seed: int = 0) -> DataFrame:
    """``url``: n of a directory page's links, the same for a seed."""
    found = page.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("url")).distinct()
    return found.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), "url"), 256), "url").limit(n)


def as_json(generations: DataFrame) -> DataFrame:
    """``url, body``: rows as the read interface answers with them."""
    fields = F.struct("url", "content_hash", "source", F.col("changed_at").isNotNull().alias("changed"), "published_at")
    return generations.select("url", F.to_json(fields).alias("body"))
