"""Snapshots of pages as a stream: each micro-batch is checked against the store.

An extension of the scheduled check: what it computes for a batch is what
``waymark.operators.monitor`` computes for a table. A batch may bring some of a site's
pages only, so what is known of its other pages is kept beside the store, and a site's
fingerprint is of all of them. Both tables are written once for a batch and under its
number, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions.urls import canonicalize_url, host_of
from waymark.operators.extract import page_meta
from waymark.operators.monitor import check, structure_hash
from waymark.scratch import Scratch
from waymark.sources.store import GenerationStore, LinkStore, recorded, upserted

PAGES = "page_id long, url string, html string"


def links_of(pages: DataFrame) -> DataFrame:
    """``site, url, title`` of pages; of two at one address the later one."""
    meta = page_meta(pages)
    rows = meta.select("page_id", host_of("page_url").alias("site"), canonicalize_url("page_url", "page_url").alias("url"), "title").filter("url IS NOT NULL")
    return rows.groupBy("site", "url").agg(F.max_by("title", "page_id").alias("title"))


def fingerprints(links: DataFrame) -> DataFrame:
    """``url, structure_hash`` of each site (host)."""
    heads = links.select("site").distinct().withColumn("site_name", F.col("site"))
    return structure_hash(heads, links).select(F.col("site").alias("url"), "structure_hash")


def apply_batch(store: GenerationStore, pages: DataFrame, batch: int) -> None:
    """Take a batch's pages in, check its sites, record the outcomes: once for each number of a batch."""
    tag, links = f"b{batch}", LinkStore(store.spark, f"{store.root}-links")
    if store.has(tag):
        return
    here = Scratch(store.spark, "stream").keep(links_of(pages), "links")
    if not links.has(tag):
        links.replace(links.read().join(here, ["site", "url"], "left_anti").unionByName(here), tag)
    known = links.read().join(here.select("site").distinct(), "site", "left_semi")
    none, now = F.lit(None).cast("string"), F.current_timestamp()
    current = fingerprints(known).select("url", none.alias("sitemap_hash"), "structure_hash", F.lit(True).alias("usable"), none.alias("published_text"))
    stored = store.read()
    new = current.join(stored.select("url"), "url", "left_anti")
    taken = upserted(stored, new.select("url", F.lit("").alias("llms_txt"), "structure_hash", F.lit("generated").alias("source"), none.alias("published_at"), now.alias("now")))
    outcome = check(taken.join(current.select("url"), "url", "left_semi"), current)
    store.replace(recorded(taken, outcome.select("*", none.alias("llms_txt"), now.alias("now"))), tag)


def watch(spark: SparkSession, source: str, store: GenerationStore, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Run over the files that arrive in ``source`` until none is left; a restart carries on from ``checkpoint``."""
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, number: apply_batch(store, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
