"""What to crawl: a total order, quotas by section, and waves over a corpus of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.config import LIMITS
from waymark.functions.urls import canonicalize_url, host_of, is_page, path_of, raw_segments
from waymark.operators.extract import page_meta
from waymark.scratch import Scratch
from waymark.sources.robots import allowed

#: The place of a link that no sitemap lists.
NO_POSITION = 9007199254740991


def linked_addresses(links: DataFrame) -> DataFrame:
    """``site, url, inbound`` of links (url, href) as pages have them. A link that starts at the root means the same
    on every page of its site, so equal ones are counted first and each is resolved once."""
    rooted = F.col("href").rlike(r"^/(?!/)")
    base = F.when(rooted, F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)).otherwise(F.col("url"))
    counted = links.groupBy(base.alias("base"), "href").agg(F.count(F.lit(1)).alias("n"))
    resolved = counted.select(host_of("base").alias("site"), canonicalize_url("href", "base").alias("url"), "n").filter("url IS NOT NULL")
    return resolved.groupBy("site", "url").agg(F.sum("n").alias("inbound"))


def section_of(segments: str) -> Column:
    return F.coalesce(F.get(segments, F.lit(0)), F.lit(""))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """``section, nth``: within a site and section, most linked first, then shallow, early, by url."""
    ranked = candidates.withColumn("section", section_of("segments"))
    order = Window.partitionBy("site", "section").orderBy(F.col("inbound").desc(), F.size("segments"), "sitemap_position", "url")
    return ranked.withColumn("nth", F.row_number().over(order))


def section_quotas(sizes: DataFrame, limit: int | str) -> DataFrame:
    """``site, section, size, quota``: one for each section, the rest by largest remainder; where sections
    are as many as slots, one for each of the largest. ``limit`` is a number or a column of ``sizes``."""
    cap = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    site = Window.partitionBy("site")
    rows = sizes.withColumn("sections", F.count(F.lit(1)).over(site)).withColumn("total", F.sum("size").over(site)).withColumn("cap", cap)
    by_size = F.row_number().over(Window.partitionBy("site").orderBy(F.col("size").desc(), "section"))
    share = F.col("cap") - F.col("sections")
    exact = share * F.col("size") / F.col("total")
    rows = rows.withColumn("by_size", by_size).withColumn("whole", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    left = share - F.sum("whole").over(site)
    by_rest = F.row_number().over(Window.partitionBy("site").orderBy(F.col("rest").desc(), "section"))
    rows = rows.withColumn("by_rest", by_rest).withColumn("left", left)
    fair = 1 + F.col("whole") + (F.col("by_rest") <= F.col("left")).cast("long")
    quota = F.when(F.col("sections") >= F.col("cap"), (F.col("by_size") <= F.col("cap")).cast("long")).otherwise(fair)
    return rows.select("site", "section", "size", quota.cast("long").alias("quota"))


def plan(candidates: DataFrame, limit: int | str) -> DataFrame:
    """``site, plan_pos, url``: sections take turns within their quotas, then beyond them, up to the limit.

    A turn is a rank within a section, so the rounds have a closed form: order by phase,
    round and section. ``limit`` is a number or a column that is one value for each site.
    """
    cap = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    # No section gives more than the limit. Where it is a number each task cuts its rows before they move.
    ranked = rank_candidates(candidates).filter(F.col("nth") <= cap)
    keep = [limit] if isinstance(limit, str) else []
    sizes = candidates.groupBy("site", section_of("segments").alias("section"), *keep).agg(F.count(F.lit(1)).alias("size"))
    met = ranked.join(section_quotas(sizes, limit).select("site", "section", "size", "quota"), ["site", "section"])
    beyond = F.col("nth") > F.col("quota")
    turn = F.when(beyond, F.col("nth") - F.least("quota", "size")).otherwise(F.col("nth"))
    order = Window.partitionBy("site").orderBy(beyond, turn, "section")
    return met.withColumn("plan_pos", F.row_number().over(order)).filter(F.col("plan_pos") <= cap).select("site", "plan_pos", "url")


def candidates_from(mentions: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Candidates from mentions (site, url, sitemap_position, ord; url canonical): on the site, a page,
    allowed; each once, as first mentioned. Counts take in every mention, on the site or not."""
    first = mentions.groupBy("site", "url").agg(F.min_by("sitemap_position", "ord").alias("sitemap_position"), F.count(F.lit(1)).alias("inbound"))
    own = first.withColumn("path", path_of("url")).filter((host_of("url") == F.col("site")) & is_page("path"))
    if rules is not None:
        own = allowed(own, rules).filter("allowed").drop("allowed")
    return own.select("site", "url", "sitemap_position", raw_segments("url").alias("segments"), "inbound")


def crawl(pages: DataFrame, seeds: DataFrame, sitemap: DataFrame | None = None, rules: DataFrame | None = None, limits=LIMITS) -> DataFrame:
    """``site, wave, plan_pos, page_id, url, title, description, links`` of the pages read.

    ``pages`` (page_id, url, html) stands for the web; ``seeds`` has site and the seed page's url.
    Each wave is planned from all that the ones before found; a planned page that the corpus lacks
    has failed and gives its slot back. Waves are written to the shared folder.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "crawl")
    where = pages.filter(F.col("url").isNotNull()).withColumn("canonical", canonicalize_url("url", "url"))
    # A page is parsed when it is fetched, so the corpus is only looked up by address here.
    addresses = scratch.keep(where.groupBy("canonical").agg(F.min("page_id").alias("page_id")), "addresses")

    def fetch(planned: DataFrame, name: str) -> DataFrame:
        hit = planned.join(addresses, planned["url"] == addresses["canonical"]).drop("canonical").withColumnRenamed("url", "asked")
        read = pages.join(hit.select("page_id").distinct(), "page_id", "left_semi")
        return scratch.keep(page_meta(read).drop("page_url").join(hit, "page_id"), name)

    start = seeds.select("site", canonicalize_url("url", "url").alias("url")).filter("url IS NOT NULL")
    done = read = fetch(start.withColumn("wave", F.lit(0)).withColumn("plan_pos", F.lit(0)), "wave-0")
    taken = start
    mentions = None
    if sitemap is not None:
        listed = sitemap.select("site", canonicalize_url("url", F.concat(F.lit("https://"), "site")).alias("url"), F.col("position").alias("sitemap_position"), F.col("position").alias("ord")).filter("url IS NOT NULL")
        mentions = scratch.keep(listed, "listed")
    for wave in range(1, limits.waves + 1):
        # A wave's links are resolved once, not again for each later wave.
        links = read.select("site", F.posexplode("links").alias("i", "href"), F.col("asked").alias("base"), (F.col("wave") * 1_000_000 + F.col("plan_pos")).alias("page_ord"))
        found = links.select("site", canonicalize_url("href", "base").alias("url"), F.lit(NO_POSITION).alias("sitemap_position"), (F.lit(1 << 50) + F.col("page_ord").cast("long") * 1_000_000 + F.col("i")).alias("ord")).filter("url IS NOT NULL")
        found = scratch.keep(found, f"found-{wave}")
        mentions = found if mentions is None else mentions.unionByName(found)
        pool = candidates_from(mentions, rules).join(taken, ["site", "url"], "left_anti")
        room = seeds.select("site").distinct().join(done.filter("wave > 0").groupBy("site").agg(F.count(F.lit(1)).alias("n")), "site", "left")
        room = room.select("site", (F.lit(limits.pages_per_site - 1) - F.coalesce("n", F.lit(0))).alias("room")).filter("room > 0")
        # Written: ranks and sizes of sections are both made from these rows.
        pool = scratch.keep(pool.join(room, "site"), f"pool-{wave}")
        planned = scratch.keep(plan(pool, "room").withColumn("wave", F.lit(wave)), f"plan-{wave}")
        if not planned.limit(1).count():
            break
        taken = taken.unionByName(planned.select("site", "url"))
        read = fetch(planned, f"wave-{wave}")
        done = done.unionByName(read)
    return done
