"""Crawled pages and a home page's own links, made into one site map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from waymark.config import LIMITS
from waymark.functions import text as X
from waymark.functions.urls import path_of, path_segments, query_of
from waymark.operators.curate import PAGES, cap_optional, choose_depth, curate, group_key
from waymark.scratch import Scratch


def repeated(pages: DataFrame, column: str) -> DataFrame:
    """``site, value`` of what a site says on a fifth of its pages, and on three at least: its template's words."""
    value = X.trim(column)
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    said = pages.select("site", value.alias("value")).filter("value <> ''").groupBy("site", "value").agg(F.count(F.lit(1)).alias("n"))
    return said.join(totals, "site").filter(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("n_pages") * 0.2))).select("site", "value", "n", "n_pages")


def note_from(description, title, is_repeated):
    """A page's description as a note: long enough, cut to length, more than its title, its own."""
    short = X.escape_inline(description)
    note = X.truncate_note(short)
    ok = (F.length(short) >= LIMITS.least_note_chars) & ~F.coalesce(is_repeated, F.lit(False)) & (X.coverage(note, title) <= 0.75)
    return F.when(ok, note)


def merge_links(home_links: DataFrame, pages: DataFrame) -> DataFrame:
    """``site, ord, url, title, description, is_repeated``: home links with what their pages say, then the other pages.

    ``home_links``: site, ord, url, title, note. ``pages``: site, ord, url, title, description.
    """
    key = F.regexp_replace("url", "/$", "")
    titles = repeated(pages, "title").select(F.col("site").alias("t_site"), F.col("value").alias("t_value"), F.lit(True).alias("t_rep"))
    notes = repeated(pages, "description").select(F.col("site").alias("d_site"), F.col("value").alias("d_value"), F.lit(True).alias("d_rep"))
    known = pages.withColumn("key", key).join(titles, (F.col("site") == F.col("t_site")) & (X.trim("title") == F.col("t_value")), "left").drop("t_site")
    known = known.join(notes, (F.col("site") == F.col("d_site")) & (X.trim("description") == F.col("d_value")), "left").drop("d_site")
    # Of two pages at one address the later one speaks; the place is the first one's.
    known = known.groupBy("site", "key").agg(
        F.min("ord").alias("p_ord"),
        F.max_by(F.struct("url", "title", "description", F.coalesce("t_rep", F.lit(False)).alias("t_rep"), F.coalesce("d_rep", F.lit(False)).alias("d_rep")), "ord").alias("p"),
        F.min_by(F.struct("url", "title", "description", F.coalesce("d_rep", F.lit(False)).alias("d_rep")), "ord").alias("q"),
    )
    own = home_links.withColumn("key", key).groupBy("site", "key").agg(F.min("ord").alias("h_ord"), F.max_by(F.struct("url", "title", "note"), "ord").alias("h"))
    met = own.join(known, ["site", "key"], "full")
    home = F.col("h").isNotNull()
    title = F.when(home, F.coalesce(F.when(~F.col("p.t_rep") & (F.col("p.title") != ""), F.col("p.title")), F.col("h.title"))).otherwise(F.col("q.title"))
    usable = F.when(~F.col("p.d_rep") & (X.trim("p.description") != ""), X.trim("p.description"))
    description = F.when(home, F.coalesce(usable, F.col("h.note"))).otherwise(F.col("q.description"))
    whole_site = notes.withColumnRenamed("d_rep", "is_repeated")
    rows = met.select(
        "site",
        F.struct((~home).alias("late"), F.coalesce("h_ord", "p_ord").alias("at")).alias("place"),
        F.coalesce("h.url", "q.url").alias("url"),
        title.alias("title"),
        description.alias("description"),
    )
    rows = rows.join(whole_site, (F.col("site") == F.col("d_site")) & (X.trim("description") == F.col("d_value")), "left").drop("d_site", "d_value")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("place")).cast("long")).drop("place")


def sections_of(entries: DataFrame, site_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (site, ord, url, title, note) as links with sections, and the optional ones.

    ``site_names``: site, site_name.
    """
    rows = entries.withColumn("segments", path_segments("url"))
    depth = choose_depth(rows)
    address = F.concat(path_of("url"), query_of("url"))
    rows = rows.join(depth, "site").withColumn("section_key", group_key(F.col("segments"), F.col("depth")))
    aside = X.is_optional(address, F.col("title"))
    main = rows.filter(~aside).join(site_names, "site", "left")
    named = X.humanize("section_key")
    main = main.withColumn("section", F.when(F.col("section_key") == "", PAGES).otherwise(X.tidy_label(named, named, F.col("site_name"))))
    sizes = main.groupBy("site", "section_key", "section").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    last = F.col("section") == PAGES
    order = F.row_number().over(Window.partitionBy("site").orderBy(last, F.when(~last, -F.col("n")), "first_ord")) - 1
    main = main.join(sizes.withColumn("section_ord", order).select("site", "section_key", "section_ord"), ["site", "section_key"])
    columns = ["site", "section_key", "section", "section_ord", "ord", "url", "title", "note"]
    return main.select(*columns), rows.filter(aside).select("site", "ord", "url", "title", "note")


def build_from_crawl(home_links: DataFrame, pages: DataFrame, heads: DataFrame) -> DataFrame:
    """``site, section, section_ord, link_ord, url, title, note``; the optional links have section_ord -1.

    ``heads``: site, home_url, site_name.
    """
    merged = merge_links(home_links, pages).join(heads.select("site", "home_url"), "site").filter(F.col("url") != F.col("home_url"))
    slug = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), path_segments("url")), -1), F.lit(""))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(X.humanize(slug))
    entries = merged.withColumn("title", title).filter("title <> ''").withColumn("note", note_from(F.col("description"), F.col("title"), F.col("is_repeated")))
    # Two spellings of an address can be left where one of them ended in a slash: the first stays.
    once = entries.withColumn("n", F.row_number().over(Window.partitionBy("site", "url").orderBy("ord"))).filter("n = 1")
    # Written: depth, sizes, order and links are all made from these rows.
    entries = Scratch(heads.sparkSession, "merged").keep(once.select("site", "ord", "url", "title", "note"), "entries")
    main, optional = sections_of(entries, heads.select("site", "site_name"))
    capped = cap_optional(optional).withColumn("link_ord", F.row_number().over(Window.partitionBy("site").orderBy("ord")) - 1)
    return curate(main).unionByName(capped.select("site", F.lit("Optional").alias("section"), F.lit(-1).alias("section_ord"), "link_ord", "url", "title", "note"))


def keep_larger(single: DataFrame, crawled: DataFrame) -> DataFrame:
    """Per site the crawled links, or the home page's own where those are more."""
    count = lambda df, name: df.groupBy("site").agg(F.count(F.lit(1)).alias(name))
    sizes = count(single, "s").join(count(crawled, "c"), "site", "full").fillna(0)
    alone = sizes.filter("s > c").select("site")
    return crawled.join(alone, "site", "left_anti").unionByName(single.join(alone, "site", "left_semi"))
