"""From links to sections: grouping, one link per page, and limits.

Duplicates are folded within a site and a path, in order of appearance, since a
later link may take the place of an earlier one. All else is windows over a site.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.config import LIMITS
from waymark.functions import plain as T, text as X
from waymark.functions.urls import path_key

PAGES = "Pages"


# -- grouping ------------------------------------------------------------------


def group_key(segments: Column, depth: Column) -> Column:
    """The segment that names a link's group; a page's own segment never does."""
    n = F.size(segments)
    return F.when(n <= 1, F.lit("")).otherwise(F.element_at(segments, F.least(depth, n - 2).cast("int") + 1))


def choose_depth(links: DataFrame) -> DataFrame:
    """``site, depth`` from rows with site and segments; every site that has links gets one."""
    keyed = links.select("site", (F.size("segments") > 1).alias("deep"), group_key(F.col("segments"), F.lit(0)).alias("k0"), group_key(F.col("segments"), F.lit(1)).alias("k1"))
    # One row for each pair of keys, so a site with many links is summed where they are.
    pairs = keyed.filter("deep").groupBy("site", "k0", "k1").agg(F.count(F.lit(1)).alias("n"))
    tops = pairs.groupBy("site", "k0").agg(F.sum("n").alias("n"), F.collect_set("k1").alias("k1s"))
    per_site = tops.groupBy("site").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("shallow"), F.max("n").alias("largest"), F.size(F.array_distinct(F.flatten(F.collect_list("k1s")))).alias("deeper")
    )
    separate = (F.col("shallow") <= 1) & (F.col("deeper") > 1)
    swallowed = (F.col("n") >= 5) & (F.col("largest") >= 0.6 * F.col("n")) & (F.col("deeper") > F.col("shallow"))
    depth = per_site.select("site", F.when(separate | swallowed, 1).otherwise(0).alias("depth"))
    return links.select("site").distinct().join(depth, "site", "left").select("site", F.coalesce("depth", F.lit(0)).alias("depth"))


# -- one link per page -----------------------------------------------------------


def survivors(links: DataFrame, keys: list[str] = ["site"], order: str = "ord") -> DataFrame:  # noqa: B006
    """The links that stay: of those at one path whose titles say the same, the one that says most.

    The fold over a path's links is sequential by definition: a link is held against the
    links kept so far, and the first that matches is replaced if the newcomer is better.
    """
    entry = F.struct(F.col(order).alias("o"), F.col("url").alias("u"), F.col("note").isNotNull().alias("noted"), F.lower(X.trim("title")).alias("t"))
    grouped = links.groupBy(*keys, path_key("url").alias("path_key")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def same(a: Column, b: Column) -> Column:
        return (a["t"] == b["t"]) | (X.token_coverage(a["c"], b["c"]) == 1) | (X.token_coverage(b["c"], a["c"]) == 1)

    def step(kept: Column, x: Column) -> Column:
        hit = F.transform(kept, lambda k: same(k, x))
        at = F.array_position(hit, F.lit(True))
        held = F.get(kept, (at - 1).cast("int"))
        better = (~held["noted"] & x["noted"]) | ((held["noted"] == x["noted"]) & (F.length(x["u"]) < F.length(held["u"])))
        swapped = F.transform(kept, lambda k, i: F.when((i == at - 1) & better, x).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(swapped)

    # Most paths have one link, which stays; words are taken where there is something to hold them against.
    worded = F.transform("entries", lambda x: F.struct(x["o"].alias("o"), x["u"].alias("u"), x["noted"].alias("noted"), x["t"].alias("t"), X.content_tokens(x["t"]).alias("c")))
    grouped = grouped.select(*keys, F.col("entries")[0]["o"].alias("first"), F.when(F.size("entries") > 1, worded).alias("entries"))
    kept = F.aggregate("entries", F.slice("entries", 1, 0), step)
    stay = grouped.select(*keys, F.explode(F.coalesce(F.transform(kept, lambda k: k["o"]), F.array("first"))).alias(order))
    return links.join(stay, [*keys, order], "left_semi")


def first_wins(links: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key."""
    return links.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


# -- limits ----------------------------------------------------------------------


def order_sections(sections: DataFrame) -> DataFrame:
    """``section_ord``: larger sections first, by first appearance on a tie, the catch-all last."""
    order = Window.partitionBy("site").orderBy(F.col("section") == PAGES, F.when(F.col("section") != PAGES, -F.col("n")), "first_ord")
    sizes = sections.groupBy("site", "section").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return sizes.withColumn("section_ord", F.row_number().over(order) - 1)


def curate(links: DataFrame) -> DataFrame:
    """``site, section, section_ord, link_ord, url, title, note`` from rows with site, section_key, section,
    section_ord, ord, url, title and note: one link per page, no section of one link, and at most
    so many sections, links in a section and links in all, those with notes first."""
    # Position before anything is dropped: section by section, then in a section's order.
    single = survivors(links.withColumn("place", F.struct("section_ord", "ord")), order="place")
    # A site has few sections, so what is decided by section is decided on rows of sections and joined back.
    sections = single.groupBy("site", "section_key").agg(F.count(F.lit(1)).alias("n"), F.min("section").alias("section"), F.min("section_ord").alias("section_ord"))
    sections = sections.withColumn("orphan", (F.col("n") == 1) & (F.col("section") != PAGES))
    # Orphans go to the first catch-all, after its own links, or to a new one at the end.
    catch_all = sections.filter(~F.col("orphan") & (F.col("section") == PAGES)).groupBy("site").agg(F.min("section_ord").alias("catch"))
    folded = sections.join(catch_all, "site", "left").select(
        "site", "section_key", "orphan", F.when(F.col("orphan"), F.coalesce("catch", F.lit(1 << 30))).otherwise(F.col("section_ord")).alias("section_ord"),
        F.when(F.col("orphan"), PAGES).otherwise(F.col("section")).alias("section"),
    )
    numbered = folded.withColumn("nth_section", F.dense_rank().over(Window.partitionBy("site").orderBy("section_ord"))).filter(F.col("nth_section") <= LIMITS.sections)
    within = Window.partitionBy("site", "nth_section").orderBy(F.col("note").isNull(), "orphan", "place")
    ranked = single.drop("section", "section_ord").join(numbered, ["site", "section_key"]).withColumn("link_ord", F.row_number().over(within)).filter(F.col("link_ord") <= LIMITS.links_per_section)
    budget = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("nth_section", "link_ord"))).filter(F.col("nth") <= LIMITS.links_per_site)
    return budget.select("site", "section", (F.col("nth_section") - 1).alias("section_ord"), (F.col("link_ord") - 1).alias("link_ord"), "url", "title", "note")


def cap_optional(links: DataFrame) -> DataFrame:
    """One link per page among the optional ones, and at most so many of them."""
    nth = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
    return survivors(links).withColumn("nth", nth).filter(F.col("nth") <= LIMITS.optional_links).drop("nth")


def chunk_links(links: DataFrame, size: int = LIMITS.chunk_links) -> DataFrame:
    """Links of a section in chunks, the Optional section left out."""
    nth = F.row_number().over(Window.partitionBy("site", "section_ord").orderBy("link_ord")) - 1
    return links.filter("section_ord >= 0").withColumn("chunk_no", F.floor(nth / size).cast("int"))


def skeleton(links: DataFrame, size: int = LIMITS.skeleton_titles) -> DataFrame:
    """``site, section, section_ord, sample``: a section's first titles."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("link_ord", "title"))), lambda x: x["title"])
    made = links.filter("section_ord >= 0").groupBy("site", "section", "section_ord").agg(titles.alias("t"))
    more = F.when(F.size("t") > size, F.lit(", ...")).otherwise(F.lit(""))
    return made.select("site", "section", "section_ord", F.concat(F.array_join(F.slice("t", 1, size), ", "), more).alias("sample"))


# -- the same for one page, whose links are at hand ------------------------------------


def survivors_plain(links: list[dict]) -> list[dict]:
    """``survivors`` of links in order of appearance."""
    slots: dict[str, list[int]] = {}
    said = [T.trim(x["title"]).lower() for x in links]
    worth = [(not x["note"], len(x["url"])) for x in links]
    for n, x in enumerate(links):
        at_path = slots.setdefault(x["url"].split("?")[0].split("#")[0], [])
        same = [k for k, held in enumerate(at_path) if said[n] == said[held] or 1 in (T.coverage(said[n], said[held]), T.coverage(said[held], said[n]))]
        if not same:
            at_path.append(n)
        elif worth[n] < worth[at_path[same[0]]]:
            at_path[same[0]] = n
    stay = {n for at_path in slots.values() for n in at_path}
    return [x for n, x in enumerate(links) if n in stay]


def curate_plain(sections: list[dict]) -> list[dict]:
    """``curate`` of one page's sections, in their order."""
    placed = [(at, s["name"], x) for at, s in enumerate(sections) for x in s["links"]]
    stay = set(map(id, survivors_plain([x for _, _, x in placed])))
    placed = [row for row in placed if id(row[2]) in stay]
    sizes = Counter(at for at, _, _ in placed)
    # A link alone in its section goes to the first catch-all, behind its own links, or to a new one at the end.
    catch_all = min((at for at, name, _ in placed if name == PAGES), default=len(sections))
    rows = []
    for at, name, x in placed:
        orphan = sizes[at] == 1 and name != PAGES
        rows.append((catch_all if orphan else at, not x["note"], orphan, len(rows), PAGES if orphan else name, x))
    out, room = [], LIMITS.links_per_site
    for _, group in islice(groupby(sorted(rows, key=lambda r: r[:4]), key=lambda r: r[0]), LIMITS.sections):
        links = [(name, x) for *_, name, x in islice(group, min(LIMITS.links_per_section, room))]
        room -= len(links)
        if links:
            out.append({"name": links[0][0], "links": [x for _, x in links]})
    return out
