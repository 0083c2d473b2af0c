"""Queries over made-up sites: pages, links and crawls that the given pages table does not have.

Sites, their home pages and their parts' pages are built from the part table by rules, so the SQL
of a query can say what must come out without parsing a page: forty parts make a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import text as X
from waymark.operators import curate as C, extract as E, markdown as M, merge as G
from waymark.plans import crawl as K
from waymark.plans.queries import _table, query
from waymark.scratch import Scratch
from waymark.sources import robots as B

PER_SITE = 40
PARTS = f"p AS (SELECT p_partkey AS key, p_partkey // {PER_SITE} AS k, p_partkey % {PER_SITE} AS idx, lower(p_type) AS type, p_name AS name FROM part)"


def _parts(spark, d) -> DataFrame:
    rows = _table(spark, d, "part")
    return rows.select(
        F.col("p_partkey").alias("key"), F.floor(F.col("p_partkey") / PER_SITE).alias("k"), (F.col("p_partkey") % PER_SITE).alias("idx"),
        F.lower("p_type").alias("type"), F.col("p_name").alias("name"),
    )


def _cat(*pieces: str | Column) -> Column:
    """Strings are written out, columns filled in."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _joined(order: Column, html: Column) -> Column:
    """An aggregate: pieces of HTML in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), html.alias("h")))), lambda x: x["h"]), "")


# -- home pages with cards, a nav and furniture ------------------------------------------


def _shops(spark, d) -> DataFrame:
    """``page_id, url, html``: a home page for each forty parts, every part a card in its type's section.

    Every fifth part is linked from the nav as well, by a shorter name and with a tracking key; every
    third card has a note. The footer has a privacy page, another site, a file and the page itself.
    """
    p = _parts(spark, d)
    k, key, name, kind = F.col("k"), F.col("key"), F.col("name"), F.col("type")
    href = _cat("/shop/", kind, "/", key)
    nav = _joined(F.col("idx"), F.when(F.col("idx") % 5 == 0, _cat('<li><a href="', href, '?utm_source=nav">', name, "</a></li>")).otherwise(""))
    note = F.when(F.col("idx") % 3 == 0, _cat("<p>Kept on shelf ", key, " of the long hall by the river</p>")).otherwise("")
    card = _cat('<div class="card"><a href="', href, '">', name, " ", key, "</a>", note, "</div>")
    sections = p.groupBy("k", "type").agg(_cat("<section><h2>Explore ", F.initcap("type"), "</h2>", _joined(F.col("idx"), card), "</section>").alias("s")).groupBy("k").agg(_joined(kind, F.col("s")).alias("sections"))
    named = F.when(k % 2 == 0, _cat('<meta property="og:site_name" content="Shop ', k, '"><title>Welcome</title>')).otherwise(_cat("<title>Shop number ", k, " of the town | Acme</title>"))
    head = _cat("<html><head>", named, '<meta name="description" content="Shop ', k, ' keeps every part in stock. Orders go out daily."><link rel="describedby" href="/llms.txt"></head><body>')
    told = "<article><p>The shop has sold parts since the mill was built, and it still sends every one of them by boat to the towns along the river.</p></article>"
    foot = '<footer><a href="/privacy">Privacy</a><a href="https://other.example/x">Other</a><a href="/files/list.pdf">List</a><a href="/">Start</a></footer></body></html>'
    homes = p.groupBy("k").agg(nav.alias("nav")).join(sections, "k")
    return homes.select(k.alias("page_id"), _cat("https://shop", k, ".example/").alias("url"), _cat(head, "<nav><ul>", F.col("nav"), "</ul></nav>", F.col("sections"), told, foot).alias("html"))


SHOP_LINKS = f"""{PARTS},
l AS (SELECT *, CASE WHEN idx % 5 = 0 THEN name ELSE name || ' ' || key END AS title, CASE WHEN idx % 5 = 0 THEN '0' || lpad(CAST(idx AS VARCHAR), 4, '0') ELSE '1' || type || lpad(CAST(idx AS VARCHAR), 4, '0') END AS ord,
  CASE WHEN idx % 3 = 0 THEN 'Kept on shelf ' || key || ' of the long hall by the river' END AS note FROM p),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, type, title ORDER BY ord) AS nth, min(ord) OVER (PARTITION BY k, type) AS first FROM l) WHERE nth = 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY k, type) AS n FROM once),
secs AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY -n, first) AS so FROM sized),
folded AS (SELECT *, CASE WHEN n = 1 THEN 1000 ELSE so END AS so2, CASE WHEN n = 1 THEN 'Pages' ELSE upper(type[1]) || type[2:] END AS section FROM secs),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY so2) - 1 AS section_ord, row_number() OVER (PARTITION BY k, so2 ORDER BY note IS NULL, so, length(title), ord) - 1 AS link_ord FROM folded)"""


@query(
    f"""WITH {SHOP_LINKS}
    SELECT 'https://shop' || k || '.example/' AS site, section, CAST(section_ord AS INT) AS section_ord, CAST(link_ord AS INT) AS link_ord, 'https://shop' || k || '.example/shop/' || type || '/' || key AS url, title, note FROM placed WHERE link_ord < 25
    UNION ALL SELECT DISTINCT 'https://shop' || k || '.example/', 'Optional', -1, 0, 'https://shop' || k || '.example/privacy', 'Privacy', NULL FROM p"""
)
def shop_links(spark, d):
    """Links that home pages' own markup gives: named, noted, grouped under headings, told apart, limited."""
    return E.site_links(E.extractions(_shops(spark, d)))


@query(
    f"""WITH {PARTS} SELECT DISTINCT 'https://shop' || k || '.example/' AS url, CASE WHEN k % 2 = 0 THEN 'Shop ' || k ELSE 'Shop number ' || k || ' of the town' END AS site_name, 'Shop ' || k || ' keeps every part in stock.' AS summary,
      'The shop has sold parts since the mill was built, and it still sends every one of them by boat to the towns along the river.' AS prose, false AS client_rendered, 'https://shop' || k || '.example/llms.txt' AS existing_file FROM p
    UNION ALL SELECT DISTINCT 'https://shell' || k || '.example/', 'shell' || k || '.example', NULL, '', true, NULL FROM p"""
)
def shop_heads(spark, d):
    """What home pages say of themselves, and application shells beside them."""
    shops = _shops(spark, d)
    shell = _cat("https://shell", F.col("page_id"), ".example/")
    shells = shops.select("page_id", shell.alias("url"), F.lit('<html><body><div id="root"></div><script src="/app.js"></script></body></html>').alias("html"))
    rows = E.extractions(shops.unionByName(shells)).select("url", "extraction.*")
    return rows.select("url", "site_name", "summary", F.array_join("prose", "|").alias("prose"), "client_rendered", "existing_file")


# -- pages of parts, crawled -----------------------------------------------------------------


SIDES = ["north", "south", "east", "west"]
_SIDE = "['north', 'south', 'east', 'west'][1 + CAST({0} % 4 AS INT)]"
TEMPLATE_TITLE, TEMPLATE_SAYS = "All the parts of the yard", "Every part of this yard is kept dry and sold by weight"
ROBOTS = "User-agent: *\nDisallow: /p/west/\n"


def _side(key: Column) -> Column:
    return F.get(F.array(*map(F.lit, SIDES)), (key % 4).cast("int"))


def _town(k: Column) -> Column:
    return _cat("town", k, ".example")


def _stall(key: Column) -> Column:
    return _cat("/p/", _side(key), "/", key)


def _towns(spark, d) -> DataFrame:
    """``page_id, url, html``: a home page a town with a link to every third stall, and the stalls' pages, each
    with a link to the next unless that one is linked from home; every seventh stall has no page."""
    # Spread first: the table is small as a file, one task then, but its pages are not.
    p = _parts(spark, d).repartition("key")
    k, key, idx = F.col("k"), F.col("key"), F.col("idx")
    link = _cat('<a href="', _stall(key), '">', F.col("name"), "</a>")
    homes = p.groupBy("k").agg(_joined(idx, F.when(idx % 3 == 0, link).otherwise("")).alias("links")).select(k.alias("page_id"), _cat("https://", _town(k), "/").alias("url"), _cat("<title>Town ", k, "</title>", F.col("links")).alias("html"))
    title = F.when(key % 5 == 2, F.lit(TEMPLATE_TITLE)).otherwise(_cat(F.col("name"), " ", key))
    says = F.when(key % 5 == 0, _cat("Part ", key, " was made in the north mill")).when((key % 5).isin(1, 3), F.lit(TEMPLATE_SAYS))
    meta = F.when(says.isNotNull(), _cat('<meta name="description" content="', says, '">')).otherwise("")
    canonical = F.when(idx % 4 == 0, _cat('<link rel="canonical" href="', _stall(key), '">')).when(idx % 4 == 1, F.lit('<link rel="canonical" href="https://elsewhere.example/">')).otherwise("")
    onward = F.when(idx % 3 < 2, _cat('<a href="', _stall(key + 1), '#top">on</a>')).otherwise("")
    stalls = p.filter(key % 7 != 0).select((1_000_000 + key).alias("page_id"), _cat("https://", _town(k), _stall(key)).alias("url"), _cat("<title>", title, " | T", k, "</title>", meta, canonical, "<p>Back</p>", onward).alias("html"))
    return homes.unionByName(stalls)


def _crawled(spark, d) -> DataFrame:
    pages = Scratch(spark, "towns").keep(_towns(spark, d), "pages")
    seeds = pages.filter("page_id < 1000000").select(F.regexp_extract("url", "//([^/]*)", 1).alias("site"), "url")
    rules = B.rules(B.lines(seeds.select("site", F.lit(ROBOTS).alias("text"))))
    return K.crawl(pages, seeds, rules=rules)


CRAWLED = f"""{PARTS}, s AS (SELECT *, key % 4 <> 3 AS ok, key % 7 <> 0 AS present, {_SIDE.format('key')} AS side, 'town' || k || '.example' AS site FROM p),
found AS (SELECT a.*, a.idx % 3 + 1 AS wave, 'https://' || a.site || '/p/' || a.side || '/' || a.key AS url, CASE WHEN a.key % 5 = 2 THEN '{TEMPLATE_TITLE}' ELSE a.name || ' ' || a.key END AS title,
    CASE WHEN a.key % 5 = 0 THEN 'Part ' || a.key || ' was made in the north mill' WHEN a.key % 5 IN (1, 3) THEN '{TEMPLATE_SAYS}' END AS description
  FROM s a LEFT JOIN s b ON b.key = a.key - 1 LEFT JOIN s c ON c.key = a.key - 2
  WHERE a.ok AND a.present AND (a.idx % 3 = 0 OR (b.ok AND b.present)) AND (a.idx % 3 < 2 OR (c.ok AND c.present)))"""


@query(
    f"""WITH {CRAWLED} SELECT site, CAST(wave AS INT) AS wave, url, title, description, CAST(CASE WHEN idx % 3 < 2 THEN 1 ELSE 0 END AS INT) AS n_links FROM found
    UNION ALL SELECT site, 0, 'https://' || site || '/', 'Town ' || k, NULL, CAST(count(*) FILTER (WHERE idx % 3 = 0) AS INT) FROM s GROUP BY site, k"""
)
def town_waves(spark, d):
    """Crawls in waves: what robots rules forbid is not planned, what has no page fails, and what only such pages link to is never found."""
    return _crawled(spark, d).select("site", F.col("wave").cast("int").alias("wave"), "url", "title", "description", F.size("links").alias("n_links"))


TOWN_MAP = f"""{CRAWLED}, said AS (SELECT site, count(*) + 1 AS n, count(*) FILTER (WHERE key % 5 = 2) AS titled, count(*) FILTER (WHERE key % 5 IN (1, 3)) AS told FROM found GROUP BY site),
rep AS (SELECT site, titled >= greatest(3, ceil(n * 0.2)) AS rep_title, told >= greatest(3, ceil(n * 0.2)) AS rep_says FROM said),
home AS (SELECT s.*, idx % 3 = 0 AS linked, 'https://' || site || '/p/' || side || '/' || key AS at, CASE WHEN idx % 2 = 0 THEN 'Kept at stall ' || key || ' of the long hall by the river' END AS home_note FROM s),
met AS (SELECT h.k, h.site, h.key, h.side, h.at AS url, NOT h.linked AS late, h.idx, f.wave,
    CASE WHEN NOT h.linked THEN f.title WHEN f.key IS NOT NULL AND NOT (h.key % 5 = 2 AND coalesce(r.rep_title, false)) THEN f.title ELSE h.name END AS title,
    CASE WHEN f.description IS NOT NULL AND NOT (h.key % 5 IN (1, 3) AND r.rep_says) THEN f.description WHEN h.linked THEN h.home_note END AS note
  FROM home h LEFT JOIN found f USING (key) LEFT JOIN rep r ON r.site = h.site WHERE h.linked OR f.key IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY late, CASE WHEN late THEN wave ELSE 0 END, CASE WHEN late THEN '' ELSE lpad(CAST(idx AS VARCHAR), 3, '0') END, url) AS ord FROM met),
sized AS (SELECT *, count(*) OVER (PARTITION BY site, side) AS n, min(ord) OVER (PARTITION BY site, side) AS first FROM ordered),
secs AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY -n, first) AS so FROM sized),
folded AS (SELECT *, CASE WHEN n = 1 THEN 1000 ELSE so END AS so2, CASE WHEN n = 1 THEN 'Pages' ELSE upper(side[1]) || side[2:] END AS section FROM secs),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY so2) - 1 AS section_ord, row_number() OVER (PARTITION BY site, so2 ORDER BY note IS NULL, so, ord) - 1 AS link_ord FROM folded)"""


def _town_map(spark, d) -> tuple[DataFrame, DataFrame]:
    """Heads and links: home links as a table, with what the crawl found."""
    p = _parts(spark, d)
    k, key, idx, site = F.col("k"), F.col("key"), F.col("idx"), _town(F.col("k"))
    note = F.when(idx % 2 == 0, _cat("Kept at stall ", key, " of the long hall by the river"))
    home = p.filter(idx % 3 == 0).select(site.alias("site"), idx.alias("ord"), _cat("https://", site, _stall(key)).alias("url"), F.col("name").alias("title"), note.alias("note"))
    crawled = _crawled(spark, d).select("site", (F.col("wave") * 1000 + F.col("plan_pos")).cast("long").alias("ord"), "url", "title", "description")
    heads = p.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(site.alias("site"), _cat("https://", site, "/").alias("home_url"), _cat("Town ", k).alias("site_name"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("prose"), F.lit(False).alias("client_rendered"))
    return heads, Scratch(spark, "town-map").keep(G.build_from_crawl(home, crawled, heads), "links")


@query(
    f"""WITH {TOWN_MAP} SELECT site, section, CAST(section_ord AS INT) AS section_ord, CAST(link_ord AS INT) AS link_ord, url, title, note FROM placed WHERE link_ord < 25"""
)
def town_maps(spark, d):
    """The main query: a home page's links and crawled pages made one map, templates' words left out."""
    _, links = _town_map(spark, d)
    return links.select("site", "section", F.col("section_ord").cast("int").alias("section_ord"), F.col("link_ord").cast("int").alias("link_ord"), "url", "title", "note")


@query(
    f"""WITH {TOWN_MAP}, blocks AS (SELECT site, k, section_ord, '## ' || section || chr(10) || chr(10) || string_agg('- [' || title || '](' || url || ')' || coalesce(': ' || note, ''), chr(10) ORDER BY link_ord) || chr(10) AS b FROM placed WHERE link_ord < 25 GROUP BY 1, 2, 3, section)
    SELECT site, '# Town ' || k || chr(10) || chr(10) || string_agg(b, chr(10) ORDER BY section_ord) AS llms_txt FROM blocks GROUP BY site, k"""
)
def town_files(spark, d):
    """The main query's files, whole."""
    heads, links = _town_map(spark, d)
    return M.render(heads, links)


@query(
    f"""WITH {CRAWLED}, v AS (SELECT site, description AS value, count(*) AS n FROM found WHERE description IS NOT NULL GROUP BY 1, 2), t AS (SELECT site, count(*) + 1 AS n_pages FROM found GROUP BY site)
    SELECT v.site, value, n, n_pages FROM v JOIN t USING (site) WHERE n >= greatest(3, ceil(n_pages * 0.2))"""
)
def town_templates(spark, d):
    """Descriptions that a site's template gives."""
    return G.repeated(_crawled(spark, d), "description")


# -- links that fall on one page ----------------------------------------------------------------


_VARIANT = "['Red widget', ' red WIDGET ', 'The red widget', 'Blue ring', 'Blue rings', 'The new page'][1 + CAST(o_orderkey % 6 AS INT)]"
VARIANTS = ["Red widget", " red WIDGET ", "The red widget", "Blue ring", "Blue rings", "The new page"]


@query(
    f"""WITH l AS (SELECT 'site' || o_custkey % 40 AS site, o_orderkey AS ord, o_orderkey % 6 AS v, {_VARIANT} AS title, '/p/' || o_orderkey % 9 AS path, 'https://a.example/p/' || o_orderkey % 9 || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '?v=' || o_orderkey WHEN 2 THEN '#x' ELSE '?w=1' END AS url, CASE WHEN o_orderkey % 4 = 1 THEN 'noted' END AS note FROM orders),
    f AS (SELECT *, CASE WHEN v <= 2 THEN 'r' ELSE 'b' END AS family, min(CASE WHEN v < 5 THEN ord END) OVER (PARTITION BY site, path) AS told FROM l WHERE v <> 5)
    SELECT site, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY site, path, family ORDER BY note IS NULL, length(url), ord) AS nth FROM f) WHERE nth = 1"""
)
def folded_links(spark, d):
    """Links of one path whose titles say the same: one stays, with a note before without, of the shorter address."""
    return C.survivors(_variants(spark, d).filter("v <> 5")).select("site", "ord", "url")


def _variants(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    key = F.col("o_orderkey")
    tail = F.when(key % 5 == 0, "").when(key % 5 == 1, _cat("?v=", key)).when(key % 5 == 2, "#x").otherwise("?w=1")
    title = F.get(F.array(*map(F.lit, VARIANTS)), (key % 6).cast("int"))
    return o.select(_cat("site", F.col("o_custkey") % 40).alias("site"), key.alias("ord"), (key % 6).alias("v"), title.alias("title"), _cat("https://a.example/p/", key % 9, tail).alias("url"), F.when(key % 4 == 1, "noted").alias("note"))


@query(
    f"""WITH l AS (SELECT 'site' || o_custkey % 40 AS site, o_orderkey AS ord, 'https://a.example/o/' || o_orderkey AS url, {_VARIANT} AS title FROM orders WHERE o_custkey < 800)
    SELECT site, ord, url, title FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS n FROM l) WHERE n <= 25"""
)
def optional_links(spark, d):
    """The Optional section's cap: a site's first twenty-five."""
    rows = _table(spark, d, "orders").filter("o_custkey < 800")
    key = F.col("o_orderkey")
    title = F.get(F.array(*map(F.lit, VARIANTS)), (key % 6).cast("int"))
    links = rows.select(_cat("site", F.col("o_custkey") % 40).alias("site"), key.alias("ord"), _cat("https://a.example/o/", key).alias("url"), title.alias("title"), F.lit(None).cast("string").alias("note"))
    return C.cap_optional(links).select("site", "ord", "url", "title")


@query(
    f"""WITH l AS (SELECT 'site' || o_custkey % 40 AS site, 'https://a.example/p/' || o_orderkey % 9 AS url, {_VARIANT} AS title, o_orderkey AS ord FROM orders)
    SELECT site, url, title, ord FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY ord) AS n FROM l) WHERE n = 1"""
)
def first_links(spark, d):
    """A union of links in which the first of an address wins."""
    rows = _variants(spark, d).withColumn("url", F.regexp_extract("url", "^([^?#]*)", 1))
    return C.first_wins(rows, ["site", "url"]).select("site", "url", "title", "ord")


@query(
    """WITH s AS (SELECT 'site' || o_custkey AS site, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS b FROM orders GROUP BY o_custkey)
    SELECT 'site' || o_custkey AS site, o_orderkey AS ord FROM orders JOIN s ON s.site = 'site' || o_custkey WHERE (o_orderkey % 3 = 0) = (a > b)"""
)
def larger_maps(spark, d):
    """Of two sets of a site's links the crawled ones, or the home page's own where those are more."""
    rows = _table(spark, d, "orders").select(_cat("site", F.col("o_custkey")).alias("site"), F.col("o_orderkey").alias("ord"))
    return G.keep_larger(rows.filter("ord % 3 = 0"), rows.filter("ord % 3 > 0"))


# -- words of labels -----------------------------------------------------------------------------


LABELS = [
    "Home", "more", "Read more", "this page", "Our Plans", "Here", "Click here", "Pricing", "browse all the parts we have in stock today", "Explore Guides", "Guides menu",
    "view all our links", "API", "getting started", "Get started", "See the docs pages", "ours", "learned", "the end", "continue", "Navigation", "links", "docs and more", "all",
]
_LABEL = "[" + ", ".join(f"'{x}'" for x in LABELS) + f"][1 + CAST(o_orderkey % {len(LABELS)} AS INT)]"
_LEAD, _TRAIL = "explore|browse|view|see|discover|all|our|the", "pages?|links?|menu|section|navigation"


@query(
    rf"""WITH l AS (SELECT o_orderkey, {_LABEL} AS s FROM orders),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(s, '(?i)^((({_LEAD})\s+)+)', ''), '(?i)\s+({_TRAIL})$', '')) AS bare FROM l)
    SELECT o_orderkey, regexp_matches(lower(s), '^(home|menu|more|links?|pages?|site|main|other|misc|navigation|explore)$') AS generic,
      regexp_matches(lower(s), '^((this|that|these|those|the|our|it|here)([^a-z0-9_].*)?|(read|learn|find out|see|click|get started|start|continue|view|browse)([^a-z0-9_].{{0,19}})?|.{{0,12}}(here|more|link))$') AS deictic,
      len(string_split(s, ' ')) < 4 OR regexp_matches(lower(s), '(^| )(the|a|an|and|or|to|for|with|of|in|on|that|your|you|it|is|are|from|by|as)( |$)') AS prose,
      array_to_string(list_transform(string_split(CASE WHEN bare = '' THEN 'fall back' ELSE bare END, ' '), lambda x, i: CASE WHEN regexp_matches(x, '^[A-Z0-9]{{2,}}$') THEN x WHEN i > 1 AND lower(x) IN ({", ".join(f"'{w}'" for w in X.W.MINOR_WORDS)}) THEN lower(x) ELSE upper(x[1]) || x[2:] END), ' ') AS label
    FROM b"""
)
def label_kinds(spark, d):
    """Labels that name nothing, that point, that read as prose, and what is left of them as a section's name."""
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("o_orderkey") % len(LABELS)).cast("int"))
    rows = _table(spark, d, "orders").select("o_orderkey", label.alias("s"))
    return rows.select("o_orderkey", X.is_generic_label("s").alias("generic"), X.is_deictic("s").alias("deictic"), X.reads_as_prose("s").alias("prose"), X.tidy_label("s", F.lit("fall back")).alias("label"))
