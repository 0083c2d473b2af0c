"""Queries over state: what a store holds after writes, what a check decides, what of a proposal is let through.

Inputs are made from the given tables by rules that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import responses as R, text as X, urls as U
from waymark.operators import extract as E, markdown as M, monitor as N, proposals as P
from waymark.plans.made_queries import _cat
from waymark.plans.queries import _table, query
from waymark.scratch import Scratch
from waymark.sources import robots as B, sitemaps as S, store as T

# -- the store -----------------------------------------------------------------------------


def _at(second: int) -> Column:
    return F.timestamp_seconds(F.lit(1_700_000_000 + second))


def _kept(spark, d) -> T.GenerationStore:
    """A store that took all suppliers in, wrote every third again, and recorded checks of every second."""
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), _cat("https://", F.col("s_name"), ".example/").alias("url"))
    none, n = F.lit(None).cast("string"), F.col("n")
    store = T.GenerationStore(spark, f"{Scratch(spark, 'generations').path}/store")
    store.upsert(s.select("url", _cat("# One ", n).alias("llms_txt"), _cat("h", n).alias("structure_hash"), none.alias("source"), none.alias("published_at"), _at(0).alias("now")))
    source = F.when(n % 6 == 0, "published")
    store.upsert(s.filter(n % 3 == 0).select("url", _cat("# Two ", n).alias("llms_txt"), none.alias("structure_hash"), source.alias("source"), F.when(n % 6 == 0, F.col("url")).alias("published_at"), _at(100).alias("now")))
    result = F.when(n % 8 == 0, "deferred").when(n % 8 == 2, "changed").otherwise("unchanged")
    checks = s.filter(n % 2 == 0).select("url", result.alias("result"), (n % 8 == 2).alias("changed"), F.when(n % 8 == 4, none).otherwise(_cat("s", n)).alias("structure_hash"), _cat("m", n).alias("sitemap_hash"), F.when(n % 8 == 2, _cat("# Three ", n)).alias("llms_txt"), _at(200).alias("now"))
    store.record_checks(checks)
    return store


STORED = """s AS (SELECT s_suppkey AS n, 'https://' || s_name || '.example/' AS url, s_suppkey % 2 = 0 AND s_suppkey % 8 <> 0 AS hit FROM supplier),
t AS (SELECT *, CASE WHEN n % 8 = 2 THEN '# Three ' || n WHEN n % 3 = 0 THEN '# Two ' || n ELSE '# One ' || n END AS llms_txt FROM s),
stored AS (SELECT n, url, llms_txt, left(sha256(llms_txt), 32) AS content_hash, 1700000000 + CASE WHEN n % 8 = 2 THEN 200 WHEN n % 3 = 0 THEN 100 ELSE 0 END AS generated,
  CASE WHEN hit THEN CASE WHEN n % 8 = 4 THEN '' ELSE 's' || n END WHEN n % 3 = 0 THEN NULL ELSE 'h' || n END AS structure_hash, CASE WHEN hit THEN 'm' || n END AS sitemap_hash,
  1700000000 + CASE WHEN hit THEN 200 WHEN n % 3 = 0 THEN 100 ELSE 0 END AS checked, CASE WHEN n % 8 = 2 THEN 1700000200 END AS changed, 0 AS change_count,
  CASE WHEN n % 6 = 0 THEN 'published' ELSE 'generated' END AS source, CASE WHEN n % 6 = 0 THEN url END AS published_at FROM t)"""


@query(f"WITH {STORED} SELECT url, llms_txt, content_hash, generated, structure_hash, sitemap_hash, checked, changed, change_count, source, published_at FROM stored")
def stored_files(spark, d):
    """Rows after upserts and recorded checks: deferred ones untouched, fingerprints and times written, texts where they changed."""
    at = lambda c: F.unix_seconds(c)
    return _kept(spark, d).read().select("url", "llms_txt", "content_hash", at(F.col("generated_at")).alias("generated"), "structure_hash", "sitemap_hash", at(F.col("last_checked_at")).alias("checked"), at(F.col("changed_at")).alias("changed"), "change_count", "source", "published_at")


@query(f"WITH {STORED} SELECT url, content_hash, source FROM stored WHERE n = 42")
def stored_file(spark, d):
    """A point read."""
    return T.read_one(_kept(spark, d).read(), "https://Supplier#000000042.example/").select("url", "content_hash", "source")


@query(
    f"""WITH {STORED} SELECT url, '{{"url":"' || url || '","content_hash":"' || content_hash || '","source":"' || source || '","changed":' || CASE WHEN changed IS NULL THEN 'false' ELSE 'true' END || CASE WHEN published_at IS NULL THEN '' ELSE ',"published_at":"' || published_at || '"' END || '}}' AS body FROM stored"""
)
def stored_json(spark, d):
    """Rows as the read interface gives them; fields without a value are left out."""
    return T.as_json(_kept(spark, d).read())


@query("SELECT url FROM (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href=\"(/[a-z]+)\"', 1)) AS url FROM pages) ORDER BY sha256('7|' || url), url LIMIT 50")
def sampled_links(spark, d):
    """Fifty of all links, the same ones for a seed: a sample is the feature."""
    return T.sample_links(_table(spark, d, "pages").select(F.col("html").alias("text")), '<a href="(/[a-z]+)"', 50, 7)


# -- checks -----------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT o_orderkey AS n, o_orderkey % 16 AS v FROM orders),
    t AS (SELECT n, CASE WHEN v = 0 THEN 'skipped' WHEN v = 1 THEN 'unchanged' WHEN v = 2 THEN 'changed' WHEN v IN (3, 4) THEN 'unchanged-sitemap' WHEN v IN (5, 6) THEN 'skipped' WHEN v IN (7, 8, 9) THEN 'unchanged' WHEN v IN (10, 11) THEN 'baseline' ELSE 'costly' END AS tier, v FROM r),
    c AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN n % 5 > 0 THEN n % 1000 END NULLS FIRST, 'u' || n) AS k FROM t),
    o AS (SELECT *, CASE WHEN tier <> 'costly' THEN tier WHEN k <= 3 THEN 'changed' ELSE 'deferred' END AS result FROM c)
    SELECT 'u' || n AS url, result, result = 'changed' AS changed,
      CASE WHEN result IN ('deferred', 'skipped', 'unchanged-sitemap') THEN CASE WHEN v IN (10, 11) THEN NULL WHEN v < 3 THEN NULL ELSE 'old' END WHEN v < 3 THEN NULL WHEN v IN (7, 8, 9) THEN 'old' ELSE 'new' END AS structure_hash,
      CASE WHEN v < 3 OR v IN (7, 12) THEN CASE WHEN v = 12 AND result = 'changed' THEN 'm' WHEN v = 12 THEN NULL END WHEN result IN ('deferred', 'skipped') THEN 'm-old' WHEN v IN (3, 4) THEN 'm' ELSE 'm' END AS sitemap_hash FROM o"""
)
def check_tiers(spark, d):
    """All tiers of a check: published files, sitemaps, pages that could not be read, structure, and what the run can afford."""
    n = F.col("n")
    v = n % 16
    none = F.lit(None).cast("string")
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("n")).withColumn("url", _cat("u", n))
    old_map = F.when((v < 3) | v.isin(7, 12), none).when(v.isin(3, 4), "m").otherwise("m-old")
    stored = rows.select(
        "url", F.when(v < 3, "published").otherwise("generated").alias("source"), F.when(v < 3, X.hash_content(F.lit("# Same"))).alias("content_hash"),
        F.when((v < 3) | v.isin(10, 11), none).otherwise("old").alias("structure_hash"), old_map.alias("sitemap_hash"), F.when(n % 5 > 0, F.timestamp_seconds(n % 1000)).alias("last_checked_at"),
    )
    now_map = F.when((v < 3) | (v == 7), none).otherwise("m")
    current = rows.select(
        "url", now_map.alias("sitemap_hash"), F.when(v < 3, none).when(v.isin(7, 8, 9), "old").otherwise("new").alias("structure_hash"), F.when(v == 5, False).when(v == 6, F.lit(None).cast("boolean")).otherwise(True).alias("usable"),
        F.when(v == 0, none).when(v == 1, "# Same").when(v == 2, "# Other").alias("published_text"),
    )
    return N.check(stored, current, 3)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN 'h' || o_orderkey END AS structure_hash FROM orders")
def partial_crawls(spark, d):
    """The fingerprint of a crawl that ran out of time is not kept."""
    return _table(spark, d, "orders").select("o_orderkey", N.stored_structure(_cat("h", F.col("o_orderkey")), F.col("o_custkey") % 3 == 0).alias("structure_hash"))


@query(
    """WITH e AS (SELECT user_id, event_id, abs(value) * 10 AS ms, event_id % 17 = 0 AS refused, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    b AS (SELECT *, avg(ms) FILTER (WHERE n <= 3) OVER (PARTITION BY user_id) AS base, lag(ms) OVER w AS m1, lag(ms, 2) OVER w AS m2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    h AS (SELECT *, n > 3 AND list_sort([ms, m1, m2])[2] > 2 * base AND list_sort([ms, m1, m2])[2] > 500 AS slow FROM b),
    c AS (SELECT user_id, count(*) FILTER (WHERE slow) AS a, count(*) FILTER (WHERE refused) AS r, max(CASE WHEN refused THEN 2 * n + 1 WHEN slow THEN 2 * n END) AS last FROM h GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS site, round(least(150 * pow(1.5, a) * pow(2, r), 2000), 6) AS interval_ms, last IS NOT NULL AND 150 * pow(1.5, a) * pow(2, r) / CASE WHEN last % 2 = 1 THEN 2 ELSE 1.5 END >= 2000 AS exhausted FROM c"""
)
def pacer_intervals(spark, d):
    """Events of a user as a latency trace; every seventeenth is a refusal."""
    rows = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("site"), F.col("event_id").alias("seq"), (F.abs("value") * 10).cast("double").alias("latency_ms"), (F.col("event_id") % 17 == 0).alias("refused"))
    return N.pacer_trace(rows).withColumn("interval_ms", F.round("interval_ms", 6))


# -- proposals ----------------------------------------------------------------------------------


OFFERS = "p AS (SELECT p_partkey AS key, p_partkey // 40 AS k, p_partkey % 40 AS idx, lower(p_type) AS type, p_name AS name, p_name || ' ' || p_partkey AS title, 'https://shop' || p_partkey // 40 || '.example/' || p_partkey AS url FROM part)"
_OFFER = "CASE key % 6 WHEN 0 THEN 'Kept on shelf ' || key || ' near the  gate.' WHEN 1 THEN 'Tiny' WHEN 2 THEN 'The ' || title WHEN 3 THEN 'See [this](x) for the parts' WHEN 4 THEN 'one two three four five six seven eight nine ten eleven twelve thirteen' END"


def _offers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Links of shops, and a reply a shop with a summary, section names and notes: some fit, some do not."""
    p = _table(spark, d, "part")
    key = F.col("p_partkey")
    k, title = F.floor(key / 40), _cat(F.col("p_name"), " ", key)
    url = _cat("https://shop", k, ".example/", key)
    site = _cat("shop", k)
    links = p.select(site.alias("site"), F.lower("p_type").alias("section"), F.dense_rank().over(_by(k, F.col("p_type"))).alias("section_ord"), (key % 40).cast("int").alias("link_ord"), url.alias("url"), title.alias("title"), F.when(key % 2 == 0, "Old note").alias("note"))
    offer = (
        F.when(key % 6 == 0, _cat("Kept on shelf ", key, " near the  gate.")).when(key % 6 == 1, "Tiny").when(key % 6 == 2, _cat("The ", title))
        .when(key % 6 == 3, "See [this](x) for the parts").when(key % 6 == 4, "one two three four five six seven eight nine ten eleven twelve thirteen")
    )
    said = p.filter(offer.isNotNull()).select(k.alias("k"), F.when(key % 12 == 6, _cat(url, "x")).otherwise(url).alias("url"), offer.alias("note"), key.alias("key"))
    notes = said.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "note")))).alias("notes"))
    names = F.create_map(*map(F.lit, ["economy", "Cheap things", "large", "cheap THINGS", "medium", "standard", "promo", "fr", "small", "Small [parts]"]))
    summary = F.when(F.col("k") % 4 == 0, _cat("Parts of every kind for the mills of town ", F.col("k"))).when(F.col("k") % 4 == 1, "Too short").when(F.col("k") % 4 == 2, _cat("Shop number ", F.col("k"), " of shop")).otherwise("All the parts at https://a.example today")
    body = F.to_json(F.struct(summary.alias("summary"), names.alias("sections"), "notes"))
    reply = F.when(F.col("k") % 10 == 9, F.lit("I cannot do that.")).when(F.col("k") % 10 == 8, _cat("{", body)).otherwise(_cat("Sure:\n```json\n", body, "\n```"))
    replies = notes.select(_cat("shop", F.col("k")).alias("site"), F.lit(0).alias("chunk"), reply.alias("reply"))
    return links, replies


def _by(*order: Column):
    from pyspark.sql import Window

    return Window.partitionBy(order[0]).orderBy(*order[1:])


READ = "k % 10 < 8"


@query(
    f"""WITH {OFFERS} SELECT 'shop' || k AS site, url, CASE WHEN {READ} AND key % 12 = 0 THEN 'Kept on shelf ' || key || ' near the gate' WHEN key % 2 = 0 THEN 'Old note' END AS note FROM p"""
)
def proposed_notes(spark, d):
    """Notes of replies, let through or not: length, words, links, what the title says already, addresses never seen."""
    links, replies = _offers(spark, d)
    heads = links.select("site").distinct().withColumn("site_name", F.col("site")).withColumn("summary", F.lit(None).cast("string"))
    return P.enhance(heads, links, replies)[1].select("site", "url", "note")


@query(
    f"""WITH {OFFERS}, o AS (SELECT *, {_OFFER} AS offer FROM p WHERE {READ})
    SELECT 'shop' || k AS site, count(*) FILTER (WHERE key % 12 = 0) AS accepted, count(*) FILTER (WHERE key % 12 <> 0) AS rejected FROM o WHERE offer IS NOT NULL GROUP BY k"""
)
def note_reports(spark, d):
    links, replies = _offers(spark, d)
    read = replies.select("site", "chunk", P.parse_reply(F.col("reply")).alias("p")).filter("p IS NOT NULL")
    return P.note_report(links, read.select("site", "chunk", F.explode("p.notes").alias("url", "note")))


@query(
    f"""WITH {OFFERS}, s AS (SELECT DISTINCT k, type FROM p)
    SELECT 'shop' || k AS site, type AS section, CASE WHEN {READ} AND type = 'economy' THEN 'Cheap Things' ELSE CASE WHEN {READ} AND type = 'large' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.k = s.k AND t.type = 'economy') THEN 'Cheap THINGS' ELSE CASE WHEN {READ} AND type = 'medium' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.k = s.k AND t.type = 'standard') THEN 'Standard' ELSE type END END END AS new_name FROM s"""
)
def proposed_names(spark, d):
    """New names of sections: the first to ask gets a name, names in use, locales and brackets are refused."""
    links, replies = _offers(spark, d)
    read = replies.select("site", P.parse_reply(F.col("reply")).alias("p")).filter("p IS NOT NULL")
    names = read.select("site", F.explode("p.sections").alias("section", "name"))
    sections = links.select("site", "section", "section_ord").distinct()
    return P.rename_sections(sections, names).select("site", "section", "new_name")


@query(f"""WITH {OFFERS} SELECT DISTINCT 'shop' || k AS site, CASE WHEN {READ} AND k % 4 = 0 THEN 'Parts of every kind for the mills of town ' || k END AS summary FROM p""")
def proposed_summaries(spark, d):
    """Summaries of replies: length, addresses, and no more than the site's name said again."""
    links, replies = _offers(spark, d)
    name = _cat("Shop number ", F.regexp_extract("site", r"\d+", 0))
    heads = links.select("site").distinct().withColumn("site_name", name).withColumn("summary", F.lit(None).cast("string"))
    return P.enhance(heads, links, replies)[0].select("site", "summary")


@query(f"""WITH {OFFERS} SELECT DISTINCT 'shop' || k AS site, {READ} AS enhanced, CASE WHEN k % 10 = 9 THEN 'no proposals in the reply' WHEN k % 10 = 8 THEN 'unreadable proposals' END AS reason FROM p""")
def enhanced_files(spark, d):
    """Whole files with what is let through; a file is kept as it was, and why, where there was nothing to let through."""
    links, replies = _offers(spark, d)
    heads = links.select("site").distinct().select("site", _cat("https://", F.col("site"), ".example/").alias("home_url"), F.col("site").alias("site_name"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("prose"), F.lit(False).alias("client_rendered"))
    return P.enhanced_files(heads, links, replies).select("site", "enhanced", "reason")


@query(
    """SELECT 'shop' || o_custkey AS site, CASE WHEN s = 402 THEN 'credits' WHEN s = 429 THEN 'rate-limited' WHEN s IN (401, 403) THEN 'auth' WHEN s >= 500 THEN 'upstream' ELSE 'unknown' END AS kind, count(*) AS n
    FROM (SELECT o_custkey, 395 + o_orderkey % 120 AS s FROM orders) GROUP BY 1, 2"""
)
def failures_by_kind(spark, d):
    """How often the calls of a site's chunks failed, by kind."""
    rows = _table(spark, d, "orders").select(_cat("shop", F.col("o_custkey")).alias("site"), (395 + F.col("o_orderkey") % 120).alias("status"))
    return P.failure_report(rows)


@query(
    """SELECT o_orderkey, CAST(CASE v WHEN 0 THEN least(o_orderkey % 50, 30) * 1000 WHEN 1 THEN least(o_orderkey % 40, 30) * 1000 END AS DOUBLE) AS wait_ms, 400 * pow(2, o_orderkey % 5) AS most_ms
    FROM (SELECT o_orderkey, o_orderkey % 3 AS v FROM orders)"""
)
def retry_waits(spark, d):
    """Waits that a refusal asks for, in seconds or as a date, and the ceiling of those it does not."""
    key = F.col("o_orderkey")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    date = F.date_format(F.timestamp_seconds(1_700_000_000 + key % 40), "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(key % 3 == 0, (key % 50).cast("string")).when(key % 3 == 1, _cat(date, " GMT")).otherwise("soon")
    return _table(spark, d, "orders").select("o_orderkey", P.retry_after_ms(header, now).alias("wait_ms"), P.backoff_ceiling_ms(key % 5).alias("most_ms"))


# -- addresses, gates, labels -----------------------------------------------------------------------


_PLAIN = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"


@query(
    rf"""SELECT page_id, CASE page_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN u || '?q=1' WHEN 5 THEN u WHEN 6 THEN u WHEN 7 THEN u || '?action=view' WHEN 8 THEN u || '/index.php?title=A' ELSE u END AS canonical
    FROM (SELECT page_id, {_PLAIN} AS u FROM pages)"""
)
def link_gate(spark, d):
    """Links made of pages' addresses: files, operations and other schemes lead to no page, spellings of one page come together."""
    u, n = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", ""), F.col("page_id") % 10
    href = (
        F.when(n == 0, _cat(u, "/paper.PDF")).when(n == 1, _cat(u, "?printable=yes")).when(n == 2, _cat(u, "?action=edit&x=1")).when(n == 3, "mailto:a@b.example").when(n == 4, _cat(u, "/?q=1&gclid=5"))
        .when(n == 5, _cat(u, "/index.html?fbclid=9")).when(n == 6, _cat(u, "/./x/../#part")).when(n == 7, _cat(u, "?action=view")).when(n == 8, _cat(u, "/index.php?title=A")).otherwise(_cat(u, "?my_campaign=1&hsa_x=2"))
    )
    return _table(spark, d, "pages").select("page_id", U.canonicalize_url(href, "url").alias("canonical"))


@query(
    rf"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://' || b WHEN 1 THEN 'http://' || b || '?q=2' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'https://' || b || '#part' END AS typed
    FROM (SELECT page_id, regexp_replace({_PLAIN}, '^https?://', '') AS b FROM pages)""".replace("|| '#part'", "")
)
def typed_addresses(spark, d):
    """What a person types: a scheme where there is none, no tracking, other schemes and nothing refused."""
    b, n = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", ""), "^https?://", ""), F.col("page_id") % 5
    text = F.when(n == 0, _cat("  ", b, " ")).when(n == 1, _cat("http://", b, "?q=2&utm_medium=x")).when(n == 2, _cat("ftp://", b)).when(n == 3, "  ").otherwise(_cat("HTTPS://", b, "#part"))
    return _table(spark, d, "pages").select("page_id", U.normalize_url(text).alias("typed"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '100%-' || page_id || '+x' ELSE 'a b/é' || page_id || '+x' END AS slug FROM pages")
def decoded_slugs(spark, d):
    """Percent codes read, pluses and broken codes left."""
    n = F.col("page_id")
    return _table(spark, d, "pages").select("page_id", U.decode_slug(F.when(n % 3 == 0, _cat("100%-", n, "+x")).otherwise(_cat("a%20b%2F%C3%A9", n, "+x"))).alias("slug"))


@query(r"SELECT page_id, path LIKE '/en/%' OR path LIKE '/fr/1%' AS inside, NOT path LIKE '/de/%' AND (path LIKE '/de%' OR path LIKE '/e%') AS both FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def path_filters(spark, d):
    path = U.path_of("url")
    return _table(spark, d, "pages").select("page_id", U.path_allowed(path, ["/en/", "/fr/1"]).alias("inside"), U.path_allowed(path, ["/de", "/e"], ["/de/"]).alias("both"))


@query(
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 'https://' || h || '/c/' || page_id || '?x=1' ELSE url END ELSE url END AS url, 'Page ' || page_id AS title
    FROM (SELECT page_id, 'https://' || h || '/at/' || page_id AS url, h FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h FROM pages))"""
)
def declared_addresses(spark, d):
    """A page's own word on its address counts on its own site only."""
    n, host = F.col("page_id"), U.host_of("url")
    canonical = F.when(n % 3 == 0, F.when(n % 2 == 0, _cat('<link rel="alternate canonical" href="/c/', n, '?x=1">')).otherwise('<link rel="canonical" href="https://far.example/">')).otherwise("")
    rows = _table(spark, d, "pages").select("page_id", _cat("https://", host, "/at/", n).alias("url"), _cat("<title>Page ", n, " | S</title>", canonical).alias("html"))
    return E.page_meta(rows).select("page_id", "url", "title")


@query(
    """SELECT page_id, page_id % 4 = 0 AND page_id % 3 < 2 AS late_block, CASE WHEN page_id % 2 = 0 THEN 503 WHEN page_id % 3 = 0 THEN 401 ELSE 200 END AS gate,
      CASE page_id % 3 WHEN 0 THEN 'no browser available to render with' WHEN 1 THEN 'the page did not finish loading within ' || CAST(floor(page_id * 10 / 1000 + 0.5) AS BIGINT) || 's' ELSE 'crashed' END AS failure,
      page_id % 7 > page_id % 5 AS adopted FROM pages"""
)
def late_answers(spark, d):
    """A verification page served as a success, the gate before a run, why a page was not rendered, and whether it replaces the plain one."""
    n = F.col("page_id")
    body = F.when(n % 3 == 0, "<p>Are you a ROBOT?</p>").when(n % 3 == 1, "<p>Just a moment</p>").otherwise("<p>Welcome</p>")
    return _table(spark, d, "pages").select(
        "page_id", R.classify_empty(body, n % 4).isNotNull().alias("late_block"), R.access_gate(n % 2 > 0, n % 3 > 0).alias("gate"),
        R.render_failure(F.when(n % 3 == 0, "no-browser").when(n % 3 == 1, "timeout").otherwise("other"), n * 10, F.lit("crashed")).alias("failure"), R.adopt_rendered(n % 5, n % 7).alias("adopted"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 THEN 'the models added nothing' ELSE concat_ws(', ', CASE WHEN a > 0 THEN a || ' notes' END, CASE WHEN b > 0 THEN b || ' sections renamed' END) || CASE WHEN c > 0 THEN ', ' || c || ' chunks failed' ELSE '' END END AS said
    FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 4 AS b, o_custkey % 2 AS c FROM orders)"""
)
def change_reports(spark, d):
    key = F.col("o_orderkey")
    return _table(spark, d, "orders").select("o_orderkey", X.report_label(key % 3, key % 4, F.col("o_custkey") % 2).alias("said"))


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 6000) || chr(10) || '… (truncated)' ELSE text END AS text FROM documents")
def trimmed_texts(spark, d):
    """The text that is sent on, cut at its limit with a mark: the limit is the feature."""
    return _table(spark, d, "documents").select("doc_id", X.truncate_text("text").alias("text"))


@query(
    """WITH f AS (SELECT s_suppkey AS n, 'https://' || s_name || '.example' AS o FROM supplier)
    SELECT o AS site, CASE WHEN n % 4 = 0 THEN o || '/docs/llms.txt' WHEN n % 4 = 2 THEN o || '/llms.txt' END AS url, CASE WHEN n % 4 = 0 THEN '# First of shop number ' || n || ' and its many parts' ELSE '# Second of shop number ' || n || ' and its many parts' END AS text FROM f WHERE n % 4 IN (0, 2)"""
)
def published_files(spark, d):
    """The first place that serves a file: text, no page, long enough, with a title."""
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), _cat("https://", F.col("s_name"), ".example").alias("site"))
    n, site = F.col("n"), F.col("site")
    tried = s.select("site", S.published_candidates(site, F.lit("/docs/x"), F.lit(None).cast("string")).alias("candidates"))
    first = s.select(_cat(site, "/docs/llms.txt").alias("url"), F.when(n % 4 == 1, 404).otherwise(200).alias("status"), F.when(n % 4 == 2, "text/HTML").otherwise("text/plain").alias("content_type"), F.when(n % 4 == 3, "# Short").otherwise(_cat("﻿\n# First of shop number ", n, " and its many parts")).alias("text"))
    second = s.select(_cat(site, "/llms.txt").alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"), F.when(n % 2 == 0, _cat("# Second of shop number ", n, " and its many parts")).otherwise("No title, but long enough to be a file of some kind").alias("text"))
    return S.find_published(tried, first.unionByName(second)).select("site", "url", F.regexp_replace("text", r"^﻿?\s*", "").alias("text"))


# -- grammar, robots, sitemaps ------------------------------------------------------------------------


#: Made-up files, and for each the lines and names of what is wrong with it.
FILES = [
    ("# Site\n\n> One\n> two\n\nFree text.\n\n## Docs\n\n- [A](https://a.example/a): note\n* [B](https://a.example/b)\n", []),
    ("\ufeff# Site\n", []),
    ("# Site\n\n# Again\n", [(3, M.SECOND_H1)]),
    ("#\n\n## Docs\n\n- [A](https://a.example/a)\n", [(1, M.EMPTY_H1), (1, M.NO_H1)]),
    ("## Docs\n\n- [A](https://a.example/a)\n", [(1, M.EARLY_HEADING), (1, M.NO_H1)]),
    ("# Site\n\n## Docs\n\n### Deep\n\n- [A](https://a.example/a)\n", [(5, M.DEEP_HEADING.format(3))]),
    ("# Site\n\n##\n\n- [A](https://a.example/a)\n", [(3, M.UNNAMED_H2)]),
    ("Hello\n\n# Site\n", [(1, M.EARLY_CONTENT)]),
    ("# Site\n\n## Docs\n\nFree text.\n- plain item\n- [A](two words)\n", [(5, M.NO_LINK), (6, M.NO_LINK), (7, M.NO_LINK)]),
    ("# Site\n\n## Docs\n\n- [ ](https://a.example/a)\n  - [B](https://a.example/b)\n", [(5, M.UNNAMED_LINK)]),
    ("", [(1, M.NO_H1)]),
]
_WRONG = ", ".join(f"({n}, {line}, '{what}')" for n, (_, found) in enumerate(FILES) for line, what in found)


@query(f"SELECT s_name AS name, CAST(line AS INT) AS line, message FROM supplier JOIN (VALUES {_WRONG}) v(n, line, message) ON s_suppkey % {len(FILES)} = n")
def grammar_issues(spark, d):
    """Every kind of departure from the grammar, with its line."""
    text = F.get(F.array(*[F.lit(t) for t, _ in FILES]), (F.col("s_suppkey") % len(FILES)).cast("int"))
    files = _table(spark, d, "supplier").select(F.col("s_name").alias("name"), text.alias("text"))
    return M.issues(M.read_lines(files)).select("name", F.col("line").cast("int").alias("line"), "message")


@query(
    f"""SELECT s_name AS name, part, value FROM supplier JOIN (VALUES (0, 'title', 'Site'), (0, 'summary', 'One two'), (0, 'details', 'Free text.'), (0, 'link 1', 'Docs|A|https://a.example/a|note'), (0, 'link 2', 'Docs|B|https://a.example/b|')) v(n, part, value) ON s_suppkey % {len(FILES)} = n"""
)
def parsed_files(spark, d):
    """The parts of files that conform."""
    text = F.get(F.array(*[F.lit(t) for t, _ in FILES]), (F.col("s_suppkey") % len(FILES)).cast("int"))
    lines = M.read_lines(_table(spark, d, "supplier").filter(F.col("s_suppkey") % len(FILES) == 0).select(F.col("s_name").alias("name"), text.alias("text")))
    head = M.documents(lines)
    parts = head.select("name", F.explode(F.create_map(F.lit("title"), F.col("title"), F.lit("summary"), F.col("summary"), F.lit("details"), F.array_join("details", "|"))).alias("part", "value"))
    nth = F.row_number().over(_by(F.col("name"), F.col("line")))
    links = M.links_of(lines).select("name", _cat("link ", nth).alias("part"), F.concat_ws("|", "section", "title", "url", F.coalesce("notes", F.lit(""))).alias("value"))
    return parts.unionByName(links)


@query(
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS site, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), m AS (SELECT *, length(site) % 3 AS kind, CAST(length(site) % 10 AS VARCHAR) AS digit FROM p)
    SELECT page_id, CASE kind WHEN 0 THEN CASE WHEN path LIKE '%.html' THEN false WHEN path LIKE '/en/' || digit || '%' THEN true WHEN path LIKE '/en/%' THEN false ELSE true END WHEN 1 THEN NOT path LIKE '/fr/%' ELSE true END AS allowed,
      CAST(CASE kind WHEN 0 THEN 2500 WHEN 1 THEN 10000 END AS DOUBLE) AS delay_ms FROM m"""
)
def robots_by_site(spark, d):
    """Sites with rules for us, with rules for everyone, and without; the longest rule decides."""
    pages = _table(spark, d, "pages").select("page_id", U.host_of("url").alias("site"), U.path_of("url").alias("path"))
    kind, digit = F.length("site") % 3, (F.length("site") % 10).cast("string")
    ours = _cat("User-agent: *\nDisallow: /\nCrawl-delay: 7\n\nUser-agent: WayMark\nCrawl-delay: 9 # once\nDisallow: /en/\nAllow: /en/", digit, "\nDisallow: /*.html$\nDisallow:\nCrawl-delay: 2.5\n")
    text = F.when(kind == 0, ours).when(kind == 1, "user-agent:*\r\ndisallow:/fr/ # old\r\ncrawl-delay: 60\r\nUser-agent: other\r\nDisallow: /\r\n")
    lines = B.lines(pages.select("site").distinct().withColumn("text", text))
    return B.allowed(pages, B.rules(lines)).join(B.delays(lines), "site", "left").select("page_id", "allowed", "delay_ms")


@query(
    """WITH k AS (SELECT p_partkey AS key, p_partkey // 40 AS k, p_partkey % 40 AS idx FROM part)
    SELECT 'shop' || k AS site, 'https://shop' || k || '.example/p?a=' || idx || '&b=' || key AS url, row_number() OVER (PARTITION BY k ORDER BY idx % 8, idx) - 1 AS position FROM k WHERE idx % 8 BETWEEN 1 AND 4"""
)
def indexed_sitemaps(spark, d):
    """An index of children: one that is missing, four that are read, and more than are followed."""
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.floor(F.col("p_partkey") / 40).alias("k"), (F.col("p_partkey") % 40).alias("idx"))
    site = _cat("shop", F.col("k"))
    loc = _cat("<url><LOC>\n https://", site, ".example/p?a=", F.col("idx"), "&amp;b=", F.col("key"), " </LOC></url>")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", loc.alias("x")))), lambda s: s["x"]), "")
    child = p.withColumn("child", F.col("idx") % 8).groupBy("k", "child").agg(body.alias("b"))
    maps = child.filter("child > 0").select(site.alias("site"), _cat(F.col("child"), ".xml").alias("sitemap_url"), _cat("<urlset><!-- <loc -->", F.col("b"), "</urlset>").alias("text"))
    index = p.select("k").distinct().select(site.alias("site"), F.lit("index.xml").alias("sitemap_url"), F.lit("<SitemapIndex>" + "".join(f"<loc>{n}.xml</loc>" for n in range(8)) + "</SitemapIndex>").alias("text"))
    entries = S.read_sitemaps(maps.unionByName(index))
    tried = p.select("k").distinct().select(site.alias("site"), F.array(F.lit("none.xml"), F.lit("index.xml"), F.lit("1.xml")).alias("candidates"))
    return S.first_sitemap(entries, tried).select("site", "url", F.col("position").cast("long").alias("position"))


ADDRESSES = {
    "::1": True, "fc00::1": True, "fd12:3456::1": True, "fe80::1": True, "2001:db8::1": False, "::ffff:10.1.2.3": True, "::ffff:8.8.8.8": False, "FE80::2": True,
    "172.31.255.255": True, "172.32.0.0": False, "100.64.0.1": True, "100.128.0.1": False, "0.1.2.3": True, "8.8.8.8": False, "localhost": False,
}


@query(f"SELECT s_name AS name, ip, private FROM supplier JOIN (VALUES {', '.join(f'({n}, {chr(39)}{ip}{chr(39)}, {private})' for n, (ip, private) in enumerate(ADDRESSES.items()))}) v(n, ip, private) ON s_suppkey % {len(ADDRESSES)} = n")
def private_ranges(spark, d):
    """Addresses of both kinds, at the edges of the ranges."""
    ip = F.get(F.array(*map(F.lit, ADDRESSES)), (F.col("s_suppkey") % len(ADDRESSES)).cast("int"))
    return _table(spark, d, "supplier").select(F.col("s_name").alias("name"), ip.alias("ip"), U.is_private_address(ip).alias("private"))


@query(
    r"""SELECT s_suppkey, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^#{1,6} ') THEN '\' || x ELSE x END), chr(10)) AS block, replace(t, '\', '') AS plain
    FROM (SELECT s_suppkey, 'Shop' || chr(10) || repeat('#', CAST(s_suppkey % 8 AS INT)) || ' ' || s_name || chr(10) || '#' || s_name || ' \[a\]' AS t FROM supplier)"""
)
def escaped_blocks(spark, d):
    """Free text in which no line may pass for a heading, and escapes taken off again."""
    n = F.col("s_suppkey")
    text = _cat("Shop\n", F.repeat(F.lit("#"), (n % 8).cast("int")), " ", F.col("s_name"), "\n#", F.col("s_name"), " \\[a\\]")
    return _table(spark, d, "supplier").select("s_suppkey", X.escape_block(text).alias("block"), X.unescape(text).alias("plain"))


@query("SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' ELSE CAST(floor(m / 60 + 0.5) AS BIGINT) || 'h ago' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 ELSE 30 + o_orderkey % 600 END AS m FROM orders) WHERE m < 1400")
def refreshed_labels(spark, d):
    """When a file was last looked at: its check, or where there was none its making."""
    n = F.col("o_orderkey")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    checked = F.when(n % 3 == 0, F.timestamp_seconds(1_700_000_000 - n % 90 * 60))
    return _table(spark, d, "orders").select("o_orderkey", X.refreshed_label(checked, F.timestamp_seconds(1_700_000_000 - (30 + n % 600) * 60), now).alias("label"))
