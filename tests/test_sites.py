"""Discovery, planning, curation and merging, against loops over the same rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.functions import text as X, urls as U
from waymark.operators import curate as C, merge as G
from waymark.operators.extract import choose_depth as choose_depth_plain
from waymark.plans import crawl as K, made_queries as M
from waymark.sources import robots as B, sitemaps as S


# -- robots -----------------------------------------------------------------------

ROBOTS = {
    "empty": "",
    "all": "User-agent: *\nDisallow: /",
    "bare": "User-agent: *\nDisallow:",
    "longest": "User-agent: *\nDisallow: /a/\nAllow: /a/b\nDisallow: /a/b/c",
    "tie": "User-agent: *\nDisallow: /a\nAllow: /a",
    "named": "User-agent: *\nDisallow: /\n\nUser-agent: Waymark\nDisallow: /x",
    "shared": "User-agent: foo\nUser-agent: way\nDisallow: /a # why\n\nUser-agent: *\nDisallow: /",
    "wild": "User-agent: *\nDisallow: /*.pdf$\nDisallow: /p*x\nCrawl-delay: 2.5",
    "repeat": "User-agent: *\nDisallow: /a\nUser-agent: z\nDisallow: /b\nUser-agent: *\nDisallow: /c\nCrawl-delay: 99",
    "sitemaps": "Sitemap: https://s/1.xml\nUser-agent: *\nSitemap: https://s/2.xml\nDisallow: /a",
}
ALLOWED = {
    "empty": {"/a": True}, "all": {"/": False, "/a": False}, "bare": {"/a": True}, "longest": {"/a/x": False, "/a/b": True, "/a/b/c/d": False, "/b": True},
    "tie": {"/a": True}, "named": {"/x/1": False, "/a": True}, "shared": {"/a": False, "/b": True}, "wild": {"/a.pdf": False, "/a.pdf2": True, "/pqx": False, "/q": True},
    "repeat": {"/a": False, "/b": True, "/c": False}, "sitemaps": {"/a": False, "/b": True},
}


def test_robots(spark):
    lines = B.lines(spark.createDataFrame(list(ROBOTS.items()), "site string, text string"))
    asked = spark.createDataFrame([(s, p) for s, ps in ALLOWED.items() for p in ps] + [("missing", "/a")], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in B.allowed(asked, B.rules(lines)).collect()}
    assert got == {(s, p): ok for s, ps in ALLOWED.items() for p, ok in ps.items()} | {("missing", "/a"): True}
    assert {r.site: r.delay_ms for r in B.delays(lines).collect()} == {"wild": 2500.0, "repeat": 10000.0}
    assert [r.url for r in B.sitemaps(lines).orderBy("ord").collect()] == ["https://s/1.xml", "https://s/2.xml"]


def test_sitemaps_and_published_files(spark):
    urlset = "<urlset><url><LOC>\n https://s/a?x=1&amp;y=2 </LOC></url><url><loc>https://s/b</loc></url></urlset>"
    index = "<sitemapindex>" + "".join(f"<loc>c{i}</loc>" for i in range(7)) + "</sitemapindex>"
    files = [("s", "i", index), ("s", "c1", urlset), ("s", "c4", "<urlset><loc>https://s/z</loc></urlset>"), ("s", "c6", urlset), ("s", "none", "<html>")]
    rows = S.read_sitemaps(spark.createDataFrame(files, "site string, sitemap_url string, text string"))
    assert [r.url for r in rows.filter("sitemap_url = 'i'").orderBy("position").collect()] == ["https://s/a?x=1&y=2", "https://s/b", "https://s/z"]
    first = S.first_sitemap(rows, spark.createDataFrame([("s", ["none", "c4", "i"])], "site string, candidates array<string>"))
    assert [r.url for r in first.collect()] == ["https://s/z"]
    served = [("https://s/llms.txt", 200, "text/plain", "# Site\n" + "x" * 60), ("https://s/docs/llms.txt", 200, "text/html", "# Site\n" + "x" * 60)]
    found = S.find_published(
        spark.createDataFrame([("s", "https://s", "/docs/a")], "site string, origin string, path string").select("site", S.published_candidates(F.col("origin"), F.col("path"), F.lit(None).cast("string")).alias("candidates")),
        spark.createDataFrame(served, "url string, status int, content_type string, text string"),
    )
    assert [r.url for r in found.collect()] == ["https://s/llms.txt"]


def test_sitemaps_are_read_whole(spark):
    long = "<urlset>" + "".join(f"<loc>https://s/{i}</loc>" for i in range(5_100)) + "</urlset>"
    index = "<sitemapindex>" + "".join(f"<loc>c{i}</loc>" for i in range(7)) + "</sitemapindex>"
    files = spark.createDataFrame([("s", "i", index), ("s", "c0", long), ("s", "c6", "<urlset><loc>https://s/last</loc></urlset>")], "site string, sitemap_url string, text string")
    entries = {r.position: r.url for r in S.read_sitemaps(files, most_children=None).filter("sitemap_url = 'i'").collect()}
    assert entries == {i: f"https://s/{i}" for i in range(5_100)} | {5_100: "https://s/last"}


# -- planning -----------------------------------------------------------------------


def slow_plan(candidates, limit):
    """Take turns, one page at a time."""
    by = defaultdict(list)
    for c in candidates:
        by[c[2][0] if c[2] else ""].append(c)
    names = sorted(by)
    for n in names:
        by[n].sort(key=lambda c: (-c[3], len(c[2]), c[1], c[0]))
    quota = dict.fromkeys(names, 1)
    if len(names) >= limit:
        quota = dict.fromkeys(sorted(names, key=lambda n: (-len(by[n]), n))[:limit], 1)
    else:
        total, share = sum(map(len, by.values())), limit - len(names)
        exact = {n: share * len(by[n]) / total for n in names}
        for n in names:
            quota[n] += int(exact[n])
        for n in sorted(names, key=lambda n: (-(exact[n] - int(exact[n])), n))[: share - sum(map(int, exact.values()))]:
            quota[n] += 1
    out, at = [], dict.fromkeys(names, 0)
    for bound in (lambda n: min(quota.get(n, 0), len(by[n])), lambda n: len(by[n])):
        moved = True
        while moved and len(out) < limit:
            moved = False
            for n in names:
                if len(out) < limit and at[n] < bound(n):
                    out.append(by[n][at[n]][0])
                    at[n] += 1
                    moved = True
    return out


def test_plan_equals_turns(spark):
    rng = random.Random(7)
    for limit in (1, 5, 20):
        rows, want = [], {}
        for s in range(40):
            site = [(f"u{i:03}", rng.randrange(20), [rng.choice("abcdefg")] * rng.randrange(3), rng.randrange(4)) for i in range(rng.randrange(1, 60))]
            rows += [(f"s{s}", *c) for c in site]
            want[f"s{s}"] = slow_plan(site, limit)
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "site string, url string, sitemap_position long, segments array<string>, inbound long")
        got = defaultdict(list)
        for r in K.plan(df, limit).orderBy("site", "plan_pos").collect():
            got[r.site].append(r.url)
        assert got == want


def test_waves_follow_links_and_failed_pages_give_back(spark):
    page = lambda *links: "<title>T</title>" + "".join(f"<a href='{x}'>x</a>" for x in links)
    pages = [(1, "https://a.com/", page("/p1", "/missing", "/p1", "https://b.com/q")), (2, "https://a.com/p1", page("/p2")), (3, "https://a.com/p2", page("/p3")), (4, "https://a.com/p3", page("/p4")), (5, "https://a.com/p4", page()), (6, "https://a.com/no", page())]
    rules = B.rules(B.lines(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no")], "site string, text string")))
    sitemap = spark.createDataFrame([("a.com", "https://a.com/no", 0)], "site string, url string, position long")
    done = K.crawl(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame([("a.com", "https://a.com/")], "site string, url string"), sitemap, rules)
    assert sorted((r.wave, r.page_id) for r in done.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]


# -- curation -------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_curate_equals_the_plain_form(spark, seed):
    rng = random.Random(seed)
    titles = ["Gift cards", "Our gift cards", "Contact us", "Contact", "Pricing", "Pricing plans", "Of the", "Reference", "API", "Changelog"]
    rows, want = [], {}
    for s in range(25):
        sections, ord_ = [], 0
        for n in range(rng.choice([1, 3, 15])):
            links = []
            for _ in range(rng.choice([1, 1, 2, 6, 30])):
                path = f"/{rng.randrange(60)}"
                link = {"url": f"https://s/{path}" + rng.choice(["", "?a=1", "?bb=22"]), "title": rng.choice(titles), "note": rng.choice([None, None, "Says a thing"])}
                rows.append((f"s{s}", f"k{n}", "Pages" if n == 2 else f"Sec {n}", n, ord_, link["url"], link["title"], link["note"]))
                links.append(link)
                ord_ += 1
            sections.append({"name": "Pages" if n == 2 else f"Sec {n}", "links": links})
        want[f"s{s}"] = [(x["name"], [(e["url"], e["title"], e["note"]) for e in x["links"]]) for x in C.curate_plain(sections)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "site string, section_key string, section string, section_ord int, ord long, url string, title string, note string")
    got = defaultdict(list)
    for r in C.curate(df).orderBy("site", "section_ord", "link_ord").collect():
        if not got[r.site] or got[r.site][-1][2] != r.section_ord:
            got[r.site].append((r.section, [], r.section_ord))
        got[r.site][-1][1].append((r.url, r.title, r.note))
    assert {s: [(n, x) for n, x, _ in v] for s, v in got.items()} == {s: v for s, v in want.items() if v}


def test_depth_equals_the_plain_form(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(60):
        paths = [["docs" if rng.random() < 0.7 else rng.choice("ab")] * (rng.random() < 0.9) + [rng.choice("xyz") for _ in range(rng.randrange(3))] for _ in range(rng.randrange(1, 12))]
        rows += [(f"s{s}", p) for p in paths]
        want[f"s{s}"] = choose_depth_plain(paths)
    assert {r.site: r.depth for r in C.choose_depth(spark.createDataFrame(rows, "site string, segments array<string>")).collect()} == want


def test_chunks_skeleton_and_caps(spark):
    rows = [("s", "A", 0, i, f"u{i}", f"T{i}", None) for i in range(23)] + [("s", "Optional", -1, 0, "o", "O", None)]
    df = spark.createDataFrame(rows, "site string, section string, section_ord int, link_ord int, url string, title string, note string")
    assert [r["count"] for r in C.chunk_links(df).groupBy("chunk_no").count().orderBy("chunk_no").collect()] == [10, 10, 3]
    assert C.skeleton(df).first().sample == "T0, T1, T2, T3, T4, T5, ..."
    many = spark.createDataFrame([("s", i, f"https://s/{i}", f"t{i}", None) for i in range(40)], "site string, ord long, url string, title string, note string")
    assert C.cap_optional(many).count() == 25


# -- merging ------------------------------------------------------------------------------


def test_merge_prefers_what_pages_say(spark):
    home = [("s", 0, "https://s/docs/a", "Aa", "from home"), ("s", 1, "https://s/docs/b/", "Bb", None), ("s", 2, "https://s/privacy", "Privacy", None)]
    same = "One description that the template serves everywhere."
    pages = [("s", 0, "https://s/", "Home", None), ("s", 1, "https://s/docs/a", "Alpha page", same), ("s", 2, "https://s/docs/b", "Right This Way", "A text of its own about the second thing."), ("s", 3, "https://s/docs/c", "Right This Way", same), ("s", 4, "https://s/docs/d", "Right This Way", same)]
    schema = "site string, ord long, url string, title string, {} string"
    heads = spark.createDataFrame([("s", "https://s/", "Site")], "site string, home_url string, site_name string")
    rows = G.build_from_crawl(spark.createDataFrame(home, schema.format("note")), spark.createDataFrame(pages, schema.format("description")), heads).collect()
    got = {r.url: (r.section, r.title, r.note) for r in rows}
    assert got == {
        "https://s/docs/a": ("Docs", "Alpha page", None),
        "https://s/docs/b/": ("Docs", "Bb", "A text of its own about the second thing."),
        "https://s/docs/c": ("Docs", "Right This Way", None),
        "https://s/docs/d": ("Docs", "Right This Way", None),
        "https://s/privacy": ("Optional", "Privacy", None),
    }
    assert [(r.value, r.n) for r in G.repeated(spark.createDataFrame(pages, schema.format("description")), "title").collect()] == [("Right This Way", 3)]


def test_router_and_prefixes(spark):
    df = spark.createDataFrame([("/legal/x", "T"), ("/x", "Log in"), ("/legalese", "T"), ("/w/index.php?title=special:sign up", "T"), ("/élegal", "T")], "p string, t string")
    assert [r.o for r in df.select(X.is_optional("p", "t").alias("o")).collect()] == [True, True, False, True, True]
    assert [r.o for r in df.select(X.is_optional("p", "t", crawled=False).alias("o")).collect()] == [True, False, False, False, True]
    paths = spark.createDataFrame([("/a/1",), ("/a/x",), ("/b",)], "p string")
    assert [r.ok for r in paths.select(U.path_allowed("p", ["/a"], ["/a/x"]).alias("ok")).collect()] == [True, False, False]


def test_made_pages_are_spread_over_tasks(spark, sf):
    # The part table is one small file, so one task would make and read all pages of its towns.
    plan = M._towns(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key" in plan
