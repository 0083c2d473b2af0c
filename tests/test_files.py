"""Rendering, the grammar, proposals, monitoring and the store."""

import datetime as dt
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import responses as R, text as X
from waymark.operators import markdown as M, monitor as N, proposals as P
from waymark.sources import store as T


# -- grammar ---------------------------------------------------------------------


def slow_issues(text):
    """The grammar as a walk over lines."""
    found, stage, title, any_section = [], "title", "", False
    for n, raw in enumerate(text.removeprefix("﻿").split("\n"), 1):
        line = raw.rstrip()
        h = re.match(r"^(#{1,6})(?:\s+(.*))?$", line)
        if h:
            level, name = len(h[1]), (h[2] or "").strip()
            if level == 1:
                if stage != "title":
                    found.append((n, M.SECOND_H1))
                else:
                    if not name:
                        found.append((n, M.EMPTY_H1))
                    title, stage = name, "summary"
                continue
            if stage == "title":
                found.append((n, M.EARLY_HEADING))
            if level > 2:
                found.append((n, M.DEEP_HEADING.format(level)))
            else:
                if not name:
                    found.append((n, M.UNNAMED_H2))
                stage = "sections"
        elif line.strip():
            if stage == "title":
                found.append((n, M.EARLY_CONTENT))
            elif stage == "summary" and not line.startswith(">"):
                stage = "details"
            elif stage == "sections":
                item = re.match(r"^[-*+]\s+\[((?:\\.|[^\]\\])*)\]\(([^)\s]+)\)\s*(?::\s*(.*))?$", line.lstrip())
                if not item:
                    found.append((n, M.NO_LINK))
                elif not item[1].strip():
                    found.append((n, M.UNNAMED_LINK))
    return sorted(found + ([] if title else [(1, M.NO_H1)]))


GOOD = "﻿# Site\n\n> One\n> two\n\nSome text\nmore\n\nLast\n\n## Docs\n\n- [A \\[b\\]](https://x/a): note: here\n  * [C](https://x/c)\n\n## Optional\n+ [D](https://x/d) \n"
FILES = [GOOD, "# Only", "", "text", "# A\n# B", "## X\n# A", "# A\n### deep", "#\n", "# A\n##\n- [ ](u)", "# A\n## S\nprose", "### x\n# T\n> q\nfree\n> not a quote\n## S\n- [a](b c)", "#hashtag\n# A"]


def test_issues_equal_a_walk(spark):
    rng = random.Random(2)
    pieces = ["# T", "#", "## S", "##", "### D", "> q", "text", "", "- [a](u)", "- [](u)", "* x", "  - [b](v): n"]
    files = FILES + ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(files)], "name string, text string")
    got = {str(i): [] for i in range(len(files))}
    for r in M.issues(M.read_lines(df)).collect():
        got[r.name].append((r.line, r.message))
    assert {k: sorted(v) for k, v in got.items()} == {str(i): slow_issues(t) for i, t in enumerate(files)}


def test_parts_of_a_file(spark):
    lines = M.read_lines(spark.createDataFrame([("g", GOOD)], "name string, text string"))
    d = M.documents(lines).first()
    assert (d.title, d.summary, d.details) == ("Site", "One two", ["Some text\nmore", "Last"])
    assert [(r.section, r.title, r.url, r.notes) for r in M.links_of(lines).orderBy("line").collect()] == [("Docs", "A [b]", "https://x/a", "note: here"), ("Docs", "C", "https://x/c", None), ("Optional", "D", "https://x/d", None)]


def test_hostile_text_renders_to_a_conforming_file(spark):
    heads = spark.createDataFrame([("s", "https://s.com/x", "A\n# B", "sum\nmary", ["## no\nheading", "x"], False), ("t", "https://t.com/", " ", None, [], True), ("u", "https://u.com/", "U", None, None, False)], "site string, home_url string, site_name string, summary string, prose array<string>, client_rendered boolean")
    links = spark.createDataFrame([("s", "Do ](x", 0, 0, "https://s.com/a(b) c", "t]i[t\\le\n", "no\nte"), ("s", "", -1, 0, "https://s.com/p", "P", None)], "site string, section string, section_ord int, link_ord int, url string, title string, note string")
    files = {r.site: r.llms_txt for r in M.render(heads, links).collect()}
    assert files["s"] == "# A # B\n\n> sum mary\n\n\\## no\nheading\n\nx\n\n## Do ](x\n\n- [t\\]i\\[t\\\\le](https://s.com/a%28b%29%20c): no te\n\n## Optional\n\n- [P](https://s.com/p)\n"
    assert files["t"].startswith("# t.com\n\n_https://t.com/ returned an application shell") and files["u"].startswith("# U\n\n_No links")
    named = spark.createDataFrame(list(files.items()), "name string, text string")
    assert {r.n_issues for r in M.validate(named).collect()} == {0}


# -- proposals ---------------------------------------------------------------------


def test_replies_and_sieve(spark):
    df = spark.createDataFrame([('Sure: {"summary":"s","notes":{"u":"n"}} ok',), ("no braces",), ("{broken",), ("} {",)], "r string")
    got = [r.p for r in df.select(P.parse_reply(F.col("r")).alias("p")).collect()]
    assert got[0].summary == "s" and got[0].notes == {"u": "n"} and got[1] is None and (got[2] is None or got[2].summary is None) and got[3] is None
    notes = [("Explains how keys rotate. ", "Keys", "Explains how keys rotate"), ("short", "K", None), ("The pricing", "Pricing", None), ("one two three four five six seven eight nine ten eleven twelve thirteen", "K", None), ("see [x](y) for all", "K", None), (None, "K", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in notes], "n string, t string")
    assert [r.x for r in df.select(P.accept_note(F.col("n"), F.col("t")).alias("x")).collect()] == [c for _, _, c in notes]
    names = [("guides and help", "Guides and Help"), ("en", None), ("x", None), ("a [b]", None), ("y" * 41, None)]
    df = spark.createDataFrame([(a,) for a, _ in names], "n string")
    assert [r.x for r in df.select(P.accept_section_name(F.col("n")).alias("x")).collect()] == [b for _, b in names]


def test_renames_in_order_and_notes(spark):
    sections = spark.createDataFrame([("s", "A", 0), ("s", "B", 1), ("s", "C", 2)], "site string, section string, section_ord int")
    asked = spark.createDataFrame([("s", "A", "B"), ("s", "B", "Guides"), ("s", "C", "b")], "site string, section string, name string")
    # B is taken when A asks for it, and free when C does, in title case.
    asked = asked.withColumn("name", F.when(F.col("name").isin("B", "b"), F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    sections = sections.withColumn("section", F.when(F.col("section") == "B", "Bx").otherwise(F.col("section")))
    asked = asked.withColumn("section", F.when(F.col("section") == "B", "Bx").otherwise(F.col("section")))
    got = {r.section: r.new_name for r in P.rename_sections(sections, asked).collect()}
    assert got == {"A": "A", "Bx": "Guides", "C": "Bx"}
    links = spark.createDataFrame([("s", "A", 0, 0, "u", "T", "old"), ("s", "A", 0, 1, "v", "T", "old")], "site string, section string, section_ord int, link_ord int, url string, title string, note string")
    notes = spark.createDataFrame([("s", "u", "Says something quite new", 0), ("s", "u", "Says the last thing here", 1), ("s", "v", "bad", 0), ("s", "made-up", "Says something quite new", 0)], "site string, url string, note string, chunk int")
    assert {r.url: r.note for r in P.apply_notes(links, notes).collect()} == {"u": "Says the last thing here", "v": "old"}
    assert [(r.accepted, r.rejected) for r in P.note_report(links, notes).collect()] == [(2, 2)]


def test_enhance_falls_back_where_nothing_is_let_through(spark):
    heads = spark.createDataFrame([("s", "https://s/", "Site", "old", None, False), ("t", "https://t/", "T", "kept", None, False)], "site string, home_url string, site_name string, summary string, prose array<string>, client_rendered boolean")
    links = spark.createDataFrame([("s", "A", 0, 0, "u", "T", None), ("t", "B", 0, 0, "v", "V", None)], "site string, section string, section_ord int, link_ord int, url string, title string, note string")
    reply = json.dumps({"summary": "A site that explains things at length.", "sections": {"A": "guides"}, "notes": {"u": "Explains how keys rotate", "x": "Explains how keys rotate"}})
    new_heads, new_links = P.enhance(heads, links, spark.createDataFrame([("s", 0, f"Here: {reply}"), ("t", 0, "no idea")], "site string, chunk int, reply string"))
    assert {r.site: r.summary for r in new_heads.collect()} == {"s": "A site that explains things at length.", "t": "kept"}
    assert {r.site: (r.section, r.note) for r in new_links.collect()} == {"s": ("Guides", "Explains how keys rotate"), "t": ("B", None)}


def test_failures(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("5",), ("99",), ("Mon, 01 Jan 2024 00:00:10 GMT",), ("Sun, 31 Dec 2023 00:00:10 GMT",), ("soon",), (None,)], "h string")
    assert [r.x for r in df.select(P.retry_after_ms(F.col("h"), now).alias("x")).collect()] == [5000, 30000, 10000, 0, None, None]


# -- monitoring ------------------------------------------------------------------------


def test_fingerprints_ignore_order_and_notes(spark):
    schema = "site string, url string, title string, note string"
    one = spark.createDataFrame([("s", "u", "T", "n"), ("s", "v", "W", None)], schema)
    two = spark.createDataFrame([("s", "v", "W", "x"), ("s", "u", "T", None)], schema)
    three = spark.createDataFrame([("s", "v", "W", "x"), ("s", "u", "T2", None)], schema)
    heads = spark.createDataFrame([("s", "Site"), ("empty", "E")], "site string, site_name string")
    h = lambda x: {r.site: r.structure_hash for r in N.structure_hash(heads, x).collect()}
    assert h(one) == h(two) and h(one)["s"] != h(three)["s"] and len(h(one)["empty"]) == 32


def digest(*pieces):
    return hashlib.sha256("\n".join(pieces).encode()).hexdigest()[:32]


def test_sitemap_fingerprints_are_of_every_address(spark):
    urls = [f"https://s/é{i}" for i in range(5_050)] + ["https://s/é1"]
    rows = [("s", u) for u in urls] + [("t", "b"), ("t", None), ("t", "a"), ("none", None)]
    got = {r.site: r.sitemap_hash for r in N.sitemap_hash(spark.createDataFrame(rows, "site string, url string").repartition(3)).collect()}
    assert got == {"s": digest(*sorted(urls)), "t": digest("a", "b"), "none": digest("")}


def test_structure_fingerprints_are_of_every_link(spark):
    links = [("s", f"u{i:03}", f"T {i}") for i in range(200)] + [("x", "u", None), ("unknown", "u", "T")]
    heads = spark.createDataFrame([("s", "Site"), ("x", None), ("empty", "E")], "site string, site_name string")
    rows = spark.createDataFrame(links, "site string, url string, title string").repartition(3)
    got = {r.site: r.structure_hash for r in N.structure_hash(heads, rows).collect()}
    assert got == {"s": digest("Site", *(f"u{i:03}\tT {i}" for i in range(200))), "x": digest("", "u"), "empty": digest("E")}


def test_outcomes_of_checks_and_write_back(spark):
    t = lambda n: dt.datetime(2024, 1, 1, n)
    text = "# Pub\n" + "x" * 50
    same = spark.range(1).select(X.hash_content(F.lit(text)).alias("h")).first().h
    stored = [("pub", same, "", None, None, "published"), ("gone", same, "", None, None, "published"), ("map", "c", "S", "M", t(1), "generated"), ("quiet", "c", "S", "M", t(2), "generated"), ("first", "c", "", None, t(3), "generated"), ("c1", "c", "S", None, t(5), "generated"), ("c2", "c", "S", None, None, "generated"), ("c3", "c", "S", None, t(6), "generated"), ("blocked", "c", "S", "M", None, "generated")]
    schema = "url string, content_hash string, structure_hash string, sitemap_hash string, last_checked_at timestamp, source string"
    rows = spark.createDataFrame(stored, schema)
    current = [("pub", None, None, None, text), ("gone", None, None, None, None), ("map", "M", "S9", True, None), ("quiet", "M2", "S", True, None), ("first", "M", "S", True, None), ("c1", "M", "X", True, None), ("c2", "M", "X", True, None), ("c3", "M", "X", True, None), ("blocked", "M2", None, False, None)]
    now = spark.createDataFrame(current, "url string, sitemap_hash string, structure_hash string, usable boolean, published_text string")
    got = {r.url: r for r in N.check(rows, now).collect()}
    assert {u: r.result for u, r in got.items()} == {"pub": "unchanged", "gone": "skipped", "map": "unchanged-sitemap", "quiet": "unchanged", "first": "baseline", "c2": "changed", "c1": "changed", "c3": "deferred", "blocked": "skipped"}
    assert got["c3"].structure_hash == "S" and got["c1"].structure_hash == "X" and got["map"].structure_hash == "S" and got["quiet"].sitemap_hash == "M2"


def test_store(spark, tmp_path):
    store = T.GenerationStore(spark, f"file://{tmp_path}/g")
    now = dt.datetime(2024, 1, 1, 12)
    new = lambda *r: spark.createDataFrame([(*x, now) for x in r], "url string, llms_txt string, structure_hash string, source string, published_at string, now timestamp")
    store.upsert(new(("a", "text", "S", "generated", None), ("b", "other", None, None, None)))
    outcome = spark.createDataFrame([("a", "changed", True, "S2", "M", "text2", now), ("b", "deferred", False, "Z", "Z", None, now)], "url string, result string, changed boolean, structure_hash string, sitemap_hash string, llms_txt string, now timestamp")
    store.record_checks(outcome)
    store.upsert(new(("b", "b2", "S", "published", "p")))
    rows = {r.url: r for r in store.read().collect()}
    assert (rows["a"].llms_txt, rows["a"].structure_hash, rows["a"].sitemap_hash, rows["a"].changed_at) == ("text2", "S2", "M", now)
    assert (rows["b"].llms_txt, rows["b"].source, rows["b"].sitemap_hash) == ("b2", "published", None) and len(store.snapshots()) == 2
    assert T.read_one(store.read(), "a").count() == 1 and T.list_latest(store.read()).columns == T.SUMMARY


def test_budget_and_deadline():
    b = N.RunBudget(2, 45_000, 35_000, started=0)
    assert b.claim(0) and b.claim(0) and not b.claim(0)
    b.release()
    assert b.spent == 1 and not b.claim(10_000) and b.claim(9_999) and not b.expired(45_000) and b.expired(45_001)
    d = N.Deadline(100, started=0)
    assert d.allows(99, 0) and not d.allows(100, 0) and d.limit(500, 60).remaining(60) == 40 and d.expired(100)


def slow_pacer(trace, start=150.0):
    interval, seen, base, out = start, [], 0.0, False

    def widen(f):
        nonlocal interval, out
        if interval >= 2000:
            out = True
        else:
            interval = min(max(interval * f, 100.0), 2000.0)

    for ms, refused in trace:
        seen.append(ms)
        if len(seen) <= 3:
            base = sum(seen) / len(seen)
        elif sorted(seen[-3:])[1] > max(2 * base, 500):
            widen(1.5)
        if refused:
            widen(2)
    return interval, out


def test_pacer(spark):
    rng = random.Random(1)
    traces = {f"s{s}": [(float(rng.choice([100, 300, 900, 2000])), rng.random() < 0.1) for _ in range(rng.randrange(1, 25))] for s in range(40)}
    df = spark.createDataFrame([(s, i, *x) for s, t in traces.items() for i, x in enumerate(t)], "site string, seq int, latency_ms double, refused boolean")
    got = {r.site: (r.interval_ms, r.exhausted) for r in N.pacer_trace(df).collect()}
    assert {s: (pytest.approx(v[0]), v[1]) for s, v in got.items()} == {s: slow_pacer(t) for s, t in traces.items()}


def test_labels_and_events(spark):
    p = spark.range(1).select(R.describe_progress(F.lit("crawling"), F.lit(15), F.lit(30)).alias("a"), R.describe_progress(F.lit("saving"), F.lit(0), F.lit(0)).alias("b"), X.report_label(F.lit(2), F.lit(0), F.lit(1)).alias("c"), X.report_label(F.lit(0), F.lit(0), F.lit(1)).alias("d"), R.render_failure(F.lit("timeout"), F.lit(24600), F.lit(None).cast("string")).alias("e"), R.access_gate(F.lit(True), F.lit(False)).alias("f"), R.adopt_rendered(F.lit(0), F.lit(3)).alias("g")).first()
    assert (p.a.percent, p.a.label) == (45, "Crawling the site - 15 of 30 pages") and p.b.percent == 98 and p.c == "2 notes, 1 chunks failed" and p.d == "the models added nothing"
    assert p.e == "the page did not finish loading within 25s" and p.f == 401 and p.g
    lines = T.to_ndjson(spark.createDataFrame([(2, "b"), (1, "a")], "seq int, stage string"), "seq").collect()
    assert [json.loads(x.value) for x in lines] == [{"stage": "a"}, {"stage": "b"}]
    late = spark.createDataFrame([("<title>Client Challenge</title>", 0), ("<p>Just a moment", 3), ("<p>hello", 0)], "b string, n int")
    assert [r.x.kind if r.x else None for r in late.select(R.classify_empty(F.col("b"), F.col("n")).alias("x")).collect()] == ["bot-challenge", None, None]


def test_stream_checks_each_batch(spark, tmp_path):
    from waymark.streaming.monitor import PAGES, watch

    store = T.GenerationStore(spark, f"file://{tmp_path}/g")
    page = lambda i, t: spark.createDataFrame([(i, f"https://a.com/{i}", f"<title>{t}</title>")], PAGES).coalesce(1)
    source, check = f"file://{tmp_path}/in", f"file://{tmp_path}/c"
    seen = []
    for t in ("One", "One", "Two"):
        page(1, t).write.mode("append").parquet(source)
        watch(spark, source, store, check).awaitTermination(120)
        seen.append(store.read().first())
    assert seen[0].structure_hash == seen[1].structure_hash != seen[2].structure_hash
    assert seen[1].changed_at is None and seen[2].changed_at is not None


def test_stream_knows_a_site_by_all_its_pages(spark, tmp_path):
    """A batch with some of a site's pages changes nothing, nor does a batch that is run again."""
    from waymark.streaming.monitor import PAGES, apply_batch

    store = T.GenerationStore(spark, f"file://{tmp_path}/g")
    pages = lambda *rows: spark.createDataFrame([(i, f"https://a.com/{i}", f"<title>{t}</title>") for i, t in rows], PAGES)
    apply_batch(store, pages((1, "One"), (2, "Two")), 0)
    first = store.read().first()
    apply_batch(store, pages((2, "Two")), 1)
    second = store.read().first()
    assert second.structure_hash == first.structure_hash and second.changed_at is None
    apply_batch(store, pages((2, "New")), 2)
    third = store.read().first()
    assert third.structure_hash != first.structure_hash and third.changed_at is not None
    names = store.snapshots()
    apply_batch(store, pages((2, "New")), 2)
    assert store.snapshots() == names and store.read().first() == third
